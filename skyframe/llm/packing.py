"""Sum-of-squares packing of token ids into windows of a fixed length.

Each task packs the documents of its own partition, in order, so nothing is
shuffled and more machines pack more.  A document gives full windows and a
remainder; the remainder of s ids goes whole to the fill level h (or to a new
window) for which the sum over levels 1..W-1 of N(level)^2 grows least, N being
the array of counts of open windows by level: that keeps all levels in supply, so
that windows close exactly.

Open windows are bounded by ``max_open``: beyond it, and at the end of a
partition, their contents are poured together and cut freely into full windows;
what then remains is cut into lengths that are powers of two, which need no
padding.  So no task pads at all, and a task holds ``max_open`` x W ids at most
besides one batch of texts.

Ids are those of the tokenizers library for a byte-level BPE file, made by the
compiled transducer of :mod:`token_fst`, which is several times faster.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_fst import transducer
from .tokens import library
from .worker import bound_batches

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: (doc_id, start, ids as little-endian uint32 bytes, ids of the whole document)
Piece = tuple[int | None, int, bytes, int]


class SumOfSquaresPacker:
    """Online packer; closed windows are lists of pieces."""

    def __init__(self, size: int, max_open: int = 256) -> None:
        self.size, self.max_open = size, max_open
        self.counts = np.zeros(size + 1, np.int64)  # by fill level; 0 and size stay 0
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.closed: list[list[Piece]] = []

    def level_for(self, s: int) -> int:
        """The level whose window takes s ids; 0: a new one.  Of equal growths the
        fullest level wins."""
        n = self.counts
        after = n[s : self.size + 1]  # N(h + s) for h = 0 .. size - s
        growth = 2 * (after - n[: self.size - s + 1]) + 2
        growth[-1] = 1 - 2 * n[self.size - s]  # it closes the window
        growth[1:][n[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * n[s] + 1
        return int(len(growth) - 1 - np.argmin(growth[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.closed.append([(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        s = total - at
        if not s:
            return
        piece = (doc_id, at, ids[4 * at :], total)
        level = self.level_for(s)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + s == self.size:
            self.closed.append(window)
            return
        self.open.setdefault(level + s, []).append(window)
        self.counts[level + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.pour(last=False)

    def pour(self, last: bool) -> None:
        """Cut the contents of all open windows into full ones.  The rest becomes
        one open window again or, at the end, sequences of powers of two."""
        flow = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        total = sum(len(p[2]) for p in flow) // 4
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        lengths = [self.size] * (total // self.size)
        rest = total % self.size
        if last:
            lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        elif rest:
            lengths.append(rest)
        windows = _cut(flow, lengths)
        if not last and rest:
            self.open[rest] = [windows.pop()]
            self.counts[rest], self.n_open = 1, 1
        self.closed += windows

    def take(self) -> list[list[Piece]]:
        out, self.closed = self.closed, []
        return out


def _cut(flow: list[Piece], lengths: list[int]) -> list[list[Piece]]:
    """Deal the pieces, in order, into windows of these lengths."""
    windows, k, used = [], 0, 0
    for length in lengths:
        window: list[Piece] = []
        while length:
            doc_id, start, ids, total = flow[k]
            n = min(length, len(ids) // 4 - used)
            window.append((doc_id, start + used, ids[4 * used : 4 * (used + n)], total))
            used, length = used + n, length - n
            if 4 * used == len(ids):
                k, used = k + 1, 0
        windows.append(window)
    return windows


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 1,
    size: int = 2048,
    max_open: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    max_states: int | None = None,
    compiled: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (little-endian uint32; null unless ``with_ids``).

    A null or empty text is its end id alone.  Repeated rows are packed each; a
    null id stays null.  An empty table gives no pieces.  A sequence's number is
    the partition's in the upper bits and a counter in the lower 40, so a task
    that is run again gives the same.  Ids are made by the compiled transducer, whose
    memory ``max_states`` bounds (about 0.8 KB a state; fewer only cost time), or,
    unless ``compiled``, by the tokenizer library, which needs less memory.  The ids
    are the same.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquaresPacker(size, max_open)
        encoder = transducer(tokenizer_file, False, max_states) if compiled else library(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(8)]
            for window in windows:
                offset = 0
                for doc_id, start, ids, total in window:
                    n = len(ids) // 4
                    for column, value in zip(out, (doc_id, start, n, crc32(ids), total, number, offset, ids if with_ids else None)):
                        column.append(value)
                    offset += n
                number += 1
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
                if packer.closed:
                    yield rows(packer.take())
        packer.pour(last=True)
        if packer.closed:
            yield rows(packer.take())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECES)
