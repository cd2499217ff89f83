"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The merge rules of a word-level BPE (lower case, white space dropped, an end mark
on the last symbol of each word) are compiled into a deterministic transducer
over bytes.  Write L(i) for the last token of the encoding of a word's first i
bytes and c(i) for its length.  Then c(i) = c(i - |L(i)|) + 1, and L(i) is the
only token that ends at i and may stand after L(i - |L(i)|), where two tokens may
stand side by side if encoding their text gives just them.  So what the future
needs of the past is a window: for each of the last d places at which some token
may begin, its L and its c relative to c(i), d being the length of the longest end
that some token starts with.  Such windows are the states.  A transition by a byte carries the number
c(i + 1) - c(i); another one, by a byte that ends the word, the number that
completes the word's count, back to the start state.

States are made when first met (a lazy automaton), so only what texts need is
compiled; past a bound the automaton starts anew.

Texts are strung together and cut into chunks of one length, which advance in
step, one table lookup per byte for thousands of chunks.  A chunk's state map is
constant from its first word end on, whatever the state before; what stands
before is unknown at first (the state UNKNOWN).  A chunk that a word goes through
has a map that depends on its entry: it is told for a few entries, first for the
start state, then for whatever states the chunk before may end in.  These maps,
with the counts that they add, are composed by a parallel prefix scan, in
logarithmically many rounds; the bytes before each chunk's first word end are
then run once more from the state that the scan puts before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import bound_batches, held

#: The automaton starts anew beyond this many states: about 1 KB each while
#: counting, 0.5 KB for ids alone.
MAX_STATES, MAX_ID_STATES = 120_000, 240_000
#: Bytes of text that are counted at once, and chunks that advance in step.
BATCH_BYTES, LANES = 1_000_000, 4096

#: Entries that a chunk's map is told for on average, before only the true ones are.
MAPS_PER_CHUNK = 16

START, UNKNOWN = 0, 1
_SHIFT = 1 << 14
_GAP, _OTHER, _LETTER, _NUMBER = 0, 1, 2, 3
#: Unicode white space (fixed values).
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _GAP
    return out


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself if printable in Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class BpeTransducer:
    """``counting``: states also tell counts apart; without, only :meth:`ids` works."""

    def __init__(self, file: str, counting: bool = True, max_states: int | None = None) -> None:
        self.counting = counting
        self.max_states = max_states or (MAX_STATES if counting else MAX_ID_STATES)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: n for n, p in enumerate(pairs)}
        self.symbol = _byte_symbols()
        self.tokens = {t for t in {a + b for a, b in pairs} | {s + m for s in self.symbol for m in ("", self.mark)} if t in self.vocabulary}
        self.own = {t: t for t in self.tokens}  # one string object per token, whoever refers to it
        self.starts = {t[:k] for t in map(self._text, self.tokens) for k in range(1, len(t))}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}
        self._plain: dict[str | None, tuple] = {}
        self._token_sizes: np.ndarray | None = None
        self._reset()

    def _text(self, token: str) -> str:
        return token.removesuffix(self.mark) if self.mark and len(token) > len(self.mark) else token

    def _reset(self) -> None:
        self.width = 64
        self.columns = np.full(256, -1, np.int32)
        self.bytes: list[int] = [-1]  # column 0: a gap
        self.windows: list[tuple] = [("", ((None, 0),)), ("", ())]
        self.number: dict[tuple, int] = {self.windows[START]: START}
        # pages of zeros cost nothing until a state is written: next holds the state + 1,
        # end the count + _SHIFT, 0 meaning that it is not made yet
        self.rows = self.max_states * 2
        self._allocate()
        self.final: dict[tuple[int, int], int] = {}  # (state, column): id of the token that ends a word
        self.last_id: list[int] = [0, 0]  # by state: id of the last token so far
        self.next[[START, UNKNOWN], 0] = START + 1
        self._open_unknown()

    def _allocate(self) -> None:
        self.next = np.zeros((self.rows, self.width), np.int32)
        if self.counting:
            self.emit, self.end = np.zeros((self.rows, self.width), np.int16), np.zeros((self.rows, self.width), np.int16)

    def _open_unknown(self) -> None:
        self.next[UNKNOWN, 1:] = UNKNOWN + 1
        if self.counting:
            self.end[UNKNOWN] = _SHIFT

    def _grow(self, rows: int, width: int) -> None:
        old = [self.next, *([self.emit, self.end] if self.counting else [])]
        n, before = len(self.windows), self.width
        self.rows, self.width = rows, width
        self._allocate()
        for new, table in zip([self.next, *([self.emit, self.end] if self.counting else [])], old):
            new[:n, :before] = table[:n]
        self._open_unknown()

    def encode_symbols(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of the lowest rank first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _symbols(self, token: str) -> list[str]:
        text = self._text(token)
        out = list(text)
        out[-1] += token[len(text) :]
        return out

    def _whole(self, token: str) -> bool:
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.encode_symbols(self._symbols(token)) == [token]
        return known

    def _side_by_side(self, a: str, b: str) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            known = self._pairs[a, b] = self.encode_symbols(self._symbols(a) + self._symbols(b)) == [a, b]
        return known

    def _last(self, window: tuple, symbol: str, mark: str) -> tuple[str, int]:
        """(L, c) after one more symbol, c relative to the window's end."""
        tail, places = window
        text = tail + symbol
        for k in range(len(places) - 1, -1, -1):  # the token starts k places back
            token = self.own.get(text[len(text) - k - 1 :] + mark)
            if token is not None:
                before, count = places[len(places) - 1 - k]
                if self._whole(token) if before is None else self._side_by_side(before, token):
                    return token, count + 1
        raise ValueError(f"no token ends at {text!r}")

    def _make_next(self, state: int, column: int) -> None:
        window, symbol = self.windows[state], self.symbol[self.bytes[column]]
        token, count = self._last(window, symbol, "")
        tail, places = window
        text = tail + symbol
        keep = len(text)
        while keep and text[len(text) - keep :] not in self.starts:
            keep -= 1
        moved = (*places, (token, count))[-keep - 1 :]
        # a place matters while some token may begin there
        new = (text[len(text) - keep :], tuple(p and (p[0], p[1] - count) if k == len(moved) - 1 or text[len(text) - len(moved) + 1 + k :] in self.starts else None for k, p in enumerate(moved)))
        if not self.counting:
            new = (new[0], tuple(p and self._plain.setdefault(p[0], (p[0], 0)) for p in new[1]))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.windows)
            self.windows.append(new)
            self.last_id.append(self.vocabulary[token])
            if to >= self.rows:
                self._grow(2 * self.rows, self.width)
            self.next[to, 0] = START + 1
        self.next[state, column] = to + 1
        if self.counting:
            self.emit[state, column] = count

    def _make_end(self, state: int, column: int) -> None:
        token, count = self._last(self.windows[state], self.symbol[self.bytes[column]], self.mark)
        if self.counting:
            self.end[state, column] = count + _SHIFT
        self.final[state, column] = self.vocabulary[token]

    def _column_of(self, values: np.ndarray) -> np.ndarray:
        for b in np.unique(values[self.columns[values] < 0]).tolist():
            self.columns[b] = len(self.bytes)
            self.bytes.append(b)
        if len(self.bytes) > self.width:
            self._grow(self.rows, len(self.bytes) + 4)
        return self.columns[values]

    def _advance(self, state: np.ndarray, acc: np.ndarray, inner: np.ndarray, last: np.ndarray, ends: list[np.ndarray], out: np.ndarray) -> None:
        """Run lanes over the rows of ``inner`` (columns; 0 for gaps and word ends);
        ``ends``: lanes whose word ends at a row, ``last``: their columns there.
        Counts of ended words go to ``out``."""
        for t in range(len(inner)):
            if len(lanes := ends[t]):
                q, c = state[lanes], last[t, lanes]
                count = self.end[q, c]
                if (miss := count == 0).any():
                    for s, x in {*zip(q[miss].tolist(), c[miss].tolist())}:
                        self._make_end(s, x)
                    count = self.end[q, c]
                out[t, lanes] = acc[lanes] + count - _SHIFT
            at = state * self.width + inner[t]
            to = self.next.ravel()[at]
            if len(to) and not to.all():
                miss = to == 0
                for s, x in {*zip(state[miss].tolist(), inner[t][miss].tolist())}:
                    self._make_next(s, x)
                at = state * self.width + inner[t]
                to = self.next.ravel()[at]
            to -= 1
            acc += self.emit.ravel()[at]
            if len(lanes):
                acc[lanes] = 0
            state[:] = to

    def _word_ends(self, data: bytes, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For bytes of normal text that end in a gap: (in a word, ends a word)."""
        kind = _char_classes()[chars]
        begins = np.empty(len(chars), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quotes = np.flatnonzero((chars == ord("'")) & begins)
        for q in quotes.tolist():
            tail = chars[q + 1 : q + 3]
            two = chr(tail[0]) + (chr(tail[1]) if len(tail) > 1 else "") if len(tail) else ""
            n = 1 if two[:1] in ("s", "t", "m", "d") and two else 2 if two in ("re", "ve", "ll") else 0
            if n:
                begins[q + 1 : q + 1 + n] = False
                if q + 1 + n < len(chars):
                    begins[q + 1 + n] = True
        inside = kind != _GAP
        ends = inside.copy()
        ends[:-1] &= begins[1:] | ~inside[1:]
        if len(data) == len(chars):
            return inside, ends
        width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        last = np.cumsum(width, dtype=np.int64) - 1
        at = np.zeros(len(data), bool)
        at[last[ends]] = True
        return np.repeat(inside, width), at

    def normal(self, text: str) -> tuple[str, int]:
        """(normal form with special strings blanked out, their number)."""
        special = 0
        if any(s in text for s in self.special):
            text, special = re.subn("|".join(map(re.escape, self.special)), " ", text)  # a cut
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing is by character
        return text.lower(), special

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        pairs = [self.normal(t or "") for t in texts]
        out, at = [], 0
        while at < len(pairs):
            upto, n = at, 0
            while upto < len(pairs) and (upto == at or n < BATCH_BYTES):
                n += len(pairs[upto][0])
                upto += 1
            out += self._count_normal([p[0] for p in pairs[at:upto]])
            at = upto
        return [n + s for n, (_, s) in zip(out, pairs)]

    def _count_normal(self, texts: list[str]) -> list[int]:
        self._fresh()
        sizes = [len(t) + 1 if t.isascii() else len(t.encode()) + 1 for t in texts]
        joined = "\n".join(texts) + "\n"
        data = joined.encode()
        chars = np.frombuffer(data, np.uint8).astype(np.uint32) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside, ends = self._word_ends(data, chars)
        flat = self._run(data, inside, ends, self._advance, mid_end=False)
        begin = np.cumsum([0, *sizes[:-1]])
        return np.add.reduceat(flat, begin).tolist() if sizes else []

    def _fresh(self) -> None:
        if len(self.windows) > self.max_states:
            self._reset()

    def _run(self, data: bytes, inside: np.ndarray, ends: np.ndarray, advance, mid_end: bool) -> np.ndarray:
        """What ``advance`` tells of each byte.  ``mid_end``: the byte that ends a
        word makes an ordinary transition, too."""
        columns = np.where(inside, self._column_of(np.frombuffer(data, np.uint8)), 0)
        lanes = max(1, min(LANES, len(data) // 64))
        steps = -(-len(data) // lanes)

        def laid(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(np.pad(x, (0, lanes * steps - len(x))).reshape(lanes, steps).T)

        last, stop, full = laid(columns), laid(ends), laid(inside)
        inner = last if mid_end else np.where(stop, 0, last)
        told = np.zeros((steps, lanes), np.int32)
        synced = stop | ~full  # after such a byte the state is START
        closed = synced.any(axis=0)
        first = np.arange(lanes) * steps
        midway = np.zeros(lanes, bool)  # lanes that begin inside a word
        valid = (first > 0) & (first < len(data))
        midway[valid] = inside[first[valid]] & ~ends[first[valid] - 1] & inside[first[valid] - 1]
        state = np.where(midway, UNKNOWN, START).astype(np.int64)
        acc = np.zeros(lanes, np.int64)

        def by_row(mask: np.ndarray) -> list[np.ndarray]:
            row, lane = np.nonzero(mask)
            return np.split(lane, np.searchsorted(row, np.arange(1, mask.shape[0])))

        advance(state, acc, inner, last, by_row(stop), told)
        head = np.where(closed, synced.argmax(axis=0) + 1, steps)
        entry, so_far = np.roll(state, 1), np.roll(acc, 1)  # what the chunk before ends in
        through = midway & ~closed
        if through.any():
            self._scan(advance, inner, last, through, entry, so_far)
        ready = np.flatnonzero(midway)
        if len(ready):
            depth = int(head[ready].max())
            rows = np.arange(depth)[:, None] < head[ready]
            part = np.zeros((depth, len(ready)), np.int32)
            advance(entry[ready], so_far[ready], np.where(rows, inner[:depth, ready], 0), last[:depth, ready], by_row(stop[:depth, ready] & rows), part)
            told[:depth, ready] = np.where(rows, part, told[:depth, ready])
        return told.T.ravel()[: len(data)]

    def _scan(self, advance, inner: np.ndarray, last: np.ndarray, through: np.ndarray, entry: np.ndarray, so_far: np.ndarray) -> None:
        """Put into ``entry`` and ``so_far`` the state and count after each chunk that a
        word goes ``through``, at the place of the chunk that follows."""
        chunks = np.flatnonzero(through)
        first = ~through[chunks - 1]  # of a run of such chunks; its entry is known
        n_chunks, steps = len(chunks), len(inner)
        number = [{int(entry[k]) if f else START: 0} for k, f in zip(chunks, first)]  # of each entry that a map is told for
        exits: list[list[int]] = [[] for _ in chunks]
        added: list[list[int]] = [[] for _ in chunks]
        todo, spent = [(n, s) for n, known in enumerate(number) for s in known], 0

        def lacking() -> list[tuple[int, int]]:
            """Entries that maps are to be told for next: all exits of the chunk before or,
            where chunks do not forget their entries, those on the true path alone."""
            out = []
            if spent <= MAPS_PER_CHUNK * n_chunks:
                out = [(n, x) for n in range(1, n_chunks) if not first[n] for x in dict.fromkeys(exits[n - 1]) if x not in number[n]]
            else:
                for n in np.flatnonzero(first).tolist():
                    at = 0
                    while n + 1 < n_chunks and not first[n + 1]:
                        x, n = exits[n][at], n + 1
                        if x not in number[n]:
                            out.append((n, x))
                            break
                        at = number[n][x]
            for n, x in out:
                number[n][x] = len(number[n])
            return out

        while todo:
            spent += len(todo)
            lanes = chunks[[n for n, _ in todo]]
            state, count = np.array([s for _, s in todo], np.int64), np.zeros(len(todo), np.int64)
            advance(state, count, inner[:, lanes], last[:, lanes], [lanes[:0]] * steps, np.zeros((steps, len(todo)), np.int32))
            for (n, _), x, c in zip(todo, state.tolist(), count.tolist()):
                exits[n].append(x)
                added[n].append(c)
            todo = lacking()
        width = max(map(len, number))
        to, add = np.zeros((n_chunks, width), np.int64), np.zeros((n_chunks, width), np.int64)
        for n in range(n_chunks):
            add[n, : len(added[n])] = added[n]
            if n + 1 < n_chunks and not first[n + 1]:
                to[n, : len(exits[n])] = [number[n + 1].get(x, 0) for x in exits[n]]
        run, maps, sums, reach = np.cumsum(first), to.copy(), add.copy(), 1
        while reach < n_chunks:  # the maps of 1, 2, 4, ... chunks up to each one
            same = (run[reach:] == run[:-reach])[:, None]
            more = sums[:-reach] + np.take_along_axis(sums[reach:], maps[:-reach], 1)
            joined = np.take_along_axis(maps[reach:], maps[:-reach], 1)
            sums[reach:] = np.where(same, more, sums[reach:])
            maps[reach:] = np.where(same, joined, maps[reach:])
            reach *= 2
        before = np.where(first, 0, np.roll(maps[:, 0], 1))  # number of each chunk's true entry
        base = so_far[chunks[first]][run - 1]
        after = chunks + 1
        there = after < len(entry)
        entry[after[there]] = np.array([exits[n][at] for n, at in enumerate(before.tolist())], np.int64)[there]
        so_far[after[there]] = (base + sums[:, 0])[there]

    def _tell_ids(self, state: np.ndarray, acc: np.ndarray, inner: np.ndarray, last: np.ndarray, ends: list[np.ndarray], out: np.ndarray) -> None:
        """As :meth:`_advance`; tells the state after each byte instead of counts and,
        where an end mark belongs to a word's last byte, -1 - the id of the last token."""
        for t in range(len(inner)):
            lanes = ends[t]
            if len(lanes) and self.mark:
                out_ids = [self._final_id(s, x) for s, x in zip(state[lanes].tolist(), last[t, lanes].tolist())]
            at = state * self.width + inner[t]
            to = self.next.ravel()[at]
            if len(to) and not to.all():
                miss = to == 0
                for s, x in {*zip(state[miss].tolist(), inner[t][miss].tolist())}:
                    self._make_next(s, x)
                to = self.next.ravel()[state * self.width + inner[t]]
            to -= 1
            out[t] = to
            if len(lanes):
                if self.mark:
                    out[t, lanes] = out_ids
                to[lanes] = START
            state[:] = to

    def _final_id(self, state: int, column: int) -> int:
        if state == UNKNOWN:
            return 0
        if (state, column) not in self.final:
            self._make_end(state, column)
        return -1 - self.final[state, column]

    def _pieces(self, text: str) -> list[str]:
        """Texts and special strings in turn, as the library cuts them."""
        if not any(s in text for s in self.special):
            return [text] if text else []
        return [p for p in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if p]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32, for byte-level vocabularies
        without an end mark, whose words are split by the usual pattern."""
        pieces = [self._pieces(t or "") for t in texts]
        flat = [p for doc in pieces for p in doc if p not in self.special]
        found, at = [], 0
        while at < len(flat):
            upto, n = at, 0
            while upto < len(flat) and (upto == at or n < BATCH_BYTES):
                n += len(flat[upto])
                upto += 1
            found += self._byte_level_ids(flat[at:upto])
            at = upto
        turn = iter(found)
        return [b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else next(turn) for p in doc) for doc in pieces]

    def _byte_level_ids(self, texts: list[str]) -> list[bytes]:
        self._fresh()
        joined = "".join(texts)
        data = joined.encode()
        chars = np.frombuffer(data, np.uint8).astype(np.uint32) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        begins = _byte_level_words(chars, starts)
        ends = np.append(begins[1:], True)
        bounds = np.append(starts, len(chars))
        if len(data) != len(chars):
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
            upto = np.cumsum(width, dtype=np.int64)
            at = np.zeros(len(data), bool)
            at[upto[ends] - 1] = True
            ends, bounds = at, np.append(0, upto)[bounds]
        state = self._run(data, np.ones(len(data), bool), ends, self._tell_ids, mid_end=True)
        ids = np.array(self.last_id, np.int32)[state]
        size = self._sizes()[ids]
        # walk back from each word's end, token by token
        is_end = np.zeros(len(data), bool)
        begin = np.zeros(len(data) + 1, bool)
        begin[1:] = ends
        begin[0] = True
        place = np.flatnonzero(ends)
        while len(place):
            is_end[place] = True
            before = place - size[place]
            place = before[~begin[before + 1]]
        chosen = ids[is_end].astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(is_end)])[bounds]
        raw = chosen.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _sizes(self) -> np.ndarray:
        """Bytes of each token, by id."""
        if self._token_sizes is None:
            self._token_sizes = np.zeros(max(self.vocabulary.values()) + 1, np.int16)
            for token in self.tokens:
                self._token_sizes[self.vocabulary[token]] = len(self._text(token))
        return self._token_sizes


def _byte_level_words(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pattern begin; texts begin at ``starts``.

    Runs of letters, of numbers and of others are words, with a space before them
    if there is one; of other white space the last character before a word stands
    alone; white space at the end of a text is one word."""
    kind = _char_classes()[chars]
    begins = np.empty(len(chars), bool)
    begins[0] = True
    begins[1:] = kind[1:] != kind[:-1]
    begins[starts] = True
    text_start = np.zeros(len(chars) + 1, bool)
    text_start[starts] = True
    after = np.flatnonzero(begins[1:] & (kind[:-1] == _GAP) & (kind[1:] != _GAP) & ~text_start[1:-1]) + 1  # words after white space
    begins[after - 1] = True
    spaced = after[chars[after - 1] == 0x20]
    begins[spaced] = False
    quotes = np.flatnonzero((chars == 0x27) & begins)
    limit = np.append(np.flatnonzero(text_start[:-1]), len(chars))
    for q in quotes.tolist():
        stop = int(limit[np.searchsorted(limit, q, side="right")])
        tail = "".join(map(chr, chars[q + 1 : min(q + 3, stop)].tolist()))
        n = 1 if tail[:1] and tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if n:
            begins[q + 1 : q + 1 + n] = False
            if q + 1 + n < stop:
                begins[q + 1 + n] = begins[q + 1 + n] or kind[q + 1 + n] == _LETTER
    return begins


def transducer(file: str, counting: bool = True, max_states: int | None = None) -> BpeTransducer:
    return held(("transducer", file, counting, max_states), lambda: BpeTransducer(file, counting, max_states))


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens``.

    Counts are those of the library for whole texts, without added special
    tokens; special strings inside a text count one each.  Null and empty texts
    have none.  Rows are counted one by one: nothing is shuffled, repeated rows
    give repeated results, and an empty table an empty one.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts = machine.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return light.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
