"""WARC files and their Merkle fixity audit.

Pages are written as WARC records, each a gzip member of its own, into files of
bounded size; the manifest holds each record's file, place, offset and length.

The audit reads each replica by the manifest's ordered offset ranges and hashes
every record together with its range.  Leaves are keyed by (file number, place)
in one 64-bit key; 64 neighbours make a node, whose hash covers their keys and
hashes, and so on up to the root.  Replicas are compared from the root down: only
children of nodes that differ are looked at, so an intact replica costs one
comparison and a damaged record one path.  Grouping is by key ranges of 64, so
no group is larger, whatever the data.

Files are written under a temporary name and renamed, and their contents depend
on the rows alone, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .worker import bound_batches

#: Children of a node: 2**_FAN_BITS.  A file holds 2**_PLACE_BITS records at most, a
#: partition writes 2**_FILE_BITS files at most.
_FAN_BITS, _PLACE_BITS, _FILE_BITS = 6, 18, 12
#: Tasks that read files, at most; each reads its files one after the other.
MAX_TASKS = 20_000
_MANIFEST = "key long, file string, place long, page_id long, offset long, length long, sha256 binary"


def record_bytes(page_id: int | None, url: str | None, html: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 resource record; null values count as empty."""
    body = (html or "").encode("utf-8", "replace")
    target = " ".join((url or "").split())
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    return headers, rest[: int(headers["Content-Length"])]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    fs.move(temporary, path)


def write_warc(pages: DataFrame, root: str, max_bytes: int = 32 << 20, max_records: int = 1 << 16, level: int = 5, columns: tuple[str, str, str] = ("page_id", "url", "html")) -> DataFrame:
    """Write one or more ``.warc.gz`` files per partition below ``root`` (a URI that
    executors share) as the returned manifest is read; write that down once.

    Columns: key, file, place, page_id, offset, length, sha256 (of the stored
    bytes).  An empty table writes nothing; repeated rows and null ids are records
    like others; a record is as long as its page, and one at least is put into a file.
    """

    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        part, number, held, rows = TaskContext.get().partitionId(), 0, bytearray(), []

        def close() -> pa.RecordBatch:
            nonlocal number
            if number >> _FILE_BITS:
                raise ValueError(f"more than {1 << _FILE_BITS} files in one partition: read the pages in more partitions or write larger files")
            name, file = f"part-{part:06d}-{number:04d}.warc.gz", part << _FILE_BITS | number
            _put(fs, f"{base}/{name}", bytes(held))
            out = [[file << _PLACE_BITS | r[0] for r in rows], [name] * len(rows), *map(list, zip(*rows))]
            number += 1
            held.clear(), rows.clear()
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "file", "place", "page_id", "offset", "length", "sha256"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                stored = gzip.compress(record_bytes(page_id, url, html), compresslevel=level, mtime=0)
                rows.append((len(rows), page_id, len(held), len(stored), hashlib.sha256(stored).digest()))
                held += stored
                if len(held) >= max_bytes or len(rows) >= max_records:
                    yield close()
        if rows:
            yield close()

    page_id, url, html = columns
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, _MANIFEST)


def _by_file(manifest: DataFrame) -> DataFrame:
    """A file's rows in order in one task; as many tasks as files (up to MAX_TASKS), since
    rows are tiny but what they point at is not."""
    files = manifest.select("file").distinct().count()
    return manifest.repartition(min(max(1, files), MAX_TASKS), "file").sortWithinPartitions("file", "place")


class _Ranges:
    """Reads byte ranges of one file after the other; what is not there is empty."""

    def __init__(self, root: str) -> None:
        self.fs, self.base = _open(root)
        self.name, self.stream = None, None

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file != self.name:
            self.close()
            self.name = file
            info = self.fs.get_file_info(f"{self.base}/{file}")
            self.stream = self.fs.open_input_file(f"{self.base}/{file}") if info.type == pafs.FileType.File else None
        if self.stream is None or offset >= self.stream.size():
            return b""
        return self.stream.read_at(min(length, self.stream.size() - offset), offset)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """``page_id, url, html`` as read back from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = _Ranges(root)
        for batch in batches:
            parsed = [parse_record(gzip.decompress(ranges.read(f, o, n))) for f, o, n in zip(batch["file"], batch["offset"], batch["length"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": [h["WARC-Target-URI"] for h, _ in parsed], "html": [b.decode() for _, b in parsed]})
        ranges.close()

    return _by_file(manifest).mapInPandas(run, "page_id long, url string, html string")


def copy_replica(manifest: DataFrame, root: str, target: str, damaged: F.Column) -> DataFrame:
    """Copy the files below ``root`` to ``target`` as the result (``file, n_damaged``)
    is read, flipping the middle byte of each record for which ``damaged`` holds.
    One file, of bounded size, is held at a time."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (fs, base), (to_fs, to) = _open(root), _open(target)
        to_fs.create_dir(to, recursive=True)
        with fs.open_input_file(f"{base}/{key[0]}") as f:
            data = bytearray(f.read())
        hit = rows[rows["damaged"]]
        for offset, length in zip(hit["offset"], hit["length"]):
            data[offset + length // 2] ^= 0xFF
        _put(to_fs, f"{to}/{key[0]}", bytes(data))
        return pd.DataFrame({"file": [key[0]], "n_damaged": [len(hit)]})

    return manifest.select("file", "offset", "length", F.coalesce(damaged, F.lit(False)).alias("damaged")).groupBy("file").applyInPandas(run, "file string, n_damaged long")


def leaves(manifest: DataFrame, root: str) -> DataFrame:
    """``key, hash, sha256``: the leaf hash covers the range and the bytes found there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = _Ranges(root)
        for batch in batches:
            hashes, plain = [], []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"]):
                data = ranges.read(file, offset, length)
                plain.append(hashlib.sha256(data).digest())
                hashes.append(hashlib.sha256(b"\0" + offset.to_bytes(8, "big") + length.to_bytes(8, "big") + plain[-1]).digest())
            yield pd.DataFrame({"key": batch["key"], "hash": hashes, "sha256": plain})
        ranges.close()

    return _by_file(manifest.select("key", "file", "place", "offset", "length")).mapInPandas(run, "key long, hash binary, sha256 binary")


def tree(leaf: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels of ``key, hash`` from the leaves up to a single root (key 0)."""
    levels = [leaf.select("key", "hash")]
    top = leaf.agg(F.max("key")).first()[0]
    while top:
        below = levels[-1]
        kids = F.sort_array(F.collect_list(F.struct("key", "hash")))  # 2**_FAN_BITS at most
        node = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k.key.cast("string"), F.hex(k.hash))), "|")
        up = below.groupBy(F.shiftright("key", _FAN_BITS).alias("key")).agg(F.unhex(F.sha2(F.encode(F.concat(F.lit("node|"), node), "utf-8"), 256)).alias("hash"))
        levels.append(scratch.save(up, f"{name}-{len(levels)}"))
        top >>= _FAN_BITS
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Keys of differing leaves, found from the roots down."""
    suspects: DataFrame | None = None
    for level in range(len(a) - 1, -1, -1):
        left, right = a[level], b[level].withColumnRenamed("hash", "other")
        if suspects is not None:
            parents = suspects.withColumnRenamed("key", "parent")
            left = left.withColumn("parent", F.shiftright("key", _FAN_BITS)).join(parents, "parent", "left_semi").drop("parent")
            right = right.withColumn("parent", F.shiftright("key", _FAN_BITS)).join(parents, "parent", "left_semi").drop("parent")
        bad = left.join(right, "key", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("key")
        suspects = scratch.save(bad, f"differ-{level}")
        if not suspects.take(1):
            break
    return suspects


def audit(manifest: DataFrame, roots: tuple[str, str], scratch: Scratch) -> DataFrame:
    """``manifest`` with ``intact_a, intact_b``: whether each replica holds the
    record as it was written.  Records whose branches agree in both trees are
    intact in both if the first replica's root was; damage shared by both replicas
    is told by the manifest's own digest.  An empty manifest gives no rows."""
    first = scratch.save(leaves(manifest, roots[0]), "leaves-a")
    second = scratch.save(leaves(manifest, roots[1]), "leaves-b")
    suspects = differing(tree(first, scratch, "tree-a"), tree(second, scratch, "tree-b"), scratch)
    suspects = suspects.select("key", F.lit(True).alias("differs"))
    own = first.select("key", F.col("sha256").alias("sha_a"))
    damaged = second.join(suspects.select("key"), "key", "left_semi").select("key", F.col("sha256").alias("sha_b"))
    out = manifest.join(own, "key").join(damaged, "key", "left").withColumn("intact_a", F.col("sha256") == F.col("sha_a"))
    return out.withColumn("intact_b", F.coalesce(F.col("sha256") == F.col("sha_b"), F.col("intact_a"))).drop("sha_a", "sha_b")
