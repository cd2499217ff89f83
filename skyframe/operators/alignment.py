"""Which log belongs to a recording, and when the recording began."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_stamp_us
from .intervals import Intervals

_US = 1_000_000


def report_paths(videos: DataFrame, sibling: str) -> DataFrame:
    """``video, priority, path``: where a recording's sync report may lie, the project
    of its folder first, then that of a sibling project."""
    folder = F.regexp_replace("video", r"/[^/]*$", "")
    project = F.regexp_replace(folder, r"/[^/]*$", "")
    stem = F.regexp_replace(F.regexp_extract("video", r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    name = F.concat(F.lit("/diagnostics/epoch_sync_"), stem, F.lit(".json"))
    beside = F.concat(F.regexp_replace(project, r"/[^/]*$", ""), F.lit(f"/{sibling}"))
    return videos.select("video", F.posexplode(F.array(F.concat(project, name), F.concat(beside, name))).alias("priority", "path"))


def resolve_starts(videos: DataFrame, reports: DataFrame, offset_hours: float = 3.0, strict: bool = True) -> DataFrame:
    """``videos`` (``video``, a path) with ``start_us`` and ``start_source``: a cached
    report's start, else the time stamp in the file name; with neither an error, or
    null unless ``strict``."""
    stamp = file_stamp_us(F.col("video"), offset_hours)
    out = videos.join(reports.select(F.col("video").alias("_v"), F.col("start_us").alias("_cached")), F.col("video") == F.col("_v"), "left")
    found = F.coalesce("_cached", stamp)
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no start time for "), "video")).cast("bigint"))
    source = F.when(F.col("_cached").isNotNull(), "cached_epoch_sync").when(stamp.isNotNull(), "filename_timestamp")
    return out.select(*videos.columns, found.alias("start_us"), source.alias("start_source"))


#: Logs that a task may hold (some 400 bytes each).
FEW_LOGS = 100_000
#: Videos that are dealt together to one piece of many logs.
_SLICE = 2_000_000
_CHOSEN = ("log_file", "folder", "log_start_us", "log_end_us", "overlap_sec")


def choose_logs(videos: DataFrame, logs: DataFrame, few_logs: int = FEW_LOGS) -> DataFrame:
    """Per video (``video, start_us, duration_sec`` or null) the log of the greatest
    key: overlap at all, seconds of overlap, holding the start, nearness of its
    start, nearness of either end; of equal ones the first by ``ord``.  Videos
    without a start have no row, of repeated ones the earliest start counts; logs
    have a start, an end and an ``ord`` each.

    With few logs (a count decides) each task holds their times and searches them
    (:class:`Intervals`), in the same time however many overlap a video.  Beyond that
    logs are dealt to pieces of so many; each piece chooses for each video, and the
    best of these is taken.  Both ways choose the same log.
    """
    end = F.col("start_us") + F.bround(F.col("duration_sec") * _US).cast("bigint")
    asked = videos.where("start_us is not null").groupBy("video").agg(F.min(F.struct("start_us", end.alias("_end"))).alias("v"))
    asked = asked.select("video", "v.start_us", F.coalesce("v._end", "v.start_us").alias("_end"))
    count = logs.count()
    found = _choose_in_memory(asked, logs) if count <= few_logs else _choose_in_pieces(asked, logs, max(2, -(-count // FEW_LOGS)))
    names = logs.select(F.col("ord").alias("_ord"), "log_file", "folder", F.col("log_start_us"), F.col("end_us").alias("log_end_us"))
    return found.join(names, "_ord").select("video", *[(F.col("_us") / F.lit(_US)).alias(c) if c == "overlap_sec" else c for c in _CHOSEN])


def require_logs(logs: DataFrame) -> DataFrame:
    """``logs``; raises LookupError where there is none to choose from."""
    if not logs.take(1):
        raise LookupError("no log with a folder, a start and an end")
    return logs


def _choose_in_memory(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """``video, _ord, _us``.  The logs' times go along with the code."""
    rows = [(r["log_start_us"], r["end_us"], r["ord"]) for r in logs.select("ord", "log_start_us", "end_us").toLocalIterator()]
    held = tuple(np.array([r[c] for r in rows], np.int64) for c in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Intervals(*held) if len(held[0]) else None
        for batch in batches:
            if index is None:
                continue
            place, us = index.choose(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.ord[place]), pa.array(us)], ["video", "_ord", "_us"])

    kind = asked.schema["video"].dataType.simpleString()
    return asked.mapInArrow(run, f"video {kind}, _ord long, _us long")


def _choose_in_pieces(asked: DataFrame, logs: DataFrame, pieces: int) -> DataFrame:
    """``video, _ord, _us``.  Each video meets each piece of the logs once; a task
    reads a piece, then the videos of a slice."""
    slices = -(-asked.count() // _SLICE) or 1
    kind = asked.schema["video"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = logs.select(F.pmod(F.xxhash64("ord"), F.lit(pieces)).cast("int").alias("_piece"), every(slices).alias("_slice"), F.lit(None).cast(kind).alias("video"), F.col("log_start_us").cast("long").alias("_from"), F.col("end_us").cast("long").alias("_to"), F.col("ord").cast("long").alias("_ord"))
    probes = asked.select(every(pieces).alias("_piece"), F.pmod(F.xxhash64("video"), F.lit(slices)).cast("int").alias("_slice"), "video", F.col("start_us").alias("_from"), F.col("_end").alias("_to"), F.lit(None).cast("long").alias("_ord"))
    dealt = held.unionByName(probes).repartition("_piece", "_slice").sortWithinPartitions("_piece", "_slice", F.col("_ord").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            piece, slice_, ord_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 5))
            is_log = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(piece) != 0) | (np.diff(slice_) != 0) | (np.diff(is_log.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)]):
                if a == b:
                    continue
                if (key := (piece[a], slice_[a])) != now:
                    now, rows, index = key, [], None
                start, end = (batch.column(k).slice(a, b - a).to_numpy() for k in (3, 4))
                if is_log[a]:
                    rows.append((start, end, ord_[a:b].astype(np.int64)))
                    continue
                if rows and index is None:
                    index = Intervals(*(np.concatenate(c) for c in zip(*rows)))
                if index is None:
                    continue
                place, us = index.choose(start, end)
                first, last = index.a[place], index.z[place]
                away = np.abs(first - start)
                columns = [-us, ~((first <= start) & (start <= last)), away, np.minimum(away, np.abs(last - start)), index.ord[place]]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), *map(pa.array, columns)], ["video", "less", "misses", "away", "edge", "_ord"])

    best = dealt.mapInArrow(run, f"video {kind}, less long, misses boolean, away long, edge long, _ord long")
    best = best.groupBy("video").agg(F.min(F.struct("less", "misses", "away", "edge", "_ord")).alias("b"))
    return best.select("video", "b._ord", (-F.col("b.less")).alias("_us"))


def named_logs(index: DataFrame) -> DataFrame:
    """An index (``start_us`` of logs) in the form that :func:`choose_logs` takes."""
    return index.withColumnRenamed("start_us", "log_start_us")
