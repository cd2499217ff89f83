"""The live plan on Structured Streaming: conflation, the telemetry prior, stateful
tracking, and an append sink without repeats."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import GeoRaster
from ..operators.timeseries import fuse_navigation
from ..plans.config import LiveConfig, LocalizeConfig
from ..plans.localize import RESULT_SCHEMA, Tracker, TrackState, localize
from ..plans.progress import Progress, told
from ..sources.results import remove


def frame_times(frames: DataFrame, fps: Column) -> DataFrame:
    """``frames`` (``frame_index, start_us``) with ``video_time_sec`` and ``t``."""
    seconds = F.col("frame_index") / fps
    return frames.withColumns({"video_time_sec": seconds, "t": F.col("start_us") + F.bround(seconds * 1_000_000).cast("bigint")})


def submitted(frames: DataFrame, interval: int, start_frame: Column | int = 0) -> DataFrame:
    """Frames that are handed to the matcher: all of them (interval 0 or less), or the
    first and every n-th."""
    start = start_frame if isinstance(start_frame, Column) else F.lit(start_frame)
    return frames if interval <= 0 else frames.where((F.col("frame_index") - start) % interval == 0)


def telemetry_priors(frames: DataFrame, navigation: tuple[DataFrame, DataFrame, DataFrame], raster: GeoRaster) -> DataFrame:
    """``frames`` (``flight, t``) with the navigation at their time and ``prior_x,
    prior_y``: where it puts them on the map; null without a position."""
    at = fuse_navigation(frames, *navigation)
    x, y = raster.latlon_to_pixel(F.col("latitude"), F.col("longitude"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return at.withColumns({"prior_x": finite(x), "prior_y": finite(y)})


def latest_wins(tasks: DataFrame, by: str = "video", order: str = "frame_index") -> DataFrame:
    """Of the tasks that wait together, the newest per source: what one mailbox slot,
    overwritten by each submission, would hold."""
    rest = [c for c in tasks.columns if c != by]
    return tasks.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("_t")).select(by, "_t.*")


def emit_once(outputs: DataFrame, by: str = "video", order: str = "seq", frame: str = "frame_index") -> DataFrame:
    """Outputs whose frame differs from the one emitted before."""
    before = F.lag(frame).over(Window.partitionBy(by).orderBy(order))
    return outputs.withColumn("_before", before).where(~F.col(frame).eqNullSafe(F.col("_before"))).drop("_before")


def match_age(now: Column, matched: Column) -> Column:
    """Seconds since the last match, never negative."""
    return F.greatest(F.lit(0.0), now - matched)


def track_tail(results: DataFrame, n: int = 40, by: str = "video", order: str = "frame_index") -> DataFrame:
    """The last ``n`` places of each track, oldest first by ``order``; a track of one
    place is not shown."""
    placed = results.where(F.col("map_center_x_px").isNotNull() & F.col("map_center_y_px").isNotNull())
    whole = Window.partitionBy(by)
    ranked = placed.withColumns({"_r": F.row_number().over(whole.orderBy(F.col(order).desc())), "_n": F.count("*").over(whole)})
    return ranked.where((F.col("_r") <= n) & (F.col("_n") >= 2)).drop("_r", "_n")


def map_focus(candidate: Column, prior: Column, middle: Column) -> Column:
    """Where the map view looks: the candidate, else the prior, else the middle."""
    return F.coalesce(candidate, prior, middle)


_STATE = "x double, y double"


def track_stream(frames: DataFrame, tiles: list[tuple[int, float, float]], config: LocalizeConfig) -> DataFrame:
    """Streaming form of :func:`..plans.localize.localize`: rows of
    :func:`..plans.localize.frames_with_candidates` arrive in frame order per
    recording; the last place found is kept as state between batches."""
    tracker = Tracker(tiles, config)
    columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = TrackState(*state.get) if state.exists else TrackState()
        rows = []
        whole = pd.concat(list(batches)).sort_values(["sampled_index", "frame_index"])
        for frame in whole.to_dict("records"):
            found = frame.pop("candidates")
            rows.append(tracker.step(held, frame, [] if found is None else list(found)))
        state.update((held.x, held.y))
        yield pd.DataFrame(rows, columns=columns)

    return frames.groupBy("video").applyInPandasWithState(update, RESULT_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def append_results(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start appending results to a Parquet folder, a batch that is replayed only once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["video", "frame_index"]).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


# --- the whole plan ----------------------------------------------------------


def conflated(submissions: DataFrame, slot: str = "slot") -> DataFrame:
    """What a matcher that is busy during each slot gets to see: of a recording's
    submissions (``video, frame_index``) in one slot the newest.  Its
    ``sampled_index`` counts all submissions before it, those overwritten included."""
    rest = [c for c in submissions.columns if c not in ("video", slot)]
    newest = submissions.groupBy("video", slot).agg(F.max_by(F.struct(*rest), "frame_index").alias("_t"), F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("video").orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.select("video", slot, "_t.*", (so_far - 1).cast("bigint").alias("sampled_index"))


@dataclass(frozen=True)
class LivePlan:
    """What the live plan works with.  ``candidates`` makes the accepted candidates of
    some frames (as :func:`..plans.localize.find_candidates` does); ``progress`` is
    told the stages."""

    navigation: tuple[DataFrame, DataFrame, DataFrame]
    raster: GeoRaster
    tiles: DataFrame
    candidates: Callable[[DataFrame], DataFrame]
    config: LiveConfig = LiveConfig()
    interval: int = 0
    start_frame: int = 0
    progress: Progress | None = None


#: Between batches, one row per recording: submissions so far, the last place found,
#: and the last frame whose result was given out.
STATE = "video string, submitted long, state_x double, state_y double, shown long"


def live_step(frames: DataFrame, state: DataFrame, plan: LivePlan) -> tuple[DataFrame, DataFrame]:
    """One batch: (results to give out, state after it).

    ``frames`` (``video, flight, frame_index, start_us, fps`` and what ``candidates``
    needs) that wait together are conflated before the matcher, so a frame that is
    overwritten never moves the track.  A result whose frame was the last one given
    out is not given out again."""
    waiting = submitted(frame_times(frames, F.col("fps")), plan.interval, plan.start_frame)
    newest = conflated(waiting.withColumn("slot", F.lit(0)))
    known = newest.drop("slot").join(state, "video", "left")
    known = known.withColumn("sampled_index", F.col("sampled_index") + F.coalesce("submitted", F.lit(0)))
    light = known.select("video", "flight", "frame_index", "t", "video_time_sec", "sampled_index", "state_x", "state_y")  # without pixels
    task = telemetry_priors(light, plan.navigation, plan.raster)
    found = localize(task, plan.candidates(known), plan.tiles, plan.config)
    before = known.select("video", "shown", "sampled_index", "state_x", "state_y")
    out = found.join(before, "video").withColumn("_again", F.col("frame_index").eqNullSafe(F.col("shown")))
    hit = F.col("status") == "localized"
    moved = out.select(
        "video",
        (F.col("sampled_index") + 1).cast("bigint").alias("submitted"),
        F.when(hit, F.col("map_center_x_px")).otherwise(F.col("state_x")).alias("state_x"),
        F.when(hit, F.col("map_center_y_px")).otherwise(F.col("state_y")).alias("state_y"),
        F.col("frame_index").alias("shown"),
    )
    results = out.where(~F.col("_again")).select(*found.columns)
    return results, moved.unionByName(state.join(moved.select("video"), "video", "left_anti"))


def run_live(frames: DataFrame, plan: LivePlan, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the live plan on a stream of frames: results go to ``target/results`` and
    the state to ``target/state``, one folder per batch, so that a batch which is
    replayed after a failure writes the same again.  A run with a new checkpoint
    deletes what an earlier one left in these two folders.  ``trigger`` as for a
    stream writer; all that is available by default."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.createDataFrame([], STATE) if epoch == 0 else spark.read.schema(STATE).parquet(f"{target}/state/epoch={epoch - 1}")
        if epoch == 0:
            for folder in ("results", "state"):
                remove(spark, f"{target}/{folder}")
        results, after = live_step(batch, state, plan)
        both = results.select(F.lit(True).alias("_result"), F.struct(*results.columns).alias("r"), F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':') for c in STATE.split(', '))}>").alias("s"))
        kept = after.select(F.lit(False).alias("_result"), F.lit(None).cast(results.select(F.struct(*results.columns)).schema[0].dataType).alias("r"), F.struct(*after.columns).alias("s"))
        work = f"{target}/state/work={epoch}"
        both.unionByName(kept).write.mode("overwrite").parquet(work)  # matched once for both tables
        done = spark.read.parquet(work)
        done.where("NOT _result").select("s.*").write.mode("overwrite").parquet(f"{target}/state/epoch={epoch}")
        done.where("_result").select("r.*").write.mode("overwrite").parquet(f"{target}/results/epoch={epoch}")
        remove(spark, work)
        remove(spark, f"{target}/state/epoch={epoch - 2}")
        told(plan.progress, "idle")

    writer = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_results(spark: SparkSession, target: str) -> DataFrame:
    """All results of :func:`run_live` so far."""
    return spark.read.schema(RESULT_SCHEMA).parquet(f"{target}/results/*")


def await_first_result(query: StreamingQuery, seconds: float = LiveConfig.first_match_timeout_sec, pause: float = 0.02) -> bool:
    """Wait without a display: until the first batch with frames is done (True), the
    query has ended (True if it had any), or the time is over (False).  An error of
    the query is raised."""
    until = time.monotonic() + seconds
    while True:
        ended = not query.isActive
        if (error := query.exception()) is not None:
            raise error
        if any(p.numInputRows for p in query.recentProgress):
            return True
        if ended or time.monotonic() >= until:
            return False
        time.sleep(pause)
