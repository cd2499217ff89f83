"""Localization of frames: which tiles to look at, the best candidate, and the state
that one frame leaves to the next.

Candidates (``video, frame_index, tile_ord, tile_id, score, ...``) are tile matches
that passed :func:`..operators.matching.acceptable`; making them is parallel over
frames and tiles.  Choosing among them is a fold over each recording's frames, as
the tiles looked at depend on the last place found; recordings are parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import GeoRaster, near_tile, project_frame
from ..operators.features import FeatureTable, match_feature_sets
from ..operators.matching import acceptable, candidate_score, extract_features, homographies, inlier_ratio
from .config import LocalizeConfig
from .progress import Progress, told


def sample_frames(frames: DataFrame, config: LocalizeConfig, fps: Column | None = None) -> DataFrame:
    """``frames`` (``video, frame_index``, of a readable recording of ``fps``, and
    ``total_frames``) that the plan looks at, with ``sampled_index`` and
    ``video_time_sec``.  A rate that is null or not positive counts as 30."""
    rate = F.when(F.col("fps") > 0, F.col("fps").cast("double")).otherwise(30.0) if fps is None else fps
    step = F.greatest(F.lit(1), F.bround(config.frame_step_seconds * rate)).cast("bigint")
    start = F.greatest(F.lit(0), F.bround(config.video_start_seconds * rate)).cast("bigint")
    since = F.col("frame_index") - start
    # the first frame is read even past a wrong total; later ones must lie below it
    below = (F.coalesce("total_frames", F.lit(0)) <= 0) | (F.col("frame_index") < F.col("total_frames")) | (since == 0)
    out = frames.where((since >= 0) & (since % step == 0) & below).withColumns({"sampled_index": (since / step).cast("bigint"), "video_time_sec": F.col("frame_index") / rate})
    return out if config.max_frames is None else out.where(F.col("sampled_index") < max(1, config.max_frames))


def score_candidates(fits: DataFrame, config: LocalizeConfig, raster: GeoRaster) -> DataFrame:
    """Fitted pairs (``homography, match_count, inlier_count, reprojection_error,
    mean_confidence``, frame size ``width, height`` and the tile's columns) that
    pass all tests, with the map place, latitude, longitude and score."""
    a = config.accept
    good = fits.where(F.col("match_count") >= a.min_match_count).where(F.col("homography").isNotNull())
    good = good.where(acceptable(a, F.col("match_count"), F.col("inlier_count"), F.col("reprojection_error")))
    _, (cx, cy) = project_frame(F.col("homography"), F.col("width"), F.col("height"))
    placed = good.withColumns({"_cx": cx, "_cy": cy}).where(near_tile(F.col("_cx"), F.col("_cy"), F.col("tile_size_px")))
    placed = placed.withColumns({"map_center_x_px": F.col("map_x0_px") + F.col("_cx"), "map_center_y_px": F.col("map_y0_px") + F.col("_cy"), "inlier_ratio": inlier_ratio(F.col("inlier_count"), F.col("match_count"))})
    lat, lon = raster.pixel_to_latlon(F.col("map_center_x_px"), F.col("map_center_y_px"))
    scored = placed.withColumns({"latitude": lat, "longitude": lon, "score": candidate_score(F.col("inlier_count"), F.col("inlier_ratio"), F.col("mean_confidence"), F.col("reprojection_error"))})
    return scored.drop("_cx", "_cy")


def find_candidates(frames: DataFrame, tiles: DataFrame, tile_images: DataFrame, cache: FeatureTable, config: LocalizeConfig, raster: GeoRaster, progress: Progress | None = None) -> DataFrame:
    """Candidates of frames (``video, frame_index, width, height, pixels``) on all tiles
    of the index.  The tiles' features come from ``cache``, which makes those that it
    lacks from ``tile_images`` (``tile_ord, width, height, pixels``); a frame's are
    made once, whatever the number of tiles."""
    told(progress, "query_features_start")
    key = ["video", "frame_index"]
    features = extract_features(frames.withColumn("_frame", F.struct(*key)), config.matcher, "_frame").select("_frame.*", "features")
    told(progress, "query_features_ready")
    references = cache.of(tile_images)
    told(progress, "match_features")
    # every frame looks at every tile: the index is small and checked, and the result is what is asked for
    index = tiles.select("tile_ord", "tile_id", "tile_size_px", "map_x0_px", "map_y0_px")
    numbers = index.agg(F.collect_set("tile_ord").alias("_tiles"))
    pairs = features.select(*key).join(F.broadcast(numbers), F.lit(True)).select(*key, F.explode("_tiles").alias("tile_ord"))  # one row
    matches = match_feature_sets(pairs, features, references, config.matcher, key, ["tile_ord"])
    told(progress, "estimate_homography")
    fits = homographies(matches, [*key, "tile_ord"]).join(frames.select(*key, "width", "height"), key).join(index, "tile_ord")
    return score_candidates(fits, config, raster).select(*key, *_CANDIDATE)


def search_mode(sampled_index: Column, has_last: Column, has_prior: Column, every: int) -> Column:
    """The mode a frame starts in, once the state is known."""
    due = ~has_last | (sampled_index == 0) | (sampled_index % every == 0)
    return F.when(~due, "track_local").when(has_prior, "telemetry_prior").otherwise("global")


@dataclass
class TrackState:
    """What a recording's frames leave behind: the last place found."""

    x: float | None = None
    y: float | None = None

    @classmethod
    def before(cls, frame: dict) -> TrackState:
        """What a recording's first frame says about the time before it."""
        x, y = frame.get("state_x"), frame.get("state_y")
        return cls(x, y) if x is not None and x == x else cls()


#: Output columns of the fold.
RESULT_SCHEMA = (
    "video string, frame_index long, video_time_sec double, status string, search_mode string, latitude double, longitude double, "
    "map_center_x_px double, map_center_y_px double, score double, tile_id string, match_count long, inlier_count long, inlier_ratio double, "
    "mean_match_confidence double, reprojection_error_px double"
)


class Tracker:
    """The fold itself, shared by the batch and the streaming plan."""

    def __init__(self, tiles: list[tuple[int, float, float]], config: LocalizeConfig) -> None:
        self.tiles, self.config = tiles, config

    def nearest(self, x: float, y: float, k: int) -> set[int]:
        near = sorted(self.tiles, key=lambda t: ((t[1] - x) * (t[1] - x) + (t[2] - y) * (t[2] - y), t[0]))
        return {t[0] for t in near[: max(1, k)]}

    def step(self, state: TrackState, frame: dict, candidates: list[dict]) -> dict:
        """One frame's result row; ``state`` moves on.  ``candidates`` are all that the
        frame has, in tile order; only those the mode looks at are used."""
        n, every = frame["sampled_index"], self.config.relocalize_every_n_frames
        due = state.x is None or n == 0 or n % every == 0
        prior = (frame.get("prior_x"), frame.get("prior_y"))
        looked: set[int] | None = None
        mode = "global"
        if not due:
            mode, looked = "track_local", self.nearest(state.x, state.y, self.config.track_local_tile_limit)
        elif prior[0] is not None and prior[1] is not None and prior[0] == prior[0] and prior[1] == prior[1]:
            mode, looked = "telemetry_prior", self.nearest(*prior, self.config.telemetry_prior_tile_limit)
        if looked is not None and not looked:
            mode, looked = "global_fallback", None
        best = self._best(candidates, looked)
        found = mode
        if best is None and mode != "global":
            best, found = self._best(candidates, None), "global_fallback"
        row = {"video": frame["video"], "frame_index": frame["frame_index"], "video_time_sec": frame["video_time_sec"]}
        if best is None:
            return row | {"status": "lost", "search_mode": mode, "latitude": None, "longitude": None, "map_center_x_px": state.x, "map_center_y_px": state.y, "score": None, "tile_id": "", "match_count": 0, "inlier_count": 0, "inlier_ratio": 0.0, "mean_match_confidence": 0.0, "reprojection_error_px": None}
        state.x, state.y = best["map_center_x_px"], best["map_center_y_px"]
        taken = ("latitude", "longitude", "map_center_x_px", "map_center_y_px", "score", "tile_id", "match_count", "inlier_count", "inlier_ratio")
        return row | {"status": "localized", "search_mode": found} | {c: best[c] for c in taken} | {"mean_match_confidence": best["mean_confidence"], "reprojection_error_px": best["reprojection_error"]}

    @staticmethod
    def _best(candidates: list[dict], looked: set[int] | None) -> dict | None:
        best = None
        for c in candidates:
            if (looked is None or c["tile_ord"] in looked) and c["score"] == c["score"] and (best is None or c["score"] > best["score"]):
                best = c
        return best


#: Tiles that every task of :func:`localize` may hold (24 bytes each).
MAX_TILES = 1_000_000

_FRAME = ("video", "frame_index", "sampled_index", "video_time_sec", "prior_x", "prior_y")
_CANDIDATE = ("tile_ord", "tile_id", "latitude", "longitude", "map_center_x_px", "map_center_y_px", "score", "match_count", "inlier_count", "inlier_ratio", "mean_confidence", "reprojection_error")


def frames_with_candidates(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per frame with its accepted candidates in tile order (at most one per
    tile of the index)."""
    prior = [F.col(c).cast("double").alias(c) if c in frames.columns else F.lit(None).cast("double").alias(c) for c in ("prior_x", "prior_y")]
    held = [F.col(c).cast("double").alias(c) for c in ("state_x", "state_y") if c in frames.columns]
    base = frames.select("video", "frame_index", "sampled_index", "video_time_sec", *prior, *held)
    listed = candidates.groupBy("video", "frame_index").agg(F.sort_array(F.collect_list(F.struct(*_CANDIDATE))).alias("candidates"))
    return base.join(listed, ["video", "frame_index"], "left")


def localize(frames: DataFrame, candidates: DataFrame, tiles: DataFrame, config: LocalizeConfig) -> DataFrame:
    """One result row per frame of each recording.

    Frames of a recording are sorted into one task and folded as a stream, so only
    one frame is held at a time; recordings are spread over tasks.  Every task holds
    the tile index, of ``MAX_TILES`` at most; raises ValueError beyond.  Frames may
    carry ``state_x, state_y``: the last place found before their recording's first."""
    if tiles.count() > MAX_TILES:
        raise ValueError(f"more than {MAX_TILES} tiles: use localize_global, which keeps none of them")
    index = sorted((r["tile_ord"], float(r["center_x_px"]), float(r["center_y_px"])) for r in tiles.select("tile_ord", "center_x_px", "center_y_px").collect())
    tracker = Tracker(index, config)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, TrackState()
        columns = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for frame in batch.to_dict("records"):
                if frame["video"] != video:
                    video, state = frame["video"], TrackState.before(frame)
                found = frame.pop("candidates")
                rows.append(tracker.step(state, frame, [] if found is None else list(found)))
            yield pd.DataFrame(rows, columns=columns)

    sorted_frames = frames_with_candidates(frames, candidates).repartition("video").sortWithinPartitions("video", "sampled_index", "frame_index")
    return sorted_frames.mapInPandas(fold, RESULT_SCHEMA)


def localize_global(frames: DataFrame, candidates: DataFrame, config: LocalizeConfig) -> DataFrame:
    """A variant without state, fully parallel: every frame looks at all tiles.  Lost
    frames still tell the last place found before them."""
    from ..operators.matching import best_candidate

    best = best_candidate(candidates.select("video", "frame_index", *_CANDIDATE), ["video", "frame_index"])
    joined = frames.join(best, ["video", "frame_index"], "left")
    by = Window.partitionBy("video").orderBy("sampled_index", "frame_index")
    hit = F.col("score").isNotNull()
    return joined.select(
        "video",
        "frame_index",
        "video_time_sec",
        F.when(hit, "localized").otherwise("lost").alias("status"),
        F.lit("global").alias("search_mode"),
        "latitude",
        "longitude",
        F.last("map_center_x_px", ignorenulls=True).over(by).alias("map_center_x_px"),
        F.last("map_center_y_px", ignorenulls=True).over(by).alias("map_center_y_px"),
        "score",
        F.coalesce("tile_id", F.lit("")).alias("tile_id"),
        F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"),
        F.coalesce("inlier_count", F.lit(0)).cast("bigint").alias("inlier_count"),
        F.coalesce("inlier_ratio", F.lit(0.0)).alias("inlier_ratio"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_match_confidence"),
        F.col("reprojection_error").alias("reprojection_error_px"),
    )


def run_summary(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Frames, localized frames, and the mean of the scores there are."""
    return results.groupBy(*by).agg(F.count("*").alias("frames"), F.count_if(F.col("status") == "localized").alias("localized"), F.avg("score").alias("mean_score"))


def debug_columns(candidates: DataFrame, collect_debug: bool, columns: tuple[str, ...] = ("homography",)) -> DataFrame:
    """Without debug output its columns are dropped before they are read."""
    return candidates if collect_debug else candidates.drop(*columns)
