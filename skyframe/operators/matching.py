"""Descriptor matching, and what a set of matches says about a place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feature extractors by name (fixed values); each is an optional plug-in.
BACKENDS = ("superpoint", "disk", "aliked", "sift")
_EXTRACTORS: dict[str, Callable[..., Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]] = {}


@dataclass(frozen=True)
class MatcherConfig:
    backend: str = "sift"
    max_keypoints: int = 2048
    resize: int = 1024
    depth_confidence: float = 0.95
    width_confidence: float = 0.99
    filter_threshold: float = 0.1
    device: str = "auto"
    compile_matcher: bool = False


def register_extractor(name: str, factory: Callable[..., Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> None:
    """``factory(config)`` gives image -> (points N x 2, descriptors N x D)."""
    if name not in BACKENDS:
        raise ValueError(f"unknown feature backend {name!r}: one of {', '.join(BACKENDS)}")
    _EXTRACTORS[name] = factory


def resolve_device(device: str, cuda: bool) -> str:
    return device if device != "auto" else "cuda" if cuda else "cpu"


def image_tensor(bgr: np.ndarray) -> np.ndarray:
    """H x W x 3 bytes in BGR order -> 3 x H x W floats from 0 to 1 in RGB order."""
    return np.ascontiguousarray(bgr[:, :, ::-1].transpose(2, 0, 1)).astype(np.float32) / 255.0


def extract_features(images: DataFrame, config: MatcherConfig, id_col: str = "image_id") -> DataFrame:
    """``id, width, height, pixels`` (BGR bytes) -> ``id, features``: an array of
    (x, y, descriptor) per image.  The extractor is built once per task."""
    if config.backend not in BACKENDS:
        raise ValueError(f"unknown feature backend {config.backend!r}: one of {', '.join(BACKENDS)}")
    if config.backend not in _EXTRACTORS:
        raise LookupError(f"no extractor is registered for {config.backend!r}")
    factory = _EXTRACTORS[config.backend]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = factory(config)
        for batch in batches:
            out = []
            for w, h, pixels in zip(batch["width"], batch["height"], batch["pixels"]):
                points, descriptors = extract(np.frombuffer(pixels, np.uint8).reshape(h, w, 3))
                out.append([{"x": float(p[0]), "y": float(p[1]), "desc": d.astype(float).tolist()} for p, d in zip(points, descriptors)])
            yield pd.DataFrame({id_col: batch[id_col], "features": out})

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, "width", "height", "pixels").mapInPandas(run, f"{id_col} {kind}, features array<struct<x:double,y:double,desc:array<double>>>")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Descriptors along a block's side, and of it along that of a tile, whose products
#: stay in a core's cache.
BLOCK, _TILE = 32_768, 512


def mutual_matches(queries: DataFrame, references: DataFrame, threshold: float, group: list[str] = (), block: int = BLOCK) -> DataFrame:
    """``group columns, query_id, ref_id, score``: pairs that are each other's nearest
    by dot product, scores of ``threshold`` or more; ties by the lower id.

    Inputs have ``id, desc`` (and the group columns, such as frame and tile, within
    which descriptors are compared); descriptors with a null in them and of unequal
    lengths have no score, rows without an id are passed over.  Of a side's equal
    descriptors only that of the least id can be in a pair, so others are left out
    first (not those whose id has several descriptors).  A group's two sides are dealt
    to blocks of bounded size.  A block gives each of its descriptors its nearest, so
    no step gives out pairs; the nearest of all blocks are the matches.
    """
    keys = [*group, "_len"]
    kind = "array<float>" if all(x.schema["desc"].dataType.simpleString() == "array<float>" for x in (queries, references)) else "array<double>"

    def side(rows: DataFrame, ref: bool) -> DataFrame:
        whole = rows.where(F.col("id").isNotNull() & F.col("desc").isNotNull())
        return whole.select(*group, F.size("desc").alias("_len"), F.lit(ref).alias("_ref"), F.col("id").cast("long").alias("_id"), F.col("desc").cast(kind).alias("_desc"))

    rows = side(queries, False).unionByName(side(references, True))
    least = rows.groupBy(*keys, "_ref", "_desc").agg(F.min("_id").alias("_id")).select(rows.columns)
    several = rows.groupBy(*group, "_ref", "_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if several.take(1):
        same = F.lit(True)
        for c in (*group, "_ref", "_id"):
            same &= F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}"))
        least = least.unionByName(rows.alias("m").join(several.alias("s"), same, "left_semi"))

    def parts(of: DataFrame) -> DataFrame:
        n = lambda ref: F.ceil(F.count(F.when(F.col("_ref") == ref, 1)) / F.lit(block)).cast("int")
        return of.groupBy(*keys).agg(n(False).alias("_nq"), n(True).alias("_nr")).where("_nq > 0 and _nr > 0")

    # a task more than there are blocks would only start a worker; those of all rows bound them
    blocks = parts(rows).agg(F.sum(F.col("_nq").cast("long") * F.col("_nr"))).first()[0] or 0
    tasks = max(1, min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * blocks))
    own = lambda n: F.array(F.pmod(F.xxhash64("_id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = least.join(parts(least), keys)
    placed = placed.withColumns({"_xs": F.when(F.col("_ref"), every("_nq")).otherwise(own("_nq")), "_ys": F.when(F.col("_ref"), own("_nr")).otherwise(every("_nr"))})
    dealt = placed.withColumn("_x", F.explode("_xs")).withColumn("_y", F.explode("_ys")).select(*keys, "_x", "_y", "_ref", "_id", "_desc")
    dealt = dealt.repartition(tasks, *keys, "_x", "_y").sortWithinPartitions(*keys, "_x", "_y")

    kinds = ", ".join(f"`{g}` {queries.schema[g].dataType.simpleString()}" for g in group)
    told = dealt.mapInArrow(lambda batches: _nearest_of_blocks(batches, len(group)), f"{kinds}{', ' if kinds else ''}_ref boolean, _id long, _other long, _score double")
    best = told.groupBy(*group, "_ref", "_id").agg(F.max(F.struct("_score", (-F.col("_other")).alias("o"))).alias("b"))
    # a pair that both of its ends name is mutual
    pair = best.select(*group, "_ref", F.when(F.col("_ref"), -F.col("b.o")).otherwise(F.col("_id")).alias("query_id"), F.when(F.col("_ref"), F.col("_id")).otherwise(-F.col("b.o")).alias("ref_id"), "b._score")
    named = pair.groupBy(*group, "query_id", "ref_id").agg(F.count("*").alias("_ends"), F.max("_score").alias("score")).where((F.col("_ends") == 2) & (F.col("score") >= threshold))
    return named.select(*group, F.col("query_id").cast(queries.schema["id"].dataType), F.col("ref_id").cast(references.schema["id"].dataType), "score")


def _nearest_of_blocks(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Columns: group, length, x, y, is it a reference, id, descriptor; rows of a block
    one after the other.  Gives each row's nearest of the other side."""
    for rows in _blocks(batches, groups + 3):
        desc = rows.column(groups + 5).combine_chunks()
        length = rows.column(groups)[0].as_py()
        if desc.flatten().null_count:
            known = desc.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(len(rows), length).all(axis=1)
            rows = rows.filter(pa.array(known))
            desc = rows.column(groups + 5).combine_chunks()
        is_ref = rows.column(groups + 3).to_numpy()
        ids = rows.column(groups + 4).to_numpy()
        desc = desc.flatten().to_numpy().astype(np.float64).reshape(len(ids), length)
        if is_ref.all() or not is_ref.any():
            continue
        (q_ids, q, q_at), (r_ids, r, r_at) = (_distinct(ids[of], desc[of]) for of in (~is_ref, is_ref))
        to_r, q_score, to_q, r_score = nearest_both_ways(q, r, q_ids, r_ids)
        own = np.concatenate([ids[~is_ref], ids[is_ref]])
        other = np.concatenate([r_ids[to_r][q_at], q_ids[to_q][r_at]])
        score = np.concatenate([q_score[q_at], r_score[r_at]])
        first = pa.array(np.zeros(len(own), np.int64))
        columns = [rows.column(k).combine_chunks().take(first) for k in range(groups)]
        columns += [pa.array(np.repeat([False, True], [len(q_at), len(r_at)])), pa.array(own), pa.array(other), pa.array(score, from_pandas=False)]
        yield pa.RecordBatch.from_arrays(columns, [*rows.column_names[:groups], "_ref", "_id", "_other", "_score"])


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            code = batch.column(k).dictionary_encode("encode").indices.to_numpy()
            new |= code[1:] != code[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            name = [batch.column(k)[a].as_py() for k in range(keys)]
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _distinct(ids: np.ndarray, desc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal descriptors one, with the least id: (ids, descriptors, each row's place)."""
    raw = np.ascontiguousarray(desc).view(np.dtype((np.void, max(1, desc.shape[1] * 8)))).ravel() if desc.shape[1] else np.zeros(len(ids), "V1")
    _, first, at = np.unique(raw, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids)
    return least, desc[first], at


def _exact(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Dot products of chosen rows, summed from the first element on, as :func:`dot` does."""
    out = np.zeros(len(at_a))
    for k in range(a.shape[1]):
        out += a[at_a, k] * b[at_b, k]
    return out


def _first_best(at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of candidates those that win at their place: greatest score (NaN above all),
    then least id."""
    order = np.lexsort((ids, -np.where(np.isnan(score), 0.0, score), ~np.isnan(score), at))
    return order[np.append(True, np.diff(at[order]) != 0)]


def nearest_both_ways(q: np.ndarray, r: np.ndarray, q_ids: np.ndarray, r_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``r`` of each ``q``'s greatest dot product and the product, and the
    same of each ``r``; of equal products the least id.

    Products in single precision, tile by tile, tell the greatest of each row and
    column of a tile.  Only tiles whose greatest its error allows to be that of the
    whole row (column) are computed once more for it, mostly one; what the error allows
    there is computed as :func:`dot` does.  Where the error has no bound (odd
    magnitudes) all are.
    """
    with np.errstate(all="ignore"):
        q_long, r_long = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1))
        tame = all(((n == 0) | ((n > 1e-10) & (n < 1e10))).all() for n in (q_long, r_long))
        q4, r4 = q.astype(np.float32), r.astype(np.float32)
    q_best, r_best = _Best(q, r, r_ids), _Best(r, q, q_ids)
    if not tame:
        for low in range(0, len(q), _TILE):
            at_q, at_r = (a.ravel() for a in np.indices((len(q4[low : low + _TILE]), len(r))))
            q_best.offer(low + at_q, at_r)
            r_best.offer(at_r, low + at_q)
        return q_best.at, q_best.score, r_best.at, r_best.score
    unsure = (4 * q.shape[1] + 16) * np.finfo(np.float32).eps
    q_lows, r_lows = range(0, len(q), _TILE), range(0, len(r), _TILE)
    q_tops, r_tops = np.empty((len(r_lows), len(q)), np.float32), np.empty((len(q_lows), len(r)), np.float32)
    for i, a in enumerate(q_lows):
        for j, b in enumerate(r_lows):
            near = q4[a : a + _TILE] @ r4[b : b + _TILE].T
            near.max(axis=1, out=q_tops[j, a : a + _TILE])
            near.max(axis=0, out=r_tops[i, b : b + _TILE])
    for best, own, other, tops, gap in ((q_best, q4, r4, q_tops, unsure * q_long * r_long.max()), (r_best, r4, q4, r_tops, unsure * r_long * q_long.max())):
        floor = tops.max(axis=0) - gap
        for j, top in enumerate(tops):
            rows = np.flatnonzero(top >= floor)
            for low in range(0, len(rows), 4 * _TILE):
                some = rows[low : low + 4 * _TILE]
                at, to = np.nonzero(own[some] @ other[j * _TILE : (j + 1) * _TILE].T >= floor[some][:, None])
                best.offer(some[at], j * _TILE + to)
    return q_best.at, q_best.score, r_best.at, r_best.score


class _Best:
    """The nearest so far of each of ``own`` among ``other``."""

    def __init__(self, own: np.ndarray, other: np.ndarray, other_ids: np.ndarray) -> None:
        self.own, self.other, self.ids = own, other, other_ids
        self.at, self.score = np.full(len(own), -1, np.int64), np.full(len(own), -np.inf)

    def offer(self, rows: np.ndarray, to: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            score = _exact(self.own, rows, self.other, to)
        have = np.unique(rows)
        have = have[self.at[have] >= 0]
        rows, to, score = np.concatenate([have, rows]), np.concatenate([self.at[have], to]), np.concatenate([self.score[have], score])
        won = _first_best(rows, score, self.ids[to])
        self.at[rows[won]], self.score[rows[won]] = to[won], score[won]


# --- robust homographies -----------------------------------------------------


def _normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved and scaled to mean 0 and distance sqrt 2, and the matrix for it."""
    mean = points.mean(axis=0)
    spread = np.sqrt(((points - mean) ** 2).sum(axis=1)).mean()
    s = np.sqrt(2) / spread if spread > 0 else 1.0
    t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1.0]])
    return (points - mean) * s, t


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform on normalised points (4 or more)."""
    (a, ta), (b, tb) = _normal(src), _normal(dst)
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 1)])
    _, s, vt = np.linalg.svd(rows, full_matrices=len(rows) < 9)  # of four points only the full one holds the null vector
    if len(s) >= 8 and s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply_homography(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return p[:, :2] / p[:, 2:]


def robust_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 6.0, trials: int = 10_000, confidence: float = 0.999, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """Seeded RANSAC over samples of four, then refits on the inliers until they
    settle: (matrix or None, inlier mask).  The trials stop once an all-inlier
    sample is as likely as ``confidence``."""
    n = len(src)
    mask = np.zeros(n, bool)
    if n < 4:
        return None, mask
    rng, needed, trial = np.random.default_rng(seed), trials, 0
    while trial < needed:
        trial += 1
        pick = rng.choice(n, 4, replace=False)
        h = fit_homography(src[pick], dst[pick])
        if h is None:
            continue
        error = np.linalg.norm(apply_homography(h, src) - dst, axis=1)
        inside = np.nan_to_num(error, nan=np.inf) <= threshold
        if inside.sum() > mask.sum():
            mask = inside
            share = mask.mean() ** 4
            needed = min(trials, int(np.ceil(np.log(1 - confidence) / np.log(1 - share)))) if share < 1 else trial
    best = None
    for _ in range(10):
        if mask.sum() < 4:
            break
        h = fit_homography(src[mask], dst[mask])
        if h is None:
            break
        best = h
        error = np.linalg.norm(apply_homography(h, src) - dst, axis=1)
        inside = np.nan_to_num(error, nan=np.inf) <= threshold
        if (inside == mask).all():
            break
        mask = inside
    return best, mask if best is not None else np.zeros(n, bool)


def homographies(matches: DataFrame, group: list[str], threshold: float = 6.0, trials: int = 10_000, confidence: float = 0.999) -> DataFrame:
    """``matches`` (``qx, qy, rx, ry, conf`` per row and group) -> per group
    ``homography`` (array of 9 or null), ``match_count``, ``inlier_count``,
    ``reprojection_error``, ``mean_confidence``.

    A group is one image pair, bounded by the keypoint limit.  Rows are put in an
    order of their own first, so the result does not depend on how they arrive."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["qx", "qy", "rx", "ry"], kind="stable")
        src, dst = pdf[["qx", "qy"]].to_numpy(float), pdf[["rx", "ry"]].to_numpy(float)
        h, inside = robust_homography(src, dst, threshold, trials, confidence)
        error = np.linalg.norm(apply_homography(h, src) - dst, axis=1)[inside].mean() if h is not None and inside.any() else np.inf
        row = {c: pdf[c].iat[0] for c in group}
        row |= {"homography": None if h is None else h.ravel().tolist(), "match_count": len(pdf), "inlier_count": int(inside.sum())}
        row |= {"reprojection_error": float(error), "mean_confidence": float(pdf["conf"].to_numpy()[inside].mean()) if inside.any() else 0.0}
        return pd.DataFrame([row])

    kinds = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in group)
    return matches.groupBy(*group).applyInPandas(fit, f"{kinds}, homography array<double>, match_count long, inlier_count long, reprojection_error double, mean_confidence double")


# --- scoring -----------------------------------------------------------------


@dataclass(frozen=True)
class AcceptConfig:
    """When a candidate place is believed."""

    min_match_count: int = 20
    min_inlier_count: int = 8
    min_inlier_ratio: float = 0.15
    max_reprojection_error_px: float = 6.0


def inlier_ratio(inliers: Column, matches: Column) -> Column:
    return inliers.cast("double") / F.greatest(F.lit(1), matches)


def candidate_score(inliers: Column, ratio: Column, confidence: Column, error: Column) -> Column:
    return 1.5 * inliers.cast("double") + 30.0 * ratio + 10.0 * confidence - 0.75 * error


def acceptable(config: AcceptConfig, matches: Column, inliers: Column, error: Column) -> Column:
    """The cascade of cheap tests, without that of the projected centre."""
    ratio = inlier_ratio(inliers, matches)
    return (matches >= config.min_match_count) & (inliers >= config.min_inlier_count) & (ratio >= config.min_inlier_ratio) & (error <= config.max_reprojection_error_px)


def best_candidate(candidates: DataFrame, by: list[str], score: str = "score", order: str = "tile_ord") -> DataFrame:
    """Per group the row of the greatest score, of equal ones the first in order;
    scores that are no number are passed over."""
    rest = [c for c in candidates.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    return candidates.where(~F.isnan(score)).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def reprojection_errors(points: DataFrame, group: list[str], h: str = "homography") -> DataFrame:
    """Mean distance of projected inliers (``qx, qy, rx, ry, inlier``) per group;
    infinite where there are none."""
    from ..functions.geo import project

    px, py = project(F.col(h), F.col("qx"), F.col("qy"))
    away = F.sqrt((px - F.col("rx")) * (px - F.col("rx")) + (py - F.col("ry")) * (py - F.col("ry")))
    return points.groupBy(*group).agg(F.coalesce(F.avg(F.when(F.col("inlier"), away)), F.lit(float("inf"))).alias("reprojection_error"))


def sample_lines(matches: DataFrame, group: list[str], order: str, limit: int = 80) -> DataFrame:
    """The match lines to be shown per group: inliers (all matches if none are), and
    of more than ``limit`` every n-th, at most ``limit``."""
    columns = matches.columns
    rows = matches.select(*[F.col(c).alias(f"g{k}") for k, c in enumerate(group)], F.col(order).alias("o"), F.col("inlier").alias("i"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    whole = Window.partitionBy(*[f"g{k}" for k in range(len(group))])
    shown = rows.withColumn("has", F.max(F.col("i").cast("int")).over(whole)).where((F.col("has") == 0) | F.col("i"))
    placed = shown.withColumns({"n": F.count("*").over(whole), "k": F.row_number().over(whole.orderBy("o")) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / limit)).cast("bigint")
    chosen = (F.col("n") <= limit) | ((F.col("k") % step == 0) & (F.col("k") / step < limit))
    return placed.where(chosen).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
