"""Toxic passages by maximum-scoring segments of word log-odds.

Fit (on a bounded sample of labelled rows):

* A word's weight is its log-odds ratio between toxic and clean documents with an
  informative Dirichlet prior (the word's share of all documents, as strong as a
  share ``prior`` of the sample); only weights of ``min_z`` standard deviations and seen in
  ``min_docs`` toxic documents count.  Words without one fall back to the weight
  of their first letters, found alike.  Near copies count once, so that a text
  that is often copied does not make its own words toxic.
* Other words cost ``gap_cost``.  Under the clean word frequencies the best
  segment of n words exceeds S with a chance of about K n exp(-lambda S)
  (Karlin-Altschul): lambda solves E[exp(lambda s)] = 1, K is set by the segments
  of clean documents.
* A logistic curve from (best, total) significance to the label is fitted on rows
  that gave no weights.

Scoring finds all maximal segments in one pass over the words (Ruzzo-Tompa).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import packed, unpacked
from .worker import bound_batches, release

_WORD = re.compile(r"\w+")
#: Scores of units kept per process.
MAX_UNITS = 60_000
_COUNTS_FLUSH = 80_000


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_train``: labelled rows that the fit may use, chosen by a hash of the id."""

    max_train: int = 40_000
    stem: int = 5
    prior: float = 0.0125
    min_docs: int = 3
    min_z: float = 2.0
    min_weight: float = 1.5
    gap_cost: float = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    gap_cost: float = 0.5
    stem: int = 5
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)


def maximal_segments(places: list[int], weights: list[float], gap_cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score) of a sequence in
    which ``places`` have positive ``weights`` and all others cost ``gap_cost``."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum up to, nearest earlier that begins lower
    total, before = 0.0, -1
    for place, weight in zip(places, weights):
        total -= gap_cost * (place - before - 1)
        first, left, total, before = place, total, total + weight, place
        while True:  # join with the nearest earlier segment that begins lower, if it ends lower
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, place, left, total, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, up - low) for a, b, low, up, _ in stack]


class Scanner:
    """Finds the segments of texts and their significance."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def _weight(self, unit: str) -> float:
        best, m = 0.0, self.model
        for w in _WORD.findall(unit):
            s = m.words.get(w)
            if s is None and len(w) >= m.stem:
                s = m.stems.get(w[: m.stem])
            best = max(best, s or 0.0)
        return best

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(white-space separated units, maximal segments as unit ranges)."""
        units = text.lower().split() if text else []
        known = self.known
        if len(known) > MAX_UNITS:
            known.clear()
        for u in {u for u in units if u not in known}:
            known[u] = self._weight(u)
        weights = list(map(known.__getitem__, units))
        if not any(weights):
            return len(units), []
        places = [k for k, w in enumerate(weights) if w]
        return len(units), maximal_segments(places, [weights[k] for k in places], self.model.gap_cost)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments: (first unit, last unit, -ln of the expected number
        of such segments in clean text of this length), above 0."""
        n, found = self.segments(text)
        base = math.log(max(self.model.scale * n, 1e-9))
        scored = [(a, b, self.model.rate * s - base) for a, b, s in found]
        return [x for x in scored if x[2] > 0]

    def features(self, text: str | None) -> tuple[float, float]:
        found = [x[2] for x in self.passages(text)]
        return max(found, default=0.0), sum(found)

    def score(self, best: float, total: float) -> float:
        a, b, c = self.model.curve
        z = a + b * best + c * math.log1p(total)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fold_of(id_col) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "utf-8")), F.lit(5))


def _training(docs: DataFrame, labels: DataFrame, config: ToxicityConfig, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, toxic, fold`` of at most ``max_train`` labelled rows outside fold 0."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    open_ = named.where(fold_of(F.col("_id")) != 0)
    chosen = open_.orderBy(F.xxhash64("_id"), "_id").limit(config.max_train)
    # at most max_train rows of 12 bytes
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic", fold_of(F.col("_id")).alias("fold"))


def _count_features(train: DataFrame, config: ToxicityConfig) -> DataFrame:
    """``feature, toxic, clean`` document counts; stems carry a leading '^'; the
    features '#' count documents and '##' units.  Near copies count once: of texts
    with one least shingle hash, then of those with one second such hash, only the
    first in the order of the texts' own hash."""
    stem = config.stem

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(0).to_pylist():
                units = (text or "").lower().split()
                hashes = [xxhash.xxh64_intdigest(" ".join(units[k : k + 3])) for k in range(max(1, len(units) - 2))]
                a = min(hashes)
                b = min((h * 0x9E3779B97F4A7C15 ^ 0x5DEECE66D) & (2**64 - 1) for h in hashes)
                for column, h in zip(rows, (a, b, xxhash.xxh64_intdigest(text or ""))):
                    column.append(h - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(r, pa.int64()) for r in rows)], ["text", "toxic", "a", "b", "h"])

    keyed = train.select("text", "toxic").mapInArrow(keys, "text string, toxic int, a long, b long, h long")
    keyed = keyed.groupBy("a").agg(F.min(F.struct("h", "b", "toxic", "text")).alias("r")).select("r.*")
    once = keyed.groupBy("b").agg(F.min(F.struct("h", "toxic", "text")).alias("r")).select("r.text", "r.toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(names, pa.string()), *(pa.array([counts[y][n] for n in names], pa.int64()) for y in (1, 0))]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                c = counts[y]
                c.update(words)
                c.update({"^" + w[:stem] for w in words if len(w) >= stem})
                c["#"] += 1
                c["##"] += len((text or "").split())
                if len(counts[0]) + len(counts[1]) > _COUNTS_FLUSH:
                    yield rows()
        yield rows()
        release()

    return once.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds ratio, its z) with a Dirichlet prior worth ``prior`` of the sample."""
    a = prior * (toxic + clean)
    prior = prior * (n_toxic + n_clean)
    up, down = toxic + a, clean + a
    ratio = np.log(up / np.maximum(n_toxic + prior - up, 0.5)) - np.log(down / np.maximum(n_clean + prior - down, 0.5))
    return ratio, ratio / np.sqrt(1 / up + 1 / down)


def _null_rate(weights: np.ndarray, chances: np.ndarray, gap_cost: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 for the clean scores."""
    def excess(x: float) -> float:
        return float((chances * np.exp(x * weights)).sum() + (1 - chances.sum()) * math.exp(-x * gap_cost) - 1)

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps for a lightly ridged logistic regression.  A step is halved until
    it lowers the loss: full steps run away where the labels are separable."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, z).sum() - y @ z + at @ penalty @ at / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        share = 1.0
        while share > 1e-9 and not (then := loss(w + share * step)) < now:
            share /= 2
        if share <= 1e-9 or now - then < 1e-10 * max(1.0, now):
            break
        w, now = w + share * step, then
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from labelled rows whose crc32(id) modulo 5 is not 0: folds 2 to 4
    give the weights, fold 1 the curve.

    Null labels, ids and labels other than 0 and 1 are passed over; of labels that
    disagree on an id the larger counts.  Without rows of both kinds the model
    scores every text alike, by the share of toxic rows.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.save(_training(docs, labels, config, id_col, text_col, label_col), "train")
    counts = scratch.save(_count_features(train.where("fold > 1"), config), "counts")
    sums = {r["feature"]: r for r in counts.where("feature in ('#', '##')").collect()}
    n_toxic, n_clean = (sums["#"]["toxic"], sums["#"]["clean"]) if "#" in sums else (0, 0)
    base = math.log((n_toxic + 0.5) / (n_clean + 2.0)) if n_toxic + n_clean else -4.0
    flat = ToxicityModel(gap_cost=config.gap_cost, stem=config.stem, curve=(min(base, -0.1) if n_toxic <= n_clean else base, 0.0, 0.0))
    if not n_toxic or not n_clean:
        return flat
    # bounded by the sample: features of min_docs toxic documents, toxic more often than clean
    often = counts.where((F.col("toxic") >= config.min_docs) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic) & ~F.col("feature").isin("#", "##"))
    table = often.orderBy("feature").toPandas()
    ratio, z = log_odds(table["toxic"].to_numpy(float), table["clean"].to_numpy(float), n_toxic, n_clean, config.prior)
    good = (z >= config.min_z) & (ratio >= config.min_weight)
    table, ratio = table[good], ratio[good]
    stems = {f[1:]: float(r) for f, r in zip(table["feature"], ratio) if f[0] == "^"}
    words = {f: float(r) for f, r in zip(table["feature"], ratio) if f[0] != "^"}
    if not words and not stems:
        return flat
    chances = (table["clean"].to_numpy(float) + 0.5) / max(sums["##"]["clean"], 1)
    whole = table["feature"].str[0].to_numpy() != "^"
    use = whole if whole.any() else ~whole
    rate = _null_rate(ratio[use], chances[use], config.gap_cost)
    model = replace(flat, words=words, stems=stems, rate=rate)

    # K: clean segments of fold 1 that reach the least weight, against the words read
    calibrate = train.where("fold = 1")
    least = float(ratio.min())
    raw = _segment_table(calibrate, model)
    seen = raw.where("toxic = 0").agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("scores", lambda s: s >= least))).alias("k")).first()
    scale = ((seen["k"] or 0) + 0.5) / max(seen["n"] or 0, 1) * math.exp(rate * least)
    model = replace(model, scale=scale)
    data = _feature_table(calibrate, model).toPandas()  # at most max_train rows of 20 bytes
    if data["toxic"].nunique() < 2:
        return replace(model, curve=(flat.curve[0], 1.0, 0.0))
    x = np.column_stack([data["best"], np.log1p(data["total"])])
    return replace(model, curve=_logistic(x, data["toxic"].to_numpy(float)))


def _segment_table(train: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for batch in batches:
            found = [scanner.segments(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in found], "scores": [[s for _, _, s in x] for _, x in found]})

    return train.select("text", "toxic").mapInPandas(run, "toxic int, n long, scores array<double>")


def _feature_table(train: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for batch in batches:
            best, total = zip(*map(scanner.features, batch["text"])) if len(batch) else ((), ())
            yield pd.DataFrame({"toxic": batch["toxic"], "best": best, "total": total})

    return train.select("text", "toxic").mapInPandas(run, "toxic int, best double, total double")


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and
    ``passages`` (first unit, last unit, significance) added, replacing such
    columns.  Null and empty texts have no passages.  Rows are scored one by one."""

    bound_batches(docs.sparkSession)

    @F.pandas_udf("score double, passages array<struct<first:long,last:long,significance:double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for texts in batches:
            found = [scanner.passages(t) for t in texts]
            values = [scanner.score(max((x[2] for x in f), default=0.0), sum(x[2] for x in f)) for f in found]
            told = [[{"first": a, "last": b, "significance": s} for a, b, s in f] for f in found]
            yield pd.DataFrame({"score": values, "passages": told})
        scanner.known.clear()
        release()

    told = ["score", "passages", "predicted"]
    kept = [c for c in docs.columns if c.lower() not in told]
    out = packed(docs, _scan=scan(F.col(f"`{text_col}`").cast("string")))  # no column of the table can clash
    own = [F.col(f"_in.`{c}`").alias(c) for c in kept]
    return out.select(*own, "_scan.score", "_scan.passages", (F.col("_scan.score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    model = fit(docs, labels, config, id_col, text_col)
    rows = packed(docs, _text=F.col(text_col))
    return unpacked(score(rows, model, "_text").where("predicted = 0"), docs.columns)
