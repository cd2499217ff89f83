"""Features that are made once and kept as a table, and matches between images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.progress import Progress, told
from .matching import MatcherConfig, extract_features, mutual_matches

_FEATURES = "features array<struct<x:double,y:double,desc:array<double>>>"


class FeatureTable:
    """Features of reference images (``id, width, height, pixels``) below ``folder``,
    which driver and executors share; one table per extractor setting.

    Each image's features are made once, whoever asks again joins the table:
    :meth:`fill` makes all that are missing beforehand, :meth:`of` those of the
    images asked for.  An id names one image; of repeated ids one is taken.
    """

    def __init__(self, spark: SparkSession, folder: str, config: MatcherConfig, id_col: str = "tile_ord", kind: str = "long", progress: Progress | None = None) -> None:
        self.spark, self.config, self.id_col, self.progress = spark, config, id_col, progress
        self.path = f"{folder.rstrip('/')}/{config.backend}-{config.max_keypoints}-{config.resize}"
        self.schema = f"`{id_col}` {kind}, {_FEATURES}"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def fill(self, images: DataFrame) -> None:
        """Add the features of images that have none yet."""
        told(self.progress, "reference_features_start")
        missing = images.join(self.stored().select(self.id_col), self.id_col, "left_anti").dropDuplicates([self.id_col])
        kind = self.stored().schema[self.id_col].dataType
        made = extract_features(missing.withColumn(self.id_col, F.col(self.id_col).cast(kind)), self.config, self.id_col)
        made.write.mode("append").parquet(self.path)
        told(self.progress, "reference_features_ready")

    def of(self, images: DataFrame) -> DataFrame:
        """``id, features`` of these images."""
        self.fill(images)
        return self.stored().join(images.select(self.id_col).distinct(), self.id_col, "left_semi")


def match_feature_sets(pairs: DataFrame, queries: DataFrame, references: DataFrame, config: MatcherConfig, query: list[str], reference: list[str]) -> DataFrame:
    """Matches of each pair of images (``pairs``: the key columns ``query`` and
    ``reference``, which may share names; ``queries`` and ``references``: key and ``features``): the keys and
    ``query_id, ref_id, qx, qy, rx, ry, conf``.  Keypoints are numbered from 0."""
    key = list(dict.fromkeys([*query, *reference]))

    def points(side: DataFrame, own: list[str]) -> DataFrame:
        return pairs.select(*key).distinct().join(side.select(*own, "features"), own).select(*key, F.posexplode("features").alias("id", "_p")).select(*key, "id", "_p.*")

    q, r = points(queries, query), points(references, reference)
    found = mutual_matches(q.select(*key, "id", "desc"), r.select(*key, "id", "desc"), config.filter_threshold, key)
    placed = found.join(q.select(*key, F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), [*key, "query_id"])
    placed = placed.join(r.select(*key, F.col("id").alias("ref_id"), F.col("x").alias("rx"), F.col("y").alias("ry")), [*key, "ref_id"])
    return placed.select(*key, "query_id", "ref_id", "qx", "qy", "rx", "ry", F.col("score").alias("conf"))


def match_images(queries: DataFrame, references: DataFrame, config: MatcherConfig, pair: str = "pair") -> DataFrame:
    """Matches between the two images of each pair, from their pixels: both sides have
    ``pair, width, height, pixels``, one image a pair; features are not kept."""
    q, r = extract_features(queries, config, pair), extract_features(references, config, pair)
    both = q.select(pair).join(r.select(pair), pair)
    return match_feature_sets(both, q, r, config, [pair], [pair])
