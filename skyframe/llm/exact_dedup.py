"""Skew-safe exact deduplication, on DataFrame functions only.

1. Rows are counted by SHA-256 digest (32 bytes; partial aggregation makes one
   row a digest and task).  Digests with a thousandth of all rows or more are
   *hot*: there are a thousand at most, so their list is small by definition.
2. Whole texts are grouped by (digest, salt, text): Spark first combines equal
   texts inside each task, then merges each salted group.  Only hot digests
   have more than one salt, so other texts are shuffled once.
3. The salt winners of hot digests are merged by (digest, text).  Grouping is by
   the text itself in both steps, so equal digests alone never merge texts.
4. Documents meet their group by digest.  A digest that stands for two different
   texts is seen in step 3; its documents are matched by text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, is_empty
from .text import lower_ascii, or_empty, packed, unpacked

#: A digest with 1/HOT_SHARE of all rows is salted, so there are HOT_SHARE at most.
HOT_SHARE = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, digest, keep_id, group_size, kept``.

    Null text counts as empty; texts are equal when identical after lower-casing
    A-Z.  The row with the largest id stays; among repeated rows with that same
    id all are marked kept (:func:`dedup` keeps one of them).  A null id never
    wins against another id; a group of null ids only has ``keep_id`` null and
    its rows are kept.  An empty table gives an empty table; further columns are
    not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = lower_ascii(or_empty(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("_text", "utf-8"), 256)))

    counts = scratch.save(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = docs.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE >= total).select("digest", F.lit(True).alias("_hot")))

    salted = rows.join(hot, "digest", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    salted = salted.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)))
    merged = scratch.save(
        salted.groupBy("digest", "_salt", "_text", "_hot").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(
            "digest", "_hot", F.when(F.col("_hot"), F.col("_text")).alias("_text"), "keep_id", "group_size"
        ),
        "merged",
    )
    winners = merged.where("_hot").groupBy("digest", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    cold = merged.where("not _hot").select("digest", "keep_id", "group_size")
    hot_groups = scratch.save(winners, "hot")
    clash = scratch.save(
        cold.groupBy("digest").count().where("count > 1").select("digest").unionByName(hot_groups.groupBy("digest").count().where("count > 1").select("digest")), "clash"
    )
    hot_groups = hot_groups.select("digest", "keep_id", "group_size")
    light = rows.select("doc_id", "digest")
    if not is_empty(clash):
        return _by_text(rows, clash, light, cold, hot_groups)
    return _kept(_by_digest(light, cold, hot_groups))


def _by_digest(light: DataFrame, cold: DataFrame, hot_groups: DataFrame) -> DataFrame:
    """Hot groups are few and broadcast; only groups of two rows or more are joined."""
    several = cold.where("group_size > 1").select("digest", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    few = hot_groups.select("digest", F.col("keep_id").alias("_hot_keep"), F.col("group_size").alias("_hot_size"))
    hot_rows = light.join(F.broadcast(few), "digest", "left")
    rest = hot_rows.where("_hot_size is null").drop("_hot_keep", "_hot_size").join(several, "digest", "left")
    rest = rest.select("doc_id", "digest", F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"))
    hot = hot_rows.where("_hot_size is not null").select("doc_id", "digest", F.col("_hot_keep").alias("keep_id"), F.col("_hot_size").alias("group_size"))
    return rest.unionByName(hot)


def _by_text(rows: DataFrame, clash: DataFrame, light: DataFrame, cold: DataFrame, hot_groups: DataFrame) -> DataFrame:
    """As :func:`_by_digest`, but documents of clashing digests are matched by text."""
    clear = _by_digest(light.join(clash, "digest", "left_anti"), cold.join(clash, "digest", "left_anti"), hot_groups.join(clash, "digest", "left_anti"))
    mixed = rows.join(clash, "digest", "left_semi")
    groups = mixed.groupBy("digest", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return _kept(clear.unionByName(mixed.join(groups, ["digest", "_text"]).select("doc_id", "digest", "keep_id", "group_size")))


def _kept(groups: DataFrame) -> DataFrame:
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row of each group.

    Of repeated rows with the id that stays one is returned, the largest as a
    whole, so the result is the same each run.  Rows with a null id are compared
    like others and stay only if no other id has the text.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    groups = exact_groups(docs, id_col, text_col)
    told = scratch.save(groups.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "told")
    norm = lower_ascii(or_empty(F.col(text_col)))
    rows = packed(docs, _id=F.col(id_col), _digest=F.unhex(F.sha2(F.encode(norm, "utf-8"), 256)))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    out = rows.join(told.where("not kept"), same, "left_anti")
    repeated = told.where("kept")
    if not is_empty(repeated):
        once = out.join(repeated, same, "left_semi").groupBy("_id", "_digest").agg(F.max("_in").alias("_in"))
        out = out.join(repeated, same, "left_anti").select("_in").unionByName(once.select("_in"))
    return unpacked(out, docs.columns)
