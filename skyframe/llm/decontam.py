"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions.

A window is ``width`` consecutive words of an item (all of a shorter one).  To
hold a whole window a text must hold each of its words, so of the window's words
in order of rarity (count over all documents, then the word) the first is a
sufficient prefix: only places where the text has that rarest word are joined.
The place of the word inside the window gives the place of the window inside the
text (positional bound), which must fit the text's length (length bound); there,
and only there, the window is compared word by word.

Words are exploded, joined and checked in one generated loop; only true
occurrences are shuffled.  The windows are broadcast while there are
``broadcast_windows`` at most (about 200 bytes each); beyond that the same join
is made by shuffling (id, place, word) and fetching the texts of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import lower_ascii, packed, unpacked

#: What separates words once A-Z are lower-cased: all of ASCII but 0-9 and a-z.
SEPARATORS = r"[\x00-/:-`{-\x7F]+"


def words_col(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window`` (array of words); items without id or words have none."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_col(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0))))
    return words.withColumn("at", begins).select("item", F.slice("words", F.col("at") + 1, width).alias("window")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 200_000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are
    the ids (as strings, sorted) of items with an occurring window.  Null and
    empty texts have no words and no hits; repeated rows give repeated results;
    without documents the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    windows = item_windows(items, width, item_id_col, item_text_col).withColumn("wid", F.md5(F.encode(F.array_join("window", " "), "utf-8")))
    windows = scratch.save(windows, "windows")
    distinct = windows.select("wid", "window").distinct()
    few = distinct.count() <= broadcast_windows
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_h"), words_col(F.col(text_col)).alias("words"))

    vocabulary = scratch.save(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    used = F.broadcast(vocabulary) if few else vocabulary
    counts = text.select(F.explode("words").alias("word")).join(used, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")

    placed = distinct.select("wid", "window", F.posexplode("window").alias("shift", "word")).join(F.broadcast(counts) if few else counts, "word")
    rarest = placed.groupBy("wid", "window").agg(F.count("*").alias("known"), F.min(F.struct("n", "word", "shift")).alias("p"))
    # a window with a word that no document has occurs nowhere
    prefix = rarest.where(F.col("known") == F.size("window")).select("wid", "window", F.size("window").alias("span"), "p.word", "p.shift")
    prefix = scratch.save(prefix, "prefix")

    found = _in_place(text, prefix) if few else _by_shuffle(text, prefix)
    spans = found.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "span")).alias("spans"))
    owners = windows.select("wid", "item")
    named = found.select("doc_id", "_h", "wid").distinct().join(F.broadcast(owners) if few else owners, "wid")
    named = named.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = spans.select("doc_id", "_h", _covered("spans").alias("n_hit"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["_h"].eqNullSafe(b["_h"])
    hits, named = scratch.save(hits, "hits"), scratch.save(named, "named")
    light = text.select("doc_id", "_h", F.size("words").cast("long").alias("n_words"))
    out = light.join(hits, same(light, hits), "left").select(light["doc_id"], light["_h"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))
    out = out.join(named, same(out, named), "left").select(out["doc_id"], out["_h"], "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("_h")


def _in_place(text: DataFrame, prefix: DataFrame) -> DataFrame:
    """Occurrences ``doc_id, _h, wid, start, span``, found where the words are."""
    places = text.select("doc_id", "_h", "words", F.posexplode("words").alias("place", "word"))
    start = F.col("place") - F.col("shift")
    fits = (places["word"] == prefix["word"]) & (start >= 0) & (start + F.col("span") <= F.size("words"))
    here = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("span")) == F.col("window")
    return places.join(F.broadcast(prefix), fits & here).select("doc_id", "_h", "wid", start.alias("start"), "span")


def _by_shuffle(text: DataFrame, prefix: DataFrame) -> DataFrame:
    """The same, for more windows than may be broadcast."""
    places = text.select("doc_id", "_h", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    start = F.col("place") - F.col("shift")
    likely = places.join(prefix.select("word", "shift", "span", "wid"), "word").where((start >= 0) & (start + F.col("span") <= F.col("n")))
    likely = likely.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "wid", start.alias("start")).distinct()
    asked = likely.select("_id", "_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash"))
    chosen = text.join(asked, same, "left_semi").dropDuplicates(["doc_id", "_h"])
    checked = chosen.join(likely, same).join(prefix.select("wid", "window", "span"), "wid")
    return checked.where(F.slice("words", F.col("start") + 1, F.col("span")) == F.col("window")).select("doc_id", "_h", "wid", "start", "span")


def _covered(spans: str) -> Column:
    """Length of the union of (start, span) intervals."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s.start + s.span
        return F.struct(F.greatest(acc.end, end).alias("end"), (acc.n + F.greatest(end - F.greatest(s.start, acc.end), F.lit(0))).cast("long").alias("n"))

    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc.n)


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with all columns.  A row is known by
    its id and text, so clean rows stay even if another row repeats their id."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    found = contamination(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")), items, width)
    bad = found.where("contaminated").select(F.col("doc_id.id").alias("_bad"), F.col("doc_id.h").alias("_bad_h")).distinct()
    bad = Scratch(docs.sparkSession, "decontam-drop").save(bad, "bad")
    rows = packed(docs, _id=F.col(id_col), _h=F.xxhash64(F.col(text_col).cast("string")))
    same = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_h") == F.col("_bad_h"))
    return unpacked(rows.join(bad, same, "left_anti"), docs.columns)
