"""Near-duplicate components by MinHash bands, odd sketches and full sets.

1. Every text gives its shingle count, one key a band of MinHash samples, the odd
   sketch of the samples, and the odd sketch of its whole shingle set.  Texts
   with one word sequence are one class, a node of the graph of links.
2. A band's bucket of m classes gives m - 1 pairs: its least class (the leader)
   with each other one.  The set sketches' XOR population count is a lower bound
   of the symmetric difference, so a pair beyond the largest difference allowed
   is no link.  Of the others, those that the sample sketches, too, find similar
   (6 standard deviations) are confirmed on full sets first; what is left over
   between different components afterwards is confirmed as well.
3. Confirmed links are merged into components.
4. A bucket whose other members still lie in several components may hide links
   between them.  They meet in blocks of bounded size; a pair is judged in the
   first band that it shares.  Each member tells the nearest sketch of another
   component, and these pairs are confirmed: one row a member at most.
5. Blocks that still hold members of several components with a near sketch are
   settled on full sets inside the block, which gives out a spanning set of
   confirmed links: fewer rows than members.

In a bucket, members of its largest component need no comparison with each other,
so they are dealt once for each block of the rest: rows stay in proportion while
the rest is small.  No step gives out all pairs of a bucket.

The bands are chosen so that a pair at the threshold is missed with a
probability of 1e-7 at most; that is the only approximation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketch import Sketcher, plan_bands, sequence_key, sketch_limit, words_of
from .store import Scratch, is_empty
from .text import packed, unpacked
from .worker import bound_batches, release

#: Bits of a whole set's parity bitmap; classes, and shingles, along a block's side.
SET_BITS = 2048
BLOCK, BLOCK_SHINGLES = 512, 500_000

_SIGNATURE = "doc_id long, n_shingles long, class_key binary, bands array<long>, odd binary, parity binary"


@dataclass(frozen=True)
class NearDupConfig:
    """Link documents with ``percent`` % or more of Jaccard similarity of their
    sets of ``width`` consecutive words."""

    width: int = 5
    percent: int = 80

    @property
    def threshold(self) -> float:
        return self.percent / 100

    def most_differing(self, sizes: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets, given the sum of their sizes:
        J >= t  <=>  difference <= (1 - t) / (1 + t) * sum."""
        return (100 - self.percent) * sizes // (100 + self.percent)


def set_parity(shingles: np.ndarray) -> bytes:
    seats = (shingles % np.uint64(SET_BITS)).astype(np.int64)
    return np.packbits((np.bincount(seats, minlength=SET_BITS) & 1).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, config: NearDupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; texts without words have a null ``class_key``."""
    width, (bands, rows) = config.width, plan_bands(config.threshold)
    bound_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width, bands, rows)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "key", "bands", "odd", "parity")}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                shingles = sketcher.shingles(words)
                out["n"].append(len(shingles))
                if not words:
                    for c in ("key", "bands", "odd", "parity"):
                        out[c].append(None)
                    continue
                samples = sketcher.samples(shingles)
                out["key"].append(sequence_key(words))
                out["bands"].append(sketcher.band_keys(samples))
                out["odd"].append(sketcher.odd(samples).tobytes())
                out["parity"].append(set_parity(shingles))
            kinds = {"n": pa.int64(), "key": pa.binary(), "bands": pa.list_(pa.int64()), "odd": pa.binary(), "parity": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[k]) for k, v in out.items())], ["doc_id", "n_shingles", "class_key", "bands", "odd", "parity"])
        del sketcher
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, _SIGNATURE)


def _bits(values: pd.Series | list) -> np.ndarray:
    rows = b"".join(values)
    return np.frombuffer(rows, np.uint64).reshape(len(values), -1)


def _bits(values: pd.Series | list) -> np.ndarray:
    rows = b"".join(values)
    return np.frombuffer(rows, np.uint64).reshape(len(values), -1)


def _sketches_allow(config: NearDupConfig):
    """Of a pair's sketches: null where the set sketches rule a link out, else whether
    the sample sketches find the pair similar, too."""
    bands, rows = plan_bands(config.threshold)
    limit = sketch_limit(config.threshold, bands * rows)

    @F.pandas_udf("boolean")
    def allow(odd_a: pd.Series, odd_b: pd.Series, parity_a: pd.Series, parity_b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="boolean")
        sampled = np.bitwise_count(_bits(odd_a) ^ _bits(odd_b)).sum(axis=1)
        whole = np.bitwise_count(_bits(parity_a) ^ _bits(parity_b)).sum(axis=1)
        return pd.Series(sampled <= limit, dtype="boolean").mask(whole > config.most_differing(n.to_numpy()))

    return allow


def _shingle_set(text: str, width: int) -> set:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def _similar(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def _linked(config: NearDupConfig):
    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last_text, last_set = None, set()
        for text_a, text_b in batches:
            out = []
            for a, b in zip(text_a, text_b):
                if a != last_text:
                    last_text, last_set = a, _shingle_set(a, config.width)
                out.append(_similar(last_set, _shingle_set(b, config.width), config.percent))
            yield pd.Series(out, dtype=bool)
        release()

    return linked


def _class_key():
    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sequence_key(words_of(t)))

    return key


class _Texts:
    """The text of each node: that row of its least document whose class it is."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, repeated: bool, scratch: Scratch) -> None:
        self.docs, self.nodes, self.repeated, self.scratch = docs, nodes, repeated, scratch

    def of(self, wanted: DataFrame, name: str) -> DataFrame:
        """``node, text`` for the column ``node`` of a written table.  Spark knows the
        size of what is wanted and broadcasts it only below its threshold."""
        needed = self.nodes.join(wanted.select("node").distinct(), "node", "left_semi")
        needed = self.scratch.save(needed.select(F.col("rep").alias("doc_id"), "node", "class_key"), f"{name}-ids")
        found = self.docs.join(needed, "doc_id")
        if self.repeated:  # an id with several texts: only the node's own
            found = found.where(_class_key()("text") == F.col("class_key"))
        found = self.scratch.save(found.select("node", "text"), f"{name}-texts")
        self.scratch.drop(f"{name}-ids")
        return found


def _confirm(pairs: DataFrame, texts: _Texts, config: NearDupConfig, scratch: Scratch, name: str) -> DataFrame:
    """Of ``a, b`` pairs (a written table), those whose full sets are linked."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    chosen = texts.of(both, name)
    left, right = chosen.select(F.col("node").alias("a"), F.col("text").alias("text_a")), chosen.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    found = pairs.join(right, "b").join(left, "a").where(_linked(config)("text_a", "text_b")).select("a", "b").distinct()
    found = scratch.save(found, f"{name}-links")
    scratch.drop(f"{name}-texts")
    return found


def _nodes(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``class_key, rep, node`` of each class, and whether an id has several classes.

    A class's node is its least document id; where that id stands for another class
    already, a number from the class key that nothing else has."""
    worded = signed.where("doc_id is not null and class_key is not null")
    classes = scratch.save(worded.groupBy("class_key").agg(F.min("doc_id").alias("rep")), "classes")
    shared = scratch.save(classes.groupBy("rep").count().where("count > 1").select("rep"), "shared")
    if is_empty(shared):
        return classes.withColumn("node", F.col("rep")), not is_empty(_several(worded))
    extra = classes.join(shared, "rep", "left_semi")
    first = extra.groupBy("rep").agg(F.min("class_key").alias("class_key"))
    extra = scratch.save(extra.join(first, ["rep", "class_key"], "left_anti"), "extra")
    plain = classes.join(extra, "class_key", "left_anti").withColumn("node", F.col("rep"))
    salt = 0
    while True:  # numbers that meet each other or an id are made anew
        numbered = scratch.save(extra.withColumn("node", F.xxhash64("class_key", "rep", F.lit(salt))), f"extra-{salt}")
        clash = numbered.groupBy("node").count().where("count > 1").select("node").unionByName(numbered.join(signed.select(F.col("doc_id").alias("node")), "node", "left_semi").select("node"))
        if is_empty(clash):
            break
        salt += 1
    return scratch.save(plain.unionByName(numbered.select(*plain.columns)), "nodes"), True


def _several(worded: DataFrame) -> DataFrame:
    """Ids that have several classes, with the least and the greatest of them."""
    keys = worded.groupBy("doc_id", "class_key").agg(F.lit(1).alias("one"))
    return keys.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")


def _merged(known: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` after some more links: only components are linked anew."""
    if is_empty(links):
        return known
    a, b = known.select(F.col("node").alias("a"), F.col("component").alias("ca")), known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = components(lifted, scratch, name)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(known, "node", "left_anti").withColumn("component", F.col("node"))
    whole = known.unionByName(fresh).join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return scratch.save(whole.select("node", F.coalesce("top", "component").alias("component")), f"{name}-merged")


def near_groups(docs: DataFrame, config: NearDupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts without words (null, empty, white space) have no shingles and are
    linked with nothing.  Rows that repeat an id are each returned; where their
    texts differ, each text has its own links, and all that any of them links is
    one component, as the id itself links its rows.  Rows with a null id are not
    linked: their component is null.  An empty table gives an empty one; further
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(signatures(docs, config, id_col, text_col), "signed")
    nodes, repeated = _nodes(signed, scratch)
    texts = _Texts(own, nodes, repeated, scratch)
    # one signature a class, fetched by its least document so that rows move once
    standing = signed.join(nodes.select(F.col("rep").alias("doc_id"), "class_key", "node"), ["doc_id", "class_key"]).dropDuplicates(["doc_id", "class_key"])
    standing = scratch.save(standing.drop("doc_id", "class_key"), "standing")

    rows = scratch.save(standing.select(F.explode("bands").alias("bucket"), F.col("node").alias("member"), "n_shingles"), "rows")
    buckets = rows.groupBy("bucket").agg(F.min("member").alias("leader"), F.max("member").alias("top"), F.count("*").alias("n"))
    buckets = scratch.save(buckets.where("leader != top").select("bucket", "leader", "n"), "buckets")
    several = scratch.save(rows.join(buckets, "bucket").where("member != leader"), "several")
    scratch.drop("rows")

    pairs = several.select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct()
    ours = standing.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("odd").alias("oa"), F.col("parity").alias("pa"))
    theirs = standing.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("odd").alias("ob"), F.col("parity").alias("pb"))
    allowed = pairs.join(theirs, "b").join(ours, "a").select("a", "b", _sketches_allow(config)("oa", "ob", "pa", "pb", F.col("na") + F.col("nb")).alias("similar"))
    allowed = scratch.save(allowed.where("similar is not null"), "allowed")
    links = _confirm(allowed.where("similar").select("a", "b"), texts, config, scratch, "first")
    if repeated:  # an id links its rows' classes
        held = signed.join(nodes.select("class_key", "node"), "class_key").where("doc_id is not null").join(_several(signed.where("class_key is not null")), "doc_id", "left_semi")
        tied = held.select("doc_id", "node").join(held.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id")
        links = links.unionByName(scratch.save(tied.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "tied"))
    known = components(links, scratch, "first-components")

    open_rows = scratch.save(_open_rows(several, known, scratch), "open-rows")
    flagged = scratch.save(_near_members(open_rows, standing, config), "flagged")
    apart = _apart(allowed.where("not similar").select("a", "b"), known)
    nearest = flagged.select(F.least("member", "near").alias("a"), F.greatest("member", "near").alias("b"))
    more = _confirm(scratch.save(apart.unionByName(nearest).distinct(), "nearest"), texts, config, scratch, "second")
    known = _merged(known, more, scratch, "second-components")

    left = scratch.save(_open_blocks(flagged, known), "left")
    if not is_empty(left):
        wanted = texts.of(left.select(F.col("member").alias("node")), "third")
        inside = left.join(wanted.withColumnRenamed("node", "member"), "member")
        known = _merged(known, scratch.save(_settle(inside, config), "third-links"), scratch, "third-components")

    by_class = nodes.join(known, "node", "left").select("class_key", "rep", F.coalesce("component", "node").alias("component"))
    by_class = scratch.save(by_class, "by-class")
    if repeated:  # a component's least node may be a made number
        least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
        by_class = scratch.save(by_class.join(least, "component").select("class_key", "component_id"), "by-class-id")
    else:
        by_class = by_class.select("class_key", F.col("component").alias("component_id"))
    light = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_key")).alias("class_key"))
    out = light.join(by_class, "class_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    scratch.keep("signed", "by-class", "by-class-id")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that are not in one component."""
    a, b = known.select(F.col("node").alias("a"), F.col("component").alias("ca")), known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("ca is null or cb is null or ca != cb").select("a", "b")


def _open_rows(several: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """``bucket, member, n_shingles, component`` of buckets whose members, leader
    apart, lie in several components."""
    rows = several.where("n > 2").select("bucket", "member", "n_shingles").join(known.withColumnRenamed("node", "member"), "member", "left")
    rows = scratch.save(rows.select("bucket", "member", "n_shingles", F.coalesce("component", "member").alias("component")), "unsettled")
    open_ = rows.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("bucket")
    return rows.join(scratch.save(open_, "open"), "bucket", "left_semi")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``x, y, side``: each bucket's members dealt to sides of bounded
    size, and to each block of two sides that may hold a pair of two components."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
    size = F.greatest(F.col("c") / F.lit(BLOCK), F.col("w") / F.lit(BLOCK_SHINGLES)).alias("size")
    whole = sizes.select("bucket", "component", size).groupBy("bucket").agg(F.max_by("component", "size").alias("main"), F.max("size").alias("large"), F.sum("size").alias("all"))
    whole = whole.select("bucket", "main", F.ceil("large").cast("int").alias("m"), F.ceil(F.greatest(F.col("all") - F.col("large"), F.lit(1e-9))).cast("int").alias("r"), (F.col("all") <= 1).alias("one"))
    dealt = rows.join(whole, "bucket")
    in_main, at = F.col("component") == F.col("main"), F.xxhash64("member")
    side = F.when(F.col("one"), 0).when(in_main, F.pmod(at, F.col("m"))).otherwise(F.col("m") + F.pmod(at, F.col("r"))).cast("int")
    last = F.col("m") + F.col("r") - 1
    others = F.when(F.col("one"), F.array(F.lit(0))).when(in_main, F.sequence(F.col("m"), last)).otherwise(F.sequence(F.lit(0), last))
    dealt = dealt.withColumn("side", side).withColumn("other", F.explode(others))
    return dealt.select(*rows.columns, F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """Each block's rows one after the other in one task."""
    return rows.select("bucket", "x", "y", *columns).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def _near_members(open_rows: DataFrame, standing: DataFrame, config: NearDupConfig) -> DataFrame:
    """``bucket, x, y, member, near``: members that may have a link into another
    component within their block, with the partner of the nearest set sketch.

    A pair counts in the first band that it shares; there it meets in this step or
    is a pair of the bucket's leader, which is judged before."""
    signed = standing.select(F.col("node").alias("member"), "n_shingles", "parity", "bands")
    dealt = _blocks(open_rows)
    dealt = _in_blocks(dealt.drop("n_shingles").join(signed, "member"), "side", "member", "component", "n_shingles", "parity", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "x", "y", "member", "near"]
        out: list[list] = [[] for _ in names]
        for block in _runs(batches, 3):
            bucket, x, y = (block.column(k)[0].as_py() for k in range(3))
            side, ids, groups, sizes = (block.column(k).to_numpy() for k in (3, 4, 5, 6))
            bits = _bits(block.column(7).to_pylist())
            bands = block.column(8).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            best = np.full(len(ids), np.iinfo(np.int64).max)
            near = np.zeros(len(ids), np.int64)
            seconds = np.flatnonzero(side == y)
            for k in np.flatnonzero(side == x):
                ask = seconds[(groups[seconds] != groups[k]) & ((x != y) | (seconds > k))]
                if not len(ask):
                    continue
                apart = np.bitwise_count(bits[ask] ^ bits[k]).sum(axis=1).astype(np.int64)
                fits = apart <= config.most_differing(sizes[ask] + sizes[k])
                ask, apart = ask[fits], apart[fits]
                if len(ask):
                    common = bands[ask] == bands[k]
                    first = bands[k][common.argmax(axis=1)] == bucket
                    ask, apart = ask[first], apart[first]
                if len(ask):
                    closer = apart < best[ask]
                    best[ask[closer]], near[ask[closer]] = apart[closer], ids[k]
                    j = int(apart.argmin())
                    if apart[j] < best[k]:
                        best[k], near[k] = apart[j], ids[ask[j]]
            found = np.flatnonzero(best < np.iinfo(np.int64).max)
            for column, values in zip(out, ([bucket] * len(found), [x] * len(found), [y] * len(found), ids[found].tolist(), near[found].tolist())):
                column.extend(values)
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return dealt.mapInArrow(compare, "bucket long, x long, y long, member long, near long")


def _open_blocks(flagged: DataFrame, known: DataFrame) -> DataFrame:
    """``bucket, x, y, member, component`` of blocks with several components left."""
    block = ["bucket", "x", "y"]
    rows = flagged.select(*block, "member").join(known.withColumnRenamed("node", "member"), "member", "left")
    rows = rows.select(*block, "member", F.coalesce("component", "member").alias("component"))
    open_ = rows.groupBy(*block).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select(*block)
    return rows.join(open_, block, "left_semi")


def _settle(rows: DataFrame, config: NearDupConfig) -> DataFrame:
    """``a, b``: confirmed links that join all linked components of each block.

    Pairs of different components are compared by their sets' 64-bit hashes, nearest
    sketches apart, and confirmed on the sets themselves; joined components are not
    compared again, so a block gives fewer links than it has members."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(config.width, 1, 1)
        for block in _runs(batches, 3):
            ids, firsts = np.unique(block.column("member").to_numpy(), return_index=True)
            groups = block.column("component").to_numpy()[firsts].copy()
            texts = [block.column("text")[int(k)].as_py() for k in firsts]
            sets = [sketcher.shingles(words_of(t)) for t in texts]
            sizes = np.array([len(s) for s in sets])
            bits = _bits([set_parity(s) for s in sets])
            found: list[tuple[int, int]] = []
            for k in range(len(ids)):
                near = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1) <= config.most_differing(sizes[k + 1 :] + sizes[k])
                for j in (np.flatnonzero(near) + k + 1).tolist():
                    if groups[j] == groups[k]:
                        continue
                    both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if both and 100 * both >= config.percent * (sizes[k] + sizes[j] - both) and _similar(_shingle_set(texts[k], config.width), _shingle_set(texts[j], config.width), config.percent):
                        found.append((int(ids[k]), int(ids[j])))
                        groups[groups == groups[j]] = groups[k]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])
        del sketcher
        release()

    return _in_blocks(rows, "member", "component", "text").mapInArrow(settle, "a long, b long").distinct()


def dedup(docs: DataFrame, config: NearDupConfig = NearDupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the least id,
    with all columns.  Rows with a null id stay."""
    gone = near_groups(docs, config, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(docs.sparkSession, "near-dedup").save(gone, "gone")
    return unpacked(packed(docs, _id=F.col(id_col).cast("long")).join(gone, F.col("_id") == F.col("_gone"), "left_anti"), docs.columns)
