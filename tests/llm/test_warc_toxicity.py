"""WARC fixity audit, toxic passages, and the pipeline."""

import random
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from skyframe.llm import queries, toxicity, warc
from skyframe.llm.store import Scratch
from skyframe.llm.toxicity import ToxicityConfig, maximal_segments


def pages(spark, n=150):
    rng = random.Random(1)
    rows = [(k, f"http://h{k}/x\r\ny", "<p>" + "é<b>" * rng.randint(0, 300), "k") for k in range(n)]
    rows += [(None, None, None, "k"), (n, "", "", "k"), (3, "http://h3/x\r\ny", "again", "k"), (n + 1, "u", "z" * 300_000, "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)


def test_warc_round_trip(spark):
    scratch, df = Scratch(spark, "w"), pages(spark)
    manifest = scratch.save(warc.write_warc(df, scratch.path("a"), max_bytes=4000, max_records=40), "m")
    assert manifest.select("key").distinct().count() == df.count()
    assert manifest.select("file").distinct().count() > 6
    want = sorted((r["page_id"], " ".join((r["url"] or "").split()), r["html"] or "") for r in df.where("page_id is not null").collect())
    assert sorted((r["page_id"], r["url"], r["html"]) for r in warc.read_warc(manifest, scratch.path("a")).where("page_id is not null").collect()) == want


def test_audit_finds_all_damage(spark):
    scratch = Scratch(spark, "w")
    a, b = scratch.path("a"), scratch.path("b")
    manifest = scratch.save(warc.write_warc(pages(spark), a, max_bytes=4000, max_records=40), "m")
    damaged = F.col("page_id") % 20 == 3
    scratch.save(warc.copy_replica(manifest, a, b, damaged), "copies")
    files = [r["file"] for r in manifest.select("file").distinct().orderBy("file").collect()]
    fs, base = pafs.FileSystem.from_uri(b)
    fs.delete_file(f"{base}/{files[0]}")
    with fs.open_input_file(f"{base}/{files[1]}") as f:
        data = f.read()
    with fs.open_output_stream(f"{base}/{files[1]}", compression=None) as f:
        f.write(data[:-7])
    got = warc.audit(manifest, (a, b), scratch).collect()
    assert len(got) == manifest.count() and all(r["intact_a"] for r in got)
    lasts = {r["file"]: r["place"] for r in manifest.groupBy("file").agg(F.max("place").alias("place")).collect()}
    for r in got:
        hurt = (r["page_id"] is not None and r["page_id"] % 20 == 3) or r["file"] == files[0] or (r["file"] == files[1] and r["place"] == lasts[files[1]])
        assert r["intact_b"] == (not hurt)


def test_audit_descends_only_where_roots_differ(spark):
    scratch = Scratch(spark, "w")
    manifest = scratch.save(warc.write_warc(pages(spark), scratch.path("a"), max_bytes=4000), "m")
    leaf = scratch.save(warc.leaves(manifest, scratch.path("a")), "l")
    tree = warc.tree(leaf, scratch, "t")
    assert tree[-1].count() == 1 and len(tree) > 2
    assert warc.differing(tree, tree, Scratch(spark, "d")).count() == 0
    empty = Scratch(spark, "e")
    nothing = empty.save(warc.write_warc(pages(spark).limit(0), empty.path("a")), "m")
    assert warc.audit(nothing, (empty.path("a"), empty.path("b")), empty).count() == 0


def test_warc_query_tells_the_planted_damage(spark):
    got = queries.op2_warc_fixity(spark, "/root/testdata/sf0.001").withColumn("planted", queries.planted_damage(F.col("page_id")))
    assert got.where("intact_a and intact_b != planted").count() == got.count() > 0


# --- toxicity ----------------------------------------------------------------


def brute_segments(values):
    """The best segment, then the same on both of its sides."""
    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        return [] if best is None else [*search(a, best[1]), (best[1], best[2], round(best[0], 6)), *search(best[2] + 1, b)]

    return search(0, len(values))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(500):
        gap = 0.5 + rng.random()
        values = [rng.choice([-gap, -gap, rng.random() * 3]) for _ in range(rng.randint(0, 25))]
        places = [k for k, v in enumerate(values) if v > 0]
        got = maximal_segments(places, [values[k] for k in places], gap)
        assert [(a, b, round(s, 6)) for a, b, s in got] == brute_segments(values)


def test_segments_take_linear_time():
    n = 300_000
    assert len(maximal_segments(list(range(0, 3 * n, 3)), [0.5] * n, 1.0)) == n


def corpus(spark, n=1500):
    rng = random.Random(6)
    clean, bad = [f"word{k}" for k in range(400)], ["vile", "rotten", "filthA", "filthB", "filthC"]
    docs, labels = [], []
    for k in range(n):
        text = rng.choices(clean, k=rng.randint(5, 80))
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad)
        docs.append((k, " ".join(text), "x"))
        labels.append((k, 1, int(toxic)))
    docs += [(n, "", "x"), (n + 1, None, "x"), (None, "vile rotten vile", "x"), (n + 2, "filthZ vile rotten " * 20_000, "x"), (n + 3, "word1 " * 50_000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).drop("passages")
    rows = scored.join(labels.drop("quality"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held) > 100
    by_id = {r["doc_id"]: r for r in scored.where("doc_id is null or doc_id >= 1500").collect()}
    assert by_id[1502]["predicted"] == 1 and by_id[None]["predicted"] == 1 and by_id[1503]["predicted"] == 0
    assert by_id[1500]["score"] == by_id[1501]["score"] < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1502").count() == 0 and kept.where("doc_id = 1503").count() == 1


def test_toxicity_does_not_learn_from_held_out_rows(spark):
    docs, labels = corpus(spark, 400)
    held = toxicity.fold_of(F.col("doc_id")) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 60)
    for few in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(docs, few, ToxicityConfig())
        assert toxicity.score(docs, model).where("score >= 0.5 or score is null").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- pipeline ----------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_near_dedup import brute
    from tests.llm.test_text_operators import brute_contamination, lower

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scanner = toxicity.Scanner(model)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scanner.score(*scanner.features(r["text"])) < 0.5]
    last = {}
    for i, t in rows:
        last[lower(t or "")] = max(i, last.get(lower(t or ""), i))
    rows = [(i, t) for i, t in rows if last[lower(t or "")] == i]
    groups = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, _, _, _, hit in brute_contamination(rows, items, 10) if hit}
    left = {i for i, _ in rows} - bad
    pieces = pipeline.run(spark, sf_dir).drop("ids").collect()
    assert {p["doc_id"] for p in pieces} == left and 0 < len(left) < docs.count()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
