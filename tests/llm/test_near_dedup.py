"""MinHash near-dedup against brute force."""

import random

import numpy as np
import pytest

from skyframe.llm import minhash_dedup
from skyframe.llm.components import components
from skyframe.llm.minhash_dedup import NearDupConfig, near_groups
from skyframe.llm.sketch import Sketcher, plan_bands, sketch_limit, words_of
from skyframe.llm.store import Scratch


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n_bases=6, copies=40, length=120):
    rows = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 9)):
                text[rng.randrange(length)] = f"w{rng.randrange(3000)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, width, percent, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)  # several blocks a bucket
    rows = near_copies(random.Random(width)) + [(9000, ""), (9001, None), (9002, "a b"), (9003, "A  b"), (9004, "a"), (9005, " \t\n"), (9006, "é É"), (9007, "é é")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(docs, NearDupConfig(width, percent)).collect()}
    assert got == brute(rows, width, percent)
    kept = minhash_dedup.dedup(docs, NearDupConfig(width, percent))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_near_groups_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs, NearDupConfig(3, 85)).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_groups(docs.limit(0), NearDupConfig()).count() == 0


def test_long_text_and_its_copy(spark):
    base = [f"v{k}" for k in range(30_000)]
    other = list(base)
    other[5::500] = ["odd"] * len(other[5::500])
    docs = spark.createDataFrame([(4, " ".join(base)), (7, " ".join(other))], "doc_id long, text string")
    assert {r["component_id"] for r in near_groups(docs, NearDupConfig(5, 80)).collect()} == {4}


def test_bands_and_sketch_limits():
    for threshold in (0.8, 0.85, 0.9):
        bands, rows = plan_bands(threshold)
        assert (1 - threshold**rows) ** bands <= 1e-7 and bands * rows <= 240
    rng = np.random.default_rng(1)
    bands, rows = plan_bands(0.8)
    sketcher, limit = Sketcher(5, bands, rows), sketch_limit(0.8, bands * rows)
    for _ in range(30):
        core, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = np.unique(np.concatenate([core, a])), np.unique(np.concatenate([core, b]))
        odd = sketcher.odd(sketcher.samples(x)) ^ sketcher.odd(sketcher.samples(y))
        assert np.bitwise_count(odd).sum() <= limit


def test_set_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 3000, 2))
        apart = np.frombuffer(minhash_dedup.set_parity(x), np.uint8) ^ np.frombuffer(minhash_dedup.set_parity(y), np.uint8)
        assert np.bitwise_count(apart).sum() <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 150), (200, 150)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    want = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {150: 150, 200: 150}
    assert got == want
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_an_id_with_several_texts_loses_no_link(spark):
    a = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(a)), (1, "quite another text of its own here"), (7, " ".join(a)), (9, " ".join([*a[:-1], "x"])), (12, "quite another text of its own here"), (11, "alone")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(docs, NearDupConfig(3, 85)).collect()}
    assert got == {(1, 1, True), (7, 1, False), (9, 1, False), (12, 1, False), (11, 11, True)}


def test_repeated_ids_with_a_shared_least_id(spark):
    """Every text stands for a class whose least id is 3; no id links them but 3."""
    rows = [(3, f"text {t} " + " ".join(f"{t}w{k}" for k in range(40))) for t in range(5)] + [(20 + t, f"text {t} " + " ".join(f"{t}w{k}" for k in range(39)) + " end") for t in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), NearDupConfig(3, 85)).collect()}
    assert got == {3: 3} | {20 + t: 3 for t in range(5)}


@pytest.mark.parametrize("block", [4, 64])
def test_one_bucket_of_many_texts_gives_fewer_links_than_members(spark, block, monkeypatch):
    """All pairs of a group are near the threshold, and they share most bands."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(400), 7):
            text[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    given, real = [], minhash_dedup._settle

    def settle(rows, config):
        links = real(rows, config)
        given.append((links.count(), rows.count()))
        return links

    monkeypatch.setattr(minhash_dedup, "_settle", settle)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), NearDupConfig(3, 85)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert all(links < members for links, members in given)


def test_blocks_hold_each_pair_of_two_components_once(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rows = [(5, k, 0 if k < 40 else 100 + k % 7, 10) for k in range(60)] + [(6, k, k % 2, 10) for k in range(4)]
    dealt = minhash_dedup._blocks(spark.createDataFrame(rows, "bucket long, member long, component long, n_shingles long")).collect()
    met: dict[tuple, int] = {}
    for one in dealt:
        for two in dealt:
            if (one["bucket"], one["x"], one["y"]) == (two["bucket"], two["x"], two["y"]) and one["side"] == one["x"] and two["side"] == two["y"] and one["component"] != two["component"]:
                pair = (one["bucket"], *sorted((one["member"], two["member"])))
                if one["x"] != one["y"] or one["member"] < two["member"]:
                    met[pair] = met.get(pair, 0) + 1
    want = {(b, i, j) for b, i, c, _ in rows for b2, j, d, _ in rows if b == b2 and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}
    assert len([r for r in dealt if r["bucket"] == 5 and r["component"] == 0]) <= 40 * 4


def test_rows_of_open_buckets_meet_their_signatures_once(spark):
    """Each join of them makes a row for each member and band that it shares."""
    open_rows = spark.createDataFrame([(1, 2, 5, 2), (1, 3, 5, 3)], "bucket long, member long, n_shingles long, component long")
    standing = spark.createDataFrame([], "node long, n_shingles long, odd binary, parity binary, bands array<long>")
    plan = minhash_dedup._near_members(open_rows, standing, NearDupConfig(5, 80))._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join" in line and "(member#" in line]) == 1
