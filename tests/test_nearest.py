"""Mutual nearest descriptors in blocks against plain comparison of all pairs."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import matching


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def plain(q, r, threshold):
    """q, r: (group, id, descriptor) with ids that may repeat."""
    best = {}
    for g, i, a in q:
        for h, j, b in r:
            if g == h and len(a) == len(b):
                s = dot(a, b)
                for at, key in ((("q", g, i), (s, -j)), (("r", g, j), (s, -i))):
                    best[at] = max(best.get(at, key), key)
    return sorted((g, i, -o, s) for (kind, g, i), (s, o) in best.items() if kind == "q" and s >= threshold and best["r", g, -o][1] == -i)


@pytest.mark.parametrize("block", [5, matching.BLOCK])
@pytest.mark.parametrize("case", ["normal", "ties", "copies", "repeated ids", "huge", "lengths"])
def test_against_all_pairs(spark, case, block):
    rng = random.Random(case)
    draw = {"ties": lambda: float(rng.randint(-1, 1)), "huge": lambda: rng.choice([1e200, -1e-200, 1.0])}.get(case, lambda: rng.gauss(0, 1))
    rows = []
    for k in range(90):
        old = rng.choice(rows)[2] if rows and case == "copies" and rng.random() < 0.7 else None
        ident = rng.randint(0, 25) if case == "repeated ids" else k
        rows.append((rng.choice("ab"), ident, old or [draw() for _ in range(rng.choice([2, 3]) if case == "lengths" else 3)], rng.random() < 0.5))
    sides = [[t[:3] for t in rows if t[3] == ref] for ref in (False, True)]
    tables = [spark.createDataFrame([*side, ("a", 900, None), ("a", 901, [1.0, None, 99.0])], "g string, id long, desc array<double>") for side in sides]
    got = matching.mutual_matches(*tables, 0.0, ["g"], block)
    assert sorted(map(tuple, got.collect())) == plain(*sides, 0.0)


@pytest.mark.parametrize("draw", ["normal", "ties"])
def test_tiles_hold_few_products(draw):
    """Products of 512 rows with all references were held at once before (a peak of 189 MB here)."""
    rng = np.random.default_rng(8)
    q, r = (rng.normal(size=(n, 12)) if draw == "normal" else rng.integers(-1, 2, (n, 12)).astype(float) for n in (1100, 40_000))
    q_ids, r_ids = rng.permutation(len(q)), rng.permutation(len(r))
    tracemalloc.start()
    to_r, q_score, to_q, r_score = matching.nearest_both_ways(q, r, q_ids, r_ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = sum(q[:, k][:, None] * r[:, k] for k in range(12))
    assert (q_score == scores.max(axis=1)).all() and (r_score == scores.max(axis=0)).all()
    least = lambda ids, of: np.where(of, ids, 1 << 40).min(axis=1)
    assert (r_ids[to_r] == least(r_ids, scores == q_score[:, None])).all()
    assert (q_ids[to_q] == least(q_ids, (scores == r_score).T)).all()
    assert draw == "ties" or most < 40e6


def test_no_step_gives_out_pairs(spark):
    """Twice 6000 descriptors, a third of them copies of one: 36,000,000 pairs."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=(6000, 16)).astype(np.float32).astype(float)
    q[::3] = q[0]
    turn = rng.permutation(6000)
    a = spark.createDataFrame([(k, v) for k, v in enumerate(q.tolist())], "id long, desc array<float>")
    b = spark.createDataFrame([(k, q[turn[k]].tolist()) for k in range(6000)], "id long, desc array<float>")
    found = matching.mutual_matches(a, b, 0.0)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    scores = q @ q[turn].T
    pairs = {(r["query_id"], r["ref_id"]) for r in found.collect()}
    to_r, to_q = scores.argmax(axis=1), scores.argmax(axis=0)
    distinct = {(i, int(j)) for i, j in enumerate(to_r) if to_q[j] == i and i % 3 and turn[j] % 3}
    assert distinct <= pairs and len(pairs) > 1000


def test_match_threshold_of_one_large_pair(spark, tmp_path):
    """36,000,000 pairs in one group: one task took all of them before."""
    from skyframe.plans import queries

    n, rng = 12_000, np.random.default_rng(5)
    desc = rng.normal(size=(n, 64)).astype(np.float32)
    desc[n // 2 :] = desc[: n // 2] * np.float32(2)
    rows = pd.DataFrame({"vec_id": np.arange(n), "embedding": desc.tolist(), "label": np.repeat([0, 5], n // 2)})
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.perf_counter()
    got = queries.f_match_threshold(spark, str(tmp_path)).collect()
    assert time.perf_counter() - began < 30
    half = desc[: n // 2].astype(float)
    scores = half @ (2 * half).T
    assert [(r["pair"], r["match_count"]) for r in got] == [(0, int((scores.argmax(axis=0)[scores.argmax(axis=1)] == np.arange(n // 2)).sum()))]
    assert abs(got[0]["best"] - scores.max()) < 1e-5
