"""The best interval for each query against plain comparison of all of them."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import alignment
from skyframe.operators.intervals import Intervals


def plain(held, start, end):
    def key(h):
        a, z, o = h
        us = max(0, min(end, z) - max(start, a))
        return (us == 0, -us, not a <= start <= z, abs(a - start), min(abs(a - start), abs(z - start)), o)

    best = min(held, key=key)
    return best[2], -key(best)[1]


@pytest.mark.parametrize("seed", range(60))
def test_against_all(seed):
    rng = random.Random(seed)
    width, n = rng.choice([(6, 5), (12, 9), (30, 40), (1000, 64)]), rng.randint(1, 70)
    held = [(a := rng.randint(0, width[0]), a + rng.randint(-2 if seed % 3 == 0 else 0, width[1]), o) for o in rng.sample(range(500), n)]
    asked = [(s := rng.randint(-5, width[0] + 10), s + rng.randint(-1, width[1] * 2)) for _ in range(200)]
    index = Intervals(*(np.array(c, np.int64) for c in zip(*held)))
    place, us = index.choose(*(np.array(c, np.int64) for c in zip(*asked)))
    assert list(zip(index.ord[place].tolist(), us.tolist())) == [plain(held, s, e) for s, e in asked]


@pytest.mark.parametrize("few", [10**6, 0])
def test_many_logs_that_all_overlap(spark, few):
    """Work must not grow with the logs that overlap a video: all pairs would be 1.2e9."""
    n = 40_000
    logs = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("l"), "id").alias("log_file"), F.lit("f").alias("folder"), F.col("id").alias("log_start_us"), (F.col("id") + 100 * n).alias("end_us"))
    videos = spark.range(30_000).select(F.col("id").alias("video"), (F.col("id") + 2000).alias("start_us"), F.lit(0.001).alias("duration_sec"))
    began = time.perf_counter()
    got = alignment.choose_logs(videos, logs, few).select("video", "log_start_us", "overlap_sec").collect()
    assert time.perf_counter() - began < 60
    assert sorted(map(tuple, got)) == [(k, k + 2000, 0.001) for k in range(30_000)]
