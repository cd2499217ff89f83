"""As-of neighbours, interpolation and time bases against plain Python."""

import math
import random
import time
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from skyframe.operators import timeseries


def lookup(points, t, angle=False):
    """points: sorted (t, value or None) lists of one series."""
    if not points:
        return None
    if t <= points[0][0]:
        return points[0][1]
    if t >= points[-1][0]:
        return points[-1][1]
    k = max(1, bisect_left([p[0] for p in points], t))
    (t0, v0), (t1, v1) = points[k - 1], points[k]
    if t1 <= t0:
        return v0
    if v0 is None or v1 is None:
        return v1 if v0 is None else v0
    alpha = (t - t0) / (t1 - t0)
    if angle:
        return (v0 + ((v1 - v0 + 180) % 360 - 180) * alpha) % 360
    return v0 + (v1 - v0) * alpha


@pytest.mark.parametrize("bucket", [7, 1000, 10**9])
@pytest.mark.parametrize("angle", [False, True])
def test_interpolate(spark, bucket, angle):
    rng = random.Random(bucket)
    points, probes = [], []
    for key in range(6):
        for n in range(rng.randint(0, 40)):
            points.append((key, rng.randint(0, 300), rng.choice([None, 0.0, rng.uniform(0, 360)]), n))
        probes += [(key, rng.randint(-20, 320), 100 * key + n) for n in range(30)]
    probes += [(99, 5, 9000), (None, 5, 9001), (1, None, 9002), (2, 50, 9003), (2, 50, 9003)]
    p = spark.createDataFrame(points, "key int, t long, v double, n int").repartition(3)
    q = spark.createDataFrame(probes, "key int, t long, probe long").repartition(2)
    got = timeseries.interpolate(p, q, "key", "t", [] if angle else ["v"], ["v"] if angle else [], "n", bucket).collect()
    assert len(got) == len(probes)
    for r in got:
        series = sorted(((t, n, v) for k, t, v, n in points if k == r["key"]), key=lambda x: x[:2])
        want = lookup([(t, v) for t, _, v in series], r["t"], angle) if r["t"] is not None else None
        assert (r["v"] is None) == (want is None), (r, want)
        assert want is None or math.isclose(r["v"], want, abs_tol=1e-9)


def base(anchors, t):
    """Linear between anchors, beyond them along the two at the end; in seconds."""
    if not anchors or t is None:
        return None
    xs, ys = [a for a, _ in anchors], [b for _, b in anchors]
    if len(xs) == 1:
        return ys[0]
    k = bisect_left(xs, t)
    i, j = (0, 1) if k <= 0 else (-2, -1) if k >= len(xs) else (k - 1, k)
    ratio = 0.0 if xs[j] == xs[i] else (t - xs[i]) / float(xs[j] - xs[i])
    return ys[i] + ratio * (ys[j] - ys[i])


@pytest.mark.parametrize("bucket", [50, 10**9])
def test_time_base(spark, bucket):
    rng = random.Random(3)
    fixes = [("a", x, 1_600_000_000_000_000 + 1000 * x + rng.randint(0, 99)) for x in rng.sample(range(1000), 12)] + [("b", 500, 7_000_000)]
    rows = [(k, rng.randint(-500, 1500), n) for n, k in enumerate("aabc" * 20)] + [("a", None, 900), ("b", None, 901)]
    f = spark.createDataFrame(fixes, "log string, x long, utc_us long")
    got = timeseries.time_base(f, spark.createDataFrame(rows, "log string, x long, n int"), "log", "x", bucket_us=bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(sorted((x, u / 1e6) for k, x, u in fixes if k == r["log"]), r["x"])
        assert (r["utc_us"] is None) == (want is None)
        assert want is None or abs(r["utc_us"] - want * 1e6) <= 1


def test_fusion_falls_back_where_attitude_is_zero_or_missing(spark):
    names = ["latitude", "longitude", "altitude_m"]
    ahr = spark.createDataFrame([("f", 1, 0, 0.0, 5.0, None, 350.0, 1.0, 2.0), ("f", 2, 10, 0.0, 7.0, None, 10.0, 3.0, 4.0)], "flight string, line_no long, t long, latitude double, longitude double, altitude_m double, yaw_deg double, roll_deg double, pitch_deg double")
    gps = spark.createDataFrame([("f", 1, 0, 1.0, 2.0, 3.0, 4.0, 5.0)], "flight string, line_no long, t long, latitude double, longitude double, altitude_m double, gps_speed_mps double, gps_course_deg double")
    imu = spark.createDataFrame([("g", 1, 0, 9.0)], "flight string, line_no long, t long, imu_gyro_magnitude double")
    row = timeseries.fuse_navigation(spark.createDataFrame([("f", 5)], "flight string, t long"), ahr, gps, imu).first()
    assert [row[n] for n in names] == [1.0, 6.0, 3.0]
    assert (row["yaw_deg"], row["roll_deg"], row["gps_speed_mps"], row["imu_gyro_magnitude"]) == (0.0, 2.0, 4.0, None)


def test_a_hot_series_is_spread(spark):
    p = spark.range(5000).select(F.lit("one").alias("key"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"))
    q = spark.range(500).select(F.lit("one").alias("key"), (F.col("id") * 97 + 3).alias("t"))
    got = timeseries.interpolate(p, q, "key", "t", ["v"], bucket_us=1000)
    assert all(math.isclose(r["v"], min(r["t"] / 10, 4999), abs_tol=1e-9) for r in got.collect())


def test_work_in_one_bucket_is_in_proportion(spark):
    """All points and probes in one bucket: quadratic windows would take minutes."""
    n = 60_000
    p = spark.range(n).select(F.lit("one").alias("key"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"))
    q = spark.range(n).select(F.lit("one").alias("key"), (F.col("id") * 10 + 5).alias("t"))
    began = time.perf_counter()
    got = timeseries.interpolate(p, q, "key", "t", ["v"]).agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
    assert time.perf_counter() - began < 60
    assert got["n"] == n and math.isclose(got["s"], sum(min(k + 0.5, n - 1) for k in range(n)))


def test_ties_and_missing_keys_and_times(spark):
    points = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 5, 2, 20.0), ("a", 9, 3, 30.0), ("a", 9, 4, 40.0), (None, 5, 5, 1.0), ("a", None, 6, 2.0)], "key string, t long, o long, v double")
    probes = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "a", 9), (4, "a", 10), (5, "a", None), (6, None, 5), (7, "z", 5), (2, "a", 6)], "n int, key string, t long")
    got = sorted((r["n"], r["lo"] and r["lo"]["v"], r["hi"] and r["hi"]["v"]) for r in timeseries.bracket(points, probes, "key", "t", ["v"], "o", bucket_us=4).collect())
    assert got == [(1, None, 10.0), (2, 20.0, 30.0), (2, 20.0, 30.0), (3, 20.0, 40.0), (4, 40.0, None), (5, None, None), (6, None, None), (7, None, None)]


def test_columns_of_the_rows_may_have_any_name(spark):
    fixes = spark.createDataFrame([("a", 0, 0), ("a", 10, 10_000_000)], "log string, x long, utc_us long")
    rows = spark.createDataFrame([("a", 5, "h", "t", "o", "r")], "log string, x long, head string, tail string, _owner string, _row string")
    row = timeseries.time_base(fixes, rows, "log", "x").first()
    assert (row["utc_us"], row["head"], row["tail"], row["_owner"], row["_row"]) == (5_000_000, "h", "t", "o", "r")
