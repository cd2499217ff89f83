"""Parsing, time bases and geometry, row by row."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.functions import geo, scalars


def column(spark, kind, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").repartition(1)
    return [r[0] for r in df.orderBy("k").select(expression(F.col("x"))).collect()]


def micros(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def test_parse_float(spark):
    texts = [" 1.5 ", "-2e3", "1d", "1f", "", None, "abc", "1_0", "_1", "0x10", ".5", "5.", "\t7\n", "1,5", "+3"]
    want = [1.5, -2000.0, None, None, None, None, None, 10.0, None, None, 0.5, 5.0, 7.0, None, 3.0]
    assert column(spark, "string", texts, scalars.parse_float) == want
    odd = column(spark, "string", ["nan", "-inf", "Infinity"], scalars.parse_float)
    assert math.isnan(odd[0]) and odd[1:] == [-math.inf, math.inf]


def test_parse_time_us(spark):
    assert column(spark, "string", ["1024975222.9", "-3.7", "x", None, "nan", "12"], scalars.parse_time_us) == [1024975222, -3, None, None, None, 12]


def test_parse_dt(spark):
    texts = ["2023-01-20 10:49:56.2", " 2023-01-20 10:49:56", "2023-01-20T10:49:56.123456", "2023-01-20", "20230120", "2023", "", None, "2023-13-01 00:00:00", "2023-01-20 25:00:00", "n/a", "2023-1-2 3:4:5"]
    want = ["2023-01-20 10:49:56.200000", "2023-01-20 10:49:56", "2023-01-20 10:49:56.123456", "2023-01-20", "2023-01-20", None, None, None, None, None, None, "2023-01-02 03:04:05"]
    assert column(spark, "string", texts, scalars.parse_dt_us) == [w and micros(w) for w in want]


def test_gps_time(spark):
    df = spark.createDataFrame([("2245", "471014200"), ("2245", "x"), (None, "1")], "week string, ms string")
    got = [r[0] for r in df.select(scalars.utc_text(scalars.gps_to_utc_us(F.col("week"), F.col("ms")))).collect()]
    assert got == ["2023-01-20 10:49:56.200000", "", ""]


def test_file_stamp(spark):
    names = ["movie/2023_0120_134558_001.MP4", "2023_0120_134558/clip.mp4", "x.mp4", None]
    got = column(spark, "string", names, scalars.file_stamp_us)
    assert got == [micros("2023-01-20 10:45:58"), None, None, None]
    with pytest.raises(Exception):
        column(spark, "string", ["2023_1320_134558.mp4"], scalars.file_stamp_us)


def test_names_and_lines(spark):
    assert column(spark, "string", ["00000003_birinci uçuş", "...", None, "a//b", "é"], scalars.sanitize_name) == ["00000003_birinci_ucus", "log", None, "a_b", "e"]
    assert column(spark, "string", ["abc", "a\x00b", "é", ""], scalars.is_plain_ascii) == [True, False, False, True]
    assert column(spark, "string", ["a\x01'", "é"], scalars.python_repr) == [repr("a\x01'"), repr("é")]


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", "b"), ("a", "b"), (None, None), ("", "")], "x string, y string")
    assert [r[0] for r in df.select(scalars.first_non_empty(F.col("x"), F.col("y"))).collect()] == ["b", "a", None, None]


def test_angles(spark):
    df = spark.createDataFrame([(350.0, 10.0, 0.5), (10.0, 350.0, 0.5), (0.0, 180.0, 0.5), (None, 400.0, 0.5), (5.0, None, 0.1)], "a double, b double, t double")
    got = [r[0] for r in df.select(scalars.lerp_angle(F.col("a"), F.col("b"), F.col("t"))).collect()]
    assert got == [0.0, 0.0, 270.0, 400.0, 5.0]


def test_projection_round_trip(spark):
    tm = geo.TransverseMercator.utm(36)
    points = [(39.80544256, 32.37832986), (0.0, 33.0), (60.0, 35.9), (-10.0, 30.1)]
    df = spark.createDataFrame(points, "lat double, lon double")
    x, y = tm.forward(F.col("lat"), F.col("lon"))
    placed = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = tm.inverse(F.col("x"), F.col("y"))
    for r in placed.select("lat", "lon", "x", "y", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r["a"] - r["lat"]) < 1e-9 and abs(r["b"] - r["lon"]) < 1e-9
    origin = placed.where("lat = 0").first()
    assert abs(origin["x"] - 500_000) < 1e-6 and abs(origin["y"]) < 1e-6


def test_meridian_arc_is_that_of_the_ellipsoid(spark):
    """Northing on the central meridian, against a numerical integral."""
    a, f = 6_378_137.0, 1 / 298.257223563
    e2, n = f * (2 - f), 20_000
    step = math.radians(39.8) / n
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 for k in range(n)) * step
    _, y = geo.TransverseMercator.utm(36).forward(F.lit(39.8), F.lit(33.0))
    assert abs(spark.range(1).select(y).first()[0] - 0.9996 * arc) < 0.01


def test_raster_round_trip(spark):
    g = geo.GeoRaster.resized((0.1, 0.02, 5e5, 0.01, -0.1, 4.4e6), 3200, 2400, 1600, geo.TransverseMercator.utm(36))
    assert (g.scale, g.width_px, g.height_px) == (0.5, 1600, 1200)
    lat, lon = g.pixel_to_latlon(F.lit(501.03), F.lit(447.46))
    x, y = g.latlon_to_pixel(F.col("lat"), F.col("lon"))
    row = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).select(x, y).first()
    assert abs(row[0] - 501.03) < 1e-3 and abs(row[1] - 447.46) < 1e-3


def test_windows_round_half_to_even(spark):
    assert column(spark, "double", [2.5, 3.5, 256.0], lambda c: geo.window_origin(c, 512)) == [2 - 256, 4 - 256, 0]
    left, right = geo.window_padding(F.lit(-3), F.lit(10), F.lit(5))
    assert tuple(spark.range(1).select(left, right).first()) == (3, 2)


def test_frame_geometry(spark):
    w, h = geo.fit_long_edge(F.lit(1920), F.lit(1080), 960)
    a, b = geo.fit_long_edge(F.lit(10), F.lit(20), 960)
    assert tuple(spark.range(1).select(w, h, a, b).first()) == (960, 540, 10, 20)
    assert tuple(spark.range(1).select(*geo.letterbox(F.lit(100), F.lit(100), 960, 540)).first()) == (540, 540, 210, 0)
    identity = F.array(*[F.lit(float(v)) for v in (1, 0, 5, 0, 1, 7, 0, 0, 1)])
    corners, (cx, cy) = geo.project_frame(identity, F.lit(11), F.lit(21))
    assert tuple(spark.range(1).select(*corners[2], cx, cy).first()) == (15.0, 27.0, 10.0, 17.0)
    gate = [geo.near_tile(F.lit(x), F.lit(0.0), F.lit(100)) for x in (-15.0, -15.1, 115.0, 115.1)]
    assert tuple(spark.range(1).select(*gate).first()) == (True, False, True, False)
