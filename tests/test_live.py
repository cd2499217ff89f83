"""Stored features, matches of images, and the live plan from end to end."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions.geo import Geographic, GeoRaster
from skyframe.operators import features, matching, tiles
from skyframe.plans import localize, progress
from skyframe.plans.config import LiveConfig
from skyframe.sources.results import remove
from skyframe.streaming import live

US = 1_000_000
IMAGE = "width int, height int, pixels binary"


def patches(log):
    """An extractor of exact patches: corners of a grid of 16 pixels, its calls told to a file."""

    def factory(config):
        def extract(image):
            with open(log, "a") as f:
                f.write(f"{image.shape}\n")
            grey = image.astype(float).mean(axis=2)
            at = [(x, y) for y in range(0, grey.shape[0] - 15, 16) for x in range(0, grey.shape[1] - 15, 16)][: config.max_keypoints]
            d = np.array([(grey[y : y + 16, x : x + 16] - grey[y : y + 16, x : x + 16].mean()).ravel() for x, y in at])
            return np.array(at, float), d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)

        return extract

    return factory


@pytest.fixture
def ground(spark, tmp_path):
    log = tmp_path / "calls"
    log.touch()
    matching.register_extractor("sift", patches(str(log)))
    yield np.random.default_rng(4).integers(0, 255, (256, 384, 3), np.uint8), log
    matching._EXTRACTORS.pop("sift")


def crop(image, x, y, w, h):
    return w, h, bytearray(np.ascontiguousarray(image[y : y + h, x : x + w]).tobytes())


def scene(spark, image, tmp_path, seen=None):
    index = tiles.tile_index(spark, 384, 256, [128]).cache()
    shots = tiles.tile_images(index, tiles.raster_blocks(spark, image, 128), 128).select("tile_ord", F.col("tile_size_px").cast("int").alias("width"), F.col("tile_size_px").cast("int").alias("height"), "pixels")
    config, raster = LiveConfig(), GeoRaster(0.001, 0, 32, 0, -0.001, 40, 384, 256, projection=Geographic())
    cache = features.FeatureTable(spark, str(tmp_path / "features"), config.matcher, progress=seen)
    return index, shots, config, raster, cache


def test_features_are_made_once(spark, ground, tmp_path):
    image, log = ground
    index, shots, config, _, cache = scene(spark, image, tmp_path)
    some = shots.where("tile_ord < 3").cache()
    assert cache.stored().count() == 0 and cache.of(some).count() == 3
    first = len(log.read_text().splitlines())
    assert first == 3 and cache.of(some.unionByName(some)).count() == 3 and len(log.read_text().splitlines()) == 3
    cache.fill(shots.where("tile_ord < 5"))  # beforehand, only those that lack
    assert len(log.read_text().splitlines()) == 5 and cache.stored().count() == 5
    assert {r["tile_ord"] for r in cache.of(some.where("tile_ord = 1")).collect()} == {1}
    cache.fill(shots.limit(0))
    assert cache.stored().count() == 5
    other = features.FeatureTable(spark, str(tmp_path / "features"), matching.MatcherConfig(max_keypoints=3))
    assert other.stored().count() == 0 and {len(r["features"]) for r in other.of(some).collect()} == {3}


def test_images_match(spark, ground):
    image, _ = ground
    pairs = [("a", *crop(image, 32, 48, 96, 64)), ("b", *crop(image, 0, 0, 64, 64)), ("lone", *crop(image, 0, 0, 16, 16))]
    refs = [("a", *crop(image, 0, 0, 256, 256)), ("b", *crop(image, 16, 0, 64, 64))]
    found = features.match_images(spark.createDataFrame(pairs, f"pair string, {IMAGE}"), spark.createDataFrame(refs, f"pair string, {IMAGE}"), matching.MatcherConfig(filter_threshold=0.9)).collect()
    moved = {(r["pair"], r["rx"] - r["qx"], r["ry"] - r["qy"]) for r in found}
    assert moved == {("a", 32.0, 48.0), ("b", -16.0, 0.0)} and len(found) == 24 + 12
    assert all(abs(r["conf"] - 1) < 1e-9 for r in found)


def navigation(spark):
    none = ", ".join(f"{c} double" for c in ("altitude_m", "yaw_deg", "roll_deg", "pitch_deg"))
    ahr = spark.createDataFrame([("f", 0, 0, 39.9, 32.1, None, None, None, None), ("f", 1, 100 * US, 39.9, 32.1, None, None, None, None)], f"flight string, line_no long, t long, latitude double, longitude double, {none}")
    gps = spark.createDataFrame([], "flight string, line_no long, t long, latitude double, longitude double, altitude_m double, gps_speed_mps double, gps_course_deg double")
    imu = spark.createDataFrame([], "flight string, line_no long, t long, imu_gyro_magnitude double")
    return ahr, gps, imu


FRAMES = f"video string, flight string, frame_index long, start_us long, fps double, {IMAGE}"


def test_live_plan(spark, ground, tmp_path):
    """Three batches of four frames a recording: the last of each is matched, the ones
    before it are not even looked at."""
    image, log = ground
    seen = []
    index, shots, config, raster, cache = scene(spark, image, tmp_path, lambda *a: seen.append(a[0]))
    cache.fill(shots)
    log.write_text("")
    shots = shots.cache()
    plan = live.LivePlan(navigation(spark), raster, index, lambda f: localize.find_candidates(f, index, shots, cache, config, raster, plan.progress), config, progress=lambda *a: seen.append(a[0]))
    rows = [(v, "f", k, 0, 10.0, *crop(image, 16 * k, 16 * n, 96, 96)) for n, v in enumerate(("v", "w")) for k in range(12)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 4 == part], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={part}"))
        time.sleep(1.1)  # the source takes files by their times
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("old", 1)], "video string, frame_index long").write.parquet(f"{target}/results/epoch=9")

    def run():
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = live.run_live(stream, plan, target, checkpoint)
        first = live.await_first_result(query, 120)
        query.awaitTermination(300)
        assert query.exception() is None
        return first

    assert run()
    out = {(r["video"], r["frame_index"]): r for r in live.read_results(spark, target).collect()}
    assert sorted(out) == [(v, k) for v in ("v", "w") for k in (3, 7, 11)]
    for (v, k), r in out.items():
        assert r["status"] == "localized" and abs(r["map_center_x_px"] - (16 * k + 47.5)) < 1e-6 and abs(r["map_center_y_px"] - (47.5 + 16 * (v == "w"))) < 1e-6
        assert r["search_mode"] == ("telemetry_prior" if k == 3 else "track_local") and abs(r["video_time_sec"] - k / 10) < 1e-9
    state = {r["video"]: (r["submitted"], r["shown"]) for r in spark.read.schema(live.STATE).parquet(f"{target}/state/epoch=2").collect()}
    assert state == {"v": (12, 11), "w": (12, 11)}
    assert len(set(log.read_text().splitlines())) == 1  # frames only: no tile's features are made again
    assert {"query_features_start", "reference_features_ready", "match_features", "estimate_homography", "idle"} <= set(seen)
    again = spark.createDataFrame([r for r in rows if r[2] == 11], FRAMES)  # the frame that was shown last
    results, after = live.live_step(again, spark.read.schema(live.STATE).parquet(f"{target}/state/epoch=2"), plan)
    assert results.count() == 0 and {r["submitted"] for r in after.collect()} == {13}
    run()  # nothing new: nothing is written twice
    assert live.read_results(spark, target).count() == 6


def test_conflation_counts_all_submissions(spark):
    rows = [("a", 0, 0, "x"), ("a", 0, 2, "y"), ("a", 1, 3, "z"), ("a", 3, 9, "u"), ("b", 1, 4, "w")]
    got = live.conflated(spark.createDataFrame(rows, "video string, slot long, frame_index long, what string")).orderBy("video", "slot").collect()
    assert [(r["video"], r["slot"], r["frame_index"], r["what"], r["sampled_index"]) for r in got] == [("a", 0, 2, "y", 1), ("a", 1, 3, "z", 2), ("a", 3, 9, "u", 3), ("b", 1, 4, "w", 0)]


def test_waiting_and_progress(spark, tmp_path):
    seen = []
    progress.told(lambda *a: seen.append(a), "match_features", 1, 2, "t")
    progress.told(None, "idle")
    with pytest.raises(ValueError):
        progress.told(None, "unheard-of")
    assert seen == [("match_features", 1, 2, "t")]
    schema = "video string, frame_index long"
    (tmp_path / "none").mkdir()

    def start(folder, name):
        return spark.readStream.schema(schema).parquet(str(folder)).writeStream.option("checkpointLocation", str(tmp_path / name)).foreachBatch(lambda b, e: b.count())

    listener = progress.BatchListener(lambda *a: seen.append(a))
    spark.streams.addListener(listener)
    idle = start(tmp_path / "none", "ck0").start()
    began = time.monotonic()
    assert not live.await_first_result(idle, 1.0) and time.monotonic() - began < 30
    idle.stop()
    spark.createDataFrame([("v", 1)], schema).write.parquet(str(tmp_path / "some"))
    busy = start(tmp_path / "some", "ck1").trigger(availableNow=True).start()
    assert live.await_first_result(busy, 60.0)
    busy.awaitTermination(60)
    until = time.monotonic() + 20
    while listener.rows < 1 and time.monotonic() < until:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert ("idle", 1, 1, None) in seen
    remove(spark, str(tmp_path / "some"))
    remove(spark, str(tmp_path / "some"))
    assert not (tmp_path / "some").exists()
