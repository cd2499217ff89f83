"""Driver queries: each operator on the provided tables, whole.

``events`` stands for telemetry (user = flight, event type = channel), line items
for image points, ``embeddings`` for descriptors, ``documents`` for raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalars import file_stamp_us, first_non_empty, gps_to_utc_us, is_plain_ascii, lerp_angle, parse_dt_us, parse_float, parse_time_us, sanitize_name, strip, turned, utc_text
from ..operators import alignment, logs, matching, tiles, timeseries
from ..session import configure
from ..sources.logs import sync_reports
from ..sources.results import result_text
from ..streaming import live
from . import localize
from .config import LocalizeConfig

US = 1_000_000
GRID = geo.GeoRaster(0.25, 0.01, 400_000.0, 0.02, -0.25, 4_400_000.0, width_px=1600, height_px=1200, scale=0.5, projection=geo.TransverseMercator.utm(36))

#: A map in degrees.
DEGREES = geo.GeoRaster(0.001, 0.0, 30.0, 0.0, -0.001, 40.0, width_px=1600, height_px=1200, scale=0.5, projection=geo.Geographic())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value", "props")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- A: logs -----------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log text, one log per ten users: FMT lines declare types, ``purchase``
    with a GPS time of its own; GPS-like lines carry fixes."""
    e = events(spark, sf_dir).withColumn("log_file", F.concat(F.lit("log"), F.col("user_id") % 10))
    rank = F.row_number().over(Window.partitionBy("log_file").orderBy("event_id"))
    e = e.withColumn("n", rank.cast("bigint"))
    declares = (F.col("n") % 97 == 5) & (F.col("event_type") != "error")
    exact = F.col("event_type") == "purchase"
    line = (
        F.when(declares & exact, F.concat_ws(",", F.lit("FMT"), F.lit("1"), F.lit("9"), "event_type", F.lit("Qd"), F.lit("TimeUS"), F.lit(" GWk "), F.lit("GMS"), F.concat(F.lit("C"), (F.col("n") % 7).cast("string"))))
        .when(declares, F.concat_ws(",", F.lit("FMT"), F.lit("1"), F.lit("9"), "event_type", F.lit("Qd"), F.lit("TimeUS"), F.lit(" Val "), F.concat(F.lit("C"), (F.col("n") % 7).cast("string"))))
        .when(F.col("n") % 11 == 3, F.concat_ws(",", F.lit("GPS"), (F.col("n") * 1000).cast("string"), F.lit("0"), (F.col("n") % 5).cast("string"), (F.col("event_id") * 200).cast("string"), F.lit("2245"), F.lit("x")))
        .when(F.col("n") % 13 == 1, F.concat(F.lit("note é "), F.col("event_id").cast("string")))
        .when(exact, F.concat_ws(",", "event_type", (F.col("n") * 1000).cast("string"), F.lit("2245"), (F.col("event_id") * 200).cast("string"), F.lit("b,c")))
        .otherwise(F.concat_ws(",", "event_type", (F.col("n") * 1000).cast("string"), F.col("event_id").cast("string"), F.lit("a"), F.lit("b,c")))
    )
    return e.select("log_file", F.col("n").alias("line_no"), line.alias("line"))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = logs.tokenize(event_lines(spark, sf_dir))
    return tokens, logs.registry(tokens)


def a_tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("log_file"), F.col("doc_id").alias("line_no"), F.coalesce("text", F.lit("")).alias("line"))
    t = logs.tokenize(docs)
    return t.select(F.col("line_no").alias("doc_id"), F.size("tokens").cast("bigint").alias("n_tokens"), "message", F.md5(F.encode(F.array_join("tokens", "|"), "utf-8")).alias("tokens_md5"))


def a_classify_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(is_plain_ascii(F.coalesce("text", F.lit(""))), "INFO").otherwise("UNPARSED").alias("kind"))


def a_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(sanitize_name(F.coalesce("text", F.lit(""))), "utf-8")).alias("clean_md5"))


def a_registry(spark, sf_dir):
    _, formats = _log(spark, sf_dir)
    return formats.select("log_file", "message", F.array_join("columns", ", ").alias("columns"), "first_line")


def a_message_counts(spark, sf_dir):
    tokens, formats = _log(spark, sf_dir)
    return logs.message_counts(logs.classify(tokens, formats))


def a_records(spark, sf_dir):
    """Registered by the whole log, so a type's early lines count here (the late rule)."""
    tokens, formats = _log(spark, sf_dir)
    return logs.records(tokens, formats).select("log_file", "line_no", "message", F.array_join("values", "|").alias("fields"))


def a_loose_lines(spark, sf_dir):
    tokens, formats = _log(spark, sf_dir)
    return logs.loose_lines(tokens, formats).select("log_file", "line_no", "kind", "line")


def a_anchors(spark, sf_dir):
    return logs.anchors(_log(spark, sf_dir)[0])


def a_gps_to_utc(spark, sf_dir):
    e = events(spark, sf_dir)
    us = gps_to_utc_us((F.lit(2200) + F.col("user_id") % 100).cast("string"), (F.col("event_id") * 250).cast("string"))
    return e.select("event_id", us.alias("utc_us"), utc_text(us).alias("utc"))


def a_time_base(spark, sf_dir):
    """Anchors are a user's signups, probes all events; the last ones lie beyond them."""
    e = events(spark, sf_dir)
    fixes = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("x"), (F.col("value") * US).cast("bigint").alias("utc_us"))
    probes = e.select("event_id", "user_id", F.col("t").alias("x"))
    out = timeseries.time_base(fixes, probes, "user_id", "x")
    return out.select("event_id", F.round(F.col("utc_us") / US, 3).alias("seconds"))


def a_enriched(spark, sf_dir):
    tokens, formats = _log(spark, sf_dir)
    out = logs.enrich(logs.records(tokens, formats), logs.anchors(tokens))
    return out.select("log_file", "line_no", "message", "utc_approx", "utc_gps")


def a_formats(spark, sf_dir):
    return logs.formats_catalog(_log(spark, sf_dir)[1])


def a_message_summary(spark, sf_dir):
    tokens, formats = _log(spark, sf_dir)
    return logs.message_summary(logs.message_counts(logs.classify(tokens, formats)), formats)


def _overview(spark, sf_dir):
    tokens, formats = _log(spark, sf_dir)
    return logs.log_overview(logs.message_counts(logs.classify(tokens, formats)), logs.anchors(tokens))


def a_log_overview(spark, sf_dir):
    return _overview(spark, sf_dir)


def a_export_index(spark, sf_dir):
    return logs.export_index(_overview(spark, sf_dir), F.concat(F.lit("out/"), F.col("LogFile")))


# --- B: series ---------------------------------------------------------------


def _time_texts(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    ts = F.timestamp_micros("t")
    text = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("  "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
        .when(F.col("event_id") % 7 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 7 == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_id") % 7 == 3, F.lit("2023"))
        .when(F.col("event_id") % 7 == 4, F.lit(""))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    return e.select("event_id", text.alias("text"))


def b_parse_dt(spark, sf_dir):
    return _time_texts(spark, sf_dir).select("event_id", parse_dt_us(F.col("text")).alias("t_us"))


def b_parse_float(spark, sf_dir):
    e = events(spark, sf_dir)
    kind, body = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = F.when(kind == 0, F.concat(F.lit(" "), body, F.lit(".5 "))).when(kind == 1, F.concat(body, F.lit("d"))).when(kind == 2, F.lit("")).when(kind == 3, F.concat(F.lit("-"), body, F.lit("e-2"))).when(kind == 4, F.lit("n/a")).otherwise(body)
    return e.select("event_id", parse_float(text).alias("number"), parse_time_us(text).alias("whole"))


def b_first_nonempty(spark, sf_dir):
    e = events(spark, sf_dir)
    a, b = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", first_non_empty(a, b).alias("chosen"))


def b_gyro_magnitude(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, d, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    return li.select("l_orderkey", "l_linenumber", r6(F.sqrt(q * q + d * d + t * t)).alias("magnitude"))


def _series(spark, sf_dir, kind: str, *names: str) -> DataFrame:
    base = {"v": F.col("value"), "angle": turned(F.col("value") * 7)}
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "t", "event_id", *[base[n].alias(n) for n in names])


def _probes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("probe"), "user_id", "t")


def b_asof_linear(spark, sf_dir):
    out = timeseries.interpolate(_series(spark, sf_dir, "view", "v"), _probes(spark, sf_dir), "user_id", "t", ["v"], order="event_id")
    return out.select("probe", r6("v").alias("v"))


def b_asof_angle(spark, sf_dir):
    out = timeseries.interpolate(_series(spark, sf_dir, "view", "angle"), _probes(spark, sf_dir), "user_id", "t", [], ["angle"], order="event_id")
    return out.select("probe", r6("angle").alias("angle"))


def b_nav_fusion(spark, sf_dir):
    """Attitude from views (every fourth altitude 0), position from clicks, turn rate
    from purchases."""
    e = events(spark, sf_dir).withColumns({"flight": F.col("user_id"), "line_no": F.col("event_id")})
    v = F.col("value")
    ahr = e.where("event_type = 'view'").select("flight", "line_no", "t", v.alias("latitude"), (v * 2).alias("longitude"), F.when(F.col("line_no") % 4 == 0, 0.0).otherwise(v).alias("altitude_m"), turned(v * 7).alias("yaw_deg"), (v / 2).alias("roll_deg"), (-v).alias("pitch_deg"))
    gps = e.where("event_type = 'click'").select("flight", "line_no", "t", (v + 1).alias("latitude"), (v + 2).alias("longitude"), (v + 3).alias("altitude_m"), (v / 4).alias("gps_speed_mps"), turned(v * 11).alias("gps_course_deg"))
    imu = e.where("event_type = 'purchase'").select("flight", "line_no", "t", v.alias("imu_gyro_magnitude"))
    probes = e.select(F.col("event_id").alias("probe"), "flight", "t")
    out = timeseries.fuse_navigation(probes, ahr, gps, imu)
    names = ["latitude", "longitude", "altitude_m", "yaw_deg", "roll_deg", "pitch_deg", "gps_speed_mps", "gps_course_deg", "imu_gyro_magnitude"]
    return out.select("probe", *[r6(c).alias(c) for c in names])


# --- C: recordings and logs --------------------------------------------------


def _videos(spark, sf_dir) -> DataFrame:
    """Each event is a recording, named by its time where the id is even."""
    e = events(spark, sf_dir)
    name = F.date_format(F.timestamp_micros(F.col("t") + 3 * 3600 * US), "yyyy_MMdd_HHmmss")
    return e.select("event_id", "t", F.concat(F.lit("/cam/"), F.when(F.col("event_id") % 2 == 0, name).otherwise(F.lit("clip")), F.lit("_"), F.col("event_id").cast("string"), F.lit(".MP4")).alias("video"))


def _reports(spark, sf_dir) -> DataFrame:
    v = _videos(spark, sf_dir)
    start = F.date_format(F.timestamp_micros(F.col("t") + 5 * US), "yyyy-MM-dd HH:mm:ss.SSSSSS")

    def report(offset: float) -> Column:
        return F.to_json(F.struct(start.alias("video_start_utc"), F.lit(offset).alias("offset_video_to_log_start_sec"), (F.col("event_id") % 10).alias("filename_delta_sec")))

    first = v.where("event_id % 3 = 0").select("video", F.lit(1).alias("priority"), F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(report(1.5)).alias("body"))
    second = v.where("event_id % 5 = 0").select("video", F.lit(2).alias("priority"), report(2.5).alias("body"))
    return first.unionByName(second)


def c_filename_start(spark, sf_dir):
    return _videos(spark, sf_dir).select("event_id", file_stamp_us(F.col("video"), 3.0).alias("start_us"))


def c_cached_sync(spark, sf_dir):
    return sync_reports(_reports(spark, sf_dir)).select("video", "start_us", "offset_sec", "filename_delta_sec")


def c_resolve_start(spark, sf_dir):
    out = alignment.resolve_starts(_videos(spark, sf_dir), sync_reports(_reports(spark, sf_dir)), strict=False)
    return out.select("event_id", "start_us", "start_source")


def c_choose_log(spark, sf_dir):
    """A user's first to last sign-up is a log, each event a recording."""
    e = events(spark, sf_dir)
    days = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("log_start_us"), F.max("t").alias("end_us"))
    index = days.select(F.col("user_id").alias("ord"), F.concat(F.lit("log"), "user_id").alias("log_file"), F.concat(F.lit("f"), "user_id").alias("folder"), "log_start_us", "end_us")
    videos = e.select(F.col("event_id").alias("video"), F.col("t").alias("start_us"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 1000).cast("double") * 60).alias("duration_sec"))
    out = alignment.choose_logs(videos, index)
    return out.select("video", "log_file", "folder", r6("overlap_sec").alias("overlap_sec"))


# --- D, E: maps and tiles ----------------------------------------------------


def _points(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 1600).alias("x"), (F.col("l_quantity") * 23.7).alias("y"))


def _key_and(points: DataFrame, *columns: Column) -> DataFrame:
    return points.select("l_orderkey", "l_linenumber", *columns)


def d_affine(spark, sf_dir):
    x, y = GRID.pixel_to_projected(F.col("x"), F.col("y"))
    return _key_and(_points(spark, sf_dir), F.round(x, 4).alias("x_proj"), F.round(y, 4).alias("y_proj"))


def d_affine_inverse(spark, sf_dir):
    x, y = GRID.projected_to_pixel(F.col("x") + 400_000, 4_400_000 - F.col("y"))
    return _key_and(_points(spark, sf_dir), F.round(x, 4).alias("x_px"), F.round(y, 4).alias("y_px"))


def d_latlon_roundtrip(spark, sf_dir):
    lat, lon = GRID.pixel_to_latlon(F.col("x"), F.col("y"))
    placed = _points(spark, sf_dir).withColumns({"lat": lat, "lon": lon})
    x, y = GRID.latlon_to_pixel(F.col("lat"), F.col("lon"))
    return _key_and(placed, F.round(x, 3).alias("x_px"), F.round(y, 3).alias("y_px"))


def d_crop_window(spark, sf_dir):
    p = _points(spark, sf_dir).withColumns({"x0": geo.window_origin(F.col("x"), 512), "y0": geo.window_origin(F.col("y"), 512)})
    left, right = geo.window_padding(F.col("x0"), F.lit(512), F.lit(1600))
    top, bottom = geo.window_padding(F.col("y0"), F.lit(512), F.lit(1200))
    return _key_and(p, "x0", "y0", left.alias("pad_left"), right.alias("pad_right"), top.alias("pad_top"), bottom.alias("pad_bottom"))


def d_grid_positions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 100).cast("bigint").alias("length"))
    at = tiles.grid_positions(F.col("length"), F.lit(512), F.lit(256))
    return part.select("p_partkey", F.array_join(F.transform(at, lambda c: c.cast("string")), ",").alias("centers"))


def e_build_tiles(spark, sf_dir):
    configure(spark)
    return tiles.tile_index(spark, 1600, 1200, [512, 768])


def _tile_probes(spark, sf_dir) -> DataFrame:
    return _points(spark, sf_dir)


def e_tiles_near(spark, sf_dir):
    near = tiles.tiles_near(_tile_probes(spark, sf_dir), e_build_tiles(spark, sf_dir), 420.0)
    return near.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_tiles"), F.min("tile_ord").alias("first_tile"))


def e_nearest_tiles(spark, sf_dir):
    near = tiles.nearest_tiles(_tile_probes(spark, sf_dir), e_build_tiles(spark, sf_dir), 4)
    return near.select("l_orderkey", "l_linenumber", "rank", "tile_ord")


# --- F, G: matches and places ------------------------------------------------


def _descriptors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two sets of key points per image pair: labels below and from five, paired by
    the rest of the label, so that each pair stays within its group."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("desc"), (F.col("label") % 5).alias("pair"), (F.col("label") >= 5).alias("ref"))
    return e.where("not ref"), e.where("ref")


def f_mutual_nn(spark, sf_dir):
    q, r = _descriptors(spark, sf_dir)
    return matching.mutual_matches(q, r, -10.0, ["pair"]).select("pair", "query_id", "ref_id", r6("score").alias("score"))


def f_match_threshold(spark, sf_dir):
    q, r = _descriptors(spark, sf_dir)
    found = matching.mutual_matches(q, r, 0.1, ["pair"])
    return found.groupBy("pair").agg(F.count("*").alias("match_count"), r6(F.max("score")).alias("best"))


#: A known homography (by rows) that the line items' points are sent through.
KNOWN_H = (1.05, 0.02, 12.0, -0.03, 0.98, 7.5, 0.00002, -0.00001, 1.0)


def _matches(spark, sf_dir) -> DataFrame:
    """All lines as matches, a supplier's as one image pair (about 600 of them whatever
    the scale): exact ones, every sixth far off."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_extendedprice") % 800).alias("qx"), (F.col("l_partkey") * 7.0 % 600).alias("qy"))
    rx, ry = geo.project(F.array(*map(F.lit, KNOWN_H)), F.col("qx"), F.col("qy"))
    off = F.when((F.col("k") + F.col("n")) % 6 == 0, F.lit(150.0) + F.col("k") % 97).otherwise(0.0)
    return p.select("pair", "k", "n", "qx", "qy", (rx + off).alias("rx"), (ry - off).alias("ry"), (0.2 + F.col("n") * 0.1).alias("conf"))


def g_homography_recover(spark, sf_dir):
    fits = matching.homographies(_matches(spark, sf_dir), ["pair"])
    return fits.select("pair", "match_count", "inlier_count", *[F.round(F.get("homography", F.lit(k)), 4).alias(f"h{k}") for k in range(8)])


def _known() -> Column:
    return F.array(*map(F.lit, KNOWN_H))


def g_reprojection(spark, sf_dir):
    points = _matches(spark, sf_dir).withColumns({"homography": _known(), "inlier": (F.col("k") + F.col("n")) % 2 == 0})
    return matching.reprojection_errors(points, ["pair"]).select("pair", F.round("reprojection_error", 4).alias("reprojection_error"))


def g_project_geometry(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16 + 320).alias("width"), (F.col("p_size") * 9 + 180).alias("height"))
    corners, (cx, cy) = geo.project_frame(_known(), F.col("width"), F.col("height"))
    sides = [F.round(c, 4).alias(f"{axis}{k}") for k, p in enumerate(corners) for axis, c in zip("xy", p)]
    return part.select("p_partkey", *sides, F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


def g_center_gate(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _key_and(p, geo.near_tile(F.col("x") - 500, F.col("y") - 300, F.lit(512)).alias("near"))


def _fits(spark, sf_dir) -> DataFrame:
    """Line items as fitted candidates: order = frame, line = tile."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame"),
        F.col("l_linenumber").cast("bigint").alias("tile_ord"),
        F.col("l_quantity").cast("bigint").alias("match_count"),
        F.floor(F.col("l_quantity") * F.col("l_discount") * 8).cast("bigint").alias("inlier_count"),
        (F.col("l_tax") * 100).alias("error"),
        F.col("l_discount").alias("confidence"),
    )


def _scored(spark, sf_dir) -> DataFrame:
    f = _fits(spark, sf_dir).withColumn("ratio", matching.inlier_ratio(F.col("inlier_count"), F.col("match_count")))
    return f.withColumn("score", F.round(matching.candidate_score(F.col("inlier_count"), F.col("ratio"), F.col("confidence"), F.col("error")), 6))


def g_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("frame", "tile_ord", F.round("score", 4).alias("score"))


def _passing(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).where(matching.acceptable(matching.AcceptConfig(), F.col("match_count"), F.col("inlier_count"), F.round("error", 6)))


def g_filter_cascade(spark, sf_dir):
    return _passing(spark, sf_dir).select("frame", "tile_ord", "match_count", "inlier_count")


def g_best_candidate(spark, sf_dir):
    best = matching.best_candidate(_passing(spark, sf_dir), ["frame"])
    return best.select("frame", "tile_ord", F.round("score", 4).alias("score"))


def _frames(spark, sf_dir) -> DataFrame:
    """Each user's events are a recording; its n-th event is frame n."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    e = events(spark, sf_dir).withColumn("frame_index", nth.cast("bigint"))
    return e.withColumns({"video": F.concat(F.lit("v"), "user_id"), "fps": (F.col("user_id") % 4).cast("double"), "total_frames": F.when(F.col("user_id") % 3 == 0, 0).otherwise(40)})


def g_frame_sampling(spark, sf_dir):
    picked = localize.sample_frames(_frames(spark, sf_dir), LocalizeConfig(frame_step_seconds=1.5, video_start_seconds=2.0, max_frames=20))
    return picked.select("video", "frame_index", "sampled_index", r6("video_time_sec").alias("video_time_sec"))


def g_query_resize(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 41 + 100).alias("w"), (F.col("p_partkey") % 1500 + 50).alias("h"))
    w, h = geo.fit_long_edge(F.col("w"), F.col("h"), 960)
    return part.select("p_partkey", w.alias("width"), h.alias("height"))


def g_search_mode(spark, sf_dir):
    f = _frames(spark, sf_dir)
    has_last = F.coalesce(F.max((F.col("event_type") == "view").cast("int")).over(Window.partitionBy("video").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return f.select("event_id", localize.search_mode(F.col("frame_index"), has_last, F.col("event_type") == "click", 12).alias("search_mode"))


def _track_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views and clicks have one candidate each, on the tile that their value picks;
    every seventh frame has a prior."""
    frames = _frames(spark, sf_dir).withColumns({"sampled_index": F.col("frame_index"), "video_time_sec": F.col("frame_index") / 30})
    frames = frames.withColumns({"prior_x": F.when(F.col("event_id") % 7 == 0, F.col("value") * 10 % 1600), "prior_y": F.when(F.col("event_id") % 7 == 0, F.col("value") * 3 % 1200)})
    index = tiles.tile_index(spark, 1600, 1200, [512, 768])
    hit = frames.where("event_type in ('view', 'click')").withColumn("tile_ord", F.pmod(F.floor("value"), F.lit(36)).cast("bigint"))
    c = hit.join(F.broadcast(index), "tile_ord").select(  # 36 tiles
        "video",
        "frame_index",
        "tile_ord",
        "tile_id",
        F.lit(39.8).alias("latitude"),
        F.lit(32.3).alias("longitude"),
        (F.col("center_x_px") + F.col("event_id") % 50).cast("double").alias("map_center_x_px"),
        (F.col("center_y_px") - F.col("event_id") % 30).cast("double").alias("map_center_y_px"),
        F.round("value", 3).alias("score"),
        F.lit(25).cast("bigint").alias("match_count"),
        F.lit(13).cast("bigint").alias("inlier_count"),
        F.lit(0.52).alias("inlier_ratio"),
        F.lit(0.2).alias("mean_confidence"),
        F.lit(2.2).alias("reprojection_error"),
    )
    return frames, c, index


def g_map_center(spark, sf_dir):
    """Line items as fits that pass all tests, on a map in degrees."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").cast("bigint").alias("tile_ord"), "l_suppkey", "l_partkey")
    shift = [F.lit(v) for v in (1.0, 0.0)] + [(F.col("l_partkey") % 100).cast("double")] + [F.lit(v) for v in (0.0, 1.0)] + [(F.col("l_suppkey") % 50).cast("double")] + [F.lit(v) for v in (0.0, 0.0, 1.0)]
    fits = li.withColumns({"homography": F.array(*shift), "match_count": F.lit(25), "inlier_count": F.lit(13), "reprojection_error": F.lit(2.0), "mean_confidence": F.lit(0.2), "width": F.lit(640), "height": F.lit(480)})
    fits = fits.withColumns({"tile_size_px": F.lit(512), "map_x0_px": F.col("l_suppkey") % 1000, "map_y0_px": F.col("l_partkey") % 700})
    placed = localize.score_candidates(fits, LocalizeConfig(), DEGREES)
    return placed.select("frame_index", "tile_ord", "map_center_x_px", "map_center_y_px", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), r6("score").alias("score"))


_SHOWN = ("video", "frame_index", "status", "search_mode", "map_center_x_px", "map_center_y_px", "score", "tile_id")


def g_stateful_track(spark, sf_dir):
    frames, candidates, index = _track_inputs(spark, sf_dir)
    return localize.localize(frames, candidates, index, LocalizeConfig()).select(*_SHOWN)


def g_global_track(spark, sf_dir):
    frames, candidates, _ = _track_inputs(spark, sf_dir)
    return localize.localize_global(frames, candidates, LocalizeConfig()).select(*_SHOWN)


def g_result_rows(spark, sf_dir):
    frames, candidates, _ = _track_inputs(spark, sf_dir)
    out = localize.localize_global(frames, candidates, LocalizeConfig())
    named = {"frame_index": "FrameIndex", "video_time_sec": "VideoTimeSec", "status": "Status", "search_mode": "SearchMode", "latitude": "Latitude", "longitude": "Longitude", "map_center_x_px": "MapCenterXPx", "map_center_y_px": "MapCenterYPx", "score": "Score", "tile_id": "TileId"}
    named |= {"match_count": "MatchCount", "inlier_count": "InlierCount", "inlier_ratio": "InlierRatio", "mean_match_confidence": "MeanMatchConfidence", "reprojection_error_px": "ReprojectionErrorPx"}
    return result_text(out.withColumnsRenamed(named))


# --- H, I: summaries and the live plan ---------------------------------------


def h_run_summary(spark, sf_dir):
    frames, candidates, _ = _track_inputs(spark, sf_dir)
    out = localize.run_summary(localize.localize_global(frames, candidates, LocalizeConfig()), ["video"])
    return out.select("video", "frames", "localized", F.round("mean_score", 9).alias("mean_score"))


def i_submitted(spark, sf_dir):
    return live.submitted(_frames(spark, sf_dir), 5).select("event_id", "video", "frame_index")


def i_latest_wins(spark, sf_dir):
    """Tasks that wait together: a recording's frames of one day."""
    f = _frames(spark, sf_dir).withColumn("slot", F.concat_ws("/", "video", F.floor(F.col("t") / (86_400 * US)).cast("string")))
    return live.latest_wins(f.select("slot", "frame_index", "event_id"), "slot").select("slot", "frame_index", "event_id")


def i_conflated(spark, sf_dir):
    """What a matcher that is busy for a day at a time sees of each recording."""
    f = live.submitted(_frames(spark, sf_dir), 2).withColumn("slot", F.floor(F.col("t") / (86_400 * US)))
    return live.conflated(f.select("video", "slot", "frame_index", "event_id")).select("video", "slot", "frame_index", "event_id", "sampled_index")


def i_emit_once(spark, sf_dir):
    f = _frames(spark, sf_dir).select("video", F.col("event_id").alias("seq"), F.floor(F.col("frame_index") / 3).alias("shown"))
    return live.emit_once(f, "video", "seq", "shown").select("video", "seq", "shown")


def i_match_age(spark, sf_dir):
    f = _frames(spark, sf_dir)
    last = F.last(F.when(F.col("event_type") == "view", F.col("t") / US), ignorenulls=True).over(Window.partitionBy("video").orderBy("frame_index"))
    return f.select("event_id", F.round(live.match_age(F.col("t") / US, last), 3).alias("age"))


def i_track_tail(spark, sf_dir):
    frames, candidates, _ = _track_inputs(spark, sf_dir)
    out = localize.localize_global(frames, candidates, LocalizeConfig()).where("status = 'localized'")
    return live.track_tail(out).select("video", "frame_index", "map_center_x_px", "map_center_y_px")


def i_line_sample(spark, sf_dir):
    m = _matches(spark, sf_dir).withColumns({"inlier": (F.col("k") + F.col("n")) % 6 != 0, "o": F.col("k") * 10 + F.col("n")})
    return matching.sample_lines(m, ["pair"], "o", 8).select("pair", "o")


def i_letterbox(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 41 + 100).alias("w"), (F.col("p_partkey") % 1500 + 50).alias("h"))
    w, h, x, y = geo.letterbox(F.col("w"), F.col("h"), 960, 540)
    return part.select("p_partkey", w.alias("width"), h.alias("height"), x.alias("offset_x"), y.alias("offset_y"))


def i_telemetry_prior(spark, sf_dir):
    """Every event is a frame between the views, clicks and purchases of its user; the
    map is in degrees, so that positions between points can be told in SQL."""
    e = events(spark, sf_dir).withColumns({"flight": F.col("user_id"), "line_no": F.col("event_id"), "px": F.pmod(F.col("value") * 10, F.lit(1600.0)), "py": F.pmod(F.col("value") * 3, F.lit(1200.0))})
    lat, lon = DEGREES.pixel_to_latlon(F.col("px"), F.col("py"))
    e = e.withColumns({"latitude": lat, "longitude": lon})
    none = F.lit(None).cast("double")
    ahr = e.where("event_type = 'view'").select("flight", "line_no", "t", "latitude", "longitude", *[none.alias(c) for c in ("altitude_m", "yaw_deg", "roll_deg", "pitch_deg")])
    gps = e.where("event_type = 'click'").select("flight", "line_no", "t", "latitude", "longitude", *[none.alias(c) for c in ("altitude_m", "gps_speed_mps", "gps_course_deg")])
    imu = e.where("event_type = 'purchase'").select("flight", "line_no", "t", F.col("value").alias("imu_gyro_magnitude"))
    frames = e.select("event_id", "flight", "t")
    return live.telemetry_priors(frames, (ahr, gps, imu), DEGREES).select("event_id", F.round("prior_x", 3).alias("prior_x"), F.round("prior_y", 3).alias("prior_y"))


QUERIES = {name: f for name, f in list(globals().items()) if name[1:2] == "_" and name[0] in "abcdefghi" and callable(f)}
