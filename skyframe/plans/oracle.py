"""DuckDB SQL for the driver queries: plain statements of the same results."""

from __future__ import annotations

from .queries import GRID, KNOWN_H

_E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value, props FROM events)"
_BLANK = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')"

# --- A -----------------------------------------------------------------------

_LINES = f"""{_E}, numbered AS (
  SELECT *, 'log' || (user_id % 10) AS log_file, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM e
), lines AS (
  SELECT log_file, n AS line_no, event_id, CASE
    WHEN n % 97 = 5 AND event_type = 'purchase' THEN 'FMT,1,9,purchase,Qd,TimeUS, GWk ,GMS,C' || (n % 7)
    WHEN n % 97 = 5 AND event_type <> 'error' THEN 'FMT,1,9,' || event_type || ',Qd,TimeUS, Val ,C' || (n % 7)
    WHEN n % 11 = 3 THEN 'GPS,' || (n * 1000) || ',0,' || (n % 5) || ',' || (event_id * 200) || ',2245,x'
    WHEN n % 13 = 1 THEN 'note é ' || event_id
    WHEN event_type = 'purchase' THEN 'purchase,' || (n * 1000) || ',2245,' || (event_id * 200) || ',b,c'
    ELSE event_type || ',' || (n * 1000) || ',' || event_id || ',a,b,c' END AS line FROM numbered
), tok AS (
  SELECT log_file, line_no, line, list_transform(string_split(line, ','), lambda x: {_STRIP}) AS tokens FROM lines
), typed AS (SELECT *, tokens[1] AS message FROM tok), formats AS (
  SELECT log_file, tokens[4] AS message, arg_max(tokens[6:], line_no) AS cols, min(line_no) AS first_line
  FROM typed WHERE message = 'FMT' AND len(tokens) >= 6 GROUP BY ALL
)"""
_COUNTED = f"""{_LINES}, counted AS (
  SELECT t.log_file, CASE WHEN t.message = 'FMT' AND len(tokens) >= 6 THEN 'FMT' WHEN f.first_line < t.line_no THEN t.message
    WHEN regexp_full_match(line, '[\\x01-\\x7F]*') THEN 'INFO' ELSE 'UNPARSED' END AS counted_as,
    coalesce(f.first_line < t.line_no, false) AND NOT (t.message = 'FMT' AND len(tokens) >= 6) AS registered
  FROM typed t LEFT JOIN formats f ON f.log_file = t.log_file AND f.message = t.message
), counts AS (SELECT log_file, counted_as, registered, count(*) AS n FROM counted GROUP BY ALL)"""
_FIXES = """fixes AS (
  SELECT log_file, line_no, CAST(tokens[2] AS BIGINT) AS time_us, 315964800000000 + CAST(tokens[6] AS BIGINT) * 604800000000 + CAST(tokens[5] AS BIGINT) * 1000 - 18000000 AS utc_us
  FROM typed WHERE message = 'GPS' AND len(tokens) >= 6 AND CAST(tokens[4] AS INT) >= 3
)"""
_TEXT = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S.%f')"
_OVERVIEW = f"""{_COUNTED}, {_FIXES}, ends AS (
  SELECT log_file, count(*) AS anchors, {_TEXT.format("arg_min(utc_us, line_no)")} AS first_utc, {_TEXT.format("arg_max(utc_us, line_no)")} AS last_utc FROM fixes GROUP BY 1
), overview AS (
  SELECT c.log_file AS "LogFile", coalesce(any_value(anchors), 0) AS "AnchorCount", coalesce(any_value(first_utc), '') AS "FirstGpsUtc", coalesce(any_value(last_utc), '') AS "LastGpsUtc",
    count(*) FILTER (registered AND counted_as <> 'FMT') AS "MessageTypeCount",
    CAST(coalesce(sum(n) FILTER (NOT registered AND counted_as = 'INFO'), 0) AS BIGINT) AS "InfoLineCount",
    CAST(coalesce(sum(n) FILTER (NOT registered AND counted_as = 'UNPARSED'), 0) AS BIGINT) AS "UnparsedLineCount"
  FROM counts c LEFT JOIN ends USING (log_file) GROUP BY 1
)"""
_RECORDS = f"""{_LINES}, recs AS (
  SELECT t.log_file, t.line_no, t.message, f.cols, list_transform(range(1, len(f.cols) + 1), lambda k: CASE
    WHEN k < len(f.cols) THEN coalesce(tokens[k + 1], '') ELSE array_to_string(tokens[k + 1:], ',') END) AS vals
  FROM typed t JOIN formats f ON f.log_file = t.log_file AND f.message = t.message WHERE t.message <> 'FMT'
)"""


def _base(points: str, probes: str, key: str) -> str:
    """CTE ``based``: probes with seconds by linear anchors, ends extrapolated."""
    line = "({a}.y + CASE WHEN {b}.x = {a}.x THEN 0 ELSE (q.x - {a}.x)::DOUBLE / ({b}.x - {a}.x) * ({b}.y - {a}.y) END)"
    return f"""lo AS (SELECT q.*, a.x AS lx, a.y AS ly FROM {probes} q ASOF LEFT JOIN {points} a ON q.{key} = a.{key} AND q.x > a.x),
  both_ AS (SELECT q.*, a.x AS hx, a.y AS hy FROM lo q ASOF LEFT JOIN {points} a ON q.{key} = a.{key} AND q.x <= a.x),
  ends_ AS (SELECT {key}, list({{'x': x, 'y': y}} ORDER BY x, y) AS p FROM {points} GROUP BY 1),
  based AS (SELECT q.*, CASE WHEN len(p) = 1 THEN p[1].y WHEN lx IS NULL THEN {line.format(a="p[1]", b="p[2]")}
    WHEN hx IS NULL THEN {line.format(a="p[-2]", b="p[-1]")}
    ELSE CASE WHEN hx = lx THEN ly ELSE ly + (q.x - lx)::DOUBLE / (hx - lx) * (hy - ly) END END AS sec FROM both_ q LEFT JOIN ends_ USING ({key}))"""


# --- B -----------------------------------------------------------------------


def _linear(v: str, angle: bool = False) -> str:
    """Value at a probe with neighbours ``l`` and ``h`` and the fraction ``alpha``."""
    if angle:
        delta = f"((((h_{v} - l_{v} + 180) % 360) + 360) % 360 - 180)"
        mixed = f"(((l_{v} + {delta} * alpha) % 360) + 360) % 360"
    else:
        mixed = f"l_{v} + (h_{v} - l_{v}) * alpha"
    return f"CASE WHEN t <= first_t THEN h_{v} WHEN t > last_t THEN l_{v} WHEN t = last_t THEN h_{v} ELSE coalesce({mixed}, l_{v}, h_{v}) END"


def _asof(points: str, probes: str, key: str, values: dict[str, bool], out: str) -> str:
    """CTE ``out``: probes with each value interpolated and clamped."""
    names = list(values)
    take = lambda a, s: ", ".join(f"{a}.{v} AS {s}_{v}" for v in names)
    shown = ", ".join(f"{_linear(v, angle)} AS {v}" for v, angle in values.items())
    return f"""{out}_lo AS (SELECT q.*, a.t AS l_t, {take("a", "l")} FROM {probes} q ASOF LEFT JOIN {points} a ON q.{key} = a.{key} AND q.t > a.t),
  {out}_hi AS (SELECT q.*, a.t AS h_t, {take("a", "h")} FROM {out}_lo q ASOF LEFT JOIN {points} a ON q.{key} = a.{key} AND q.t <= a.t),
  {out}_ends AS (SELECT {key}, min(t) AS first_t, max(t) AS last_t FROM {points} GROUP BY 1),
  {out} AS (SELECT probe, {shown} FROM (SELECT *, (t - l_t)::DOUBLE / (h_t - l_t) AS alpha FROM {out}_hi LEFT JOIN {out}_ends USING ({key})))"""


_PROBES = "probes AS (SELECT event_id AS probe, user_id, t FROM e)"

# --- C -----------------------------------------------------------------------

_VIDEOS = f"""{_E}, videos AS (
  SELECT event_id, t, '/cam/' || CASE WHEN event_id % 2 = 0 THEN strftime(make_timestamp(t + 10800000000), '%Y_%m%d_%H%M%S') ELSE 'clip' END || '_' || event_id || '.MP4' AS video
  FROM e
), named AS (
  SELECT *, CASE WHEN regexp_matches(video, '\\d{{4}}_\\d{{4}}_\\d{{6}}')
    THEN epoch_us(strptime(regexp_extract(video, '\\d{{4}}_\\d{{4}}_\\d{{6}}'), '%Y_%m%d_%H%M%S')) - 10800000000 END AS stamp FROM videos
), cached AS (
  SELECT video, event_id, t + 5000000 AS start_us, CASE WHEN event_id % 3 = 0 AND event_id % 9 <> 0 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END AS offset_sec, (event_id % 10)::DOUBLE AS filename_delta_sec
  FROM videos WHERE (event_id % 3 = 0 AND event_id % 9 <> 0) OR event_id % 5 = 0
)"""

# --- D, E --------------------------------------------------------------------

_POINTS = "points AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 1600 AS x, l_quantity * 23.7::DOUBLE AS y FROM lineitem)"
_SIZES = "sizes AS (SELECT * FROM (VALUES (0, 512, 256), (1, 768, 384)) s(size_ord, size, stride))"


def _positions(length: str, size: str, stride: str) -> str:
    last = f"greatest({size} // 2, {length} - {size} // 2)"
    return f"CASE WHEN {length} <= {size} THEN [{length} // 2] ELSE list_sort(list_distinct(list_concat(range({size} // 2, {last} + 1, {stride}), [{last}]))) END"


_TILES = f"""{_SIZES}, cells AS (
  SELECT size_ord, size, stride, cy, unnest({_positions("1600", "size", "stride")}) AS cx FROM (SELECT *, unnest({_positions("1200", "size", "stride")}) AS cy FROM sizes)
), tiles AS (
  SELECT row_number() OVER (ORDER BY size_ord, cy, cx) - 1 AS tile_ord, printf('tile_%dpx_%04d', size, row_number() OVER (PARTITION BY size_ord ORDER BY cy, cx) - 1) AS tile_id,
    size::BIGINT AS tile_size_px, stride::BIGINT AS stride_px, cx::BIGINT AS center_x_px, cy::BIGINT AS center_y_px, (cx - size // 2)::BIGINT AS map_x0_px, (cy - size // 2)::BIGINT AS map_y0_px FROM cells
)"""
_G = GRID
_SCALED = f"(x / {_G.scale}::DOUBLE)", f"(y / {_G.scale}::DOUBLE)"
_DET = _G.a * _G.e - _G.b * _G.d
_H = KNOWN_H


def _through(x: str, y: str) -> tuple[str, str]:
    w = f"({_H[6]!r}::DOUBLE * {x} + {_H[7]!r}::DOUBLE * {y} + 1::DOUBLE)"
    return tuple(f"(({_H[k]!r}::DOUBLE * {x} + {_H[k + 1]!r}::DOUBLE * {y} + {_H[k + 2]!r}::DOUBLE) / {w})" for k in (0, 3))


_MATCHES = f"""raw AS (
  SELECT l_suppkey AS pair, l_orderkey AS k, l_linenumber AS n, l_extendedprice % 800 AS qx, (l_partkey * 7::DOUBLE) % 600 AS qy FROM lineitem
), matches AS (
  SELECT *, {_through("qx", "qy")[0]} AS px, {_through("qx", "qy")[1]} AS py, CASE WHEN (k + n) % 6 = 0 THEN 150::DOUBLE + k % 97 ELSE 0::DOUBLE END AS off FROM raw
)"""
_FITS = """fits AS (
  SELECT l_orderkey AS frame, l_linenumber::BIGINT AS tile_ord, trunc(l_quantity)::BIGINT AS match_count, floor(l_quantity * l_discount * 8)::BIGINT AS inlier_count, l_tax * 100 AS error, l_discount AS confidence FROM lineitem
), ratios AS (SELECT *, inlier_count::DOUBLE / greatest(1, match_count) AS ratio FROM fits
), scored AS (SELECT *, round(1.5::DOUBLE * inlier_count + 30::DOUBLE * ratio + 10::DOUBLE * confidence - 0.75::DOUBLE * error, 6) AS score FROM ratios
), passing AS (SELECT * FROM scored WHERE match_count >= 20 AND inlier_count >= 8 AND ratio >= 0.15::DOUBLE AND round(error, 6) <= 6)"""
_FRAMES = f"""{_E}, frames AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame_index, 'v' || user_id AS video, CASE WHEN user_id % 4 > 0 THEN (user_id % 4)::DOUBLE ELSE 30::DOUBLE END AS rate,
    CASE WHEN user_id % 3 = 0 THEN 0 ELSE 40 END AS total_frames FROM e
)"""
_TRACK = f"""{_FRAMES}, {_TILES}, cand AS (
  SELECT f.video, f.frame_index, c.tile_ord, c.tile_id, (center_x_px + event_id % 50)::DOUBLE AS x, (center_y_px - event_id % 30)::DOUBLE AS y, round(value, 3) AS score, center_x_px AS cx, center_y_px AS cy
  FROM frames f JOIN tiles c ON c.tile_ord = ((floor(value)::BIGINT % 36) + 36) % 36 WHERE event_type IN ('view', 'click')
), track AS (
  SELECT f.video, f.frame_index, f.event_id, f.value, c.tile_ord, c.tile_id, c.x, c.y, c.score, c.cx, c.cy,
    last_value(c.x IGNORE NULLS) OVER w AS shown_x, last_value(c.y IGNORE NULLS) OVER w AS shown_y, last_value(c.x IGNORE NULLS) OVER p AS last_x, last_value(c.y IGNORE NULLS) OVER p AS last_y
  FROM frames f LEFT JOIN cand c USING (video, frame_index)
  WINDOW w AS (PARTITION BY f.video ORDER BY f.frame_index ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY f.video ORDER BY f.frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_GLOBAL = """SELECT video, frame_index, CASE WHEN score IS NULL THEN 'lost' ELSE 'localized' END AS status, 'global' AS search_mode, shown_x AS map_center_x_px, shown_y AS map_center_y_px, score, coalesce(tile_id, '') AS tile_id FROM track"""


ORACLE_SQL: dict[str, str] = {
    "a_tokenize": f"""
WITH t AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ','), lambda x: {_STRIP}) AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, tokens[1] AS message, md5(array_to_string(tokens, '|')) AS tokens_md5 FROM t""",
    "a_classify_lines": "SELECT doc_id, CASE WHEN regexp_full_match(coalesce(text, ''), '[\\x01-\\x7F]*') THEN 'INFO' ELSE 'UNPARSED' END AS kind FROM documents",
    "a_sanitize": r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_.') AS s FROM documents)
SELECT doc_id, md5(CASE WHEN s = '' THEN 'log' ELSE s END) AS clean_md5 FROM c""",
    "a_registry": f"WITH {_LINES} SELECT log_file, message, array_to_string(cols, ', ') AS columns, first_line FROM formats",
    "a_message_counts": f"WITH {_COUNTED} SELECT * FROM counts",
    "a_records": f"WITH {_RECORDS} SELECT log_file, line_no, message, array_to_string(vals, '|') AS fields FROM recs",
    "a_loose_lines": f"""
WITH {_LINES} SELECT t.log_file, line_no, CASE WHEN regexp_full_match(line, '[\\x01-\\x7F]*') THEN 'INFO' ELSE 'UNPARSED' END AS kind, line
FROM typed t ANTI JOIN formats f ON f.log_file = t.log_file AND f.message = t.message WHERE t.message <> 'FMT'""",
    "a_anchors": f"WITH {_LINES}, {_FIXES} SELECT * FROM fixes",
    "a_gps_to_utc": f"""
WITH {_E}, u AS (SELECT event_id, 315964800000000 + (2200 + user_id % 100) * 604800000000 + event_id * 250000 - 18000000 AS utc_us FROM e)
SELECT event_id, utc_us, {_TEXT.format("utc_us")} AS utc FROM u""",
    "a_time_base": f"""
WITH {_E}, points AS (SELECT user_id, t AS x, trunc(value * 1000000)::BIGINT / 1000000::DOUBLE AS y FROM e WHERE event_type = 'signup'), probes AS (SELECT event_id, user_id, t AS x FROM e),
  {_base("points", "probes", "user_id")}
SELECT event_id, round(round_even(sec * 1000000, 0)::BIGINT / 1000000::DOUBLE, 3) AS seconds FROM based""",
    "a_enriched": f"""
WITH {_RECORDS}, {_FIXES}, points AS (SELECT log_file, time_us AS x, utc_us / 1000000::DOUBLE AS y FROM fixes),
  probes AS (SELECT log_file, line_no, message, CASE WHEN list_contains(cols, 'TimeUS') THEN CAST(vals[list_position(cols, 'TimeUS')] AS BIGINT) END AS x, list_contains(cols, 'TimeUS') AS has_time,
    CASE WHEN list_contains(cols, 'GWk') THEN 315964800000000 + CAST(vals[list_position(cols, 'GWk')] AS BIGINT) * 604800000000 + CAST(vals[list_position(cols, 'GMS')] AS BIGINT) * 1000 - 18000000 END AS own_us FROM recs),
  {_base("points", "probes", "log_file")}
SELECT log_file, line_no, message, CASE WHEN has_time THEN coalesce({_TEXT.format("round_even(sec * 1000000, 0)::BIGINT")}, '') END AS utc_approx, {_TEXT.format("own_us")} AS utc_gps FROM based""",
    "a_formats": f"""WITH {_LINES} SELECT log_file, message AS "Message", array_to_string(cols, ', ') AS "Columns" FROM formats""",
    "a_message_summary": f"""
WITH {_COUNTED}
SELECT c.log_file, counted_as AS "Message", n AS "Count", list_contains(cols, 'TimeUS')::INT AS "HasTimeUS",
  ((list_contains(cols, 'GWk') AND list_contains(cols, 'GMS')) OR (list_contains(cols, 'GPSWeek') AND list_contains(cols, 'GPSTime')))::INT AS "HasExactGpsUtc",
  counted_as || '.csv' AS "File", '' AS "Purpose", array_to_string(cols, ', ') AS "Columns"
FROM counts c JOIN formats f ON f.log_file = c.log_file AND f.message = c.counted_as WHERE registered AND counted_as <> 'FMT'
UNION ALL SELECT log_file, counted_as, n, 0, 0, counted_as || '.csv', CASE counted_as WHEN 'INFO' THEN 'plain-text information lines' ELSE 'binary or broken lines' END, 'RawLine'
FROM counts WHERE NOT registered AND counted_as IN ('INFO', 'UNPARSED')""",
    "a_log_overview": f"WITH {_OVERVIEW} SELECT * FROM overview",
    "a_export_index": f"""
WITH {_OVERVIEW}
SELECT "LogFile", 'out/' || "LogFile" AS "Folder", "MessageTypeCount" + ("InfoLineCount" > 0)::BIGINT + ("UnparsedLineCount" > 0)::BIGINT AS "MessageTypes", "AnchorCount" AS "GpsAnchors", "FirstGpsUtc", "LastGpsUtc" FROM overview""",
    "b_parse_dt": f"""
WITH {_E} SELECT event_id, CASE event_id % 7 WHEN 0 THEN t - t % 1000000 WHEN 2 THEN t - t % 86400000000 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE t END AS t_us FROM e""",
    "b_parse_float": f"""
WITH {_E}, x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id || '.5' AS DOUBLE) WHEN 3 THEN CAST('-' || event_id || 'e-2' AS DOUBLE) WHEN 5 THEN event_id::DOUBLE END AS number FROM e)
SELECT event_id, number, trunc(number)::BIGINT AS whole FROM x""",
    "b_first_nonempty": f"""
WITH {_E} SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR END, '')) AS chosen FROM e""",
    "b_gyro_magnitude": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS magnitude FROM lineitem",
    "b_asof_linear": f"""
WITH {_E}, {_PROBES}, points AS (SELECT user_id, t, value AS v FROM e WHERE event_type = 'view'), {_asof("points", "probes", "user_id", {"v": False}, "found")}
SELECT probe, round(v, 6) AS v FROM found""",
    "b_asof_angle": f"""
WITH {_E}, {_PROBES}, points AS (SELECT user_id, t, (((value * 7) % 360) + 360) % 360 AS angle FROM e WHERE event_type = 'view'), {_asof("points", "probes", "user_id", {"angle": True}, "found")}
SELECT probe, round(angle, 6) AS angle FROM found""",
    "b_nav_fusion": f"""
WITH {_E}, {_PROBES},
  ahr AS (SELECT user_id, t, value AS lat, value * 2 AS lon, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS alt, (((value * 7) % 360) + 360) % 360 AS yaw, value / 2 AS roll, -value AS pitch FROM e WHERE event_type = 'view'),
  gps AS (SELECT user_id, t, value + 1 AS lat, value + 2 AS lon, value + 3 AS alt, value / 4 AS speed, (((value * 11) % 360) + 360) % 360 AS course FROM e WHERE event_type = 'click'),
  imu AS (SELECT user_id, t, value AS gyro FROM e WHERE event_type = 'purchase'),
  {_asof("ahr", "probes", "user_id", {"lat": False, "lon": False, "alt": False, "yaw": True, "roll": False, "pitch": False}, "a")},
  {_asof("gps", "probes", "user_id", {"lat": False, "lon": False, "alt": False, "speed": False, "course": True}, "g")},
  {_asof("imu", "probes", "user_id", {"gyro": False}, "i")}
SELECT probe, round(coalesce(nullif(a.lat, 0), g.lat), 6) AS latitude, round(coalesce(nullif(a.lon, 0), g.lon), 6) AS longitude, round(coalesce(nullif(a.alt, 0), g.alt), 6) AS altitude_m,
  round(yaw, 6) AS yaw_deg, round(roll, 6) AS roll_deg, round(pitch, 6) AS pitch_deg, round(speed, 6) AS gps_speed_mps, round(course, 6) AS gps_course_deg, round(gyro, 6) AS imu_gyro_magnitude
FROM a JOIN g USING (probe) JOIN i USING (probe)""",
    "c_filename_start": f"WITH {_VIDEOS} SELECT event_id, stamp AS start_us FROM named",
    "c_cached_sync": f"WITH {_VIDEOS} SELECT video, start_us, offset_sec, filename_delta_sec FROM cached",
    "c_resolve_start": f"""
WITH {_VIDEOS} SELECT n.event_id, coalesce(c.start_us, n.stamp) AS start_us, CASE WHEN c.start_us IS NOT NULL THEN 'cached_epoch_sync' WHEN n.stamp IS NOT NULL THEN 'filename_timestamp' END AS start_source
FROM named n LEFT JOIN cached c USING (video)""",
    "c_choose_log": f"""
WITH {_E}, logs AS (SELECT user_id AS ord, 'log' || user_id AS log_file, 'f' || user_id AS folder, min(t) AS s, max(t) AS z FROM e WHERE event_type = 'signup' GROUP BY 1),
  v AS (SELECT event_id AS video, t, CASE WHEN event_id % 4 <> 0 THEN (event_id % 1000) * 60000000 END AS dur FROM e),
  k AS (SELECT *, CASE WHEN dur IS NULL THEN 0 ELSE greatest(0, least(t + dur, z) - greatest(t, s)) END AS us FROM v, logs),
  r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY us > 0 DESC, us DESC, (t BETWEEN s AND z) DESC, abs(s - t), least(abs(s - t), abs(z - t)), ord) AS n FROM k)
SELECT video, log_file, folder, round(us / 1000000::DOUBLE, 6) AS overlap_sec FROM r WHERE n = 1""",
    "d_affine": f"""
WITH {_POINTS} SELECT l_orderkey, l_linenumber, round({_G.a}::DOUBLE * {_SCALED[0]} + {_G.b}::DOUBLE * {_SCALED[1]} + {_G.c}::DOUBLE, 4) AS x_proj,
  round({_G.d}::DOUBLE * {_SCALED[0]} + ({_G.e}::DOUBLE) * {_SCALED[1]} + {_G.f}::DOUBLE, 4) AS y_proj FROM points""",
    "d_affine_inverse": f"""
WITH {_POINTS}, u AS (SELECT l_orderkey, l_linenumber, (x + 400000) - {_G.c}::DOUBLE AS u, (4400000 - y) - {_G.f}::DOUBLE AS v FROM points)
SELECT l_orderkey, l_linenumber, round((({_G.e}::DOUBLE) * u - {_G.b}::DOUBLE * v) / ({_DET!r}::DOUBLE) * {_G.scale}::DOUBLE, 4) AS x_px,
  round(({_G.a}::DOUBLE * v - {_G.d}::DOUBLE * u) / ({_DET!r}::DOUBLE) * {_G.scale}::DOUBLE, 4) AS y_px FROM u""",
    "d_latlon_roundtrip": f"WITH {_POINTS} SELECT l_orderkey, l_linenumber, round(x, 3) AS x_px, round(y, 3) AS y_px FROM points",
    "d_crop_window": f"""
WITH {_POINTS}, w AS (SELECT l_orderkey, l_linenumber, round_even(x, 0)::BIGINT - 256 AS x0, round_even(y, 0)::BIGINT - 256 AS y0 FROM points)
SELECT *, greatest(0, -x0) AS pad_left, greatest(0, x0 + 512 - 1600) AS pad_right, greatest(0, -y0) AS pad_top, greatest(0, y0 + 512 - 1200) AS pad_bottom FROM w""",
    "d_grid_positions": f"""
WITH l AS (SELECT p_partkey, p_size * 37 + 100 AS n FROM part) SELECT p_partkey, array_to_string({_positions("n", "512", "256")}, ',') AS centers FROM l""",
    "e_build_tiles": f"WITH {_TILES} SELECT * FROM tiles",
    "e_tiles_near": f"""
WITH {_POINTS}, {_TILES} SELECT l_orderkey, l_linenumber, count(*) AS n_tiles, min(tile_ord) AS first_tile FROM points JOIN tiles
ON (center_x_px - x) * (center_x_px - x) + (center_y_px - y) * (center_y_px - y) <= 420 * 420 GROUP BY ALL""",
    "e_nearest_tiles": f"""
WITH {_POINTS}, {_TILES}, p AS (SELECT *, row_number() OVER () AS id FROM points),
  r AS (SELECT l_orderkey, l_linenumber, tile_ord, row_number() OVER (PARTITION BY id ORDER BY (center_x_px - x) * (center_x_px - x) + (center_y_px - y) * (center_y_px - y), tile_ord) - 1 AS rank FROM p, tiles)
SELECT l_orderkey, l_linenumber, rank, tile_ord FROM r WHERE rank < 4""",
    "f_mutual_nn": """
WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 5 AS pair, label >= 5 AS ref FROM embeddings),
  s AS (SELECT q.pair, q.vec_id AS query_id, r.vec_id AS ref_id, list_inner_product(q.v, r.v) AS score FROM d q JOIN d r ON q.pair = r.pair AND NOT q.ref AND r.ref),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS a, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, query_id) AS b FROM s)
SELECT pair, query_id, ref_id, round(score, 6) AS score FROM k WHERE a = 1 AND b = 1""",
    "f_match_threshold": """
WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 5 AS pair, label >= 5 AS ref FROM embeddings),
  s AS (SELECT q.pair, q.vec_id AS query_id, r.vec_id AS ref_id, list_inner_product(q.v, r.v) AS score FROM d q JOIN d r ON q.pair = r.pair AND NOT q.ref AND r.ref),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS a, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, query_id) AS b FROM s)
SELECT pair, count(*) AS match_count, round(max(score), 6) AS best FROM k WHERE a = 1 AND b = 1 AND score >= 0.1 GROUP BY pair""",
    "g_homography_recover": f"""
WITH {_MATCHES} SELECT pair, count(*) AS match_count, count(*) FILTER (off = 0) AS inlier_count, {", ".join(f"round({_H[k]!r}::DOUBLE, 4) AS h{k}" for k in range(8))} FROM matches GROUP BY pair""",
    "g_reprojection": f"""
WITH {_MATCHES} SELECT pair, round(coalesce(avg(sqrt(off * off + off * off)) FILTER ((k + n) % 2 = 0), 'inf'::DOUBLE), 4) AS reprojection_error FROM matches GROUP BY pair""",
    "g_project_geometry": "WITH p AS (SELECT p_partkey, (p_size * 16 + 319)::DOUBLE AS r, (p_size * 9 + 179)::DOUBLE AS b, 0::DOUBLE AS z FROM part) SELECT p_partkey, "
    + ", ".join(f"round({c}, 4) AS {a}{k}" for k, (x, y) in enumerate((("z", "z"), ("r", "z"), ("r", "b"), ("z", "b"))) for a, c in zip("xy", _through(x, y)))
    + ", "
    + ", ".join(f"round({c}, 4) AS c{a}" for a, c in zip("xy", _through("(r * 0.5::DOUBLE)", "(b * 0.5::DOUBLE)")))
    + " FROM p",
    "g_center_gate": f"WITH {_POINTS} SELECT l_orderkey, l_linenumber, (x - 500 BETWEEN -76.8 AND 588.8) AND (y - 300 BETWEEN -76.8 AND 588.8) AS near FROM points",
    "g_score": f"WITH {_FITS} SELECT frame, tile_ord, round(score, 4) AS score FROM scored",
    "g_filter_cascade": f"WITH {_FITS} SELECT frame, tile_ord, match_count, inlier_count FROM passing",
    "g_best_candidate": f"""
WITH {_FITS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, tile_ord) AS n FROM passing) SELECT frame, tile_ord, round(score, 4) AS score FROM r WHERE n = 1""",
    "g_frame_sampling": f"""
WITH {_FRAMES}, s AS (SELECT *, greatest(1, round_even(1.5::DOUBLE * rate, 0))::BIGINT AS step, round_even(2 * rate, 0)::BIGINT AS start FROM frames)
SELECT video, frame_index, (frame_index - start) // step AS sampled_index, round(frame_index / rate, 6) AS video_time_sec FROM s
WHERE frame_index >= start AND (frame_index - start) % step = 0 AND (total_frames = 0 OR frame_index < total_frames OR frame_index = start) AND (frame_index - start) // step < 20""",
    "g_query_resize": """
WITH p AS (SELECT p_partkey, p_size * 41 + 100 AS w, p_partkey % 1500 + 50 AS h FROM part), s AS (SELECT *, 960::DOUBLE / greatest(w, h) AS s FROM p)
SELECT p_partkey, CASE WHEN greatest(w, h) <= 960 THEN w ELSE greatest(1, round_even(w * s, 0)) END::BIGINT AS width, CASE WHEN greatest(w, h) <= 960 THEN h ELSE greatest(1, round_even(h * s, 0)) END::BIGINT AS height FROM s""",
    "g_search_mode": f"""
WITH {_FRAMES}, l AS (SELECT *, coalesce(bool_or(event_type = 'view') OVER (PARTITION BY video ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS has_last FROM frames)
SELECT event_id, CASE WHEN has_last AND frame_index % 12 <> 0 THEN 'track_local' WHEN event_type = 'click' THEN 'telemetry_prior' ELSE 'global' END AS search_mode FROM l""",
    "g_stateful_track": f"""
WITH {_TRACK}, f AS (
  SELECT *, (value * 10) % 1600 AS prior_x, (value * 3) % 1200 AS prior_y, event_id % 7 = 0 AS has_prior, last_x IS NOT NULL AND frame_index % 12 <> 0 AS local_ FROM track
), m AS (
  SELECT *, CASE WHEN local_ THEN 'track_local' WHEN has_prior THEN 'telemetry_prior' ELSE 'global' END AS mode, CASE WHEN local_ THEN last_x ELSE prior_x END AS nx, CASE WHEN local_ THEN last_y ELSE prior_y END AS ny FROM f
), d AS (
  SELECT *, CASE WHEN mode = 'global' OR score IS NULL THEN true ELSE (SELECT count(*) FROM tiles o WHERE
    (o.center_x_px - nx) * (o.center_x_px - nx) + (o.center_y_px - ny) * (o.center_y_px - ny) < (cx - nx) * (cx - nx) + (cy - ny) * (cy - ny)
    OR ((o.center_x_px - nx) * (o.center_x_px - nx) + (o.center_y_px - ny) * (o.center_y_px - ny) = (cx - nx) * (cx - nx) + (cy - ny) * (cy - ny) AND o.tile_ord < m.tile_ord)) < 4 END AS inside FROM m
)
SELECT video, frame_index, CASE WHEN score IS NULL THEN 'lost' ELSE 'localized' END AS status, CASE WHEN inside THEN mode ELSE 'global_fallback' END AS search_mode,
  shown_x AS map_center_x_px, shown_y AS map_center_y_px, score, coalesce(tile_id, '') AS tile_id FROM d""",
    "g_global_track": f"WITH {_TRACK} {_GLOBAL}",
    "g_result_rows": f"""
WITH {_TRACK} SELECT frame_index::VARCHAR AS "FrameIndex", round_even(frame_index / 30::DOUBLE, 3)::VARCHAR AS "VideoTimeSec", CASE WHEN score IS NULL THEN 'lost' ELSE 'localized' END AS "Status", 'global' AS "SearchMode",
  CASE WHEN score IS NULL THEN '' ELSE '39.80000000' END AS "Latitude", CASE WHEN score IS NULL THEN '' ELSE '32.30000000' END AS "Longitude", coalesce(printf('%.2f', shown_x), '') AS "MapCenterXPx", coalesce(printf('%.2f', shown_y), '') AS "MapCenterYPx",
  coalesce(printf('%.4f', score), '') AS "Score", coalesce(tile_id, '') AS "TileId", CASE WHEN score IS NULL THEN '0' ELSE '25' END AS "MatchCount", CASE WHEN score IS NULL THEN '0' ELSE '13' END AS "InlierCount",
  CASE WHEN score IS NULL THEN '0.0000' ELSE '0.5200' END AS "InlierRatio", CASE WHEN score IS NULL THEN '0.0000' ELSE '0.2000' END AS "MeanMatchConfidence", CASE WHEN score IS NULL THEN '' ELSE '2.2000' END AS "ReprojectionErrorPx" FROM track""",
    "g_map_center": """
WITH c AS (SELECT l_orderkey AS frame_index, l_linenumber::BIGINT AS tile_ord, l_partkey % 100 + 319.5::DOUBLE AS cx, l_suppkey % 50 + 239.5::DOUBLE AS cy, l_suppkey % 1000 AS x0, l_partkey % 700 AS y0 FROM lineitem)
SELECT frame_index, tile_ord, x0 + cx AS map_center_x_px, y0 + cy AS map_center_y_px, round(40 - 0.001::DOUBLE * (y0 + cy) / 0.5::DOUBLE, 6) AS latitude, round(30 + 0.001::DOUBLE * (x0 + cx) / 0.5::DOUBLE, 6) AS longitude,
  round(1.5::DOUBLE * 13 + 30::DOUBLE * 13 / 25 + 10 * 0.2::DOUBLE - 0.75::DOUBLE * 2, 6) AS score
FROM c WHERE cx BETWEEN -76.8 AND 588.8 AND cy BETWEEN -76.8 AND 588.8""",
    "h_run_summary": f"WITH {_TRACK} SELECT video, count(*) AS frames, count(score) AS localized, round(avg(score), 9) AS mean_score FROM track GROUP BY video",
    "i_submitted": f"WITH {_FRAMES} SELECT event_id, video, frame_index FROM frames WHERE frame_index % 5 = 0",
    "i_latest_wins": f"""
WITH {_FRAMES} SELECT video || '/' || (t // 86400000000) AS slot, max(frame_index) AS frame_index, arg_max(event_id, frame_index) AS event_id FROM frames GROUP BY 1""",
    "i_conflated": f"""
WITH {_FRAMES}, s AS (SELECT video, t // 86400000000 AS slot, max(frame_index) AS frame_index, arg_max(event_id, frame_index) AS event_id, count(*) AS n FROM frames WHERE frame_index % 2 = 0 GROUP BY 1, 2)
SELECT video, slot, frame_index, event_id, (sum(n) OVER (PARTITION BY video ORDER BY slot) - 1)::BIGINT AS sampled_index FROM s""",
    "i_emit_once": f"""
WITH {_FRAMES}, s AS (SELECT video, event_id AS seq, frame_index // 3 AS shown FROM frames), l AS (SELECT *, lag(shown) OVER (PARTITION BY video ORDER BY seq) AS b FROM s)
SELECT video, seq, shown FROM l WHERE shown IS DISTINCT FROM b""",
    "i_match_age": f"""
WITH {_FRAMES}, l AS (SELECT event_id, t / 1000000::DOUBLE AS now, last_value(CASE WHEN event_type = 'view' THEN t / 1000000::DOUBLE END IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS m FROM frames)
SELECT event_id, round(CASE WHEN m IS NULL THEN 0 ELSE greatest(0, now - m) END, 3) AS age FROM l""",
    "i_track_tail": f"""
WITH {_TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_index DESC) AS r, count(*) OVER (PARTITION BY video) AS n FROM track WHERE score IS NOT NULL)
SELECT video, frame_index, x AS map_center_x_px, y AS map_center_y_px FROM r WHERE r <= 40 AND n >= 2""",
    "i_line_sample": f"""
WITH {_MATCHES}, i AS (SELECT pair, k * 10 + n AS o, (k + n) % 6 <> 0 AS inlier FROM matches), s AS (SELECT *, bool_or(inlier) OVER (PARTITION BY pair) AS has FROM i),
  r AS (SELECT pair, o, count(*) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY o) - 1 AS j FROM s WHERE inlier OR NOT has)
SELECT pair, o FROM r WHERE n <= 8 OR (j % greatest(1, n // 8) = 0 AND j // greatest(1, n // 8) < 8)""",
    "i_letterbox": """
WITH p AS (SELECT p_partkey, p_size * 41 + 100 AS w, p_partkey % 1500 + 50 AS h FROM part), s AS (SELECT *, least(960::DOUBLE / w, 540::DOUBLE / h) AS s FROM p),
  b AS (SELECT p_partkey, greatest(1, round_even(w * s, 0))::BIGINT AS width, greatest(1, round_even(h * s, 0))::BIGINT AS height FROM s)
SELECT *, (960 - width) // 2 AS offset_x, (540 - height) // 2 AS offset_y FROM b""",
    "i_telemetry_prior": f"""
WITH {_E}, {_PROBES}, p AS (SELECT user_id, t, event_type, (((value * 10) % 1600) + 1600) % 1600 AS px, (((value * 3) % 1200) + 1200) % 1200 AS py FROM e),
  ahr AS (SELECT user_id, t, px, py FROM p WHERE event_type = 'view'), gps AS (SELECT user_id, t, px, py FROM p WHERE event_type = 'click'),
  {_asof("ahr", "probes", "user_id", {"px": False, "py": False}, "a")},
  {_asof("gps", "probes", "user_id", {"px": False, "py": False}, "g")}
SELECT probe AS event_id, round(coalesce(a.px, g.px), 3) AS prior_x, round(coalesce(a.py, g.py), 3) AS prior_y FROM a JOIN g USING (probe)""",
}
