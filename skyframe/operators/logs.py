"""Flight-log text to typed tables and catalogs.

Input rows are ``log_file, line_no, line`` (see :mod:`..sources.logs`): stripped,
non-empty lines with their physical numbers.  All operators are per log, so many
logs are processed at once; registries are small and aggregated in part first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gps_to_utc_us, is_plain_ascii, parse_time_us, sanitize_name, strip, utc_text
from .timeseries import time_base

#: What well-known message types hold (fixed values).
KEY_CHANNELS = {
    "GPS": "GNSS position and velocity",
    "GPA": "GNSS accuracy metrics",
    "ATT": "attitude controller state",
    "AHR2": "fused attitude and position",
    "POS": "position estimate",
    "IMU": "raw fused IMU sample",
    "ACC": "accelerometer stream",
    "GYR": "gyroscope stream",
    "BARO": "barometer",
    "MAG": "magnetometer",
    "BAT": "battery",
    "MODE": "flight mode changes",
    "CAM": "camera trigger pose",
    "TRIG": "camera trigger events",
    "XKF1": "EKF state estimate",
    "XKF2": "EKF sensor state",
    "XKF3": "EKF innovations",
    "XKF4": "EKF consistency",
    "XKF5": "EKF terrain/range",
    "VIBE": "vibration diagnostics",
    "RCIN": "input PWM",
    "RCOU": "output PWM",
}


def tokenize(lines: DataFrame) -> DataFrame:
    """``lines`` with ``tokens`` (split at commas, stripped) and ``message``, the first."""
    out = lines.withColumn("tokens", F.transform(F.split("line", ","), strip))
    return out.withColumn("message", F.get("tokens", F.lit(0)))


def _is_format(message: Column, tokens: Column) -> Column:
    return (message == "FMT") & (F.size(tokens) >= 6)


def registry(tokens: DataFrame) -> DataFrame:
    """``log_file, message, columns, first_line``: what FMT records declare; the last
    record of a name wins, ``first_line`` is its earliest."""
    found = tokens.where(_is_format(F.col("message"), F.col("tokens")))
    columns = F.slice("tokens", 6, F.size("tokens") - 5)
    return found.groupBy("log_file", F.get("tokens", F.lit(3)).alias("message")).agg(F.max_by(columns, "line_no").alias("columns"), F.min("line_no").alias("first_line"))


def classify(tokens: DataFrame, formats: DataFrame) -> DataFrame:
    """``tokens`` with ``counted_as``: the message type if it is registered by that
    line, FMT for format records, else INFO (plain ASCII) or UNPARSED."""
    known = formats.select("log_file", "message", "first_line")
    out = tokens.join(known, ["log_file", "message"], "left")
    loose = F.when(is_plain_ascii(F.col("line")), F.lit("INFO")).otherwise(F.lit("UNPARSED"))
    kind = F.when(_is_format(F.col("message"), F.col("tokens")), F.lit("FMT")).when(F.col("first_line") < F.col("line_no"), F.col("message")).otherwise(loose)
    registered = (F.col("first_line") < F.col("line_no")) & ~_is_format(F.col("message"), F.col("tokens"))
    return out.withColumns({"counted_as": kind, "registered": F.coalesce(registered, F.lit(False))}).drop("first_line")


def message_counts(classified: DataFrame) -> DataFrame:
    """``log_file, counted_as, registered, n``; a registered type may be named INFO."""
    return classified.groupBy("log_file", "counted_as", "registered").agg(F.count("*").alias("n"))


def anchors(tokens: DataFrame) -> DataFrame:
    """``log_file, line_no, time_us, utc_us``: GPS lines of six tokens or more with a
    fix (status 3 or better), by place, whatever the registry says."""
    gps = tokens.where((F.col("message") == "GPS") & (F.size("tokens") >= 6))
    at = lambda k: F.get("tokens", F.lit(k))
    fixed = gps.where(parse_time_us(at(3)) >= 3)
    out = fixed.select("log_file", "line_no", parse_time_us(at(1)).alias("time_us"), gps_to_utc_us(at(5), at(4)).alias("utc_us"))
    return out.where("time_us is not null and utc_us is not null")


def records(tokens: DataFrame, formats: DataFrame) -> DataFrame:
    """``log_file, line_no, message, columns, values``: lines of registered types (by
    the whole log's registry).  Values are padded with empty text to the declared
    width; surplus commas stay in the last value.  Format records are left out."""
    known = formats.select("log_file", "message", "columns").where(F.size("columns") > 0)
    lines = tokens.where("message != 'FMT'").join(known, ["log_file", "message"])
    parts = F.transform(F.split(F.col("line"), ",", F.size("columns") + 1), strip)
    blank = lambda p: F.array_repeat(F.lit(""), F.greatest(F.size("columns") + 1 - F.size(p), F.lit(0)))
    filled = F.transform(F.array(parts), lambda p: F.slice(F.concat(p, blank(p)), 2, F.size("columns")))  # the parts are made once
    padded = F.get(filled, F.lit(0))
    return lines.select("log_file", "line_no", "message", "columns", padded.alias("values"))


def loose_lines(tokens: DataFrame, formats: DataFrame) -> DataFrame:
    """``log_file, line_no, line, kind``: INFO and UNPARSED lines by the whole log's
    registry."""
    known = formats.where(F.size("columns") > 0).select("log_file", "message")
    rest = tokens.where("message != 'FMT'").join(known, ["log_file", "message"], "left_anti")
    return rest.select("log_file", "line_no", "line", F.when(is_plain_ascii(F.col("line")), F.lit("INFO")).otherwise(F.lit("UNPARSED")).alias("kind"))


def _has(name: str) -> Column:
    return F.array_contains("columns", name)


def has_exact_time() -> Column:
    """Whether a type declares a GPS week and time."""
    return (_has("GWk") & _has("GMS")) | (_has("GPSWeek") & _has("GPSTime"))


def exact_utc_us() -> Column:
    """A record's own GPS time: the first declared pair decides, even if it is no
    number."""
    return F.when(_has("GWk") & _has("GMS"), gps_to_utc_us(_value("GWk"), _value("GMS"))).when(_has("GPSWeek") & _has("GPSTime"), gps_to_utc_us(_value("GPSWeek"), _value("GPSTime")))


def _value(name: str) -> Column:
    return F.get("values", (F.nullif(F.array_position("columns", name), F.lit(0).cast("bigint")) - 1).cast("int"))


def enrich(recs: DataFrame, fixes: DataFrame) -> DataFrame:
    """``recs`` with ``utc_approx`` (text; null for types without TimeUS) and
    ``utc_gps`` (text; null for types whose first record has no exact time)."""
    timed = recs.withColumn("time_us", parse_time_us(_value("TimeUS")))
    based = time_base(fixes.select("log_file", "time_us", "utc_us"), timed, "log_file", "time_us")
    first = recs.where(has_exact_time()).groupBy("log_file", "message").agg(F.min_by(F.struct("columns", "values"), "line_no").alias("r")).select("log_file", "message", "r.*")
    out = based.join(first.where(exact_utc_us().isNotNull()).select("log_file", "message", F.lit(True).alias("_exact")), ["log_file", "message"], "left")
    return out.select(
        "log_file",
        "line_no",
        "message",
        "columns",
        "values",
        F.when(_has("TimeUS"), utc_text(F.col("utc_us"))).alias("utc_approx"),
        F.when(F.col("_exact"), utc_text(exact_utc_us())).alias("utc_gps"),
    )


def formats_catalog(formats: DataFrame) -> DataFrame:
    """``log_file, Message, Columns`` as text."""
    return formats.select("log_file", F.col("message").alias("Message"), F.array_join("columns", ", ").alias("Columns"))


def message_summary(counts: DataFrame, formats: DataFrame) -> DataFrame:
    """One row per counted type (not FMT), then INFO and UNPARSED where there are any."""
    purposes = F.create_map(*[F.lit(x) for pair in KEY_CHANNELS.items() for x in pair])
    typed = counts.where("registered").select("log_file", F.col("counted_as").alias("message"), "n").join(formats, ["log_file", "message"], "left")
    rows = typed.select(
        "log_file",
        F.col("message").alias("Message"),
        F.col("n").alias("Count"),
        _has("TimeUS").cast("int").alias("HasTimeUS"),
        has_exact_time().cast("int").alias("HasExactGpsUtc"),
        F.concat(sanitize_name(F.col("message")), F.lit(".csv")).alias("File"),
        F.coalesce(F.try_element_at(purposes, F.col("message")), F.lit("")).alias("Purpose"),
        F.array_join("columns", ", ").alias("Columns"),
    )
    loose = counts.where("not registered and counted_as in ('INFO', 'UNPARSED')").select(
        "log_file",
        F.col("counted_as").alias("Message"),
        F.col("n").alias("Count"),
        F.lit(0).alias("HasTimeUS"),
        F.lit(0).alias("HasExactGpsUtc"),
        F.concat("counted_as", F.lit(".csv")).alias("File"),
        F.when(F.col("counted_as") == "INFO", F.lit("plain-text information lines")).otherwise(F.lit("binary or broken lines")).alias("Purpose"),
        F.lit("RawLine").alias("Columns"),
    )
    return rows.where("Message != 'FMT'").unionByName(loose)


def log_overview(counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row per log: anchors (the first and last in file order), types, loose lines."""
    typed = F.col("registered") & (F.col("counted_as") != "FMT")
    per_log = counts.groupBy("log_file").agg(
        F.count_if(typed).alias("MessageTypeCount"),
        F.sum(F.when(~F.col("registered") & (F.col("counted_as") == "INFO"), F.col("n")).otherwise(0)).alias("InfoLineCount"),
        F.sum(F.when(~F.col("registered") & (F.col("counted_as") == "UNPARSED"), F.col("n")).otherwise(0)).alias("UnparsedLineCount"),
    )
    ends = fixes.groupBy("log_file").agg(F.count("*").alias("AnchorCount"), F.min_by("utc_us", "line_no").alias("_first"), F.max_by("utc_us", "line_no").alias("_last"))
    return per_log.join(ends, "log_file", "left").select(
        F.col("log_file").alias("LogFile"),
        F.coalesce("AnchorCount", F.lit(0).cast("bigint")).alias("AnchorCount"),
        utc_text(F.col("_first")).alias("FirstGpsUtc"),
        utc_text(F.col("_last")).alias("LastGpsUtc"),
        "MessageTypeCount",
        "InfoLineCount",
        "UnparsedLineCount",
    )


def export_index(overview: DataFrame, folder: Column) -> DataFrame:
    """One row per log; INFO and UNPARSED count as one type each where present."""
    types = F.col("MessageTypeCount") + (F.col("InfoLineCount") > 0).cast("bigint") + (F.col("UnparsedLineCount") > 0).cast("bigint")
    return overview.select("LogFile", folder.alias("Folder"), types.alias("MessageTypes"), F.col("AnchorCount").alias("GpsAnchors"), "FirstGpsUtc", "LastGpsUtc")
