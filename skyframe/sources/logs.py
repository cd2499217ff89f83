"""Log folders in, CSV tables out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_non_empty, parse_dt_us, parse_float, python_repr
from ..operators.logs import records

#: Python's universal line ends; other separators stay inside a line.
_LINE_END = re.compile(rb"\r\n|\n|\r")


def scan_logs(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """``log_file, line_no, line``: stripped non-empty lines of all matching files,
    numbered from 1 with blank lines counted; invalid bytes are dropped.

    A file is one row of at most 2 GB while it is split, in the task that reads it.
    Raises FileNotFoundError if no file matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if not files.select("path").take(1):
        raise FileNotFoundError(f"no {pattern} files in {folder}")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                numbers, lines = [], []
                for n, raw in enumerate(_LINE_END.split(content), start=1):
                    line = raw.decode("utf-8", "ignore").strip()
                    if line:
                        numbers.append(n)
                        lines.append(line)
                    if len(lines) >= 50_000:
                        yield pd.DataFrame({"log_file": name, "line_no": numbers, "line": lines})
                        numbers, lines = [], []
                yield pd.DataFrame({"log_file": pd.Series([name] * len(lines), dtype=str), "line_no": pd.Series(numbers, dtype="int64"), "line": pd.Series(lines, dtype=str)})

    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    return files.select(F.url_decode(name).alias("name"), "content").mapInPandas(split, "log_file string, line_no long, line string")


def write_records(enriched: DataFrame, loose: DataFrame, target: str) -> None:
    """The long form of all typed records and loose lines as Parquet, partitioned by
    log and message: readers prune to the types they need."""
    fields = F.map_from_arrays(F.array_distinct("columns"), F.transform(F.array_distinct("columns"), lambda c: F.element_at("values", F.array_position("columns", c).cast("int"))))
    enriched.select("log_file", "line_no", "message", "utc_approx", "utc_gps", fields.alias("fields")).write.mode("overwrite").partitionBy("log_file", "message").parquet(f"{target}/records")
    raw = F.when(F.col("kind") == "UNPARSED", python_repr(F.col("line"))).otherwise(F.col("line"))
    loose.select("log_file", "kind", F.col("line_no").alias("LineNo"), raw.alias("RawLine")).write.mode("overwrite").partitionBy("log_file", "kind").parquet(f"{target}/loose")


def write_channel_csv(enriched: DataFrame, log_file: str, message: str, target: str) -> None:
    """One type of one log as CSV: LineNo, UTC_Approx and UTC_GPS where the type has
    them, then its columns, in line order."""
    own = enriched.where((F.col("log_file") == log_file) & (F.col("message") == message))
    first = own.select("columns", F.col("utc_approx").isNotNull().alias("approx"), F.col("utc_gps").isNotNull().alias("gps")).first()
    if first is None:
        return
    extra = [c for c, there in (("UTC_Approx", first["approx"]), ("UTC_GPS", first["gps"])) if there]
    columns = [F.get("values", F.lit(k)).alias(c) for k, c in enumerate(first["columns"])]
    rows = own.select(F.col("line_no").alias("LineNo"), *[F.col({"UTC_Approx": "utc_approx", "UTC_GPS": "utc_gps"}[c]).alias(c) for c in extra], *columns)
    rows.orderBy("LineNo").write.mode("overwrite").csv(target, header=True, emptyValue="", lineSep="\r\n")


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table as text columns by header name, byte order mark dropped, empty
    fields as empty text."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.removeprefix("﻿")) for c in rows.columns])


def _get(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def _pick(rows: DataFrame, *names: str) -> Column:
    return first_non_empty(*[_get(rows, n) for n in names])


def attitude_points(rows: DataFrame, flight: str) -> DataFrame:
    """Attitude and position series from a channel's text rows; rows without a time go."""
    number = lambda *names: parse_float(_pick(rows, *names))
    out = rows.select(
        F.lit(flight).alias("flight"),
        _get(rows, "LineNo").try_cast("bigint").alias("line_no"),
        parse_dt_us(_pick(rows, "UTC_Approx", "UTC_GPS")).alias("t"),
        number("Lat").alias("latitude"),
        number("Lng", "Lon").alias("longitude"),
        number("Alt").alias("altitude_m"),
        number("Yaw").alias("yaw_deg"),
        number("Roll").alias("roll_deg"),
        number("Pitch").alias("pitch_deg"),
    )
    return out.where("t is not null")


def position_points(rows: DataFrame, flight: str) -> DataFrame:
    """Position, speed and course series."""
    number = lambda *names: parse_float(_pick(rows, *names))
    out = rows.select(
        F.lit(flight).alias("flight"),
        _get(rows, "LineNo").try_cast("bigint").alias("line_no"),
        parse_dt_us(_pick(rows, "UTC_GPS", "UTC_Approx")).alias("t"),
        number("Lat").alias("latitude"),
        number("Lng", "Lon").alias("longitude"),
        number("Alt").alias("altitude_m"),
        number("Spd").alias("gps_speed_mps"),
        number("GCrs", "Heading", "Yaw").alias("gps_course_deg"),
    )
    return out.where("t is not null")


def turn_rate_points(rows: DataFrame, flight: str) -> DataFrame:
    """Turn-rate magnitude series; rows without a time or any axis go."""
    x, y, z = (parse_float(_get(rows, c)) for c in ("GyrX", "GyrY", "GyrZ"))
    out = rows.select(
        F.lit(flight).alias("flight"),
        _get(rows, "LineNo").try_cast("bigint").alias("line_no"),
        parse_dt_us(_pick(rows, "UTC_Approx", "UTC_GPS")).alias("t"),
        F.sqrt(x * x + y * y + z * z).alias("imu_gyro_magnitude"),
    )
    return out.where("t is not null and imu_gyro_magnitude is not null")


def load_navigation(spark: SparkSession, folder: str, flight: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(attitude, position, turn rate) of a folder of channel CSVs."""
    return (
        attitude_points(read_table_csv(spark, f"{folder}/AHR2.csv"), flight),
        position_points(read_table_csv(spark, f"{folder}/GPS.csv"), flight),
        turn_rate_points(read_table_csv(spark, f"{folder}/IMU.csv"), flight),
    )


def log_index(rows: DataFrame) -> DataFrame:
    """``ord, log_file, folder, start_us, end_us`` from an export index; rows without
    folder, start or end go."""
    out = rows.select(
        F.monotonically_increasing_id().alias("ord"),
        F.trim(_get(rows, "LogFile")).alias("log_file"),
        F.trim(_get(rows, "Folder")).alias("folder"),
        parse_dt_us(_get(rows, "FirstGpsUtc")).alias("start_us"),
        parse_dt_us(_get(rows, "LastGpsUtc")).alias("end_us"),
    )
    return out.where("folder != '' and start_us is not null and end_us is not null")


def sync_reports(reports: DataFrame, priority: str = "priority", body: str = "body") -> DataFrame:
    """Per ``video``, the first readable report in order of priority that has a valid
    start: ``video, start_us, offset_sec, filename_delta_sec``."""
    parsed = F.from_json(F.col(body), "video_start_utc string, offset_video_to_log_start_sec string, filename_delta_sec string", {"mode": "PERMISSIVE"})
    out = reports.select("video", F.col(priority).alias("_p"), parsed.alias("r")).select(
        "video",
        "_p",
        parse_dt_us(F.col("r.video_start_utc")).alias("start_us"),
        parse_float(F.col("r.offset_video_to_log_start_sec")).alias("offset_sec"),
        parse_float(F.col("r.filename_delta_sec")).alias("filename_delta_sec"),
    )
    best = F.min_by(F.struct("start_us", "offset_sec", "filename_delta_sec"), "_p").alias("b")
    return out.where("start_us is not null").groupBy("video").agg(best).select("video", "b.*")


def typed_records(tokens: DataFrame, formats: DataFrame, message: str) -> DataFrame:
    """One type's records as a table of text columns, by the registry of each log;
    the columns are those of the type's widest declaration."""
    own = records(tokens, formats).where(F.col("message") == message)
    widest = formats.where(F.col("message") == message).orderBy(F.size("columns").desc(), "log_file").select("columns").first()
    names = list(dict.fromkeys(widest["columns"])) if widest else []
    place = {c: F.array_position("columns", c) for c in names}
    return own.select("log_file", F.col("line_no").alias("LineNo"), *[F.when(place[c] > 0, F.get("values", (place[c] - 1).cast("int"))).alias(c) for c in names])
