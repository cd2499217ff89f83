"""Log text to tables: a small log against expected rows, and golden values."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from skyframe.operators import logs
from skyframe.sources import logs as source

LOG = (
    "FMT, 128, 89, FMT, BBnNZ, Type,Length,Name,Format,Columns\r\n"
    "\r\n"
    "IMU, 1000, 0.5\n"
    "FMT, 1, 2, IMU, QB, TimeUS, GyrX\n"
    "IMU, 2000\n"
    "IMU, 3000, 0.7, extra, more\n"
    "plain note, with commas\n"
    "FMT, short\n"
    "  GPS, 1000, 0, 3, 471014200, 2245  \n"
    "FMT, 1, 2, GPS, QBBIH, TimeUS, I, Status, GMS, GWk\n"
    "GPS, 2000, 0, 3.9, 471015200, 2245\n"
    "GPS, 2500, 0, 2, 471015700, 2245\n"
    "GPS, 2600, 0, bad, 471015700, 2245\n"
    "MSG, 5, café\n"
    "FMT, 1, 2, MSG, QZ, TimeUS, Message\n"
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "uçuş 1.log").write_bytes(LOG.encode() + b"junk \xff\x00 line\n")
    (path / "empty.log").write_bytes(b"\n\n")
    (path / "skip.txt").write_text("IMU,1")
    return path


@pytest.fixture(scope="module")
def tokens(spark, folder):
    return logs.tokenize(source.scan_logs(spark, str(folder))).cache()


def test_scan(spark, folder, tokens):
    rows = tokens.orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [1, *range(3, 17)]
    assert rows[0]["log_file"] == "uçuş 1.log" and rows[7]["line"] == "GPS, 1000, 0, 3, 471014200, 2245"
    assert rows[-1]["line"] == "junk \x00 line"
    with pytest.raises(FileNotFoundError):
        source.scan_logs(spark, str(folder), "*.none")


def test_registry_last_declaration_wins(spark, tokens):
    got = {r["message"]: (r["columns"], r["first_line"]) for r in logs.registry(tokens).collect()}
    assert got["IMU"] == (["TimeUS", "GyrX"], 4) and got["GPS"][0][3:] == ["GMS", "GWk"] and set(got) == {"FMT", "IMU", "GPS", "MSG"}
    again = tokens.unionByName(tokens.where("line_no = 4").withColumns({"line_no": F.lit(99).cast("long"), "tokens": F.array(*map(F.lit, ["FMT", "1", "2", "IMU", "Q", "Only"]))}))
    assert logs.registry(again).where("message = 'IMU'").first()["columns"] == ["Only"]


def test_early_lines_are_counted_loose_but_written_typed(tokens):
    formats = logs.registry(tokens)
    counts = {(r["counted_as"], r["registered"]): r["n"] for r in logs.message_counts(logs.classify(tokens, formats)).collect()}
    assert counts[("IMU", True)] == 2 and counts[("GPS", True)] == 3
    assert counts[("INFO", False)] == 3 and counts[("UNPARSED", False)] == 2  # early IMU, early GPS and a note; MSG and junk
    assert counts[("FMT", False)] == 4 and counts[("FMT", True)] == 1
    assert logs.records(tokens, formats).where("message = 'IMU'").count() == 3
    assert [r["kind"] for r in logs.loose_lines(tokens, formats).orderBy("line_no").collect()] == ["INFO", "UNPARSED"]


def test_values_are_padded_and_absorb_commas(tokens):
    rows = {r["line_no"]: r["values"] for r in logs.records(tokens, logs.registry(tokens)).collect()}
    assert rows[3] == ["1000", "0.5"] and rows[5] == ["2000", ""] and rows[6] == ["3000", "0.7, extra, more"]


def test_anchors_need_a_fix(tokens):
    assert [(r["line_no"], r["time_us"]) for r in logs.anchors(tokens).orderBy("line_no").collect()] == [(9, 1000), (11, 2000)]


def test_enriched_times(tokens):
    rows = {r["line_no"]: r for r in logs.enrich(logs.records(tokens, logs.registry(tokens)), logs.anchors(tokens)).collect()}
    assert rows[3]["utc_approx"] == "2023-01-20 10:49:56.200000" and rows[6]["utc_approx"] == "2023-01-20 10:49:58.200000"
    assert rows[3]["utc_gps"] is None and rows[11]["utc_gps"] == "2023-01-20 10:49:57.200000"


def test_catalogs(tokens):
    formats, fixes = logs.registry(tokens), logs.anchors(tokens)
    counts = logs.message_counts(logs.classify(tokens, formats))
    summary = {r["Message"]: r for r in logs.message_summary(counts, formats).collect()}
    assert set(summary) == {"GPS", "IMU", "INFO", "UNPARSED"}
    assert (summary["GPS"]["HasExactGpsUtc"], summary["GPS"]["Purpose"]) == (1, "GNSS position and velocity")
    assert (summary["IMU"]["Columns"], summary["IMU"]["HasTimeUS"], summary["INFO"]["Columns"]) == ("TimeUS, GyrX", 1, "RawLine")
    overview = logs.log_overview(counts, fixes)
    row = overview.first()
    assert (row["AnchorCount"], row["MessageTypeCount"], row["InfoLineCount"], row["UnparsedLineCount"]) == (2, 2, 3, 2)
    assert (row["FirstGpsUtc"], row["LastGpsUtc"]) == ("2023-01-20 10:49:56.200000", "2023-01-20 10:49:57.200000")
    assert logs.export_index(overview, F.lit("out")).first()["MessageTypes"] == 4
    assert logs.formats_catalog(formats).where("Message = 'IMU'").first()["Columns"] == "TimeUS, GyrX"


def test_type_counts_of_recorded_logs(spark):
    """55 types with both kinds of loose lines are 57; 56 are 58."""
    rows = [("3", 4610, "a", "b", 55, 130, 8), ("4", 4331, "a", "b", 56, 132, 8)]
    df = spark.createDataFrame(rows, "LogFile string, AnchorCount long, FirstGpsUtc string, LastGpsUtc string, MessageTypeCount long, InfoLineCount long, UnparsedLineCount long")
    assert [r["MessageTypes"] for r in logs.export_index(df, F.lit("x")).orderBy("LogFile").collect()] == [57, 58]


def test_sinks_and_navigation(spark, tokens, tmp_path):
    formats = logs.registry(tokens)
    enriched = logs.enrich(logs.records(tokens, formats), logs.anchors(tokens))
    source.write_records(enriched, logs.loose_lines(tokens, formats), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/records"))
    assert back.where("message = 'IMU'").count() == 3 and back.where("message = 'GPS'").first()["fields"]["GWk"] == "2245"
    raw = {r["kind"]: r["RawLine"] for r in spark.read.parquet(str(tmp_path / "out/loose")).collect()}
    assert raw["UNPARSED"] == repr("junk \x00 line")
    name = tokens.first()["log_file"]
    source.write_channel_csv(enriched.coalesce(1), name, "GPS", str(tmp_path / "gps"))
    with open(glob.glob(str(tmp_path / "gps/*.csv"))[0], newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["LineNo", "UTC_Approx", "UTC_GPS", "TimeUS", "I", "Status", "GMS", "GWk"] and len(rows) == 5
    (tmp_path / "nav").mkdir()
    bom = "﻿"
    (tmp_path / "nav/AHR2.csv").write_text(bom + "LineNo,UTC_Approx,Lat,Lng,Alt,Yaw,Roll,Pitch\n1,2023-01-20 10:00:00,39.8,32.3,,350,1,2\n2,,1,1,1,1,1,1\n")
    (tmp_path / "nav/GPS.csv").write_text("LineNo,UTC_GPS,UTC_Approx,Lat,Lon,Alt,Spd,Heading\n1,,2023-01-20 10:00:01,1,2,3,4,5\n")
    (tmp_path / "nav/IMU.csv").write_text("LineNo,UTC_Approx,GyrX,GyrY,GyrZ\n1,2023-01-20 10:00:01,3,4,0\n2,2023-01-20 10:00:02,3,,0\n")
    ahr, gps, imu = source.load_navigation(spark, str(tmp_path / "nav"), "f")
    assert (ahr.count(), ahr.first()["altitude_m"], gps.first()["gps_course_deg"], gps.first()["longitude"]) == (1, None, 5.0, 2.0)
    assert [r["imu_gyro_magnitude"] for r in imu.collect()] == [5.0]
    assert source.typed_records(tokens, formats, "IMU").columns == ["log_file", "LineNo", "TimeUS", "GyrX"]
