"""The result table's text form, its CSV sink, and image input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result columns and their decimals as text (None: as they are); fixed values.
RESULT_COLUMNS = {
    "FrameIndex": None,
    "VideoTimeSec": 3,
    "Status": None,
    "SearchMode": None,
    "Latitude": 8,
    "Longitude": 8,
    "MapCenterXPx": 2,
    "MapCenterYPx": 2,
    "Score": 4,
    "TileId": None,
    "MatchCount": None,
    "InlierCount": None,
    "InlierRatio": 4,
    "MeanMatchConfidence": 4,
    "ReprojectionErrorPx": 4,
}


def exact_decimals(value: Column, digits: int) -> Column:
    """Fixed decimals, rounded on the exact binary value with halves to even (SQL's
    own formatting rounds the shortest decimal text, halves up)."""

    @F.pandas_udf("string")
    def spell(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return spell(value.cast("double"))


def result_text(results: DataFrame) -> DataFrame:
    """All columns as text, null as empty text."""
    spelled = {c: F.col(c).cast("string") if d is None else exact_decimals(F.col(c), d) for c, d in RESULT_COLUMNS.items()}
    spelled["VideoTimeSec"] = F.bround("VideoTimeSec", 3).cast("string")
    return results.select(*[F.coalesce(x, F.lit("")).alias(c) for c, x in spelled.items()])


def write_results_csv(results: DataFrame, target: str, by: str = "FrameIndex") -> None:
    result_text(results.orderBy(by)).write.mode("overwrite").csv(target, header=True, emptyValue="")


def read_images(spark: SparkSession, folder: str, decode: Callable[[bytes], tuple[int, int, bytes]], pattern: str = "*") -> DataFrame:
    """``path, width, height, pixels``: files decoded by an injected decoder (imaging
    libraries are optional and not needed by anything else)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = [decode(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "width": [s[0] for s in shapes], "height": [s[1] for s in shapes], "pixels": [s[2] for s in shapes]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, pixels binary")


def first_video(names: list[str], fallback: str) -> str:
    """The first ``.mp4`` by name, whatever its case, else a fixed name."""
    return min((n for n in names if n.lower().endswith(".mp4")), default=fallback)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder of any file system that Spark reaches, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
