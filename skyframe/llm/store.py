"""Written intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` is read from the session; only where it is unset and the
master is this machine (as in tests) is a folder made here.  Nothing is ever kept
in an executor's own folder.  What a returned DataFrame still reads stays until
:func:`clear` or the end of the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Folders of queries whose results may still be read.
_roots: set[str] = set()


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a full URI, so that Spark, and Arrow, which would take a
    bare path for a local one, mean the same place.

    Raises RuntimeError where none is set and executors are on other machines."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="skyframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set(_KEY, where)
    path, fs = _path(spark, where)
    return fs.makeQualified(path).toString().rstrip("/")


def _delete(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this process's queries; their results can no longer be read."""
    for root in list(_roots):
        _delete(spark, root)
        _roots.discard(root)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _roots else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone by now
            clear(spark)


class Scratch:
    """Tables of one query, below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        _roots.add(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: cuts the lineage, gives Spark its size."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no result depends on any more."""
        for name in names:
            _delete(self.spark, self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the result is still read from."""
        self.drop(*sorted(self.names - set(names)))

    def close(self) -> None:
        """Delete the whole folder."""
        _delete(self.spark, self.root)
        self.names.clear()
        _roots.discard(self.root)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
