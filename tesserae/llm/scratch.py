"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table under the folder named in ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and never a recomputation of everything before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "tesserae-scratch"
_own: dict[str, str] = {}  # of applications in local mode that set no folder


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tesserae-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


class Scratch:
    """A fresh folder for one call of an operator. ``drop()`` removes it once its results aren't needed; what is left goes
    when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{_FOLDER}/{name}-{uuid.uuid4().hex}"
        fs, path = self._place()
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _place(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet (zstd) and reads it back with the schema it had, so that empty tables work too. Files
        follow the partitions: those of the scan, or those that adaptive execution sized after a shuffle."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        """A table that was saved, once more, with columns of its own: for joins of a table with itself."""
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        fs, path = self._place()
        fs.delete(path, True)
