"""Tables in the folder that driver and executors share; they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows for a file of a table whose rows are known.
FILE_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset a temporary one, in a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder under one fresh name.

    They stay while the application runs, as lazy results read them, and go when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._files(self.base)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, where: str):
        """A path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back with the same schema.

        ``rows`` is about how many it has, where that is known: a small table then gets no
        file for each partition, as a file costs more calls (on a local disk processes) than its rows.
        """
        path = self.path()
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path, files = self._files(t._scratch_path)
            files.delete(path, True)
