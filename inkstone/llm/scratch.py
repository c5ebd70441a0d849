"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or else the session's checkpoint folder; on one machine, as in tests, a temporary one.

    A cluster that names no shared folder is an error: each executor would write to its own disk."""
    context = spark.sparkContext
    if top := context.getConf().get("spark.checkpoint.dir"):
        return top
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="inkstone-")


class Scratch:
    """Parquet tables under a new folder of the shared folder.

    A written table cuts the lineage and outlives executors. Results are read from such tables when they are used, so
    what is left of them goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark).rstrip('/')}/inkstone-{uuid.uuid4().hex}"
        path, files = self._place("")
        files.deleteOnExit(path)

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads; all of them if none is named."""
        for name in names or ("",):
            path, files = self._place(name)
            files.delete(path, True)
