"""Conversion of streams: the same column functions on `readStream`, without state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inkstone.operators.convert import convert


def convert_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, config: str, slots: Mapping[str, Mapping[str, str]], column: str = "text") -> StreamingQuery:
    """Reads new Parquet files of a folder, converts a column and appends the rows to another folder, exactly once."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    out = rows.withColumn(column, convert(spark, F.col(column), config, slots))
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
