"""Upserts from a stream of arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from courtlens.operators.store import current, publish, upsert


def stream_upserts(spark: SparkSession, source: str, schema: str | T.StructType, target: str, keys: Sequence[str], ordinal: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Apply each batch of new Parquet files to the current version of a table and publish the next; stops when no file is left.

    A batch that is run again writes the version it wrote before, so a restart neither loses nor doubles a row.
    """

    def apply(batch: DataFrame, number: int) -> None:
        version = f"{number + 1:08d}"
        old = current(spark, target, below=version)
        publish(upsert(old, batch, keys, ordinal), target, version, replace=True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
