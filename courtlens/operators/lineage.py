"""Results kept in the shared folder, for operators that need the same rows twice; rows dealt to many tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent whole to all executors, by way of the driver.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on one machine."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame as written to the shared folder: it is computed once, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over as many tasks as the session shuffles to.

    A small or well compressed file is one task's or a few tasks' read, however much work each row is. Rows are dealt by
    their number where they are read, which needs no sort and puts no key's rows together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_dealt", F.monotonically_increasing_id()).repartition(n, "_dealt").drop("_dealt")


def shuffled(df: DataFrame) -> DataFrame:
    """The frame as a side of joins that shuffle both sides by key, so that no row of it passes through the driver.

    For joins on ids with a row or a few rows each. Else Spark sends a side of few compressed bytes to all executors by
    way of the driver, and ids in order or repeated text compress to a small part of what then arrives there.
    """
    return df.hint("merge")


def is_few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def beside(df: DataFrame, few: bool | None = None) -> DataFrame:
    """The frame as a side of joins by words or names, whose frequent ones would be much work for one task: up to FEW
    rows go to all executors, more are shuffled. Rows are counted, as Spark's guess by compressed bytes, or by which side
    is done first, may send the larger side. ``few`` says it for a frame that is as small as one already counted."""
    if few is None:
        df = checkpoint(df)
        few = is_few(df)
    return F.broadcast(df) if few else shuffled(df)
