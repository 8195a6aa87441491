"""Numbers for rows in a total order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.operators.joins import settling
from courtlens.operators.lineage import checkpoint

#: The row's number within its partition is in so many low bits of Spark's increasing id.
_ROW_BITS = 33


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Each row's number (long, from 1) in the order given, in each group of ``by`` for itself; nulls are a group, too.

    Rows are dealt by ranges of group and order, sorted within, and numbered from the start of their range; what the
    ranges before it in the group hold is a running sum over one row for each group and range. Ties are settled by the
    other columns; rows that are equal throughout are spread over several ranges and get different numbers. A hot group
    is many ranges. Rows are written once, since sampled ranges differ from run to run. An empty table has no numbers.
    """
    whole = lambda c: F.col("`" + c.replace("`", "``") + "`")  # noqa: E731  by its whole name, dots and all
    spark, here = df.sparkSession, [whole(c) for c in df.columns]
    groups = [whole(c).alias(f"_g{k}") for k, c in enumerate(by)]
    keys = [F.col(f"_g{k}") for k in range(len(by))]
    # settling columns may be long texts: their hash will do, as only rows that are equal to 64 bits stay in any order
    rest = F.xxhash64(*map(whole, settling(df))) if settling(df) else F.lit(0)
    wanted = df.select(*here, *groups, rest.alias("_tie"), F.monotonically_increasing_id().alias("_any"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartitionByRange(n, *keys, *order, "_tie", "_any").sortWithinPartitions(*keys, *order, "_tie", "_any")
    rows = checkpoint(dealt.drop("_tie", "_any").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", _ROW_BITS))
    ranges = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*[k.alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, i: a & F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}")), range(len(by)), F.col("_range") == F.col("_r"))
    number = F.col("_before") + F.col("_at") - F.col("_from") + 1
    return rows.join(starts, same).select(*here, number.alias(name))


def carry_last(df: DataFrame, value: Column, by: Sequence[str], pos: str, name: str, chunk: int = 100_000) -> DataFrame:
    """Add the last value that isn't null at or before each row of its group, in order of ``pos`` (a number).

    Long groups are cut into chunks of ``chunk`` positions: a value is carried on within a chunk, and into the next ones by
    way of one row for each chunk, so a group of any length is many tasks' work. Nulls in ``by`` are a group, and those in
    ``pos`` come before all; rows at one position see each other's value. Columns that begin with _k are its own.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.withColumns({k: F.col(c) for k, c in zip(keys, by)} | {"_kc": F.floor(F.col(pos) / chunk), "_kv": value})
    within = F.last("_kv", ignorenulls=True).over(Window.partitionBy(*keys, "_kc").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*keys, "_kc").agg(F.max_by("_kv", F.when(F.col("_kv").isNotNull(), F.struct(pos, "_kv"))).alias("_ke"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_kc").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_kc").alias("_kc_"), F.last("_ke", ignorenulls=True).over(before).alias("_ko"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{k}_")), keys, F.col("_kc").eqNullSafe(F.col("_kc_")))
    return rows.withColumn("_kv", within).join(carried, same).withColumn(name, F.coalesce("_kv", "_ko")).select(*[c for c in df.columns if c != name], name)
