"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.functions.numbers import round_even
from courtlens.functions.text import is_blank, to_null


def ordered_list(item: Column, *order: Column | str, when: Column | None = None) -> Column:
    """The items of a group joined by ", " in the given order."""
    row = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)], item.alias("item"))
    kept = F.collect_list(row if when is None else F.when(when, row))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["item"]), ", ")


def top_groups(df: DataFrame, group: str, n: int, name: str = "n") -> DataFrame:
    """The n largest groups; equals go by the group."""
    return df.groupBy(group).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(group)).limit(n)


def top_with_rest(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """(group, items, more): the first n distinct items in order, and how many more there are."""
    items = df.where(F.col(group).isNotNull()).select(group, F.col(item).alias("_i")).distinct()
    first = items.where("_i is not null").withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_i"))).where(F.col("_k") <= n)
    first = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_i"))), lambda x: x["_i"]), ", ").alias("items"))
    more = items.groupBy(group).agg(F.greatest(F.lit(0), F.count("_i") - n).cast("int").alias("more"))
    return more.join(first, group, "left").select(group, F.coalesce("items", F.lit("")).alias("items"), "more")


def code_counts(df: DataFrame, codes: Column) -> DataFrame:
    return df.select(F.explode(codes).alias("code")).where("code <> ''").groupBy("code").agg(F.count("*").alias("n"))


def value_map(df: DataFrame, raw: str, normalized: str) -> DataFrame:
    """How often each raw value stands, and what it becomes."""
    return df.groupBy(raw).agg(F.count("*").alias("n"), F.min(normalized).alias(normalized))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def any_filled(columns: Sequence[str]) -> Column:
    """Whether a row of the group has a value in one of the columns."""
    return F.bool_or(reduce(lambda a, b: a | b, (~is_blank(c) for c in columns)))


def missing_share(c: Column | str, digits: int = 4) -> Column:
    return round_even(F.avg(is_blank(c).cast("double")), digits)


def completeness(c: Column | str, digits: int = 2) -> Column:
    """Percent of rows that have a value; null without rows."""
    return round_even(100 * (1 - F.count_if(to_null(c, ("", "nan")).isNull()) / F.nullif(F.count("*"), F.lit(0))), digits)


def label_score(df: DataFrame, group: str, weight: Column, share: Column) -> DataFrame:
    """Mean of label weights by share; null if the shares add up to nothing."""
    total = F.sum(F.when(weight.isNotNull(), share))
    return df.groupBy(group).agg((F.sum(weight * share) / F.nullif(total, F.lit(0.0))).alias("score"))


def diversity(df: DataFrame, group: str, amount: Column) -> DataFrame:
    """(group, index, label): Simpson's 1 - sum of squared shares, to three decimals."""
    share = F.col("_a") / F.nullif(F.sum("_a").over(Window.partitionBy(group)), F.lit(0.0))
    rows = df.withColumn("_a", amount.cast("double")).where("_a is not null").withColumn("_p", share)
    out = rows.groupBy(group).agg(round_even(1 - F.sum(F.col("_p") * F.col("_p")), 3).alias("diversity_index"))
    index = F.col("diversity_index")
    label = F.when(index >= 0.8, "Very diverse").when(index >= 0.7, "Diverse").when(index >= 0.6, "Moderately diverse").when(index.isNotNull(), "Less diverse")
    return out.withColumn("diversity_label", label)


def with_total(df: DataFrame, name: str = "total", counted: DataFrame | None = None) -> DataFrame:
    """The row count on each row, for paging; an aggregate (one row) joined back, so no task sees all rows.

    ``counted``: a frame with as many rows that is cheaper to count, say before joins that add only columns.
    """
    return df.join(F.broadcast((df if counted is None else counted).agg(F.count("*").alias(name))), how="cross")
