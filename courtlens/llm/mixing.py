"""Mixing sources to target weights with hash-threshold histograms: no sort, only the boundary bucket is refined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.llm.common import WORD, checkpoint, column

#: Bits of the document hash that each histogram level looks at, and the levels.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Column | None = None, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order (null last) weigh 1, 2, 3, repeating, unless ``weights`` is given over the column
    ``rank``. Targets share the whole size by weight and stop at ``cap`` times the source's size; the excess is shared
    anew among the others. The table has a row a source, so its windows need no partition.
    """
    weight = weights if weights is not None else ((F.col("rank") - 1) % 3 + 1)
    # sources that fill up first have the least cap a weight; the level is found where the next one no longer fills up
    by_fill = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        .withColumn("weight", weight.cast("double")).withColumn("cap", cap * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
    )
    total, all_weight = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
    found = ranked.withColumn("level", level).withColumn(
        "water", F.min_by("level", F.when(F.col("fill") >= F.col("level"), F.struct("fill", "rank"))).over(Window.partitionBy())
    )
    return found.select("source", "source_size", F.least("cap", F.coalesce("water", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, h, source, size, source_size, target, taken, copies).

    Whole copies first, then one more copy of the documents whose hash lies under the source's threshold. The
    threshold's first bits come from a histogram of sizes by source and hash bucket; the bucket in which the budget
    ends, and only that, is split by the next bits. Rows with equal id and text share a hash and go together, so reruns
    agree. Null texts have size 0; null sources are a source. Empty tables give empty results.
    """
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), *facts(id_col, text_col, source_col)))
    return take(sized, plan(sized, cap))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with its own columns."""
    sized = checkpoint(docs.select(*facts(id_col, text_col, source_col)))
    inner = [column(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*inner, *facts(id_col, text_col, source_col))
    taken = take(rows, plan(sized, cap)).where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)))


def facts(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """source, size and h of a document: the first bits of the MD5 of id and text, which SQL engines share."""
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    h = F.conv(F.substring(F.md5(whole), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    return [F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h")]


def plan(sized: DataFrame, cap: int) -> DataFrame:
    """(s, source_size, target, copies, threshold) of each source of (source, size, h)."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap=cap)
    size = F.col("source_size")
    copies = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * size)
    state = checkpoint(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("budget") > 0).withColumn("last", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        at = state.where("open").select(F.col("source").alias("s"), "prefix")
        inside = sized.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("cum", F.sum("n").over(upto)).alias("x")
        ends = (
            hist.join(state.where("open").select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
            .where("cum > budget").groupBy("source").agg(F.min(F.struct("bucket", "cum", "n")).alias("e"))
            .select(F.col("source").alias("s"), "e.*")
        )
        state = checkpoint(state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "copies",
            F.when(F.col("bucket").isNotNull(), F.col("budget") - (F.col("cum") - F.col("n"))).otherwise(F.col("budget")).alias("budget"),
            F.when(F.col("bucket").isNotNull(), F.col("bucket")).otherwise(F.shiftleft(F.col("prefix") + F.when(F.col("open"), 1).otherwise(0), BITS)).alias("prefix"),
            (F.col("open") & F.col("bucket").isNotNull()).alias("open"),
            F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("last"),
        ))
    # what is left of the boundary bucket goes in if that comes nearer to the target
    return state.select(
        F.col("source").alias("s"), "source_size", "target", "copies",
        (F.col("prefix") + F.when(F.col("open") & (2 * F.col("budget") >= F.col("last")), 1).otherwise(0)).alias("threshold"),
    )


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, copies and taken to rows (source, size, h, ...)."""
    copies = F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("threshold")
