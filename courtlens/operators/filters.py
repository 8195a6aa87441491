"""Row predicates and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.functions.text import col, school_key, text, wish_keys

# Rows of totals in statistics tables, facility types, words for yes.
SUMMARY_ROWS = ("TEAM", "Totals", "Opponent Totals")
FACILITY_TYPES = ("large_airport", "medium_airport")
YES = ("1", "true", "yes", "y")
AUTO_MARK = "Auto-filled"


def same(c: Column | str, value: str) -> Column:
    """Equality without case."""
    return F.lower(col(c)) == value.lower()


def contains_any(columns: list[Column | str], term: str) -> Column:
    """Some column holds the term, without case; % and _ in it stay wildcards."""
    return reduce(lambda a, b: a | b, (F.lower(col(c)).like(f"%{term.lower()}%") for c in columns))


def optional(df: DataFrame, filters: list[tuple[object, Column]]) -> DataFrame:
    """Apply the conditions whose value is given; None, 0 and '' mean no filter."""
    return reduce(lambda d, f: d.where(f[1]) if f[0] else d, filters, df)


def drop_summary(df: DataFrame, name: str) -> DataFrame:
    return df.where(~F.coalesce(col(name), F.lit("")).isin(*SUMMARY_ROWS))


def commercial_facility(kind: Column, scheduled: Column, code: Column, name: Column, lat: Column, lon: Column) -> Column:
    """Large or medium, with scheduled service, a three-letter code, no military name, and coordinates that are numbers."""
    military = F.lower(text(name)).rlike("air force base|army air")
    return (
        kind.isin(*FACILITY_TYPES) & (F.lower(text(scheduled)) != "no") & F.upper(F.trim(text(code))).rlike("^[A-Z]{3}$") & ~military
        & text(lat).try_cast("double").isNotNull() & text(lon).try_cast("double").isNotNull()
    )


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(text(c))).isin(*YES)


def keep_flagged(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Groups with a flagged row keep their flagged rows; others keep all."""
    hit = truthy(flag)
    return df.withColumn("_any", F.max(hit).over(Window.partitionBy(group))).where(hit | ~F.col("_any")).drop("_any")


def wish_list(df: DataFrame, name: str, aliases: str | None, wishes: DataFrame, wish: str) -> DataFrame:
    """Rows whose name or alias has a key of the wish list, with or without parentheses; all rows if none has.

    Rows meet the wishes by their whole set of keys, so repeated rows stay as often as they are there.
    """
    names = F.array(F.col(name)) if aliases is None else F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    keyed = df.withColumn("_keys", F.array_distinct(F.flatten(F.transform(names, lambda x: wish_keys(x)))))
    wanted = wishes.select(F.explode(wish_keys(wish)).alias("_wish")).where("_wish <> ''").distinct()
    sets = keyed.select("_keys").distinct().select("_keys", F.explode("_keys").alias("_key"))
    hits = sets.join(wanted, F.col("_key") == F.col("_wish"), "left_semi").select("_keys").distinct()
    nothing = hits.agg((F.count("*") == 0).alias("_none")).where("_none")
    found = keyed.join(hits, "_keys", "left_semi").select(*df.columns)
    return found.unionByName(df.join(nothing, how="cross").drop("_none"))


def restrict(df: DataFrame, name: str, names: DataFrame, listed: str, by_key: bool = True) -> DataFrame:
    """Rows whose name is listed, by normalized key or exactly."""
    key = school_key if by_key else col
    return df.join(names.select(key(listed).alias("_k")).distinct(), key(name) == F.col("_k"), "left_semi")


def tiered_lookup(terms: DataFrame, term: str, targets: DataFrame, target: str) -> DataFrame:
    """(term, tier, matches, found, status): exact names first, else names that contain the term without case.

    status: ok for one match, none or several otherwise. Each term is answered from the best tier that matches. Terms
    meet the names that have their rarest three letters in a row, shorter ones those that have them in a row. The empty
    term is in every name.
    """
    t = terms.select(F.col(term).alias("term")).distinct()
    names = targets.select(F.col(target).alias("found")).distinct()
    exact = t.join(names, F.col("term") == F.col("found")).withColumn("tier", F.lit(1))
    rest = t.join(exact.select("term"), "term", "left_anti")
    size = F.length(F.lower("term"))
    pieces = lambda c, n: F.when(F.length(F.lower(c)) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(F.lower(c)) - (n - 1)), lambda i: F.substring(F.lower(c), i, F.lit(n)))))
    grams = names.select("found", F.explode(pieces("found", 3)).alias("w"))
    times = grams.groupBy("w").agg(F.count("*").alias("n"))
    asked = rest.select("term", F.explode(pieces("term", 3)).alias("w")).join(times, "w", "left")
    asked = asked.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("x")).select("term", "x.w")
    holds = F.contains(F.lower("found"), F.lower("term"))
    loose = asked.join(grams, "w").where(holds).select("term", "found")
    short = [rest.where(size == n).join(names.select("found", F.explode(pieces("found", n)).alias("w")), F.lower("term") == F.col("w")).select("term", "found") for n in (1, 2)]
    loose = loose.unionByName(short[0]).unionByName(short[1]).withColumn("tier", F.lit(2))
    hits = exact.unionByName(loose).groupBy("term", "tier").agg(F.count("*").alias("matches"), F.min("found").alias("found"))
    every = names.where("found is not null").agg(F.count("*").alias("matches"), F.min("found").alias("found")).where("matches > 0")
    hits = hits.unionByName(rest.where(size == 0).join(every).select("term", F.lit(2).alias("tier"), "matches", "found"))
    out = t.join(hits, "term", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") == 1, "ok").when(F.col("matches") == 0, "none").otherwise("several")
    return out.select("term", "tier", "matches", F.when(F.col("matches") == 1, F.col("found")).alias("found"), status.alias("status"))


def refresh_generated(old: Column, new: Column, mark: str = AUTO_MARK) -> Column:
    """Overwrite a note only if it is empty or was generated."""
    return F.when((text(old) == "") | F.contains(text(old), F.lit(mark)), new).otherwise(old)


def todo(df: DataFrame, done: Column, force: bool = False) -> DataFrame:
    return df if force else df.where(~done)
