"""Data-quality checks: every check gives rows of (check, entity, name, detail); metrics and lists come from those.

``name`` is the person or contact of a row-level issue, and empty for issues of a whole entity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.functions.text import is_blank, text
from courtlens.functions.validity import invalid_positions, valid_class, valid_email, valid_height, valid_phone
from courtlens.operators.aggregates import any_filled, duplicate_groups, missing_share
from courtlens.operators.ranks import carry_last

# Words of non-players in their order, and team sizes out of the ordinary.
NON_PLAYER = ("coach", "assistant", "director", "coordinator", "manager", "trainer", "admin", "staff", "volunteer", "graduate assistant")
SMALL_TEAM, LARGE_TEAM, MISSING_MOST = 10, 25, 0.5


def issue(check: str, hit: Column, detail: Column) -> Column:
    return F.when(hit, F.struct(F.lit(check).alias("check"), detail.alias("detail")))


def row_checks(columns: Sequence[str], raws: dict[str, str]) -> list[Column]:
    """Issues of one row: missing values, raw values that normalized to nothing, invalid forms."""
    out = [issue(f"missing_{c}", is_blank(c), F.lit("")) for c in columns]
    out += [issue(f"unparsed_{c}", ~is_blank(raw) & is_blank(c), text(raw)) for c, raw in raws.items()]
    bad = invalid_positions("position")
    out += [
        issue("invalid_position", ~is_blank("position") & (F.size(bad) > 0), F.array_join(bad, "/")),
        issue("invalid_height", ~is_blank("height") & ~valid_height("height"), text("height")),
        issue("invalid_class", ~is_blank("class") & ~valid_class("class"), text("class")),
    ]
    return out


def non_player(*columns: str) -> Column:
    """The first word of NON_PLAYER in one of the columns (the first is the name); "staff" doesn't count for a Stafford."""
    low = [F.lower(text(c)) for c in columns]
    found = [
        F.when(reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for c in low)) & (~low[0].rlike(r"\bstafford\b") if w == "staff" else F.lit(True)), F.lit(w))
        for w in NON_PLAYER
    ]
    return F.coalesce(*found)


def issues(df: DataFrame, entity: str, checks: Sequence[Column], name: str | None = None) -> DataFrame:
    """(check, entity, name, detail) of all row checks, in one pass; ``name`` is the column with the person."""
    who = F.lit("") if name is None else text(name)
    return df.select(F.col(entity).alias("entity"), who.alias("name"), F.explode(F.array_compact(F.array(*checks))).alias("x")).select("x.check", "entity", "name", "x.detail")


def whole(check: str, rows: DataFrame, entity: str, detail: Column | None = None) -> DataFrame:
    """A row of an issue for each row, without a person."""
    return rows.select(F.lit(check).alias("check"), F.col(entity).alias("entity"), F.lit("").alias("name"), (F.lit("") if detail is None else detail).alias("detail"))


def unparsed_examples(df: DataFrame, raws: dict[str, str], name: str, n: int = 3) -> DataFrame:
    """(column, raw, n, examples): raw values that normalized to nothing, how often, and the first names with them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~is_blank(raw) & is_blank(c), F.trim(text(raw))).alias("raw")) for c, raw in raws.items()])
    rows = df.select(text(name).alias("_who"), F.inline(pairs)).where("raw is not null")
    counts = rows.groupBy("column", "raw").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column", "raw").orderBy("_who")
    few = rows.distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy("column", "raw").agg(F.array_sort(F.collect_list("_who")).alias("examples"))
    return counts.join(few, ["column", "raw"])


def duplicates(df: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    d = duplicate_groups(df, [entity, *keys])
    return whole("duplicate", d, entity, F.concat_ws("|", *keys, "n"))


def team_sizes(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    g = df.groupBy(entity).agg(F.count("*").alias("n"), *[missing_share(c).alias(c) for c in columns])
    found = [issue("small_team", F.col("n") < SMALL_TEAM, F.col("n").cast("string")), issue("large_team", F.col("n") > LARGE_TEAM, F.col("n").cast("string"))]
    found += [issue(f"mostly_missing_{c}", F.col(c) > MISSING_MOST, F.lit("")) for c in columns]
    return issues(g, entity, found)


def teams_without(df: DataFrame, entity: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Teams in which no row has any value in a group of columns."""
    g = df.groupBy(entity).agg(*[any_filled(c).alias(name) for name, c in groups.items()])
    return issues(g, entity, [issue(f"no_{name}", ~F.col(name), F.lit("")) for name in groups])


def invalid_emails(df: DataFrame, entity: str) -> DataFrame:
    """Every column whose name holds "email"."""
    cols = [c for c in df.columns if "email" in c.lower()]
    long = df.select(F.col(entity).alias("entity"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in cols])))
    return whole("invalid_email", long.where((F.trim("v") != "") & ~valid_email(F.trim("v"))), "entity", F.concat_ws(":", "column", "v"))


def contact_issues(entities: DataFrame, entity: str, contacts: DataFrame) -> DataFrame:
    """Entities without a contact, and contacts with an invalid e-mail or phone. ``contacts``: entity, name, email, phone."""
    none = whole("no_contact", entities.select(entity).join(contacts, entity, "left_anti"), entity)
    bad = [issue("contact_email", ~is_blank("email") & ~valid_email("email"), text("email")), issue("contact_phone", ~is_blank("phone") & ~valid_phone("phone"), text("phone"))]
    return none.unionByName(issues(contacts, entity, bad, "name" if "name" in contacts.columns else None))


def entity_sets(expected: DataFrame, actual: DataFrame, entity: str) -> DataFrame:
    """Expected entities that are missing, and entities nobody expects."""
    side = lambda a, b, name: whole(name, a.select(entity).distinct().join(b, entity, "left_anti"), entity)
    return side(expected, actual, "missing_entity").unionByName(side(actual, expected, "unexpected_entity"))


def metrics(found: DataFrame) -> DataFrame:
    """(name, value): the issues of each check."""
    return found.groupBy(F.col("check").alias("name")).agg(F.count("*").alias("value"))


def problem_entities(found: DataFrame) -> DataFrame:
    """(entity, reasons, n) of every entity with an issue."""
    return found.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("reasons"), F.count("*").alias("n"))


def log_scan(lines: DataFrame) -> DataFrame:
    """One row: errors, warnings, entities attempted and with errors, from lines (pos, line).

    An error belongs to the last "Analyzing team: X" before it; lines are told apart by ``source`` (a file), in which
    ``pos`` orders them.
    """
    line = F.col("line")
    name = F.nullif(F.trim(F.regexp_extract("line", r"Analyzing team: (.*)$", 1)), F.lit(""))
    rows = carry_last(lines.select("source", "pos", "line", name.alias("named")), F.col("named"), ["source"], "pos", "team")
    error = line.rlike("ERROR|Could not")
    return rows.agg(
        F.count_if(error).alias("errors"), F.count_if(line.rlike("WARNING")).alias("warnings"), F.countDistinct("named").alias("attempted"),
        F.countDistinct(F.when(error, F.col("team"))).alias("with_errors"),
    )


