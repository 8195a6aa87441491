"""Plan-time column resolution, renames, wide and long layouts, display columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.functions.text import text

# Fixed bounds of the map: degrees of longitude and latitude.
MAP_LON, MAP_LAT = (-128.0, -65.0), (24.0, 50.0)


def resolve_column(df: DataFrame, candidates: Sequence[str], ignore_case: bool = True) -> str | None:
    """The first candidate that the frame has, in the candidates' order."""
    names = {c.lower() if ignore_case else c: c for c in reversed(df.columns)}
    return next((names[k] for c in candidates if (k := c.lower() if ignore_case else c) in names), None)


def detect_columns(df: DataFrame, keywords: dict[str, Sequence[str]]) -> dict[str, str | None]:
    """For each role the first column whose header holds one of its keywords."""
    return {role: next((c for c in df.columns if any(k in c.lower() for k in words)), None) for role, words in keywords.items()}


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def keep_existing(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def prepend(df: DataFrame, values: dict[str, Column | object]) -> DataFrame:
    new = [(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in values.items()]
    return df.select(*new, *[c for c in df.columns if c not in values])


def stat_columns(stats: DataFrame, roster: DataFrame, drop: Sequence[str] = ("Trpl Dbl",)) -> list[str]:
    return [c for c in stats.columns if c not in roster.columns and not c.endswith("_roster") and c not in drop]


def join_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """Join on equal names; the right side's other columns that clash get the suffix."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), list(on), how)


def pack_wide(items: Column, fields: Sequence[str], slots: int, prefix: str) -> list[Column]:
    """prefix1_field ... prefixN_field from an array of structs, blank where it is shorter."""
    return [
        F.coalesce(F.get(items, k).getField(f).cast("string"), F.lit("")).alias(f"{prefix}{k + 1}_{f}") for k in range(slots) for f in fields
    ]


def unpack_wide(df: DataFrame, keys: Sequence[str], fields: Sequence[str], slots: int, prefix: str) -> DataFrame:
    """One row for each slot that has any value; ``slot`` counts from 1."""
    rows = F.array(*[F.struct(F.lit(k).alias("slot"), *[F.col(f"{prefix}{k}_{f}").alias(f) for f in fields]) for k in range(1, slots + 1)])
    filled = F.concat_ws("", *[F.col(f) for f in fields]) != ""
    return df.select(*keys, F.inline(rows)).where(filled)


def map_position(x: Column, y: Column, lat: Column, lon: Column) -> Column:
    """struct(map_x, map_y) in 0..1: given positions clamped, else by linear scaling of coordinates, else null."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    given, placed = x.isNotNull() & y.isNotNull(), lat.isNotNull() & lon.isNotNull()
    pick = lambda own, made: F.when(given, unit(own)).when(placed, unit(made))
    return F.struct(
        pick(x, (lon - MAP_LON[0]) / (MAP_LON[1] - MAP_LON[0])).alias("map_x"), pick(y, (lat - MAP_LAT[0]) / (MAP_LAT[1] - MAP_LAT[0])).alias("map_y")
    )


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded half to even."""
    units = F.bround(c * float(10**digits), 0).cast("bigint")
    sign = F.when(units < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return units.cast("string")
    size = F.abs(units)
    return F.concat(sign, F.floor(size / 10**digits).cast("string"), F.lit("."), F.lpad((size % 10**digits).cast("string"), digits, "0"))


def show_height(inches: Column) -> Column:
    """F'II", or a dash."""
    n = inches.cast("int")
    return F.coalesce(F.concat(F.floor(n / 12).cast("string"), F.lit("'"), F.lpad((n % 12).cast("string"), 2, "0"), F.lit('"')), F.lit("—"))


def show_number(name: str, c: Column) -> Column:
    """By the column's name: percentages times 100 with one decimal, rates with two, others whole; a dash for null."""
    return F.coalesce(fixed(c * 100, 1) if "%" in name else fixed(c, 2) if "/" in name else fixed(c, 0), F.lit("—"))


def report_columns(rank: Column, drive: Column, hours: Column, flight: Column, fit: Column) -> dict[str, Column]:
    return {
        "rank_text": F.coalesce(rank.cast("int").cast("string"), F.lit("N/A")), "drive_text": fixed(drive, 0),
        "drive_hr_text": fixed(hours, 1), "flight_hr_text": fixed(flight, 2), "fit_text": fixed(fit, 2),
    }


def label_or(first: Column | str, second: Column | str) -> Column:
    return F.coalesce(F.nullif(text(first), F.lit("")), F.col(second) if isinstance(second, str) else second)




def season_row(rows: Column, season: Column | int, field: str = "season") -> Column:
    """The first struct of the season in an array, else the array's first; null if it is empty."""
    want = F.lit(season) if isinstance(season, int) else season
    return F.coalesce(F.get(F.filter(rows, lambda x: x[field] == want), 0), F.get(rows, 0))


def side_tables(dim: DataFrame, name: str, fields: dict[str, Column]) -> dict[str, DataFrame]:
    """A table (name, field) for each field of a dimension, of the rows that have it filled. Structs count as filled if
    one of their fields is."""
    out = {}
    for field, value in fields.items():
        rows = dim.where(F.col(name).isNotNull()).select(name, value.alias(field))
        kind = rows.schema[field].dataType
        parts = [F.col(field)[x] for x in kind.names] if isinstance(kind, T.StructType) else [F.col(field)]
        filled = F.concat(*(F.trim(F.coalesce(x.cast("string"), F.lit(""))) for x in parts)) != ""
        out[field] = rows.where(filled)
    return out


def base_name(path: Column | str) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(text(path), "[^/]*$", 0)
