"""Casts, scales, grades and weights, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtlens.functions.text import MISSING, clean, text, to_null

# Grade limits in falling order, their order, label limits, ordinal words, weights and thresholds.
GRADES = ((93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (60, "D"))
SCALE = ("A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-")
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
    "thirteenth", "fourteenth", "fifteenth",
)
EXPERIENCE = (("gr", 1.0), ("sr", 0.9), ("jr", 0.7), ("so", 0.5), ("fr", 0.3))
PRODUCTION = {"assists": (800, 400, 200), "kills": (300, 150, 75), "digs": (400, 250, 150)}
POLITICS = ("very conservative", "conservative", "moderate / independent", "liberal", "very liberal")
POLITICS_WEIGHTS = {"very conservative": -2.0, "conservative": -1.0, "moderate": 0.0, "balanced": 0.0, "liberal": 1.0, "very liberal": 2.0}
EARTH_KM, MILES_PER_KM = 6371.0, 0.621371


def round_even(c: Column, digits: int) -> Column:
    """Half to even at a decimal, by scaling: the same bits come out of other engines."""
    return F.bround(c * float(10**digits), 0) / F.lit(float(10**digits))


def number(c: Column | str, tokens: tuple[str, ...] = MISSING) -> Column:
    """A double; thousands commas go, missing spellings, non-numbers and NaN are null."""
    d = F.regexp_replace(to_null(c, tokens), ",", "").try_cast("double")
    return F.when(~F.isnan(d), d)


def whole_or_zero(c: Column | str) -> Column:
    """Truncated towards zero; what is no plain number (commas too) is 0."""
    d = F.trim(text(c)).try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d).try_cast("bigint"), F.lit(0).cast("bigint"))


def stat_text(c: Column | str) -> Column:
    """Whole numbers without decimals, others with one; null is empty, other text stays."""
    d = text(c).try_cast("double")
    shown = F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(round_even(d, 1).cast("string"))
    return F.coalesce(shown, text(c))


def minutes(c: Column | str, compat: bool = False) -> Column:
    """Minutes in a text: an hour part counts 60 each, a dash range its mean; 0 without a number. ``compat`` knows no hours."""
    s = F.regexp_replace(text(c), "–", "-")
    found = F.transform(F.regexp_extract_all(s, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))
    plain = F.when(F.contains(s, F.lit("-")) & (F.size(found) >= 2), (F.get(found, 0) + F.get(found, 1)) / 2).otherwise(F.coalesce(F.get(found, 0), F.lit(0.0)))
    if compat:
        return plain
    hours = F.regexp_extract(s, r"([0-9]+)\s*h", 1).try_cast("double")
    rest = F.coalesce(F.regexp_extract(s, r"([0-9]+)\s*min", 1).try_cast("double"), F.lit(0.0))
    return F.when(hours.isNotNull(), hours * 60 + rest).otherwise(plain)


def airport_codes(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit("[A-Z]{3}"), F.lit(0))))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * MILES_PER_KM


def drive_time(miles: Column, mph: float = 55.0) -> Column:
    """~H hr M min (~D mi); empty for nothing."""
    m = F.bround(miles / mph * 60, 0).cast("int")
    h, rest = F.floor(m / 60), m % 60
    span = F.when(h == 0, F.concat(rest.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(h.cast("string"), F.lit(" hr"))).otherwise(F.concat(h.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min")))
    return F.when(F.coalesce(miles, F.lit(0.0)) <= 0, F.lit("")).otherwise(F.concat(F.lit("~"), span, F.lit(" (~"), F.bround(miles, 0).cast("int").cast("string"), F.lit(" mi)")))


def scaled(c: Column, worst: float, best: float) -> Column:
    """0 at worst, 100 at best, clamped; null stays null."""
    t = (c - worst) / (best - worst)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 100)


def grade(c: Column) -> Column:
    rest = reduce(lambda rest, step: F.when(c >= step[0], F.lit(step[1])).otherwise(rest), reversed(GRADES), F.lit("D-"))
    return F.when(c.isNotNull(), rest)


def grade_rank(c: Column | str) -> Column:
    """0 for the best grade; unknown ones are in the middle."""
    at = F.array_position(F.array(*map(F.lit, SCALE)), F.upper(F.trim(text(c))))
    return F.when(at == 0, F.lit(len(SCALE) // 2)).otherwise(at - 1).cast("int")


def weighted_mean(*parts: tuple[Column, float]) -> Column:
    """Mean by weight of what is not null; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c * w, F.lit(0.0)) for c, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts))
    return total / F.nullif(weight, F.lit(0.0))


def score_label(c: Column, labels: tuple[str, str, str, str, str] = POLITICS) -> Column:
    """Five labels by the limits -0.8, -0.3, 0.3 and 0.8; the lower two include their limit."""
    steps = F.when(c <= -0.8, labels[0]).when(c <= -0.3, labels[1]).when(c < 0.3, labels[2]).when(c < 0.8, labels[3])
    return F.when(c.isNotNull(), steps.otherwise(labels[4]))


def experience(c: Column | str) -> Column:
    s = F.lower(text(c))
    return reduce(lambda rest, step: F.when(F.startswith(s, F.lit(step[0])), F.lit(step[1])).otherwise(rest), reversed(EXPERIENCE), F.lit(0.5))


def production(keys: Column, assists: Column, kills: Column, digs: Column) -> Column:
    """0 to 1 by the first of setter, attacker, defender among the keys; 0.2 for others."""

    def by(value: Column, limits: tuple[int, int, int]) -> Column:
        v = F.coalesce(value.cast("double"), F.lit(0.0))
        return F.when(v >= limits[0], 1.0).when(v >= limits[1], 0.5).when(v >= limits[2], 0.3).otherwise(0.1)

    attack = F.array_contains(keys, "mb") | F.array_contains(keys, "pin")
    return (
        F.when(F.array_contains(keys, "s"), by(assists, PRODUCTION["assists"])).when(attack, by(kills, PRODUCTION["kills"]))
        .when(F.array_contains(keys, "def"), by(digs, PRODUCTION["digs"])).otherwise(0.2)
    )


def ordinal(c: Column | str) -> Column:
    """1 to 49 from third, 3rd or 3; else null."""
    t = F.lower(F.trim(text(c)))
    n = F.regexp_replace(t, "(st|nd|rd|th)$", "").try_cast("int")
    word = F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), t), F.lit(0))
    return F.coalesce(F.when(n.between(1, 49), n), word.cast("int"))


# How biographies tell the season that begins, and the year of a start.
BEGINS_SEASON = r"(?i)\b(?:enter(?:ing|s)?|heading into|in|returns for|embarks on)\s+(?:his |her |their )?\s*"
SINCE_YEAR = r"(?i)(?:since|hired|joined|named|promoted|appointed|took over)\s+(?:in\s+)?(20[0-9]{2})"


def tenure(c: Column | str, year: int) -> Column:
    """struct(start_year, seasons) from "enters her third season" or else "hired in 2019"; a year to come has no seasons."""
    body = clean(c)
    number_ = r"([0-9]{1,2}|" + "|".join(ORDINALS) + ")"
    seasons = ordinal(F.regexp_extract(body, BEGINS_SEASON + number_ + r"(?:st|nd|rd|th)?\s+(?:season|year)", 1))
    since = F.regexp_extract(body, SINCE_YEAR, 1).try_cast("int")
    start = F.coalesce(F.lit(year) - seasons + 1, since)
    return F.struct(start.cast("int").alias("start_year"), F.coalesce(seasons, F.when(since <= year, F.greatest(F.lit(1), F.lit(year) - since + 1))).cast("int").alias("seasons"))


def meta_number(html: Column | str, name: str) -> Column:
    """The number in the content of a named meta tag."""
    return F.regexp_extract(text(html), r'(?i)<meta[^>]*(?:property|name)="' + name + r'"[^>]*content="([^"]*)"', 1).try_cast("double")


def dollars(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(text(c), r"\$\s*([0-9][0-9,]*)", 1), ",", "").try_cast("int")
