"""Class, height and position rules, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtlens.functions.text import clean, text, words

# Fixed values of the closed sets and keyword tables.
CLASSES = ("Fr", "R-Fr", "So", "R-So", "Jr", "R-Jr", "Sr", "R-Sr", "Gr", "Fifth")
NEXT = {"Fr": "So", "R-Fr": "R-So", "So": "Jr", "R-So": "R-Jr", "Jr": "Sr", "R-Jr": "R-Sr", "Sr": "Gr", "R-Sr": "Gr", "Gr": "Gr", "Fifth": "Gr"}
GRADUATING = ("Sr", "R-Sr", "Gr", "Fifth")
FIRST_YEAR = ("fy", "first year", "first-year", "firstyear")
REDSHIRT_FIRST_YEAR = ("rfr", "r-fy", "r fy", "rf", "rfy", "r-fr")
CLASS_STEPS = (
    ("Fr", r"fresh|\bfr\b|first year|\bfy\b"), ("So", r"soph|\bso\b"), ("Jr", r"junior|\bjr\b"), ("Sr", r"senior|\bsr\b"),
    ("Fifth", r"fifth|5th|6th|sixth"), ("Gr", r"grad|\bgr\b"),
)
STAFF = (
    "coach", "assistant", "director", "consultant", "coordinator", "analyst", "trainer", "manager", "intern", "video",
    "strength", "operations", "development", "technical", "volunteer", "graduate assistant",
)
POSITION_STEPS = (
    ("DS", r"libero|defensive specialist|\bds\b|(^| )(l|lib)( |$)|utility|\butl\b|\buu\b"),
    ("MB", r"middle|\bmb\b|\bmh\b"),
    ("OH", r"outside|pin|left|\boh\b|\bls\b|utility|\butl\b|\buu\b"),
    ("RS", r"opp|right side|rightside|\brs\b|\brh\b"),
    ("S", r"setter|\bs\b"),
)
POSITION_KEYS = {
    "s": ("s", "set", "setter"), "pin": ("oh", "rs", "opp", "opposite", "outside", "pin"), "mb": ("mb", "mh", "middle"),
    "def": ("ds", "l", "lib", "libero", "def"),
}


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, default)


def class_year(c: Column | str, compat: bool = False) -> Column:
    """One of CLASSES, or empty. A leading "r-" marks a redshirt too, so the rule maps its results onto themselves;
    with ``compat`` only "redshirt" and "r " do."""
    s = clean(F.regexp_replace(F.lower(clean(c)), r"[^a-z0-9\s\-]", " "))
    base = reduce(lambda rest, step: F.when(s.rlike(step[1]), F.lit(step[0])).otherwise(rest), reversed(CLASS_STEPS), F.lit(""))
    redshirt = s.rlike("redshirt|^r " if compat else "redshirt|^r[ -]")
    marked = F.when(redshirt & base.isin("Fr", "So", "Jr", "Sr"), F.concat(F.lit("R-"), base)).otherwise(base)
    return F.when(s.isin(*FIRST_YEAR), F.lit("Fr")).when(s.isin(*REDSHIRT_FIRST_YEAR), F.lit("R-Fr")).otherwise(marked)


def class_next(c: Column | str) -> Column:
    return lookup(NEXT, class_year(c), F.lit(""))


def graduating(c: Column | str) -> Column:
    return class_year(c).isin(*GRADUATING)


def looks_graduating(c: Column | str) -> Column:
    """The report's looser test on raw text."""
    return F.lower(F.trim(text(c))).rlike(r"^gr|sr|senior|grad|gr\.|gr |gs")


def advance_class(c: Column | str) -> Column:
    """The report's next class: "Graduated" after senior and graduate years, unknown texts unchanged."""
    s = F.lower(F.trim(text(c)))
    redshirt = s.rlike("^(r|rs)[- ]")
    base = F.when(redshirt & F.contains(s, F.lit("-")), F.regexp_extract(s, "^[^-]*-(.*)$", 1)).when(redshirt, F.regexp_extract(s, "^[^ ]* (.*)$", 1)).otherwise(s)
    after = (
        F.when(base.isin("fr", "freshman"), F.lit("So")).when(base.isin("so", "soph", "sophomore"), F.lit("Jr")).when(base.isin("jr", "junior"), F.lit("Sr"))
        .when(base.isin("sr", "senior", "gr", "gs", "grad", "graduate"), F.lit("Graduated"))
    )
    done = F.when(redshirt & (after != "Graduated"), F.concat(F.lit("R-"), after)).otherwise(after)
    return F.when(text(c) == "", F.lit("")).otherwise(F.coalesce(done, F.when(redshirt, F.concat(F.lit("R-"), text(c))).otherwise(text(c))))


def height(c: Column | str) -> Column:
    """F-I with 4 to 7 feet and 0 to 11 inches, else empty."""
    s = F.lower(clean(c))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[’`]", "'"), '"|in', ""))
    both = [F.regexp_extract(s, r"^([0-9]+)\s*['\-]\s*([0-9]+)", k) for k in (1, 2)]
    numbers = F.regexp_extract_all(s, F.lit(r"[0-9]+"), F.lit(0))

    def made(feet: Column, inches: Column) -> Column:
        f, i = feet.try_cast("int"), inches.try_cast("int")
        return F.when(f.between(4, 7) & i.between(0, 11), F.concat_ws("-", f, i))

    return F.coalesce(made(*both), F.when(F.size(numbers) == 2, made(F.get(numbers, 0), F.get(numbers, 1))), F.lit(""))


def height_inches(c: Column | str, loose: bool = False) -> Column:
    """Inches of F-I; with ``loose`` also of F'I in several apostrophes, and of bare digits. Null if neither."""
    s = F.trim(text(c))
    s = F.regexp_replace(F.regexp_replace(s, "[’'′]", "-"), '"', "") if loose else s
    made = F.regexp_extract(s, r"^([0-9]+)\s*-\s*([0-9]+)$", 1).try_cast("int") * 12 + F.regexp_extract(s, r"^([0-9]+)\s*-\s*([0-9]+)$", 2).try_cast("int")
    return F.coalesce(made, F.when(s.rlike("^[0-9]+$"), s.try_cast("int"))) if loose else made


def inches_height(c: Column) -> Column:
    """F' I" after rounding half to even; empty for null."""
    n = F.bround(c, 0).cast("int")
    return F.coalesce(F.concat(F.floor(n / 12).cast("string"), F.lit("' "), (n % 12).cast("string"), F.lit('"')), F.lit(""))


def position_codes(c: Column | str) -> Column:
    """Sorted codes out of DS, MB, OH, RS, S; none for staff. The substring tests are loose on purpose."""
    p = F.trim(F.regexp_replace(F.lower(clean(c)), r"\.", " "))
    joined = clean(F.regexp_replace(p, "[/,;]+", " "))
    codes = F.array_compact(F.array(*(F.when(joined.rlike(rule), F.lit(code)) for code, rule in POSITION_STEPS)))
    return F.when(p.rlike("|".join(STAFF)), F.array().cast("array<string>")).otherwise(codes)


def has(codes: Column, *wanted: str) -> Column:
    return reduce(lambda a, b: a | b, (F.array_contains(codes, w) for w in wanted))


def position_flags(codes: Column) -> dict[str, Column]:
    pin, middle, defender = has(codes, "OH", "RS"), has(codes, "MB"), has(codes, "DS")
    setter = has(codes, "S") & ~has(codes, "OH", "MB") & (has(codes, "RS") | (~pin & ~defender))
    return {"is_setter": setter, "is_pin": pin, "is_middle": middle, "is_def": defender}


def position_label(codes: Column, raw: Column) -> Column:
    one = F.size(codes) == 1
    return (
        F.when(one & has(codes, "S"), F.lit("Setter")).when(one & has(codes, "MB"), F.lit("Middle"))
        .when(has(codes, "OH", "RS"), F.lit("Pin")).when(has(codes, "DS"), F.lit("Defender")).otherwise(raw)
    )


def position_keys(c: Column | str) -> Column:
    """Sorted distinct keys s, pin, mb, def; other words stand for themselves."""
    table = {v: k for k, variants in POSITION_KEYS.items() for v in variants}
    tokens = words(F.regexp_replace(F.lower(text(c)), "[^a-zA-Z]+", " "))
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: lookup(table, t, t))))
