"""Normalizers for names, keys and contact text, as column expressions.

Null counts as the empty text unless a docstring says otherwise; patterns keep to what Java and RE2 both understand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtlens.functions.references import held

# Words and letters that the keys leave out, and the alias table of the collected rosters.
SCHOOL_STOP = ("university", "college", "of", "the")
SCORECARD_STOP = ("the", "university", "college", "state", "of", "at", "campus", "city", "institution")
INDEX_STOP = ("university", "the", "college", "at", "of", "state", "campus")
SCHOOL_ALIASES = {
    "university at albany": "ualbany", "ualbany": "ualbany", "albany": "ualbany",
    "binghamton university": "binghamton", "binghamton": "binghamton",
    "bryant university": "bryant", "bryant": "bryant",
    "university of maryland baltimore county": "umbc", "maryland baltimore county": "umbc", "umbc": "umbc",
    "the ohio state university": "ohio state university",
}
MISSING = ("", "nan", "NULL", "PrivacySuppressed")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def clean(c: Column | str) -> Column:
    """Every run of white space, no-break and other Unicode blanks too, as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def to_null(c: Column | str, tokens: tuple[str, ...] = MISSING) -> Column:
    """Null where the trimmed value is one of the spellings of missing."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(~trimmed.isin(*tokens), trimmed)


def is_blank(c: Column | str) -> Column:
    return to_null(c, ("", "nan")).isNull()


def first_filled(*columns: Column | str, tokens: tuple[str, ...] = MISSING) -> Column:
    """The first value that is not missing, else the empty text."""
    return F.coalesce(*(to_null(c, tokens) for c in columns), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def without(c: Column, stop: tuple[str, ...]) -> Column:
    """The words of a cleaned text but for the stop words, in their order."""
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*stop)), " ")


def excel_unprotect(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(text(c)), r'^="(.*)"$', "$1")


def excel_protect_record(c: Column | str) -> Column:
    """Keep records such as 14-12 from becoming dates."""
    s = clean(c)
    return F.when(s.rlike("-") & s.rlike("[0-9]") & ~s.startswith('="'), F.concat(F.lit('="'), s, F.lit('"'))).otherwise(s)


def excel_protect_phone(c: Column | str) -> Column:
    s = clean(c)
    return F.when(s == "", s).otherwise(F.concat(F.lit('="'), s, F.lit('"')))


def player_name(c: Column | str) -> Column:
    """Without jersey numbers; "Last, First" turned round if there is exactly one comma."""
    s = clean(F.regexp_replace(clean(c), r"\b[0-9]+\b", ""))
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(s)


def school_key(c: Column | str) -> Column:
    return without(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "), SCHOOL_STOP)


def alias_key(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Letters and digits in lower case, then the alias table."""
    known = SCHOOL_ALIASES if aliases is None else aliases
    key = F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", " "))
    if not known:
        return key
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def scorecard_key(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(text(c)), "&", " and ")
    s = F.regexp_replace(F.regexp_replace(s, r"[,.\-]", " "), "[’']", "")
    return without(clean(s), SCORECARD_STOP)


def index_key(c: Column | str) -> Column:
    """Stop words go where they stand as whole words, then everything but letters and digits."""
    s = F.regexp_replace(F.lower(text(c)), r"\b(" + "|".join(INDEX_STOP) + r")\b", " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def wish_keys(c: Column | str) -> Column:
    """A wish-list name's key, and its key without what stands in parentheses."""
    base = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    s = text(c)
    return F.array_distinct(F.array(base(s), base(F.regexp_replace(s, r"\(.*?\)", " "))))


def canonical_name(c: Column | str) -> Column:
    """Distinct letter words in lower case, sorted."""
    s = F.regexp_replace(F.lower(clean(c)), r"[^a-z\s]", " ")
    return F.array_join(F.array_sort(F.array_distinct(words(s))), " ")


def file_slug(c: Column | str) -> Column:
    """Runs of anything but letters and digits as one underscore; case stays."""
    return F.btrim(F.regexp_replace(text(c), "[^A-Za-z0-9]+", "_"), F.lit("_"))


def lower_slug(c: Column | str, fallback: str = "player") -> Column:
    return held(F.lower(file_slug(c)), lambda s: F.when(s == "", F.lit(fallback)).otherwise(s))


def hyphen_slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(text(c)), "&", " and ")
    return F.btrim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))


def phone(c: Column | str) -> Column:
    """(XXX) XXX-XXXX for ten digits (a leading 1 goes), empty without digits, else the trimmed text."""
    digits = F.regexp_replace(F.regexp_replace(text(c), r"\D", ""), "^1([0-9]{10})$", "$1")
    done = F.regexp_replace(digits, "^([0-9]{3})([0-9]{3})([0-9]{4})$", "($1) $2-$3")
    return F.when(F.length(digits) == 10, done).when(digits == "", F.lit("")).otherwise(F.trim(text(c)))


def ladder(s: Column, steps: list[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first step whose needle the text holds."""
    return reduce(lambda rest, step: F.when(F.contains(s, F.lit(step[0])), F.lit(step[1])).otherwise(rest), reversed(steps), otherwise)


def politics_label(c: Column | str) -> Column:
    steps = [
        ("very liberal", "Very liberal"), ("liberal", "Liberal"), ("very conservative", "Very conservative"),
        ("conservative", "Conservative"), ("moderate", "Moderate / independent"), ("independent", "Moderate / independent"),
    ]
    return ladder(F.lower(F.trim(text(c))), steps, F.trim(text(c)))


def coach_title(c: Column | str) -> Column:
    return ladder(F.lower(text(c)), [("associate", "Associate Head Coach"), ("assistant", "Assistant Head Coach"), ("head", "Head Coach")], text(c))


def city_state(city: Column | str, state: Column | str, joined: Column | str) -> Column:
    """struct(city, state, city_state): missing parts come from "City, ST" at its first comma, a missing whole from both parts."""
    parts = F.split(text(joined), ",", 2)
    c = F.coalesce(to_null(city), to_null(parts[0]))
    s = F.coalesce(to_null(state), to_null(F.get(parts, 1)))
    whole = F.coalesce(to_null(joined), F.when(c.isNotNull() & s.isNotNull(), F.concat_ws(", ", c, s)), c, F.lit(""))
    return F.struct(c.alias("city"), s.alias("state"), whole.alias("city_state"))


def asset_path(path: Column | str, slug: Column | str, name: Column | str, prefixes: tuple[str, ...] = ("public/", "static/", "assets/")) -> Column:
    """A path without its leading slash and first known prefix; else one made of slug or name."""
    s = F.regexp_replace(to_null(path), "^/+", "")
    s = F.regexp_replace(s, "^(" + "|".join(prefixes) + ")", "")
    made = F.concat(F.lit("logos/"), F.coalesce(to_null(slug), lower_slug(name, "team")), F.lit(".png"))
    return F.coalesce(s, made)


def year_in_url(url: Column | str, year: Column | int, yearless: Column | bool = False) -> Column:
    """Set ``year`` in the query; without a query append /year, or a slash if the year already stands at the end."""
    y = (F.lit(year) if isinstance(year, int) else year).cast("string")
    off = F.lit(yearless) if isinstance(yearless, bool) else yearless
    u = F.trim(text(url))
    has_year = u.rlike(r"[?&]year=")
    bare = F.regexp_replace(u, "/+$", "")
    changed = (
        F.when(has_year, F.regexp_replace(u, F.lit(r"([?&]year=)[^&#]*"), F.concat(F.lit("$1"), y)))
        .when(F.contains(u, F.lit("?")), F.concat(u, F.lit("&year="), y))
        .when(F.endswith(bare, F.concat(F.lit("/"), y)), F.concat(bare, F.lit("/")))
        .otherwise(F.concat(bare, F.lit("/"), y))
    )
    return F.when(off | (u == ""), u).otherwise(changed)
