"""Free-text lists of incoming players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.functions.classify import lookup
from courtlens.functions.text import player_name, text
from courtlens.operators.ranks import carry_last

# Class words in the hints.
CLASS_WORDS = {"fr": "Fr", "fr.": "Fr", "so": "So", "so.": "So", "soph": "So", "jr": "Jr", "jr.": "Jr", "sr": "Sr", "sr.": "Sr", "gr": "Gr", "gs": "Gr"}


def parse_lines(lines: DataFrame, group: list[str], pos: str, line: str, need_header: bool = True) -> DataFrame:
    """"Conference:" headers and "name - school - position (club)" lines: adds conference, name, school, position, club
    and drops headers, blank lines, lines of fewer than two parts and, unless told otherwise, lines before a header."""
    s = F.trim(text(line))
    header = F.when(F.endswith(s, F.lit(":")), F.trim(F.regexp_replace(s, ":+$", "")))
    rows = carry_last(lines.withColumn("_s", s), header, group, pos, "conference").where(~F.endswith("_s", F.lit(":")) & (F.col("_s") != ""))
    body = F.trim(F.regexp_replace("_s", r"\(([^()]+|.*)\)\s*$", ""))
    parts = F.transform(F.split(body, " - "), lambda x: F.trim(x))
    rows = rows.withColumns({
        "club": F.trim(F.regexp_extract("_s", r"\((.+)\)\s*$", 1)), "name": parts[0], "school": F.get(parts, 1), "position": F.coalesce(F.get(parts, 2), F.lit("")),
    }).where("school is not null")
    return (rows.where("conference is not null") if need_header else rows).drop("_s")


def parse_transfers(lines: DataFrame, group: list[str], pos: str, line: str) -> DataFrame:
    """"Conference:" headers and "name - school - position" lines of at least three parts: adds conference (empty before
    the first header), name, school, position without what follows a parenthesis, and is_transfer."""
    s = F.trim(text(line))
    header = F.when(F.endswith(s, F.lit(":")), F.trim(F.regexp_replace(s, ":$", "")))
    rows = carry_last(lines.withColumn("_s", s), header, group, pos, "conference").where(~F.endswith("_s", F.lit(":")) & (F.col("_s") != ""))
    parts = F.transform(F.split("_s", " - "), lambda x: F.trim(x))
    rows = rows.where(F.size(parts) >= 3).withColumns({
        "conference": F.coalesce("conference", F.lit("")), "name": player_name(parts[0]), "school": parts[1], "position": F.trim(F.regexp_replace(parts[2], r"(?s)\(.*$", "")),
        "is_transfer": F.contains(F.lower(parts[2]), F.lit("transfer")),
    })
    return rows.drop("_s")


def parse_list(raw: Column | str, default_position: str) -> Column:
    """array<struct<name, position, class, is_transfer>> of "Name (So. Setter - Transfer), ..."; the last hint of a kind wins."""
    parts = F.filter(F.transform(F.split(text(raw), ","), lambda x: F.trim(x)), lambda x: x != "")

    def entry(part: Column) -> Column:
        inside = F.regexp_extract(part, r"\((.*)\)", 1)
        tokens = F.transform(F.split(F.lower(F.trim(inside)), r"[\s/-]+"), lambda x: F.trim(x))
        known = F.filter(F.transform(tokens, lambda t: lookup(CLASS_WORDS, t)), lambda x: x.isNotNull())
        place = lambda t: (
            F.when(F.startswith(t, F.lit("set")), "S").when(F.startswith(t, F.lit("pin")) | t.isin("oh", "rs"), "OH/RS")
            .when(F.startswith(t, F.lit("mb")) | F.contains(t, F.lit("middle")), "MB").when(t.isin("ds", "lib", "libero"), "DS/L")
        )
        places = F.filter(F.transform(tokens, place), lambda x: x.isNotNull())
        return F.struct(
            F.trim(F.regexp_replace(part, r"\(.*$", "")).alias("name"), F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(default_position)).alias("position"),
            F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit("")).alias("class"), F.exists(tokens, lambda t: F.contains(t, F.lit("transfer"))).alias("is_transfer"),
        )

    return F.transform(parts, entry)


def display_incoming(name: Column, position: Column, class_year: Column, is_transfer: Column) -> Column:
    """Name (position), and for transfers Name (class. position - Transfer)."""
    year = F.when(F.coalesce(class_year, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.regexp_replace(class_year, r"\.$", ""), F.lit(". ")))
    return F.when(is_transfer, F.concat(name, F.lit(" ("), year, position, F.lit(" - Transfer)"))).otherwise(F.concat(name, F.lit(" ("), position, F.lit(")")))
