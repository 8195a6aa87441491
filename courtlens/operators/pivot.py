"""The team pivot: one row a team from rosters, incoming players, transfers and team facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.functions.classify import class_next, graduating, has, height_inches, inches_height, position_codes, position_flags, position_label
from courtlens.functions.numbers import whole_or_zero
from courtlens.functions.text import alias_key, player_name
from courtlens.operators.aggregates import ordered_list
from courtlens.operators.columns import pack_wide
from courtlens.operators.joins import last_by
from courtlens.operators.lineage import checkpoint

#: Assists from which a returning player counts as a setter too, and a setter as one of the offense's (fixed values).
BONUS, OFFENSE = 150, 350
GROUPS = {"setter": "assists", "pin": "kills", "middle": "kills", "def": "digs"}


def roster_flags(roster: DataFrame, transfers: DataFrame) -> DataFrame:
    """Add team_key, next class, flags and height to roster rows.

    ``roster``: team, conference, ordinal, name, class, position, height, assists, kills, digs. ``transfers``: name,
    old_team, new_team, ordinal. Rows without a team go.
    """
    rows = roster.where("team is not null").withColumns({"team_key": alias_key("team"), "who": player_name("name"), "codes": position_codes("position")})
    out = transfers.select(alias_key("old_team").alias("team_key"), player_name("name").alias("who"), F.lit(True).alias("leaves")).distinct()
    rows = rows.join(out, ["team_key", "who"], "left")
    flags = position_flags(F.col("codes"))
    stats = {c: whole_or_zero(c) for c in ("assists", "kills", "digs")}
    rows = rows.withColumns(flags | stats | {"class_next": class_next("class"), "inches": height_inches("height")})
    stays = ~graduating("class") & F.col("leaves").isNull()
    bonus = stays & (F.col("assists") >= BONUS) & ~F.col("is_setter")
    return rows.withColumns({"returns": stays, "bonus": bonus})


def incoming_flags(incoming: DataFrame, roster: DataFrame) -> DataFrame:
    """Add team_key, group flags and the display text to incoming rows (school, name, position, is_transfer, ordinal).

    Transfers show the class and position of the roster's last row of the same name, where there is one.
    """
    known = roster.select(player_name("name").alias("who"), class_next("class").alias("k_class"), position_codes("position").alias("k_codes"), "ordinal")
    known = last_by(known, ["who"], ["ordinal"]).drop("ordinal")
    rows = incoming.withColumns({"team_key": alias_key("school"), "who": player_name("name"), "codes": position_codes("position")}).join(known, "who", "left")
    best = F.when(F.size(F.coalesce("k_codes", F.array().cast("array<string>"))) > 0, F.col("k_codes")).otherwise(F.col("codes"))
    year = F.when(F.coalesce("k_class", F.lit("")) != "", F.concat("k_class", F.lit(". "))).otherwise(F.lit(""))
    moved = F.concat("name", F.lit(" ("), year, position_label(best, F.col("position")), F.lit(" - Transfer)"))
    shown = F.when(F.col("is_transfer"), moved).otherwise(F.concat("name", F.lit(" ("), F.col("position"), F.lit(")")))
    codes = F.col("codes")
    return rows.withColumns({
        "in_setter": has(codes, "S") & ~has(codes, "DS"), "in_pin": has(codes, "OH", "RS"), "in_middle": has(codes, "MB"), "in_def": has(codes, "DS"), "shown": shown,
    })


def team_pivot(roster: DataFrame, incoming: DataFrame, transfers: DataFrame, facts: DataFrame) -> DataFrame:
    """33 core columns and five coaches of six fields for each team.

    ``facts``: team_key, roster_url, stats_url, rank, record, coaches (array of structs). One shuffle by team carries
    the roster; the other sides are aggregated to a row a team first.
    """
    # both are gone through more than once
    roster, transfers = checkpoint(roster), checkpoint(transfers)
    rows = roster_flags(roster, transfers)
    who = {"setter": F.col("is_setter"), "pin": F.col("is_pin"), "middle": F.col("is_middle"), "def": F.col("is_def")}
    aggs: list[Column] = []
    for group, stat in GROUPS.items():
        member = F.col("returns") & who[group]
        listed = member | F.col("bonus") if group == "setter" else member
        text = F.concat("name", F.lit(" - "), "class_next", F.lit(" ("), F.col(stat).cast("string"), F.lit(")"))
        aggs += [
            F.count_if(member).alias(f"returning_{group}_count"), F.count_if(listed).alias(f"_{group}"),
            ordered_list(text, F.when(who[group], 0).otherwise(1), "ordinal", when=listed).alias(f"returning_{group}_names"),
            inches_height(F.avg(F.when(listed, F.col("inches")))).alias(f"avg_{group}_height"),
        ]
    setters = F.count_if(F.col("is_setter") & (F.col("assists") >= OFFENSE))
    offense = F.when(setters >= 2, "6-2").when(setters == 1, "5-1").otherwise("Unknown")
    base = rows.groupBy("team").agg(F.min("team_key").alias("team_key"), F.min_by("conference", "ordinal").alias("conference"), offense.alias("offense_type"), *aggs)
    inc = incoming_flags(incoming, roster).groupBy("team_key").agg(
        *[F.count_if(F.col(f"in_{g}")).alias(f"incoming_{g}_count") for g in GROUPS],
        *[ordered_list(F.col("shown"), "ordinal", when=F.col(f"in_{g}")).alias(f"incoming_{g}_names") for g in GROUPS],
    )
    leave, come = (
        transfers.select(alias_key(side).alias("team_key"), "name", "ordinal").where("team_key <> ''")
        .groupBy("team_key").agg(ordered_list(F.col("name"), "ordinal").alias(f"{kind}_transfers"))
        for side, kind in (("old_team", "outgoing"), ("new_team", "incoming"))
    )
    out = base.join(facts, "team_key", "left").join(inc, "team_key", "left").join(leave, "team_key", "left").join(come, "team_key", "left")
    cols = ["team", "conference", "roster_url", "stats_url", "rank", "record", "offense_type"]
    made = {}
    for g in GROUPS:
        made |= {f"incoming_{g}_count": F.coalesce(f"incoming_{g}_count", F.lit(0)), f"incoming_{g}_names": F.coalesce(f"incoming_{g}_names", F.lit(""))}
        made |= {f"projected_{g}_count": F.col(f"_{g}") + F.coalesce(f"incoming_{g}_count", F.lit(0))}
        cols += [f"{k}_{g}_{v}" for k, v in (("returning", "count"), ("returning", "names"), ("incoming", "count"), ("incoming", "names"), ("projected", "count"), ("avg", "height"))]
    made |= {c: F.coalesce(c, F.lit("")) for c in ("outgoing_transfers", "incoming_transfers")}
    coaches = pack_wide(F.col("coaches"), ("name", "title", "email", "phone", "start_year", "seasons_at_school"), 5, "coach")
    return out.withColumns(made).select(*cols, "outgoing_transfers", "incoming_transfers", *coaches)
