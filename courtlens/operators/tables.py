"""Filtered, sorted and paged table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.functions.text import text
from courtlens.operators.aggregates import with_total
from courtlens.operators.filters import contains_any, optional, same

#: Most rows of a page (fixed values).
TEAM_LIMIT, PLAYER_LIMIT, AIRPORT_LIMIT = 200, 500, 500


def bounded(n: int, most: int, name: str = "limit") -> int:
    if not 1 <= n <= most:
        raise ValueError(f"{name} must be from 1 to {most}")
    return n


def list_conferences(conferences: DataFrame) -> DataFrame:
    return conferences.orderBy(F.asc_nulls_first("name"), "id")


def list_airports(airports: DataFrame, state: str | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    found = optional(airports, [(state, same("iso_region", state or "")), (search, contains_any(["name", "municipality", "iata_code"], search or ""))])
    return found.orderBy(F.asc_nulls_first("name"), "id").limit(bounded(limit, AIRPORT_LIMIT))


def filter_teams(teams: DataFrame, conferences: DataFrame, conference: str | None = None, state: str | None = None, tier: str | None = None, search: str | None = None) -> DataFrame:
    found = optional(teams, [(state, same("state", state or "")), (tier, same("tier", tier or "")), (search, contains_any(["name", "short_name"], search or ""))])
    if conference:
        found = found.join(conferences.where(same("name", conference)), found.conference_id == conferences.id, "left_semi")
    return found.join(conferences.select(F.col("id").alias("conference_id"), F.col("name").alias("conference")), "conference_id", "left")


def list_teams(teams: DataFrame, conferences: DataFrame, limit: int = 50, offset: int = 0, **filters: str | None) -> DataFrame:
    """A page of teams by name, each row with the total of all that match."""
    rows = filter_teams(teams, conferences, **filters)
    rows = with_total(rows, counted=rows.select("id"))
    return rows.orderBy(F.asc_nulls_first("name"), "id").offset(offset).limit(bounded(limit, TEAM_LIMIT))


def team_detail(teams: DataFrame, conferences: DataFrame, airports: DataFrame, scorecards: DataFrame, coaches: DataFrame, team_id: int) -> DataFrame:
    """The team with its conference, airport and scorecard as structs and its coaches in order; no row if unknown."""
    one = teams.where(F.col("id") == team_id)
    nest = lambda df, key, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*df.columns).alias(name))
    staff = coaches.where(F.col("team_id") == team_id).groupBy(F.col("team_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "name", "title", "email", "phone"))).alias("coaches"))
    out = one.join(nest(conferences, "id", "conference"), F.col("conference_id") == F.col("_conference"), "left")
    out = out.join(nest(airports, "id", "airport"), F.col("airport_id") == F.col("_airport"), "left")
    out = out.join(nest(scorecards, "unitid", "scorecard"), F.col("scorecard_unitid") == F.col("_scorecard"), "left")
    return out.join(staff, "id", "left").drop("_conference", "_airport", "_scorecard")


def list_players(
    players: DataFrame, teams: DataFrame, conferences: DataFrame, stats: DataFrame, team_id: int | None = None, season: int | None = None, position: str | None = None,
    class_year: str | None = None, search: str | None = None, include_stats: bool = False, sort_field: str | None = None, sort_dir: str | None = "asc", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of players with team and conference, each row with the total of all that match.

    Sorts by conference, team, name or a statistic of the season; other fields give the default order, other directions
    mean ascending. Without a season no statistics match. The id breaks ties, so pages don't overlap.
    """
    fields = [c for c in stats.columns if c not in ("player_id", "season")]
    found = optional(players, [
        (team_id, F.col("team_id") == team_id), (season, F.col("season") == season), (position, same("position", position or "")),
        (class_year, same("class_year", class_year or "")), (search, contains_any(["name"], search or "")),
    ])
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"), "conference_id")
    c = conferences.select(F.col("id").alias("conference_id"), F.col("name").alias("conference"))
    own = stats.where(F.col("season") == season if season else F.lit(False)).select(F.col("player_id").alias("id"), *fields)
    kept = found.join(t, "team_id")
    rows = with_total(kept.join(c, "conference_id", "left").join(own, "id", "left"), counted=kept.select("id"))
    order: dict[str, Column] = {k: F.asc_nulls_first(k) for k in ("conference", "team", "name")}
    turn = F.desc_nulls_last if (sort_dir or "").lower() == "desc" else F.asc_nulls_first
    if sort_field in order:
        order[sort_field] = turn(sort_field)
    keys = list(order.values())
    if sort_field in fields:
        keys.insert(0, turn(sort_field))
    out = rows.orderBy(*keys, "id").offset(offset).limit(bounded(limit, PLAYER_LIMIT))
    return out if include_stats else out.drop(*fields)


def player(players: DataFrame, stats: DataFrame, player_id: int, include_stats: bool = False) -> DataFrame:
    one = players.where(F.col("id") == player_id)
    if not include_stats:
        return one
    own = stats.where(F.col("player_id") == player_id).groupBy(F.col("player_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("season", *[c for c in stats.columns if c not in ("season", "player_id")]))).alias("stats"))
    return one.join(own, "id", "left")


def scorecard(scorecards: DataFrame, unitid: int) -> DataFrame:
    return scorecards.where(F.col("unitid") == unitid)


def directory(teams: DataFrame, conferences: DataFrame, search: str = "", conference: str = "", state: str = "", tier: str = "") -> DataFrame:
    """All teams, filtered exactly: the name or short name contains the search, other fields are equal."""
    rows = filter_teams(teams, conferences)
    low = search.strip().lower()
    hit = F.contains(F.lower(text("name")), F.lit(low)) | F.contains(F.lower(text("short_name")), F.lit(low))
    return optional(rows, [(low, hit), (conference, F.col("conference") == conference), (state, F.col("state") == state), (tier, F.col("tier") == tier)]).orderBy(F.asc_nulls_first("name"), "id")


def featured(teams: DataFrame, n: int = 6) -> DataFrame:
    return teams.orderBy(F.asc_nulls_first("name"), "id").limit(n)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
