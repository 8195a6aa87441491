"""Scoring models as column pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.functions.classify import advance_class, looks_graduating, position_keys
from courtlens.functions.numbers import airport_codes, experience, grade, grade_rank, haversine_miles, minutes, production, round_even, scaled, weighted_mean
from courtlens.functions.text import politics_label, text, to_null
from courtlens.operators.columns import fixed
from courtlens.operators.filters import keep_flagged
from courtlens.operators.joins import first_by, merge_contacts, resolve_aliases
from courtlens.operators.ranks import rank_rows

# Fixed values of the models.
CONGESTED = ("ATL", "ORD", "LAX", "JFK", "EWR", "DFW", "DEN", "SFO", "CLT", "IAH", "PHX", "BOS", "LGA")
POWER = ("Big 12", "ACC", "Big East", "Big Ten", "SEC", "Pac-12")
TIERS = {"A": 3.0, "A-": 2.7, "B+": 2.3, "B": 2.0}
# The sentences of explanations and warnings; {} stands for a value.
RATES = "Our Scorecard-based model rates this school around a {} overall."
BREAKS_DOWN, FOR_ACADEMICS, FOR_VALUE = "That breaks down to {}.", "{} for academics", "{} for value"
OTHER_HIGHER = "Niche lists the overall experience closer to a {}, but federal outcome data (graduation, cost, and earnings) make it look weaker in this model."
OTHER_LOWER = "Niche lists the overall experience around a {}, but based on Scorecard outcomes this model sees somewhat stronger performance."
OTHER_SAME = "Niche’s overall grade of {} is broadly in line with this Scorecard-based estimate."
DRIVERS = "Key drivers behind these grades: {}."
GRADUATION = (
    "graduation rate is solid at roughly {}",
    "graduation rate is moderate at about {}",
    "graduation rate is on the low side at around {}, which drags down academics",
)
RETENTION = ("first-year retention is strong at about {}", "first-year retention is somewhat low at about {}")
EARNINGS = (
    "alumni earnings are high, with median 10-year salaries around {}",
    "alumni earnings are decent, with median 10-year salaries around {}",
    "median 10-year earnings are relatively modest at about {}",
)
COST = (
    "average annual cost after aid is relatively low at roughly {}, helping the value score",
    "average annual cost after aid is mid-range at about {}",
    "average annual cost after aid is on the higher side at roughly {}, which hurts value",
)
ADMISSION = ("admission is fairly selective with an acceptance rate near {}", "admission is relatively open with an acceptance rate around {}")
RISK_POWER = "Power-conference competition; playing time may depend on winning a role early."
RISK_CROWDED = "Position group may be crowded; monitor depth chart and portal additions closely."
RISK_OPEN = "High current opportunity, but staff may add competition quickly."
RISK_FAR = "Long-distance travel and separation from home are non-trivial factors."
RISK_ACADEMIC = "Stronger academic profile may come with higher workload and expectations."
RISK_NONE = "No major structural risks flagged; focus on staff fit, culture, and major alignment."
# Notes about stops on the way.
NONSTOP, MANY_STOPS = r"\bnon[- ]?stop\b|\bdirect\b", r"\b2[- ]?stop|\btwo[- ]?stop|\bmulti[- ]?stop"


def academic_scores(df: DataFrame) -> DataFrame:
    """Scores and grades from graduation_rate, retention_rate (percent), salary and cost; nulls are skipped."""
    salary, cost = scaled(F.col("salary"), 30_000, 80_000), scaled(F.col("cost"), 70_000, 10_000)
    grad = F.col("graduation_rate")
    df = df.withColumns({
        "academic_score": weighted_mean((grad, 0.4), (F.col("retention_rate"), 0.3), (salary, 0.3)), "value_score": weighted_mean((salary, 0.6), (cost, 0.4)),
    })
    df = df.withColumn("overall_score", weighted_mean((F.col("academic_score"), 0.5), (F.col("value_score"), 0.4), (grad, 0.1)))
    return df.withColumns({f"{k}_grade": grade(F.col(f"{k}_score")) for k in ("academic", "value", "overall")})


def dollars(c: Column) -> Column:
    """$1,234 rounded half to even."""
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0).cast("bigint"), 0))


def say(sentence: str, *values: Column) -> Column:
    """A sentence with its {} filled in order; null if a value is."""
    parts = [F.lit(x) for x in sentence.split("{}")]
    return F.concat(parts[0], *[x for pair in zip(values, parts[1:]) for x in pair])


def score_explanation(other_grade: Column) -> Column:
    """Text from graded scores: the grades, how another grade compares, and the first three drivers."""
    overall, academic, value = F.col("overall_grade"), F.col("academic_grade"), F.col("value_grade")
    parts = F.array_join(F.array_compact(F.array(say(FOR_ACADEMICS, academic), say(FOR_VALUE, value))), " and ")
    other = to_null(other_grade)
    gap = grade_rank(overall) - grade_rank(other)
    compared = F.when(gap >= 2, say(OTHER_HIGHER, other)).when(gap <= -2, say(OTHER_LOWER, other)).otherwise(say(OTHER_SAME, other))
    pct = lambda c: F.concat(fixed(F.col(c), 0), F.lit("%"))
    g, r, s, c, a = (F.col(x) for x in ("graduation_rate", "retention_rate", "salary", "cost", "acceptance_rate"))
    graduation, retention, admission = pct("graduation_rate"), pct("retention_rate"), pct("acceptance_rate")
    bits = F.array_compact(F.array(
        F.when(g >= 75, say(GRADUATION[0], graduation)).when(g >= 60, say(GRADUATION[1], graduation)).when(g.isNotNull(), say(GRADUATION[2], graduation)),
        F.when(r >= 85, say(RETENTION[0], retention)).when(r < 75, say(RETENTION[1], retention)),
        F.when(s >= 65_000, say(EARNINGS[0], dollars(s))).when(s >= 50_000, say(EARNINGS[1], dollars(s))).when(s.isNotNull(), say(EARNINGS[2], dollars(s))),
        F.when(c <= 20_000, say(COST[0], dollars(c))).when(c <= 35_000, say(COST[1], dollars(c))).when(c.isNotNull(), say(COST[2], dollars(c))),
        F.when(a <= 30, say(ADMISSION[0], admission)).when(a >= 75, say(ADMISSION[1], admission)),
    ))
    return F.concat_ws(
        " ",
        F.when(overall.isNotNull(), say(RATES, overall)),
        F.when(parts != "", say(BREAKS_DOWN, parts)),
        F.when(overall.isNotNull() & other.isNotNull(), compared),
        F.when(F.size(bits) > 0, say(DRIVERS, F.array_join(F.slice(bits, 1, 3), "; "))),
    )


def travel_and_fit(df: DataFrame, home_lat: float, home_lon: float) -> DataFrame:
    """Distances, times, travel difficulty, geo, academic and fit scores.

    Needs lat, lon, airport_code, airport_drive_time, airport_notes, tier, vb_opp_score, rank. Without coordinates the
    distances are 0, the difficulty 10 and the geo score 1.5.
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    zero = lambda c: F.when(known, c).otherwise(F.lit(0.0))
    df = df.withColumn("_d", haversine_miles(F.lit(home_lat), F.lit(home_lon), F.col("lat"), F.col("lon")))
    df = df.withColumns({"flight_dist_mi": zero(round_even(F.col("_d"), 1)), "drive_dist_mi": zero(round_even(F.col("_d") * 1.15, 1))})
    df = df.withColumns({"drive_time_hr": round_even(F.col("drive_dist_mi") / 60, 1), "flight_time_hr": round_even(F.col("flight_dist_mi") / 450, 2)})
    notes, drive, flight = F.lower(text("airport_notes")), F.col("drive_dist_mi"), F.col("flight_dist_mi")
    stops = F.when(notes.rlike(NONSTOP), -10).when(notes.rlike(MANY_STOPS), 10).otherwise(0)
    crowded = F.when(F.arrays_overlap(airport_codes("airport_code"), F.array(*map(F.lit, CONGESTED))), 8).otherwise(0)
    fly = flight / 18 + minutes("airport_drive_time") / 3 + 20 + stops + crowded + F.when(flight > 1600, 5).otherwise(0)
    hard = F.when(drive <= 350, drive / 18 + 6).otherwise(fly)
    geo = F.when(drive <= 300, 3.0).when(drive <= 600, 2.5).when(drive <= 1000, 2.0).when(drive <= 1500, 1.5).otherwise(1.0)
    tier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TIERS.items() for x in p]), F.col("tier")), F.lit(2.0))
    place = F.greatest(F.lit(1.0), F.least(F.lit(350.0), F.col("rank").cast("double")))
    rank = F.when(F.col("rank").isNotNull(), 3.0 - (place - 1) * (1.0 / 349)).otherwise(2.5)
    df = df.withColumns({
        "travel_difficulty": F.when(known, F.least(F.lit(100.0), F.greatest(F.lit(10.0), hard)).cast("int")).otherwise(10), "geo_score": F.when(known, geo).otherwise(1.5),
        "academic_score": tier, "_rank": rank,
    })
    fit = F.col("academic_score") * 0.40 + F.coalesce("vb_opp_score", F.lit(2.0)) * 0.35 + F.col("geo_score") * 0.15 + F.col("_rank") * 0.10
    return df.withColumn("fit_score", round_even(fit, 2)).drop("_d", "_rank")


def report_ranks(df: DataFrame, tie: str) -> DataFrame:
    """The places of a school in the three orders of the reports, ties by ``tie``.

    fit_rank: the fit table, best first, unknown last; travel_rank: by travel difficulty, then by the drive, what is
    unknown last; page_rank: the pages, by fit, where an unknown one counts as 0.
    """
    fit, page = [F.desc_nulls_last("fit_score"), F.col(tie)], [F.desc(F.coalesce("fit_score", F.lit(0.0))), F.col(tie)]
    travel = [F.asc_nulls_last("travel_difficulty"), F.asc_nulls_last("drive_dist_mi"), F.col(tie)]
    return rank_rows(rank_rows(rank_rows(df, fit, "fit_rank"), travel, "travel_rank"), page, "page_rank")


def opportunity(roster: DataFrame, team: str, position: str | None) -> DataFrame:
    """(team, vb_opp_score) from the experience and production of the team's players at a position.

    ``roster``: team, position, class, assists, kills, digs. 2.0 without a position, 3.0 where nobody plays it.
    """
    teams = roster.select(team).distinct()
    if not (position or "").strip(" 0123456789/-"):
        return teams.withColumn("vb_opp_score", F.lit(2.0))
    mine = position_keys(F.lit(position))
    same = roster.where(F.arrays_overlap(position_keys("position"), mine))
    load = same.groupBy(team).agg(F.sum(experience("class")).alias("e"), F.sum(production(mine, F.col("assists"), F.col("kills"), F.col("digs"))).alias("p"))
    score = round_even(F.greatest(F.lit(1.0), F.least(F.lit(3.0), 3.0 - 0.25 * F.col("e") - 0.25 * F.col("p"))), 2)
    return teams.join(load, team, "left").select(team, F.coalesce(score, F.lit(3.0)).alias("vb_opp_score"))


def opportunity_by_count(position: str | None, row: DataFrame, fallback: Column) -> Column:
    """From the projected count at a position: the fewer, the better; less 0.2 for setters in a 6-2 with two or more."""
    pos = (position or "").upper()
    group = "middle" if "MB" in pos or "MH" in pos else "pin" if "OH" in pos or "RS" in pos else "def" if "DS" in pos or "L" in pos else "setter"
    n = text(f"projected_{group}_count").try_cast("double")
    base = F.when(n.isNull(), fallback).when(n <= 1, 3.0).when(n <= 2, 2.7).when(n <= 3, 2.3).otherwise(2.0)
    crowded = F.lit(group == "setter") & (F.trim(text("offense_type")) == "6-2") & (n >= 2)
    return F.greatest(F.lit(2.0), F.least(F.lit(3.0), base - F.when(crowded, 0.2).otherwise(0.0)))


def enrich_schools(schools: DataFrame, name: str, pivot: DataFrame, aliases: DataFrame, contacts: DataFrame, position: str | None) -> DataFrame:
    """Schools with what the pivot knows of them, the opportunity that follows from it, and their coaches.

    ``schools``: the name and, where known, conference, offense_type, rpi_rank, record, vb_opp_score, politics_label.
    ``pivot``: team, conference, offense_type, rank, record, politics_label and the projected counts. ``aliases``: alias,
    canonical, ordinal. ``contacts``: team (the school's or the pivot's name), source (the lower counts first), ordinal,
    name, title, email, phone. Schools that the pivot lacks keep what they have and get no coaches. Adds coaches, an
    array of (name, title, email, phone) in order.
    """
    found = resolve_aliases(schools, name, aliases, "_team").withColumn("_have", F.coalesce("vb_opp_score", F.lit(2.5)))
    row = pivot.select(*[F.col(c).alias(f"_p_{c}") for c in ("team", "conference", "offense_type", "rank", "record", "politics_label")], *[c for c in pivot.columns if c.startswith("projected_")])
    joined = found.join(row, F.col("_team") == F.col("_p_team"), "left")
    known = F.col("_p_team").isNotNull()
    scored = joined.withColumn("offense_type", F.when(known, F.col("_p_offense_type")).otherwise(F.col("offense_type")))
    scored = scored.withColumns({
        "conference": F.when(known, F.col("_p_conference")).otherwise(F.col("conference")), "rpi_rank": F.when(known, F.col("_p_rank").cast("double")).otherwise(F.col("rpi_rank")),
        "record": F.when(known, F.coalesce("_p_record", F.lit("N/A"))).otherwise(F.col("record")),
        "vb_opp_score": F.when(known, opportunity_by_count(position, scored, F.col("_have"))).otherwise(F.col("vb_opp_score")),
        "politics_label": F.when(known & to_null("politics_label").isNull(), politics_label("_p_politics_label")).otherwise(F.col("politics_label")),
    })
    names = scored.where(known).select(F.col(name).alias("_s"), F.explode(F.array_distinct(F.array(F.col("_team"), F.col(name)))).alias("team"))
    own = names.join(contacts, "team").select(F.col("_s").alias("team"), "source", "ordinal", "name", "title", "email", "phone")
    staff = merge_contacts(own, "team").groupBy("team").agg(F.array_sort(F.collect_list(F.struct("position", "name", "title", "email", "phone"))).alias("_c"))
    staff = staff.select(F.col("team").alias("_t"), F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title"), x["email"].alias("email"), x["phone"].alias("phone"))).alias("coaches"))
    out = scored.join(staff, F.col(name) == F.col("_t"), "left")
    none = F.array().cast("array<struct<name:string,title:string,email:string,phone:string>>")
    return out.select(*schools.columns, F.coalesce("coaches", none).alias("coaches"))


def risk_text() -> Column:
    """Warnings from conference, opportunity, distance and tier; risk_watchouts stays where it is given."""
    opp = F.coalesce("vb_opp_score", F.lit(2.0))
    msgs = F.array_compact(F.array(
        F.when(F.trim(text("conference")).isin(*POWER), RISK_POWER),
        F.when(opp <= 2.2, RISK_CROWDED).when(opp >= 2.9, RISK_OPEN),
        F.when((F.coalesce("drive_dist_mi", F.lit(0.0)) > 800) | (F.coalesce("travel_difficulty", F.lit(0)) >= 60), RISK_FAR),
        F.when(F.trim(text("tier")).isin("A", "A-"), RISK_ACADEMIC),
    ))
    made = F.when(F.size(msgs) == 0, RISK_NONE).otherwise(F.array_join(msgs, " "))
    return F.coalesce(to_null("risk_watchouts"), made)


def projected_roster(roster: DataFrame, outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next season's roster: flagged rows, without graduates and leavers, each name once, classes advanced, and the
    incoming (first-years unless told) added.

    ``roster``: team, ordinal, name, class, position, include. ``outgoing``: team, name. ``incoming``: team, ordinal,
    name, class, position. Names are the same without case; the first seen counts.
    """
    stays = keep_flagged(roster, "team", "include").where(~looks_graduating("class"))
    who = lambda df: df.withColumn("_who", F.lower(F.trim("name")))
    stays = who(stays).join(who(outgoing).select("team", "_who").distinct(), ["team", "_who"], "left_anti")
    kept = stays.select("team", F.lit(0).alias("_src"), "ordinal", "name", "_who", advance_class("class").alias("class"), "position")
    new = who(incoming).select("team", F.lit(1).alias("_src"), "ordinal", "name", "_who", F.coalesce(to_null("class"), F.lit("Fr")).alias("class"), "position")
    both = first_by(kept.unionByName(new), [F.col("team"), F.col("_who")], ["_src", "ordinal"])
    return both.select("team", "name", "class", "position", (F.col("_src") == 1).alias("incoming"))
