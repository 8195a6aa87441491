"""Matching, geography and scoring over parts, suppliers, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.functions.text import scorecard_key
from courtlens.operators import filters, joins, score
from courtlens.plans.binding import Query, cycle, cycle_sql, half_even_sql
from courtlens.sources.files import read_table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _lat_lon(key: str):
    k = F.col(key)
    return (25.0 + (k * 37) % 2400 / F.lit(100.0)).alias("lat"), (-125.0 + (k * 91) % 5800 / F.lit(100.0)).alias("lon")


def _lat_lon_sql(key: str) -> str:
    return f"25.0::double + ({key} * 37) % 2400 / 100.0::double as lat, -125.0::double + ({key} * 91) % 5800 / 100.0::double as lon"


def _miles_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"(6371.0::double * 2 * atan2(sqrt({a}), sqrt(1 - ({a}))) * 0.621371::double)"


def nearest_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", *_lat_lon("c_custkey"))
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", *_lat_lon("s_suppkey"))
    out = joins.nearest(p, "c_custkey", s, "s_suppkey", cell=4.0)
    return out.select("c_custkey", "s_suppkey", (F.bround(F.col("miles") * 1000, 0) / 1000).alias("miles"))


QUERIES["nearest_facility"] = nearest_facility
ORACLE_SQL["nearest_facility"] = f"""
    with p as (select c_custkey, {_lat_lon_sql('c_custkey')} from customer), s as (select s_suppkey, {_lat_lon_sql('s_suppkey')} from supplier),
    d as (select c_custkey, s_suppkey, {_miles_sql('p.lat', 'p.lon', 's.lat', 's.lon')} as d from p, s)
    select c_custkey, arg_min(s_suppkey, row(d, s_suppkey)) as s_suppkey, round_even(min(d) * 1000, 0) / 1000 as miles from d group by 1
"""


def entity_match_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts against the distinct names."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    spelled = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", F.col("p_name"), F.lit("the"), F.lower("p_type"))).otherwise(F.concat(F.lit("University of "), F.split("p_name", " ")[0]))
    e = p.select("p_partkey", F.array(spelled, F.lower("p_type")).alias("names"), F.when(F.col("p_partkey") % 50 == 0, F.lit("none such")).alias("override"))
    rows = p.select("p_name").distinct()
    return joins.match_tokens(e, "p_partkey", "names", rows, "p_name", "p_name").select("p_partkey", F.col("p_name").alias("match"), F.bround(F.col("score") * 1e6, 0).cast("long").alias("score"), "confidence")


_STOP = "['the', 'university', 'college', 'state', 'of', 'at', 'campus', 'city', 'institution']"
_KEY = "list_filter(string_split(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[,.\\-]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x <> '' and not list_contains(" + _STOP + ", x))"
QUERIES["entity_match_jaccard"] = entity_match_jaccard
ORACLE_SQL["entity_match_jaccard"] = f"""
    with e as (
        select p_partkey, 0 as c, case p_partkey % 3 when 0 then p_name when 1 then p_name || ' the ' || lower(p_type) else 'University of ' || string_split(p_name, ' ')[1] end as n from part
        union all select p_partkey, 1, lower(p_type) from part
    ), ek as (select p_partkey, c, {_KEY.format('n')} as ta from e), r as (select distinct p_name, {_KEY.format('p_name')} as tb from part),
    exact as (select p_partkey, arg_min(p_name, row(c, p_name)) as m from ek join r on array_to_string(ta, ' ') = array_to_string(tb, ' ') where len(ta) > 0 group by 1),
    pairs as (
        select p_partkey, c, p_name, len(list_intersect(ta, tb)) / cast(len(list_distinct(ta)) + len(list_distinct(tb)) - len(list_intersect(ta, tb)) as double) as s
        from ek, r where p_partkey not in (select p_partkey from exact) and len(list_intersect(ta, tb)) > 0
    ), best as (select p_partkey, arg_min(p_name, row(-s, p_name, c)) as m, max(s) as s from pairs group by 1)
    select part.p_partkey, coalesce(exact.m, case when best.s >= 0.6 then best.m end) as match,
        cast(round_even(case when exact.m is not null then 1.0 when best.s >= 0.6 then best.s end * 1000000.0::double, 0) as bigint) as score,
        case when exact.m is not null then 'high' when best.s >= 0.8 then 'medium' when best.s >= 0.6 then 'low' end as confidence
    from part left join exact using (p_partkey) left join best using (p_partkey)
"""


def entity_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    names = p.select("p_name").distinct()
    e = names.select(F.concat("p_name", F.when(F.length("p_name") % 2 == 0, F.lit("")).when(F.length("p_name") % 3 == 0, F.lit(" quite another name")).otherwise(F.lit(" xy"))).alias("name"))
    out = joins.match_sequences(e, "name", names, "p_name")
    return out.select("name", F.col("p_name").alias("match"), "match_type", F.bround(F.col("score") * 1e6, 0).cast("long").alias("score"))


QUERIES["entity_match_ratio"] = entity_match_ratio
_INDEX = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(university|the|college|at|of|state|campus)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
ORACLE_SQL["entity_match_ratio"] = f"""
    with n as (select distinct p_name from part), e as (select p_name || case when length(p_name) % 2 = 0 then '' when length(p_name) % 3 = 0 then ' quite another name' else ' xy' end as name from n),
    ek as (select name, {_INDEX.format('name')} as k from e), r as (select p_name, {_INDEX.format('p_name')} as m from n),
    s as (select name, p_name, k = m as same, 1 - levenshtein(k, m) / cast(greatest(length(k), length(m)) as double) as s from ek, r),
    b as (select name, arg_min(p_name, row(not same, -s, p_name)) as match, bool_or(same) as same, max(s) as s from s where s >= 0.78 group by name)
    select ek.name, match, case when same then 'exact' when match is not null then 'similar' else 'none' end as match_type,
        cast(round_even(coalesce(s, 0) * 1000000.0::double, 0) as bigint) as score from ek left join b using (name)
"""


def tiered_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    w = F.split("p_name", " ")
    terms = p.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper(F.substring("p_name", 2, 12))).otherwise(F.concat(w[0], F.lit(" zz"))).alias("term"))
    return filters.tiered_lookup(terms, "term", p, "p_name")


QUERIES["tiered_id_lookup"] = tiered_id_lookup
ORACLE_SQL["tiered_id_lookup"] = """
    with t as (select distinct case p_partkey % 3 when 0 then p_name when 1 then upper(substr(p_name, 2, 12)) else string_split(p_name, ' ')[1] || ' zz' end as term from part),
    n as (select distinct p_name from part),
    h as (select term, p_name, case when term = p_name then 1 when contains(lower(p_name), lower(term)) then 2 end as tier from t, n),
    b as (select term, min(tier) as tier from h where tier is not null group by 1),
    c as (select b.term, b.tier, count(*) as matches, min(p_name) as found from b join h on h.term = b.term and h.tier = b.tier group by all)
    select t.term, tier, coalesce(matches, 0) as matches, case when matches = 1 then found end as found,
        case when coalesce(matches, 0) = 0 then 'none' when matches = 1 then 'ok' else 'several' end as status from t left join c using (term)
"""


def wishlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    wishes = p.where("p_partkey % 7 = 0").select(F.concat(F.upper("p_name"), F.lit(" (X)")).alias("wish"))
    # each part one to three times over; and a column that can't be compared
    rows = p.withColumns({"aliases": F.array("p_type"), "extra": F.create_map(F.lit("k"), F.col("p_partkey"))}).withColumn("again", F.explode(F.array_repeat(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))))
    out = filters.wish_list(rows, "p_name", "aliases", wishes, "wish")
    return out.select("p_partkey", "p_name", F.col("extra")["k"].alias("extra"))


QUERIES["wishlist"] = wishlist
ORACLE_SQL["wishlist"] = """
    with k as (select p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as a, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) as b from part)
    select p_partkey, p_name, p_partkey as extra from k, unnest(range(p_partkey % 3 + 1)) where a in (select a from k where p_partkey % 7 = 0) or b in (select a from k where p_partkey % 7 = 0)
"""


def overlay_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sparse layers over nations, the maps merged by key."""
    n, k = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("n_nationkey")
    facts = lambda i: F.create_map(F.lit("shared"), F.lit(str(i)), F.lit(f"own{i}"), F.lit("x"))
    base = n.select("n_nationkey", F.lit("base").alias("label"), facts(0).alias("facts"))
    layers = [n.where(k % m == 0).select("n_nationkey", F.when(k % 5 != 0, F.lit(f"layer{m}")).alias("label"), facts(m).alias("facts")) for m in (2, 3, 4)]
    out = joins.overlay(base, "n_nationkey", layers, maps=("facts",))
    return out.select("n_nationkey", "label", F.col("facts")["shared"].alias("shared"), F.array_join(F.array_sort(F.map_keys("facts")), ",").alias("keys"))


QUERIES["overlay_config"] = overlay_config
ORACLE_SQL["overlay_config"] = """
    select n_nationkey, case when n_nationkey % 5 = 0 then 'base' when n_nationkey % 4 = 0 then 'layer4' when n_nationkey % 3 = 0 then 'layer3' when n_nationkey % 2 = 0 then 'layer2' else 'base' end as label,
        case when n_nationkey % 4 = 0 then '4' when n_nationkey % 3 = 0 then '3' when n_nationkey % 2 = 0 then '2' else '0' end as shared,
        'own0' || case when n_nationkey % 2 = 0 then ',own2' else '' end || case when n_nationkey % 3 = 0 then ',own3' else '' end || case when n_nationkey % 4 = 0 then ',own4' else '' end || ',shared' as keys
    from nation
"""


def contact_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as contacts, told by three sources that know different things."""
    s, k = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), F.col("s_suppkey")
    part = lambda src, keep, name, email, phone: s.where(keep).select(
        "s_nationkey", F.lit(src).alias("source"), k.alias("ordinal"), name.alias("name"), F.when(k % 2 == 0, "Assistant coach").otherwise("Head Coach").alias("title"), email.alias("email"), phone.alias("phone")
    )
    mail, dial = F.concat(F.lit("s"), k.cast("string"), F.lit("@u.edu ")), F.lpad(k.cast("string"), 10, "5")
    sources = part(1, k % 3 == 0, F.upper("s_name"), F.lit(""), F.lit(None).cast("string")).unionByName(part(2, k % 4 != 1, F.col("s_name"), F.when(k % 4 == 0, mail), dial)).unionByName(part(3, k > 0, F.lower("s_name"), mail, F.lit("none")))
    return joins.merge_contacts(sources, "s_nationkey")


QUERIES["contact_priority_merge"] = contact_priority_merge
ORACLE_SQL["contact_priority_merge"] = """
    with s as (select *, case when s_suppkey % 2 = 0 then 'Assistant Head Coach' else 'Head Coach' end as title, lpad(cast(s_suppkey as varchar), 10, '5') as d from supplier),
    c as (select s_nationkey, case when s_suppkey % 3 = 0 then 1 when s_suppkey % 4 <> 1 then 2 else 3 end as src, s_suppkey,
        case when s_suppkey % 3 = 0 then upper(s_name) when s_suppkey % 4 <> 1 then s_name else lower(s_name) end as name, title,
        's' || s_suppkey || '@u.edu' as email, case when s_suppkey % 4 <> 1 then '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) else '' end as phone from s)
    select s_nationkey, name, title, email, phone, cast(row_number() over (partition by s_nationkey order by src, s_suppkey) as integer) as position from c
"""


def facility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", "s_suppkey")
    kinds, codes, lats = ["large_airport", "medium_airport", "small_airport", None], ["ATL", "ord", "X1", "", None], ["39.5", "x", None]
    names, flights = ["City", "Some Air Force Base", "Army Airfield", None], ["yes", "no", None]
    ok = filters.commercial_facility(cycle("s_suppkey", kinds), cycle("s_suppkey", flights), cycle("s_suppkey", codes), cycle("s_suppkey", names), cycle("s_suppkey", lats), F.lit("1.0"))
    return s.where(ok)


QUERIES["facility_filter"] = facility_filter
ORACLE_SQL["facility_filter"] = """
    select s_suppkey from supplier where s_suppkey % 4 in (0, 1) and s_suppkey % 3 <> 1 and s_suppkey % 5 in (0, 1) and s_suppkey % 4 in (0, 3) and s_suppkey % 3 = 0
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(
        "p_partkey", F.when(k % 5 != 0, 2.0 * F.col("p_size")).alias("graduation_rate"), F.when(k % 7 != 0, 100.0 - F.col("p_size")).alias("retention_rate"),
        F.when(k % 3 != 0, 40.0 * F.col("p_retailprice")).alias("salary"), F.when(k % 4 != 0, 20.0 * F.col("p_retailprice")).alias("cost"), F.when(k % 6 != 0, (k % 100).cast("double")).alias("acceptance_rate"),
    )
    return score.academic_scores(p)


_RAW_SQL = """select p_partkey, case when p_partkey % 5 <> 0 then 2.0::double * p_size end as g, case when p_partkey % 7 <> 0 then 100.0::double - p_size end as r,
    case when p_partkey % 3 <> 0 then 40.0::double * p_retailprice end as s, case when p_partkey % 4 <> 0 then 20.0::double * p_retailprice end as c,
    case when p_partkey % 6 <> 0 then cast(p_partkey % 100 as double) end as a from part"""


def _mean_sql(*parts: tuple[str, float]) -> str:
    top = " + ".join(f"coalesce({c} * {w}::double, 0)" for c, w in parts)
    low = " + ".join(f"case when {c} is not null then {w}::double else 0 end" for c, w in parts)
    return f"({top}) / nullif({low}, 0)"


def _grade_sql(c: str) -> str:
    steps = " ".join(f"when {c} >= {limit} then '{g}'" for limit, g in ((93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (60, "D")))
    return f"case {steps} when {c} is not null then 'D-' end"


_SCORES_SQL = f"""
    raw as ({_RAW_SQL}),
    sc as (select *, case when s is not null then greatest(0.0, least(1.0, (s - 30000) / 50000)) * 100 end::double as ss, case when c is not null then greatest(0.0, least(1.0, (c - 70000) / (-60000))) * 100 end::double as cs from raw),
    av as (select *, {_mean_sql(('g', 0.4), ('r', 0.3), ('ss', 0.3))} as ac, {_mean_sql(('ss', 0.6), ('cs', 0.4))} as va from sc),
    ov as (select *, {_mean_sql(('ac', 0.5), ('va', 0.4), ('g', 0.1))} as o from av),
    gr as (select *, {_grade_sql('ac')} as ag, {_grade_sql('va')} as vg, {_grade_sql('o')} as og from ov)"""


def scorecard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: (F.bround(F.col(c) * 100, 0) / 100).alias(c)
    return _scored(spark, sf_dir).select("p_partkey", r("academic_score"), r("value_score"), r("overall_score"), "academic_grade", "value_grade", "overall_grade")


QUERIES["scorecard_scores"] = scorecard_scores
ORACLE_SQL["scorecard_scores"] = f"""
    with {_SCORES_SQL} select p_partkey, {half_even_sql('ac', 2)} as academic_score, {half_even_sql('va', 2)} as value_score, {half_even_sql('o', 2)} as overall_score,
        ag as academic_grade, vg as value_grade, og as overall_grade from gr
"""


def score_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = cycle("p_partkey", ["A", "B", "D", "", None])
    return _scored(spark, sf_dir).select("p_partkey", score.score_explanation(other).alias("explanation"))


QUERIES["score_explanation"] = score_explanation
_PCT = "cast(cast(round_even({0}, 0) as bigint) as varchar) || '%'"
_USD = "'$' || format('{{:,}}', cast(round_even({0}, 0) as bigint))"
_SCALE = "['A', 'A-', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D+', 'D', 'D-']"
ORACLE_SQL["score_explanation"] = f"""
    with {_SCORES_SQL},
    t as (select *, nullif({cycle_sql('p_partkey', ['A', 'B', 'D', '', None])}, '') as other from gr),
    u as (select *, list_position({_SCALE}, og) - list_position({_SCALE}, other) as gap,
        list_filter([
            case when g >= 75 then 'graduation rate is solid at roughly ' || {_PCT.format('g')} when g >= 60 then 'graduation rate is moderate at about ' || {_PCT.format('g')}
                when g is not null then 'graduation rate is on the low side at around ' || {_PCT.format('g')} || ', which drags down academics' end,
            case when r >= 85 then 'first-year retention is strong at about ' || {_PCT.format('r')} when r < 75 then 'first-year retention is somewhat low at about ' || {_PCT.format('r')} end,
            case when s >= 65000 then 'alumni earnings are high, with median 10-year salaries around ' || {_USD.format('s')} when s >= 50000 then 'alumni earnings are decent, with median 10-year salaries around ' || {_USD.format('s')}
                when s is not null then 'median 10-year earnings are relatively modest at about ' || {_USD.format('s')} end,
            case when c <= 20000 then 'average annual cost after aid is relatively low at roughly ' || {_USD.format('c')} || ', helping the value score' when c <= 35000 then 'average annual cost after aid is mid-range at about ' || {_USD.format('c')}
                when c is not null then 'average annual cost after aid is on the higher side at roughly ' || {_USD.format('c')} || ', which hurts value' end,
            case when a <= 30 then 'admission is fairly selective with an acceptance rate near ' || {_PCT.format('a')} when a >= 75 then 'admission is relatively open with an acceptance rate around ' || {_PCT.format('a')} end
        ], lambda x: x is not null) as bits,
        array_to_string(list_filter([ag || ' for academics', vg || ' for value'], lambda x: x is not null), ' and ') as parts from t)
    select p_partkey, concat_ws(' ', 'Our Scorecard-based model rates this school around a ' || og || ' overall.', case when parts <> '' then 'That breaks down to ' || parts || '.' end,
        case when og is not null and other is not null then case
            when gap >= 2 then 'Niche lists the overall experience closer to a ' || other || ', but federal outcome data (graduation, cost, and earnings) make it look weaker in this model.'
            when gap <= -2 then 'Niche lists the overall experience around a ' || other || ', but based on Scorecard outcomes this model sees somewhat stronger performance.'
            else 'Niche’s overall grade of ' || other || ' is broadly in line with this Scorecard-based estimate.' end end,
        case when len(bits) > 0 then 'Key drivers behind these grades: ' || array_to_string(bits[1:3], '; ') || '.' end) as explanation from u
"""
_NOTES, _TIERS, _AIR, _DRIVES = ["Nonstop daily", "two-stop only", "", None, "direct in season"], ["A", "A-", "B+", "B", "C", None], ["ORD / MDW", "IND", None], ["15-20 min", "1 hr", ""]


def travel_fit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as schools; their places in the three orders of the reports, what is unknown last."""
    k = F.col("s_suppkey")
    lat, lon = _lat_lon("s_suppkey")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").select(
        "s_suppkey", F.when(k % 9 != 0, lat).alias("lat"), F.when(k % 9 != 0, lon).alias("lon"), cycle("s_suppkey", _AIR).alias("airport_code"), cycle("s_suppkey", _DRIVES).alias("airport_drive_time"),
        cycle("s_suppkey", _NOTES).alias("airport_notes"), cycle("s_suppkey", _TIERS).alias("tier"), F.when(k % 4 != 0, 2.0 + k % 11 / F.lit(10.0)).alias("vb_opp_score"), F.when(k % 6 != 0, k % 400).alias("rank"),
    )
    out = score.travel_and_fit(s, 39.7684, -86.1581)
    out = score.report_ranks(out, "s_suppkey")
    return out.select("s_suppkey", "flight_dist_mi", "drive_dist_mi", "drive_time_hr", "flight_time_hr", "travel_difficulty", "geo_score", "academic_score", "fit_score", "fit_rank", "travel_rank", "page_rank")


QUERIES["travel_fit_rank"] = travel_fit_rank
ORACLE_SQL["travel_fit_rank"] = f"""
    with s as (select s_suppkey, s_suppkey % 9 <> 0 as known, {_lat_lon_sql('s_suppkey')}, {cycle_sql('s_suppkey', [True, False, False])} as crowded, {cycle_sql('s_suppkey', [17.5, 60.0, 0.0])}::double as mins,
        {cycle_sql('s_suppkey', [-10, 10, 0, 0, -10])} as stops, {cycle_sql('s_suppkey', [3.0, 2.7, 2.3, 2.0, 2.0, 2.0])}::double as academic_score,
        case when s_suppkey % 4 <> 0 then 2.0::double + s_suppkey % 11 / 10.0::double else 2.0 end::double as opp, case when s_suppkey % 6 <> 0 then s_suppkey % 400 end as rank from supplier),
    d as (select *, {_miles_sql('39.7684::double', '-86.1581::double', 'lat', 'lon')} as d from s),
    m as (select *, case when known then {half_even_sql('d', 1)} else 0.0 end::double as flight_dist_mi, case when known then {half_even_sql('d * 1.15::double', 1)} else 0.0 end::double as drive_dist_mi from d),
    t as (select *, {half_even_sql('drive_dist_mi / 60', 1)} as drive_time_hr, {half_even_sql('flight_dist_mi / 450', 2)} as flight_time_hr,
        case when not known then 10 else cast(trunc(least(100.0::double, greatest(10.0::double, case when drive_dist_mi <= 350 then drive_dist_mi / 18 + 6
            else flight_dist_mi / 18 + mins / 3 + 20 + stops + case when crowded then 8 else 0 end + case when flight_dist_mi > 1600 then 5 else 0 end end))) as integer) end as travel_difficulty,
        case when not known then 1.5 when drive_dist_mi <= 300 then 3.0 when drive_dist_mi <= 600 then 2.5 when drive_dist_mi <= 1000 then 2.0 when drive_dist_mi <= 1500 then 1.5 else 1.0 end::double as geo_score,
        case when rank is not null then 3.0::double - (greatest(1.0::double, least(350.0::double, rank)) - 1) * (1.0::double / 349) else 2.5 end::double as rp from m),
    f as (select *, {half_even_sql('academic_score * 0.40::double + opp * 0.35::double + geo_score * 0.15::double + rp * 0.10::double', 2)} as fit_score from t)
    select s_suppkey, flight_dist_mi, drive_dist_mi, drive_time_hr, flight_time_hr, travel_difficulty, geo_score, academic_score, fit_score,
        row_number() over (order by fit_score desc nulls last, s_suppkey) as fit_rank, row_number() over (order by travel_difficulty nulls last, drive_dist_mi nulls last, s_suppkey) as travel_rank,
        row_number() over (order by coalesce(fit_score, 0) desc, s_suppkey) as page_rank from f
"""


def risk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").select(
        "s_suppkey", cycle("s_suppkey", ["Big 12", "MAC", None]).alias("conference"), cycle("s_suppkey", ["A", "B"]).alias("tier"), (k * 13 % 1500).cast("double").alias("drive_dist_mi"),
        (k % 80).cast("int").alias("travel_difficulty"), F.when(k % 5 != 0, 2.0 + k % 11 / F.lit(10.0)).alias("vb_opp_score"), F.when(k % 7 == 0, "given").otherwise(" ").alias("risk_watchouts"),
    )
    return s.select("s_suppkey", score.risk_text().alias("risk"))


QUERIES["risk_text"] = risk_text
ORACLE_SQL["risk_text"] = """
    with s as (select s_suppkey, case when s_suppkey % 5 <> 0 then 2.0::double + s_suppkey % 11 / 10.0::double else 2.0 end as opp from supplier),
    m as (select s_suppkey, list_filter([
        case when s_suppkey % 3 = 0 then 'Power-conference competition; playing time may depend on winning a role early.' end,
        case when opp <= 2.2::double then 'Position group may be crowded; monitor depth chart and portal additions closely.' when opp >= 2.9::double then 'High current opportunity, but staff may add competition quickly.' end,
        case when s_suppkey * 13 % 1500 > 800 or s_suppkey % 80 >= 60 then 'Long-distance travel and separation from home are non-trivial factors.' end,
        case when s_suppkey % 2 = 0 then 'Stronger academic profile may come with higher workload and expectations.' end], lambda x: x is not null) as msgs from s)
    select s_suppkey, case when s_suppkey % 7 = 0 then 'given' when len(msgs) = 0 then 'No major structural risks flagged; focus on staff fit, culture, and major alignment.' else array_to_string(msgs, ' ') end as risk from m
"""


def scorecard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by their scorecard key: how many spellings share one."""
    p = read_table(spark, sf_dir, "part", "p_name", "p_type")
    return p.select(scorecard_key(F.concat_ws(" of the ", "p_name", "p_type")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


QUERIES["scorecard_names"] = scorecard_names
ORACLE_SQL["scorecard_names"] = f"select array_to_string({_KEY.format(chr(40) + 'p_name || ' + chr(39) + ' of the ' + chr(39) + ' || p_type)')}, ' ') as key, count(*) as n from part group by 1"
