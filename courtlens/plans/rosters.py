"""Rosters, transfers and team pivots over customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.functions import classify, dates
from courtlens.functions.text import alias_key, player_name
from courtlens.operators import columns, filters, incoming, joins, pivot, score
from courtlens.plans.binding import Query, cycle, cycle_sql
from courtlens.sources.files import read_table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The literals that customers cycle through, and what the rules make of them.
CLASS = ["Fr", "So.", "Junior", "Sr", "R-Fr", "Graduate", "Sophomore", "", "R-Jr"]
YEAR = ["Fr", "So", "Jr", "Sr", "R-Fr", "Gr", "So", "", "R-Jr"]
AFTER = ["So", "Jr", "Sr", "Gr", "R-So", "Gr", "Jr", "", "R-Sr"]
LEAVES = [False, False, False, True, False, True, False, False, False]
POSITION = ["S", "OH", "MB", "L/DS", "Setter/RS", "OH/S", "Utility", "Coach", "RS", "DS", "Middle"]
CODES = [["S"], ["OH"], ["MB"], ["DS"], ["RS", "S"], ["OH", "S"], ["DS", "OH"], [], ["RS"], ["DS"], ["MB"]]
LABEL = ["Setter", "Pin", "Middle", "Defender", "Pin", "Pin", "Pin", "Coach", "Pin", "Defender", "Middle"]
SETTER = [True, False, False, False, True, False, False, False, False, False, False]
HEIGHT = ["6-2", "5-11", "", "6-0", "bad", "5-8", "6-4"]
INCHES = [74, 71, None, 72, None, 68, 76]
#: Numbers as letters: a name that keeps apart what the digit rule would merge.
SQL_NAME = "'Pat ' || translate(cast({} as varchar), '0123456789', 'abcdefghij')"


def person(key: str):
    return F.concat(F.lit("Pat "), F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team, conference, ordinal, name, class, position, height, assists, kills, digs of customers with their orders."""
    n = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("n_name").alias("team"), F.col("r_name").alias("conference"), F.col("c_custkey").alias("ordinal"), person("c_custkey").alias("name"), cycle("c_custkey", CLASS).alias("class"),
        cycle("c_custkey", POSITION).alias("position"), cycle("c_custkey", HEIGHT).alias("height"), (F.col("n") * 40).alias("assists"), F.floor(F.col("total") / 10_000).alias("kills"), (F.col("n") * 7).alias("digs"),
        F.col("c_nationkey").alias("team_no"),
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th customer leaves, every 34th to the next nation, the others to nowhere known."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_custkey % 17 = 0")
    to = n.select(F.col("n_nationkey").alias("to_key"), F.col("n_name").alias("to_name"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(to, (F.col("c_nationkey") + 1) % 25 == F.col("to_key"), "left")
    return rows.select(person("c_custkey").alias("name"), F.col("n_name").alias("old_team"), F.when(F.col("c_custkey") % 34 == 0, F.col("to_name")).otherwise("").alias("new_team"), F.col("c_custkey").alias("ordinal"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_suppkey") % 3 == 0, person("s_suppkey")).otherwise(F.concat(F.lit("New "), person("s_suppkey")))
    return s.select(F.col("n_name").alias("school"), name.alias("name"), cycle("s_suppkey", POSITION).alias("position"), (F.col("s_suppkey") % 2 == 0).alias("is_transfer"), F.col("s_suppkey").alias("ordinal"))


def team_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    coach = lambda i: F.struct(F.concat(F.lit(f"Coach {i} "), "n_name").alias("name"), F.lit("Head").alias("title"), F.lit(f"c{i}@u.edu").alias("email"), F.lit(None).cast("string").alias("phone"), F.lit(2000 + i).alias("start_year"), F.lit(i).alias("seasons_at_school"))
    facts = read_table(spark, sf_dir, "nation").select(
        alias_key("n_name").alias("team_key"), F.concat(F.lit("http://r/"), k.cast("string")).alias("roster_url"), F.concat(F.lit("http://s/"), k.cast("string")).alias("stats_url"),
        F.when(k % 4 != 0, k + 1).alias("rank"), F.lit("10-5").alias("record"), F.slice(F.array(*map(coach, range(1, 7))), 1, (k % 7).cast("int")).alias("coaches"),
    )
    return pivot.team_pivot(roster(spark, sf_dir), arrivals(spark, sf_dir), moves(spark, sf_dir), facts)


QUERIES["team_pivot"] = team_pivot
_HAS = {"pin": "(list_contains(codes, 'OH') or list_contains(codes, 'RS'))", "middle": "list_contains(codes, 'MB')", "def": "list_contains(codes, 'DS')"}


def _pivot_sql() -> str:
    parts, inc, out = [], [], []
    for g, stat in (("setter", "assists"), ("pin", "kills"), ("middle", "kills"), ("def", "digs")):
        is_ = "is_setter" if g == "setter" else _HAS[g]
        listed = "(is_setter or assists >= 150)" if g == "setter" else is_
        came = "list_contains(icodes, 'S') and not list_contains(icodes, 'DS')" if g == "setter" else _HAS[g].replace("codes", "icodes")
        parts += [
            f"count(*) filter (stays and {is_}) as ret_{g}", f"count(*) filter (stays and {listed}) as listed_{g}",
            f"coalesce(string_agg(name || ' - ' || class_next || ' (' || cast({stat} as varchar) || ')', ', ' order by {is_} desc, ordinal) filter (stays and {listed}), '') as names_{g}",
            f"round_even(avg(inches) filter (stays and {listed}), 0) as high_{g}",
        ]
        inc += [f"count(*) filter ({came}) as n_{g}", f"coalesce(string_agg(shown, ', ' order by ordinal) filter ({came}), '') as in_{g}"]
        out += [
            f"ret_{g} as returning_{g}_count", f"names_{g} as returning_{g}_names", f"coalesce(n_{g}, 0) as incoming_{g}_count", f"coalesce(in_{g}, '') as incoming_{g}_names",
            f"listed_{g} + coalesce(n_{g}, 0) as projected_{g}_count",
            f"coalesce(cast(cast(high_{g} as integer) // 12 as varchar) || ''' ' || cast(cast(high_{g} as integer) % 12 as varchar) || '\"', '') as avg_{g}_height",
        ]
    for i in range(1, 6):
        has = f"n_nationkey % 7 >= {i}"
        vals = {"name": f"'Coach {i} ' || team", "title": "'Head'", "email": f"'c{i}@u.edu'", "phone": "''", "start_year": f"'{2000 + i}'", "seasons_at_school": f"'{i}'"}
        out += [f"case when {has} then {v} else '' end as coach{i}_{f}" for f, v in vals.items()]
    cust = SQL_NAME.format("c_custkey")
    supp = SQL_NAME.format("s_suppkey")
    return f"""
        with stats as (select o_custkey, count(*) as n, sum(o_totalprice) as total from orders group by 1),
        players as (
            select n_name as team, r_name as conference, c_custkey as ordinal, n_nationkey, {cust} as name, {cycle_sql('c_custkey', AFTER)} as class_next,
                {cycle_sql('c_custkey', CODES)} as codes, {cycle_sql('c_custkey', SETTER)} as is_setter, {cycle_sql('c_custkey', INCHES)} as inches,
                coalesce(n, 0) * 40 as assists, cast(coalesce(floor(total / 10000), 0) as bigint) as kills, coalesce(n, 0) * 7 as digs,
                not {cycle_sql('c_custkey', LEAVES)} and c_custkey % 17 <> 0 as stays
            from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join stats on o_custkey = c_custkey
        ), base as (
            select team, n_nationkey, arg_min(conference, ordinal) as conference, count(*) filter (is_setter and assists >= 350) as setters, {', '.join(parts)}
            from players group by team, n_nationkey
        ), came as (
            select n_name as school, s_suppkey as ordinal, {cycle_sql('s_suppkey', CODES)} as icodes,
                case when s_suppkey % 3 = 0 then {supp} else 'New ' || {supp} end as name, {cycle_sql('s_suppkey', POSITION)} as position,
                s_suppkey % 3 = 0 and s_suppkey in (select c_custkey from customer) as known, {cycle_sql('s_suppkey', AFTER)} as k_next, {cycle_sql('s_suppkey', LABEL)} as label, s_suppkey % 2 = 0 as moved
            from supplier join nation on s_nationkey = n_nationkey
        ), shown as (
            select *, case when moved then name || ' (' || case when known and k_next <> '' then k_next || '. ' else '' end || label || ' - Transfer)' else name || ' (' || position || ')' end as shown from came
        ), arrived as (select school, {', '.join(inc)} from shown group by school),
        moves as (
            select {cust} as name, c_custkey as ordinal, a.n_name as old_team, case when c_custkey % 34 = 0 then b.n_name else '' end as new_team
            from customer join nation a on c_nationkey = a.n_nationkey left join nation b on (c_nationkey + 1) % 25 = b.n_nationkey where c_custkey % 17 = 0
        ), leaves as (select old_team, string_agg(name, ', ' order by ordinal) as gone from moves group by 1),
        comes as (select new_team, string_agg(name, ', ' order by ordinal) as new from moves where new_team <> '' group by 1)
        select team, conference, 'http://r/' || n_nationkey as roster_url, 'http://s/' || n_nationkey as stats_url, case when n_nationkey % 4 <> 0 then n_nationkey + 1 end as rank, '10-5' as record,
            case when setters >= 2 then '6-2' when setters = 1 then '5-1' else 'Unknown' end as offense_type,
            coalesce(gone, '') as outgoing_transfers, coalesce(new, '') as incoming_transfers, {', '.join(out)}
        from base left join arrived on school = team left join leaves on old_team = team left join comes on new_team = team
    """


ORACLE_SQL["team_pivot"] = _pivot_sql()


def transfer_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and position of transfers, where missing, from the roster by school and name; the position as its label."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_custkey % 5 = 0")
    edges = c.select("c_custkey", F.col("c_nationkey").alias("school"), person("c_custkey").alias("who"), F.when(F.col("c_custkey") % 3 != 0, "Jr").alias("class"), F.when(F.col("c_custkey") % 2 == 0, "OH").alias("position"))
    known = roster(spark, sf_dir).select(F.col("team_no").alias("school"), F.col("name").alias("who"), classify.class_year("class").alias("k_class"), F.col("position").alias("k_position"), "ordinal")
    rows = edges.join(joins.last_by(known, ["school", "who"], ["ordinal"]), ["school", "who"], "left")
    place = F.coalesce("position", "k_position")
    return rows.select("c_custkey", F.coalesce("class", "k_class").alias("class"), classify.position_label(classify.position_codes(place), place).alias("position"))


QUERIES["transfer_enrich"] = transfer_enrich
ORACLE_SQL["transfer_enrich"] = f"""
    select c_custkey, case when c_custkey % 3 <> 0 then 'Jr' else {cycle_sql('c_custkey', YEAR)} end as class,
        case when c_custkey % 2 = 0 then 'Pin' else {cycle_sql('c_custkey', LABEL)} end as position
    from customer where c_custkey % 5 = 0
"""


def merge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large returned lines by part, else totals by part name."""
    parts = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    lines = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_returnflag")
    one = lines.where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("quantity"), F.count("*").alias("n"))
    two = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.max("l_quantity").alias("quantity"), F.count("*").alias("n"))
    return joins.merge_fallback(parts, one, ["p_partkey"], two, ["p_name"], ["quantity", "n"]).select("p_partkey", "quantity", "n")


QUERIES["merge_fallback"] = merge_fallback
ORACLE_SQL["merge_fallback"] = """
    with one as (select l_partkey, max(l_quantity) as q, count(*) as n from lineitem where l_returnflag = 'R' and l_quantity > 45 group by 1),
    two as (select p_name, max(l_quantity) as q, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1)
    select p_partkey, coalesce(one.q, two.q) as quantity, coalesce(one.n, two.n) as n
    from part left join one on l_partkey = p_partkey left join two on part.p_name = two.p_name
"""


def roster_join_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their cheapest line; columns that clash get a suffix, season and label come first."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "price"})
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_extendedprice")
    first = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("status"), F.min("l_extendedprice").alias("price"))
    year = dates.season_year(F.col("o_orderdate"))
    out = columns.prepend(columns.join_suffixed(o, first, ["id"], "_roster"), {"season": dates.season_label(year), "team": "all"})
    return out.drop("o_orderdate")


QUERIES["roster_join_suffix"] = roster_join_suffix
ORACLE_SQL["roster_join_suffix"] = """
    with l as (select l_orderkey, min(l_linestatus) as status_roster, min(l_extendedprice) as price_roster from lineitem group by 1),
    o as (select *, case when month(o_orderdate) >= 8 then year(o_orderdate) else year(o_orderdate) - 1 end as y from orders)
    select y || '-' || (y + 1) as season, 'all' as team, o_orderkey as id, o_orderstatus as status, o_totalprice as price, status_roster, price_roster
    from o left join l on l_orderkey = o_orderkey
"""


def projected_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = roster(spark, sf_dir).select("team", "ordinal", "name", "class", "position", "team_no", F.when(F.col("team_no") % 2 == 0, F.when(F.col("ordinal") % 3 == 0, "Yes").otherwise("no")).alias("include"))
    gone = moves(spark, sf_dir).select(F.col("old_team").alias("team"), F.upper("name").alias("name"))
    new = arrivals(spark, sf_dir).select(F.col("school").alias("team"), "ordinal", "name", F.when(F.col("ordinal") % 2 == 0, "Jr").alias("class"), "position")
    return score.projected_roster(c.drop("team_no"), gone, new)


QUERIES["projected_roster"] = projected_roster
ADVANCED = ["So", "So.", "Sr", "Graduated", "R-So", "Graduated", "Jr", "", "R-Sr"]
ORACLE_SQL["projected_roster"] = f"""
    with stay as (
        select n_name as team, c_custkey as ordinal, {SQL_NAME.format('c_custkey')} as name, {cycle_sql('c_custkey', ADVANCED)} as class, {cycle_sql('c_custkey', POSITION)} as position, n_nationkey
        from customer join nation on c_nationkey = n_nationkey
        where c_custkey % 17 <> 0 and not {cycle_sql('c_custkey', LEAVES)}
            and (n_nationkey % 2 = 1 or c_custkey % 3 = 0 or n_nationkey not in (select c_nationkey from customer where c_custkey % 3 = 0))
    ), new as (
        select n_name as team, s_suppkey as ordinal, case when s_suppkey % 3 = 0 then '' else 'New ' end || {SQL_NAME.format('s_suppkey')} as name,
            case when s_suppkey % 2 = 0 then 'Jr' else 'Fr' end as class, {cycle_sql('s_suppkey', POSITION)} as position
        from supplier join nation on s_nationkey = n_nationkey
    ), both_ as (select team, 0 as src, ordinal, name, class, position from stay union all select team, 1, ordinal, name, class, position from new)
    select team, name, class, position, src = 1 as incoming from both_ qualify row_number() over (partition by team, lower(name) order by src, ordinal) = 1
"""


def opportunity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.opportunity(roster(spark, sf_dir), "team", "Setter")


QUERIES["opportunity_score"] = opportunity_score
_S = [True, False, False, False, True, True, False, False, False, False, False]
_W = [0.3, 0.5, 0.5, 0.9, 0.5, 1.0, 0.5, 0.5, 0.5]  # "Junior" begins with "ju", not "jr"
ORACLE_SQL["opportunity_score"] = f"""
    with stats as (select o_custkey, count(*) * 40 as assists from orders group by 1),
    p as (
        select n_name as team, {cycle_sql('c_custkey', _S)} as same, {cycle_sql('c_custkey', _W)}::double as e,
            case when coalesce(assists, 0) >= 800 then 1.0 when assists >= 400 then 0.5 when assists >= 200 then 0.3 else 0.1 end::double as w
        from customer join nation on c_nationkey = n_nationkey left join stats on o_custkey = c_custkey
    ), l as (select team, sum(e) filter (same) as e, sum(w) filter (same) as w from p group by team)
    select team, coalesce(round_even(greatest(1.0, least(3.0, 3.0::double - 0.25::double * e - 0.25::double * w)) * 100.0, 0) / 100.0::double, 3.0)::double as vb_opp_score from l
"""


def program_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as schools, most of them an alias of their nation's team: what its pivot row tells, the opportunity that
    follows from the projected count, and the coaches of the team and the school, merged."""
    k, named = F.col("s_suppkey"), read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    pivot = team_pivot(spark, sf_dir).select("team", "conference", "offense_type", "rank", "record", "projected_setter_count")
    pivot = pivot.withColumn("politics_label", F.when(F.length("team") % 2 == 0, F.lit("Quite Conservative here")))
    schools = s.select(
        "s_suppkey", F.col("s_name").alias("name"), F.lit("own").alias("conference"), F.lit("?").alias("offense_type"), F.when(k % 3 == 0, 7.0).alias("rpi_rank"), F.lit("1-1").alias("record"),
        F.when(k % 4 == 0, 2.9).alias("vb_opp_score"), F.when(k % 7 == 0, F.lit("mine")).alias("politics_label"),
    )
    aliases = s.where(k % 5 != 0).select(F.lower("s_name").alias("alias"), F.col("n_name").alias("canonical"), k.alias("ordinal"))
    person = lambda team, source, ordinal, name, title, email, phone: (team.alias("team"), F.lit(source).alias("source"), F.lit(ordinal).alias("ordinal"), name.alias("name"), F.lit(title).alias("title"), F.lit(email).alias("email"), F.lit(phone).alias("phone"))
    jo = F.concat(F.lit("Jo "), "n_name")
    contacts = named.select(*person(F.col("n_name"), 1, 1, jo, "head coach", "jo@u.edu", "")).unionByName(s.select(*person(F.col("s_name"), 2, 1, F.upper(jo), "Head", "", "317.555.0100")))
    contacts = contacts.unionByName(s.where(k % 2 == 0).select(*person(F.col("s_name"), 2, 2, F.lit("Al"), "Trainer", "", "")))
    out = score.enrich_schools(schools, "name", pivot, aliases, contacts, "S")
    told = F.array_join(F.transform("coaches", lambda c: F.concat_ws("|", c["name"], c["title"], c["email"], c["phone"])), ";")
    return out.select("s_suppkey", "conference", "offense_type", "rpi_rank", "record", "vb_opp_score", "politics_label", told.alias("coaches"))


QUERIES["program_enrich"] = program_enrich
ORACLE_SQL["program_enrich"] = f"""
    with pivot_ as ({_pivot_sql()}),
    s as (select s_suppkey as k, n_name, p.*, s_suppkey % 5 <> 0 and p.team is not null as known, case when s_suppkey % 4 = 0 then 2.9::double else 2.5::double end as have
        from supplier join nation on s_nationkey = n_nationkey left join pivot_ p on team = n_name)
    select k as s_suppkey, case when known then conference else 'own' end as conference, case when known then offense_type else '?' end as offense_type,
        case when known then cast(rank as double) when k % 3 = 0 then 7.0::double end as rpi_rank, case when known then coalesce(record, 'N/A') else '1-1' end as record,
        case when not known then case when k % 4 = 0 then 2.9::double end when projected_setter_count is null then have
            else greatest(2.0, least(3.0, case when projected_setter_count <= 1 then 3.0::double when projected_setter_count <= 2 then 2.7::double
                when projected_setter_count <= 3 then 2.3::double else 2.0::double end - case when offense_type = '6-2' and projected_setter_count >= 2 then 0.2::double else 0 end)) end::double as vb_opp_score,
        case when k % 7 = 0 then 'mine' when known and length(n_name) % 2 = 0 then 'Conservative' when known then '' end as politics_label,
        case when known then 'Jo ' || n_name || '|Head Coach|jo@u.edu|(317) 555-0100' || case when k % 2 = 0 then ';Al|Trainer||' else '' end else '' end as coaches
    from s
"""


def transfer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of transfers made of whole turns of conversations, with the header that the last user turn gives."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    head, moves = F.regexp_replace("text", "[^A-Za-z ]", ""), F.when(F.col("turn") % 4 == 1, " - OH transfer (Club - x)").otherwise(" - MB (Club)")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Conf "), head, F.lit(":"))).otherwise(F.concat(F.lit("Lee, P 12 - "), head, moves))
    rows = incoming.parse_transfers(c.where("turn > 0").select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")
    return rows.select("conv_id", "turn", "conference", "name", "school", "position", "is_transfer")


QUERIES["transfer_lines"] = transfer_lines
ORACLE_SQL["transfer_lines"] = """
    with h as (select conv_id, turn, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') as head from conversations where turn > 0),
    c as (select *, last_value(case when role = 'user' then trim('Conf ' || head) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as conference from h)
    select conv_id, turn, coalesce(conference, '') as conference, 'P Lee' as name, trim(head) as school, case when turn % 4 = 1 then 'OH transfer' else 'MB' end as position, turn % 4 = 1 as is_transfer
    from c where role <> 'user'
"""


def incoming_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and lines made of whole turns of conversations: each conversation's user turns head what follows."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    head = F.regexp_replace("text", "[^A-Za-z ]", "")
    line = F.when(F.col("role") == "user", F.concat(F.lit("Conf "), head, F.lit(":"))).otherwise(F.concat(F.lit("P - "), head, F.lit(" - OH (Club)")))
    rows = incoming.parse_lines(c.select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")
    return rows.select("conv_id", "turn", "conference", "name", "school", "position", "club")


QUERIES["incoming_parse"] = incoming_parse
ORACLE_SQL["incoming_parse"] = """
    with h as (select conv_id, turn, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') as head from conversations),
    c as (select *, last_value(case when role = 'user' then trim('Conf ' || head) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as conference from h)
    select conv_id, turn, conference, 'P' as name, trim(head) as school, 'OH' as position, 'Club' as club from c where role <> 'user' and conference is not null
"""


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, lower-case names and codes of nations as aliases; of equal aliases the last counts."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    rows = n.select(F.col("n_name").alias("canonical"), F.col("n_nationkey").alias("ordinal"), F.explode(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 2)))).alias("alias"))
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    spelled = F.when(F.col("s_suppkey") % 3 == 0, F.substring("n_name", 1, 2)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), "n_name")).otherwise(F.concat(F.lit("x"), "n_name"))
    return joins.resolve_aliases(s.select("s_suppkey", spelled.alias("name")), "name", rows).select("s_suppkey", "name", "canonical")


QUERIES["alias_resolve"] = alias_resolve
ORACLE_SQL["alias_resolve"] = """
    with a as (select n_name, n_nationkey, unnest([lower(n_name), lower(substr(n_name, 1, 2))]) as alias from nation),
    d as (select alias, arg_max(n_name, n_nationkey * 1000) as canonical from a group by alias),
    s as (select s_suppkey, case when s_suppkey % 3 = 0 then substr(n_name, 1, 2) when s_suppkey % 3 = 1 then ' ' || n_name else 'x' || n_name end as name from supplier join nation on s_nationkey = n_nationkey)
    select s_suppkey, name, coalesce(canonical, name) as canonical from s left join d on alias = lower(trim(name))
"""


def artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo files of some suppliers, named in several ways."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("who", person("s_suppkey"))
    named = lambda mid, end: F.concat("n_name", F.lit(mid), F.regexp_replace("who", " ", "_"), F.lit(end))
    file = F.when(F.col("s_suppkey") % 4 == 0, named("_", ".JPG")).when(F.col("s_suppkey") % 4 == 1, named("_college_", ".png")).when(F.col("s_suppkey") % 4 == 2, named("_x_", "_old.gif"))
    files = s.select(file.alias("file")).where("file is not null")
    return joins.match_artifacts(s, "s_suppkey", "n_name", "who", files, "file")


QUERIES["artifact_match"] = artifact_match
ORACLE_SQL["artifact_match"] = f"""
    with s as (select s_suppkey, replace(n_name, ' ', '_') as team, n_name, replace({SQL_NAME.format('s_suppkey')}, ' ', '_') as who from supplier join nation on s_nationkey = n_nationkey),
    f as (select case s_suppkey % 4 when 0 then n_name || '_' || who || '.JPG' when 1 then n_name || '_college_' || who || '.png' when 2 then n_name || '_x_' || who || '_old.gif' end as file from s),
    hits as (
        select s_suppkey, file, case when lower(file) in (lower(team) || '_' || lower(who) || '.jpg', lower(team) || '_college_' || lower(who) || '.png') then 1
            when starts_with(lower(file), lower(team)) and contains(lower(file), lower(who)) then 2 end as k
        from s, f where file is not null
    ), best as (select s_suppkey, min(k) as k from hits where k is not null group by 1)
    select s.s_suppkey, min(h.file) as file, case min(b.k) when 1 then 'name' when 2 then 'contains' end as step
    from s left join best b using (s_suppkey) left join hits h on h.s_suppkey = s.s_suppkey and h.k = b.k group by 1
"""


def filters_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged customers of nations that flag any, of segments given without case, one way of travel shown by distance."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    c = c.withColumn("flag", F.when(F.col("c_nationkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, " TRUE ").otherwise("0")))
    kept = filters.keep_flagged(c, "c_nationkey", "flag")
    kept = filters.optional(kept, [("building", filters.same("c_mktsegment", "building") | filters.contains_any(["c_name"], "00_5")), (0, F.lit(False))])
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    named = kept.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("c_acctbal").isNotNull())
    listed = filters.restrict(named, "n_name", n.where("n_nationkey < 20").select(F.concat(F.lit("The "), F.lower("n_name")).alias("listed")), "listed")
    return listed.select("c_custkey", F.when(F.col("c_acctbal") > 350, "flight").alias("travel"))


QUERIES["filters_basic"] = filters_basic
ORACLE_SQL["filters_basic"] = """
    with c as (select *, c_nationkey % 3 = 0 and c_custkey % 2 = 0 as hit from customer), k as (select *, bool_or(hit) over (partition by c_nationkey) as any_hit from c)
    select c_custkey, case when c_acctbal > 350 then 'flight' end as travel from k
    where (hit or not any_hit) and (lower(c_mktsegment) = 'building' or lower(c_name) like '%00_5%') and c_acctbal is not null and c_nationkey < 20
"""


def player_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster rows that have a row of the same name next door: names compare by their normalized form."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumn("who", player_name(person("c_custkey")))
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").select(player_name(F.concat_ws(", ", F.regexp_extract(person("s_suppkey"), " (.*)$", 1), F.lit("Pat"))).alias("who"), "s_suppkey")
    return c.join(joins.last_by(s, ["who"], ["s_suppkey"]), "who").select("c_custkey", "s_suppkey", "who")


QUERIES["player_lookup"] = player_keys
ORACLE_SQL["player_lookup"] = f"select c_custkey, s_suppkey, {SQL_NAME.format('c_custkey')} as who from customer join supplier on c_custkey = s_suppkey"
