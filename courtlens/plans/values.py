"""Rules for single values, over literals that cover their cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.functions import classify, dates, numbers, text, validity
from courtlens.operators import incoming
from courtlens.operators.columns import base_name, season_row, side_tables
from courtlens.operators.extract import by_year
from courtlens.operators.lineage import spread
from courtlens.plans.binding import Query, cycle_sql, half_even_sql, literal_query, sql_literal
from courtlens.sources.files import read_table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, made: tuple[Query, str]) -> None:
    QUERIES[name], ORACLE_SQL[name] = made


SCHOOLS = ["The University of Texas at San Antonio", "Ohio State University-Main Campus", "  St. John's   College ", None, "University at Albany", "Texas A&M University", "BRYANT university"]
add("key_normalize", literal_query("orders", "o_orderkey", {
    "cleaned": (SCHOOLS, text.clean, ["The University of Texas at San Antonio", "Ohio State University-Main Campus", "St. John's College", "", "University at Albany", "Texas A&M University", "BRYANT university"]),
    "school_key": (SCHOOLS, text.school_key, ["texas at san antonio", "ohio state main campus", "st john s", "", "at albany", "texas a m", "bryant"]),
    "alias_key": (SCHOOLS, text.alias_key, ["the university of texas at san antonio", "ohio state university main campus", "st john s college", "", "ualbany", "texas a m university", "bryant"]),
    "scorecard_key": (SCHOOLS, text.scorecard_key, ["texas san antonio", "ohio main", "st johns", "", "albany", "texas a and m", "bryant"]),
    "index_key": (SCHOOLS, text.index_key, ["texas san antonio", "ohio main", "st john s", "", "albany", "texas a m", "bryant"]),
    "wish_keys": (["Ohio State (OH)", "Rice", None], lambda c: F.array_join(text.wish_keys(c), "|"), ["ohio state oh|ohio state", "rice", ""]),
}))

NAMES = ["Beatty, Molly 12", "O'Neil, Mary-Kate", "  Jane   Roe ", "Smith, Ann, Jr", None, "7 Ana Lo 21", "Lee Lee"]
add("player_name", literal_query("customer", "c_custkey", {
    "person": (NAMES, text.player_name, ["Molly Beatty", "Mary-Kate O'Neil", "Jane Roe", "Smith, Ann, Jr", "", "Ana Lo", "Lee Lee"]),
    "canonical": (NAMES, text.canonical_name, ["beatty molly", "kate mary neil o", "jane roe", "ann jr smith", "", "ana lo", "lee"]),
}))

add("slugs", literal_query("supplier", "s_suppkey", {
    "file_slug": (["Molly O'Neil", " A & B ", None, "Ünal"], text.file_slug, ["Molly_O_Neil", "A_B", "", "nal"]),
    "lower_slug": (["Molly O'Neil", " A & B ", None, "??"], text.lower_slug, ["molly_o_neil", "a_b", "player", "player"]),
    "hyphen_slug": (["Texas A&M", "St. John's (NY)", None, "--"], text.hyphen_slug, ["texas-a-and-m", "st-john-s-ny", "", ""]),
    "plain": (['="14-12"', "x", None, '="'], text.excel_unprotect, ["14-12", "x", "", '="']),
    "record": (["14-12", "a-b", None, '="14-12"'], text.excel_protect_record, ['="14-12"', "a-b", "", '="14-12"']),
    "dial": (["5551234567", None, " "], text.excel_protect_phone, ['="5551234567"', "", ""]),
}))

CLASSES = ["Freshman", "First-Year", "FY", "R-Fr.", "rfr", "So.", "", "5th Year", "Fifth-Year Senior", "Graduate Student", "Redshirt Junior", "R Jr", "R-So.", "nan", None, "Sixth", "R-Gr"]
YEARS = ["Fr", "Fr", "Fr", "R-Fr", "R-Fr", "So", "", "Fifth", "Sr", "Gr", "R-Jr", "R-Jr", "R-So", "", "", "Fifth", "Gr"]
add("class_ladder", literal_query("orders", "o_orderkey", {
    "class_year": (CLASSES, classify.class_year, YEARS),
    "compat": (CLASSES, lambda c: classify.class_year(c, True), ["So" if y == "R-So" else y for y in YEARS]),
    "again": (CLASSES, lambda c: classify.class_year(classify.class_year(c)), YEARS),
    "next_year": (CLASSES, classify.class_next, [classify.NEXT.get(y, "") for y in YEARS]),
    "leaves": (CLASSES, classify.graduating, [y in classify.GRADUATING for y in YEARS]),
    "looks_leaving": (["Sr.", "Grad Student", "Jr", None, "Gr-2", "GS"], classify.looks_graduating, [True, True, False, False, True, True]),
    "advanced": (["Fr", "So.", "Jr", "Sr", "R-Fr", "R-Sr", "RS Jr", "xyz", None, "junior"], classify.advance_class, ["So", "So.", "Sr", "Graduated", "R-So", "Graduated", "R-Sr", "xyz", "", "Sr"]),
}))

HEIGHTS = ["6-2", "6'2\"", "6’ 02", "6 - 02", "6 2", "6ft 2in", "6-2 1/2", "5-13", "3-11", "188cm", "", None]
add("height_parse", literal_query("orders", "o_orderkey", {
    "height": (HEIGHTS, classify.height, ["6-2", "6-2", "6-2", "6-2", "6-2", "6-2", "6-2", "", "", "", "", ""]),
    "inches": (["6-2", "6'2", "5-11", None, "x"], classify.height_inches, [74, None, 71, None, None]),
    "loose": (["6-2", "6’2", "6'2", "74", None], lambda c: classify.height_inches(c, True), [74, 74, 74, 74, None]),
    "shown": (["72.5", "74", "73.5", None], lambda c: classify.inches_height(c.try_cast("double")), ["6' 0\"", "6' 2\"", "6' 2\"", ""]),
}))

POSITIONS = ["S", "Setter/RS", "Opposite/Setter", "OH/S", "MB/S", "S/DS", "S/RS/DS", "L/DS", "Utility", "Pin Hitter", "MH", "RH", "Assistant Coach", "", None]
CODES = ["S", "RS,S", "RS,S", "OH,S", "MB,S", "DS,S", "DS,RS,S", "DS", "DS,OH", "OH", "MB", "RS", "", "", ""]
add("position_codes", literal_query("customer", "c_custkey", {
    "codes": (POSITIONS, lambda c: F.array_join(classify.position_codes(c), ","), CODES),
    "is_setter": (POSITIONS, lambda c: classify.position_flags(classify.position_codes(c))["is_setter"], [k in (0, 1, 2, 6) for k in range(15)]),
    "label": (POSITIONS, lambda c: classify.position_label(classify.position_codes(c), text.text(c)), ["Setter", "Pin", "Pin", "Pin", "MB/S", "Defender", "Pin", "Defender", "Pin", "Pin", "Middle", "Pin", "Assistant Coach", "", ""]),
    "keys": (["Setter / OPP", "L", "Beach", None, "MB-DS"], lambda c: F.array_join(classify.position_keys(c), ","), ["pin,s", "def", "beach", "", "def,mb"]),
}))

add("phone_email_valid", literal_query("supplier", "s_suppkey", {
    "phone": (["1 (555) 123-4567", "555.123.4567", "12345", None, "none"], text.phone, ["(555) 123-4567", "(555) 123-4567", "12345", "", ""]),
    "phone_ok": (["(555) 123-4567", "555-1234", "+1 555 123 4567 x12", None], validity.valid_phone, [True, False, True, False]),
    "email_ok": (["a.b@c.edu", "a@b", "x y@c.com", None, "q+1@d-e.co"], validity.valid_email, [True, False, False, False, True]),
    "height_ok": (["6-2", "6'2\"", "8-1", "6-123", None], validity.valid_height, [True, True, False, False, False]),
    "class_ok": (["Fr", "R-So", "Freshman", None], validity.valid_class, [True, True, False, False]),
    "bad_codes": (["S/OH", "S/XX", "L / Q", None], lambda c: F.array_join(validity.invalid_positions(c), ","), ["", "XX", "Q", ""]),
}))

add("text_ladders", literal_query("part", "p_partkey", {
    "politics": (["Very Liberal area", "liberal", "very conservative", "Conservative", "independent-ish", "unknown ", None], text.politics_label, ["Very liberal", "Liberal", "Very conservative", "Conservative", "Moderate / independent", "unknown", ""]),
    "title": (["Associate Head Coach", "assistant", "Head Coach", "Trainer", None], text.coach_title, ["Associate Head Coach", "Assistant Head Coach", "Head Coach", "Trainer", ""]),
    "filled": (["NULL", "", "x ", None, "PrivacySuppressed"], lambda c: text.first_filled(c, F.lit("other")), ["other", "other", "x", "other", "other"]),
    "city": (["Austin, TX", "Austin", None, " , "], lambda c: text.city_state(F.lit(None), F.lit(""), c)["city"], ["Austin", "Austin", None, None]),
    "state": (["Austin, TX", "Austin", None, "a,b,c"], lambda c: text.city_state(F.lit(None), F.lit(""), c)["state"], ["TX", None, None, "b,c"]),
    "asset": (["/public/logos/a.png", "assets/b.png", None, "c.png"], lambda c: text.asset_path(c, F.lit(None), F.lit("My School")), ["logos/a.png", "b.png", "logos/my_school.png", "c.png"]),
    "link": (["http://h/roster", "http://h/roster/2025", "http://h/t?year=2020&a=1", "http://h/t?a=1", None], lambda c: text.year_in_url(c, 2025), ["http://h/roster/2025", "http://h/roster/2025/", "http://h/t?year=2025&a=1", "http://h/t?a=1&year=2025", ""]),
    "shown": (["Setter", "OH"], lambda c: incoming.display_incoming(F.lit("Ann"), c, F.lit("So"), c == "OH"), ["Ann (Setter)", "Ann (So. OH - Transfer)"]),
    "aliases": (['["a","b"]', "not json", "", None], lambda c: F.array_join(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), ","), ["a,b", "", "", ""]),
}))

add("text_numbers", literal_query("part", "p_partkey", {
    "stat": (["12.0", "12.34", None, "n/a", "-3"], numbers.stat_text, ["12", "12.3", "", "n/a", "-3"]),
    "minutes": (["15–20 min", "15 minutes", "", "~1 hr 5 min (~60 mi)", None, "1,5"], numbers.minutes, [17.5, 15.0, 0.0, 65.0, 0.0, 1.5]),
    "minutes_compat": (["15-20 min", "~1 hr 5 min (~60 mi)", None], lambda c: numbers.minutes(c, True), [17.5, 1.0, 0.0]),
    "airports": (["ORD / MDW", "atl", None, "ab"], lambda c: F.array_join(numbers.airport_codes(c), ","), ["MDW,ORD", "ATL", "", ""]),
    "ordinal": (["third", "3rd", "3", "50", "x", None, "Fifteenth"], numbers.ordinal, [3, 3, 3, None, None, None, 15]),
    "start_year": (["enters her third season", "hired in 2019", "joined in 2030", "no match", None], lambda c: numbers.tenure(c, 2025)["start_year"], [2023, 2019, 2030, None, None]),
    "seasons": (["enters her third season", "hired in 2019", "joined in 2030", "is in his 6th year", None], lambda c: numbers.tenure(c, 2025)["seasons"], [3, 7, None, 6, None]),
    "latitude": (['<meta property="place:location:latitude" content="39.5">', "<p>", None], lambda c: numbers.meta_number(c, "place:location:latitude"), [39.5, None, None]),
    "dollars": (["earns $45,600 a year", "none", None], numbers.dollars, [45600, None, None]),
    "drive": (["0", "11", "55", "66", None], lambda c: numbers.drive_time(c.try_cast("double")), ["", "~12 min (~11 mi)", "~1 hr (~55 mi)", "~1 hr 12 min (~66 mi)", ""]),
    "grade": (["93", "92.9", "90", "87", "80", "70", "67", "60", "59.9", None], lambda c: numbers.grade(c.try_cast("double")), ["A", "A-", "A-", "B+", "B-", "C-", "D+", "D", "D-", None]),
    "grade_rank": (["A", "d-", " b ", "Z", None], numbers.grade_rank, [0, 10, 3, 5, 5]),
    "politics": (["-0.8", "-0.3", "0.29", "0.3", "0.8", None], lambda c: numbers.score_label(c.try_cast("double")), ["very conservative", "conservative", "moderate / independent", "liberal", "very liberal", None]),
    "weight": (["Gr", "Sr", "jr", "So", "Fr", "R-Jr", None], numbers.experience, [1.0, 0.9, 0.7, 0.5, 0.3, 0.5, 0.5]),
}))

LISTS = ["Molly Beatty (So. Setter - Transfer), Jane Roe (Fr. MB)", "Isabella Sohl (Setter)", None, "Ann Lo, , Bo Ray (DS/Jr)"]
PARSED = [["Molly Beatty|S|So|true", "Jane Roe|MB|Fr|false"], ["Isabella Sohl|S||false"], [], ["Ann Lo|OH||false", "Bo Ray|DS/L|Jr|false"]]


def incoming_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtlens.plans.binding import cycle

    df = read_table(spark, sf_dir, "customer", "c_custkey")
    rows = df.select("c_custkey", F.posexplode(incoming.parse_list(cycle("c_custkey", LISTS), "OH")).alias("pos", "x"))
    return rows.select("c_custkey", "pos", F.concat_ws("|", "x.name", "x.position", "x.class", F.col("x.is_transfer").cast("string")).alias("entry"))


QUERIES["incoming_list_parse"] = incoming_list_parse
ORACLE_SQL["incoming_list_parse"] = f"""
    with l as (select c_custkey, {cycle_sql('c_custkey', PARSED)} as x from customer)
    select c_custkey, cast(i - 1 as integer) as pos, x[i] as entry from l, range(1, 100) r(i) where i <= len(x)
"""


def safe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals on every other row, quantities as text on the rest."""
    from courtlens.plans.binding import cycle

    df = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    raw = F.when(F.col("l_orderkey") % 2 == 0, cycle("l_orderkey", NUMBERS)).otherwise(F.col("l_quantity").cast("string"))
    rows = df.select("l_orderkey", "l_linenumber", numbers.number(raw).alias("value"), numbers.whole_or_zero(raw).alias("whole"))
    return rows.groupBy("l_orderkey").agg(F.sum("value").alias("value"), F.sum("whole").alias("whole"), F.count("value").alias("n"))


NUMBERS = ["12.7", "1,234", "", "nan", "abc", "-3.9", None, "NULL", " 5 "]
VALUES, WHOLES = [12.7, 1234.0, None, None, None, -3.9, None, None, 5.0], [12, 0, 0, 0, 0, -3, 0, 0, 5]
QUERIES["safe_numeric"] = safe_numeric
ORACLE_SQL["safe_numeric"] = f"""
    with r as (select l_orderkey,
        case when l_orderkey % 2 = 0 then {cycle_sql('l_orderkey', VALUES)} else l_quantity end as v,
        case when l_orderkey % 2 = 0 then {cycle_sql('l_orderkey', WHOLES)} else trunc(l_quantity) end as w from lineitem)
    select l_orderkey, sum(v) as value, cast(sum(w) as bigint) as whole, count(v) as n from r group by l_orderkey
"""


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of whole texts in several languages."""
    df = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return df.select("doc_id", text.canonical_name(F.col("text")).alias("canonical"), text.alias_key(F.col("text"), {}).alias("key"), text.hyphen_slug(F.col("text")).alias("slug"))


QUERIES["canonical_name"] = canonical_documents
ORACLE_SQL["canonical_name"] = """
    with h as (select doc_id, lower(coalesce(text, '')) as s from documents)
    select doc_id,
        array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(s, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> ''))), ' ') as canonical,
        trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) as key,
        regexp_replace(regexp_replace(replace(s, '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug
    from h
"""


_BLANKS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name keys and slugs of whole texts of documents."""
    df = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return df.select(
        "doc_id", F.md5(text.clean("text")).alias("cleaned"), F.md5(text.school_key("text")).alias("school"), F.md5(text.scorecard_key("text")).alias("scorecard"),
        F.md5(F.array_join(text.wish_keys("text"), "|")).alias("wishes"), F.md5(text.file_slug("text")).alias("file"), F.md5(text.lower_slug("text")).alias("slug"),
        F.md5(text.politics_label("text")).alias("label"), text.coach_title(F.lower("text")).isin("Associate Head Coach", "Assistant Head Coach", "Head Coach").alias("titled"),
    )


QUERIES["document_keys"] = document_keys
_WITHOUT = "array_to_string(list_filter(string_split({0}, ' '), lambda w: w <> '' and w not in {1}), ' ')"
_LADDER = "contains(low, '{0}') then '{1}'"
ORACLE_SQL["document_keys"] = f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    k as (select *, lower(t) as low, trim(regexp_replace(t, '{_BLANKS}', ' ', 'g')) as cleaned,
        regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as file,
        trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) as w1, trim(regexp_replace(lower(regexp_replace(t, '\\(.*?\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) as w2 from d)
    select doc_id, md5(cleaned) as cleaned, md5({_WITHOUT.format("regexp_replace(low, '[^a-z0-9]+', ' ', 'g')", text.SCHOOL_STOP)}) as school,
        md5({_WITHOUT.format("regexp_replace(regexp_replace(regexp_replace(replace(low, '&', ' and '), '[,.-]', ' ', 'g'), '[’'']', '', 'g'), '" + _BLANKS + "', ' ', 'g')", text.SCORECARD_STOP)}) as scorecard,
        md5(case when w1 = w2 then w1 else w1 || '|' || w2 end) as wishes, md5(file) as file, md5(case when file = '' then 'player' else lower(file) end) as slug,
        md5(case when {_LADDER.format("very liberal", "Very liberal")} when {_LADDER.format("liberal", "Liberal")} when {_LADDER.format("very conservative", "Very conservative")} when {_LADDER.format("conservative", "Conservative")}
            when {_LADDER.format("moderate", "Moderate / independent")} when {_LADDER.format("independent", "Moderate / independent")} else trim(t) end) as label,
        contains(low, 'associate') or contains(low, 'assistant') or contains(low, 'head') as titled
    from k
"""


def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phone number in documents in its one form, and every amount of dollars and quantity, as numbers."""
    df = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    every = lambda p: F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(1)))
    dials = df.select("doc_id", every(PHONES).alias("pos", "raw")).select("doc_id", F.lit("phone").alias("kind"), "pos", text.phone("raw").alias("said"), F.lit(None).cast("double").alias("value"))
    sums = df.select("doc_id", every(AMOUNTS).alias("pos", "raw")).select("doc_id", F.lit("number").alias("kind"), "pos", F.col("raw").alias("said"), numbers.number(F.col("raw")).alias("value"))
    return dials.unionByName(sums)


PHONES, AMOUNTS = r"([+(]?[0-9][0-9() .\-]{8,}[0-9])", r"\b([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+)\b"
QUERIES["numbers_in_text"] = numbers_in_text
ORACLE_SQL["numbers_in_text"] = rf"""
    with p as (select doc_id, unnest(m) as raw, generate_subscripts(m, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '{PHONES}', 1) as m from documents)),
    q as (select *, regexp_replace(regexp_replace(raw, '\D', '', 'g'), '^1([0-9]{{10}})$', '\1') as n from p),
    a as (select doc_id, unnest(m) as raw, generate_subscripts(m, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '{AMOUNTS}', 1) as m from documents))
    select doc_id, 'phone' as kind, cast(pos as integer) as pos, case when length(n) = 10 then '(' || n[1:3] || ') ' || n[4:6] || '-' || n[7:10] else trim(raw) end as said, cast(null as double) as value from q
    union all select doc_id, 'number', cast(pos as integer), raw, cast(replace(raw, ',', '') as double) from a
"""


def classes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and position rules over whole texts of documents."""
    df = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return df.select(
        "doc_id", classify.class_year("text").alias("class"), classify.class_next("text").alias("next"), classify.graduating("text").alias("graduating"), classify.looks_graduating("text").alias("looks"),
        F.md5(F.array_join(classify.position_keys("text"), ",")).alias("position_keys"),
    )


QUERIES["classes_in_text"] = classes_in_text
_CLASS_CASES = " ".join(f"when regexp_matches(s, '{rule}') then '{code}'" for code, rule in classify.CLASS_STEPS)
_KEY_CASES = " ".join(f"when t in ({', '.join(map(sql_literal, words))}) then '{code}'" for code, words in classify.POSITION_KEYS.items())
_NEXT_CASES = " ".join(f"when '{a}' then '{b}'" for a, b in classify.NEXT.items())
ORACLE_SQL["classes_in_text"] = rf"""
    with d as (select doc_id, coalesce(text, '') as t, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'))), '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')) as s from documents),
    b as (select *, case {_CLASS_CASES} else '' end as base, regexp_matches(s, 'redshirt|^r[ -]') as red from d),
    c as (select *, case when s in {classify.FIRST_YEAR} then 'Fr' when s in {classify.REDSHIRT_FIRST_YEAR} then 'R-Fr' when red and base in ('Fr', 'So', 'Jr', 'Sr') then 'R-' || base else base end as class from b),
    k as (select doc_id, list_sort(list(distinct case {_KEY_CASES} else t end)) as keys from (select doc_id, unnest(list_filter(string_split(regexp_replace(lower(t), '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: x <> '')) as t from d) group by doc_id)
    select doc_id, class, case class {_NEXT_CASES} else '' end as next, class in {classify.GRADUATING} as graduating,
        regexp_matches(lower(trim(t)), '^gr|sr|senior|grad|gr\.|gr |gs') as looks, md5(coalesce(array_to_string(keys, ','), '')) as position_keys
    from c left join k using (doc_id)
"""


def heights_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of numbers with a dash between in documents, as a height, in inches, and as those are shown."""
    df = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    pairs = df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+ ?- ?[0-9]+)"), F.lit(1))).alias("pos", "raw"))
    high = classify.height("raw")
    return pairs.select("doc_id", "pos", "raw", high.alias("height"), classify.height_inches(high).alias("inches"), classify.inches_height(classify.height_inches(high)).alias("shown"))


QUERIES["heights_in_text"] = heights_in_text
ORACLE_SQL["heights_in_text"] = """
    with p as (select doc_id, unnest(m) as raw, generate_subscripts(m, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, '([0-9]+ ?- ?[0-9]+)', 1) as m from documents)),
    n as (select *, try_cast(regexp_extract(raw, '^([0-9]+)', 1) as integer) as f, try_cast(regexp_extract(raw, '([0-9]+)$', 1) as integer) as i from p),
    h as (select *, coalesce(f between 4 and 7 and i between 0 and 11, false) as fits from n)
    select doc_id, cast(pos as integer) as pos, raw, case when fits then f || '-' || i else '' end as height, case when fits then f * 12 + i end as inches,
        case when fits then f || chr(39) || ' ' || i || '"' else '' end as shown from h
"""


def season_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    year = dates.season_year(F.col("o_orderdate"))
    return df.select("o_orderkey", year.cast("int").alias("season"), dates.incoming_year(F.col("o_orderdate")).cast("int").alias("entering"), dates.season_label(year).alias("label"))


QUERIES["season_year"] = season_year
ORACLE_SQL["season_year"] = """
    with s as (select o_orderkey, cast(case when month(o_orderdate) >= 8 then year(o_orderdate) else year(o_orderdate) - 1 end as integer) as season from orders)
    select o_orderkey, season, season + 1 as entering, season || '-' || (season + 1) as label from s
"""


def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtlens.operators.columns import label_or, report_columns, show_height, show_number

    df = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    inches = F.when(k % 7 != 0, 60 + k % 20)
    rank = F.when(k % 5 != 0, (k % 350).cast("double"))
    stat = F.when(k % 11 != 0, (k % 1000) / F.lit(8.0))
    return df.select(
        "c_custkey", show_height(inches).alias("height_text"), show_number("HIT%", stat / 100).alias("hit_text"), show_number("K/S", stat).alias("rate_text"), show_number("K", stat).alias("count_text"),
        label_or(F.when(k % 3 == 0, F.col("c_mktsegment")), F.lit("Independent")).alias("label"),
        *[c.alias(n) for n, c in report_columns(rank, stat, stat, stat, stat).items()],
    )


def _fixed_sql(x: str, d: int) -> str:
    u = f"cast(round_even({x} * {10**d}.0, 0) as bigint)"
    if d == 0:
        return f"cast({u} as varchar)"
    return f"(cast({u} // {10**d} as varchar) || '.' || lpad(cast({u} % {10**d} as varchar), {d}, '0'))"


QUERIES["display_columns"] = display_columns
ORACLE_SQL["display_columns"] = f"""
    with s as (select *, case when c_custkey % 11 <> 0 then (c_custkey % 1000) / 8.0::double end as stat, 60 + c_custkey % 20 as inches from customer)
    select c_custkey,
        case when c_custkey % 7 <> 0 then cast(inches // 12 as varchar) || '''' || lpad(cast(inches % 12 as varchar), 2, '0') || '"' else '—' end as height_text,
        coalesce({_fixed_sql('((stat / 100) * 100)', 1)}, '—') as hit_text, coalesce({_fixed_sql('stat', 2)}, '—') as rate_text, coalesce({_fixed_sql('stat', 0)}, '—') as count_text,
        case when c_custkey % 3 = 0 then c_mktsegment else 'Independent' end as label,
        case when c_custkey % 5 <> 0 then cast(c_custkey % 350 as varchar) else 'N/A' end as rank_text,
        {_fixed_sql('stat', 0)} as drive_text, {_fixed_sql('stat', 1)} as drive_hr_text, {_fixed_sql('stat', 2)} as flight_hr_text, {_fixed_sql('stat', 2)} as fit_text
    from s
"""


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders a year as nested rows and as a map: those of one season, else of the first; and of a given year."""
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("season", "n"))).alias("stats")
    nested = o.groupBy("o_custkey").agg(rows, F.map_from_entries(F.collect_list(F.struct(F.col("season").cast("string"), "n"))).alias("years"))
    c = read_table(spark, sf_dir, "customer", "c_custkey").join(nested, F.col("c_custkey") == F.col("o_custkey"), "left")
    row = season_row(F.col("stats"), 1996)
    return c.select("c_custkey", row["season"].alias("season"), row["n"].alias("n"), by_year(F.col("years"), "1995").alias("of_1995"))


QUERIES["season_rows"] = season_rows
ORACLE_SQL["season_rows"] = """
    with o as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by 1, 2),
    p as (select *, row_number() over (partition by o_custkey order by y <> 1996, y) as k from o)
    select c_custkey, cast(p.y as integer) as season, p.n, q.n as of_1995 from customer left join p on p.o_custkey = c_custkey and k = 1 left join o q on q.o_custkey = c_custkey and q.y = 1995
"""


def side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side tables of suppliers (logo, airport, first alias), one after the other."""
    k = F.col("s_suppkey")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumn("key", k.cast("string"))
    path = F.when(k % 3 != 0, F.concat(F.lit("/a/b/"), "s_name", F.lit(".png"))).when(k % 2 == 0, " ")
    airport = F.struct(F.when(k % 4 == 0, F.lit("IND")).alias("code"), F.when(k % 5 == 0, F.lit("Far")).otherwise("").alias("name"))
    first = F.get(F.when(k % 2 == 0, F.array(F.lower("s_name"), F.lit("x"))), 0)
    made = side_tables(s, "key", {"logo": base_name(path), "airport": airport, "alias": first})
    text_of = {"logo": F.col("logo"), "airport": F.concat_ws("/", "airport.code", "airport.name"), "alias": F.col("alias")}
    parts = [df.select("key", F.lit(name).alias("field"), text_of[name].alias("value")) for name, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["side_rows"] = side_rows
ORACLE_SQL["side_rows"] = """
    with s as (select s_suppkey as k, cast(s_suppkey as varchar) as key, s_name from supplier)
    select key, 'logo' as field, s_name || '.png' as value from s where k % 3 <> 0
    union all select key, 'airport', case when k % 4 = 0 then 'IND/' else '' end || case when k % 5 = 0 then 'Far' else '' end from s where k % 4 = 0 or k % 5 = 0
    union all select key, 'alias', lower(s_name) from s where k % 2 = 0
"""


def map_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtlens.operators.columns import map_position

    df = read_table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    lat, lon = F.when(k % 4 != 3, 20.0 + k % 40), F.when(k % 4 != 3, -130.0 + k % 70)
    x, y = F.when(k % 5 == 0, k % 3 - 0.5), F.when(k % 5 == 0, k % 7 / 4.0)
    return df.select("s_suppkey", map_position(x, y, lat, lon).alias("m")).select("s_suppkey", "m.map_x", "m.map_y")


QUERIES["map_position"] = map_positions
ORACLE_SQL["map_position"] = """
    select s_suppkey,
        case when s_suppkey % 5 = 0 then greatest(0.0, least(1.0, cast(s_suppkey % 3 as double) - 0.5::double))
            when s_suppkey % 4 <> 3 then greatest(0.0, least(1.0, ((-130.0::double + s_suppkey % 70) - (-128.0::double)) / (-65.0::double - (-128.0::double)))) end::double as map_x,
        case when s_suppkey % 5 = 0 then greatest(0.0, least(1.0, (s_suppkey % 7) / 4.0::double))
            when s_suppkey % 4 <> 3 then greatest(0.0, least(1.0, ((20.0::double + s_suppkey % 40) - 24.0::double) / (50.0::double - 24.0::double))) end::double as map_y
    from supplier
"""


def diversity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtlens.operators.aggregates import diversity

    counts = read_table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return diversity(counts, "user_id", F.col("n"))


QUERIES["diversity_index"] = diversity_index
ORACLE_SQL["diversity_index"] = f"""
    with c as (select user_id, event_type, cast(count(*) as double) as n from events group by all),
    p as (select user_id, n / sum(n) over (partition by user_id) as p from c),
    d as (select user_id, {half_even_sql('1 - sum(p * p)', 3)} as diversity_index from p group by user_id)
    select *, case when diversity_index >= 0.8 then 'Very diverse' when diversity_index >= 0.7 then 'Diverse'
        when diversity_index >= 0.6 then 'Moderately diverse' else 'Less diverse' end as diversity_label from d
"""


def label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtlens.operators.aggregates import label_score as by_share
    from courtlens.plans.binding import cycle

    events = read_table(spark, sf_dir, "events", "event_id", "user_id")
    label = cycle("event_id", list(numbers.POLITICS_WEIGHTS))
    rows = events.select("user_id", classify.lookup({k: str(v) for k, v in numbers.POLITICS_WEIGHTS.items()}, label).cast("double").alias("w"), (F.col("event_id") % 7).cast("double").alias("share"))
    out = by_share(rows, "user_id", F.col("w"), F.col("share"))
    return out.select("user_id", numbers.round_even(F.col("score"), 3).alias("score")).withColumn("label", numbers.score_label(F.col("score")))


QUERIES["label_score"] = label_score
ORACLE_SQL["label_score"] = f"""
    with r as (select user_id, {cycle_sql('event_id', list(numbers.POLITICS_WEIGHTS.values()))}::double as w, cast(event_id % 7 as double) as share from events),
    s as (select user_id, {half_even_sql('sum(w * share) / nullif(sum(share), 0)', 3)} as score from r group by user_id)
    select *, case when score <= -0.8 then 'very conservative' when score <= -0.3 then 'conservative' when score < 0.3 then 'moderate / independent'
        when score < 0.8 then 'liberal' when score is not null then 'very liberal' end as label from s
"""
