"""Column rules, and extraction from pages and JSON that are made of the tables' own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.operators import columns, extract, filters
from courtlens.operators.lineage import spread
from courtlens.operators.page_tables import table_rows
from courtlens.plans.binding import Query
from courtlens.sources.files import read_table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def column_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by name and by header words, renamed, given defaults, put in order; summary rows go."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    who = F.when(F.col("c_custkey") % 10 == 0, "TEAM").when(F.col("c_custkey") % 10 == 1, "Totals").when(F.col("c_custkey") % 10 == 2, "Opponent Totals").otherwise(F.col("c_name"))
    df = filters.drop_summary(columns.rename(c.withColumn("c_name", who), {"c_name": "Player", "not there": "x"}), "Player")
    roles = columns.detect_columns(df, {"amount": ["acct", "money"], "kind": ["segment"], "none": ["zzz"]})
    stats = columns.stat_columns(df, df.select("c_custkey", "Player"), drop=("c_mktsegment",))
    df = columns.ensure_columns(df, {"Season": 2025, "Player": "unused"}).withColumn("found", F.lit(f"{columns.resolve_column(df, ['name', 'PLAYER'])} {roles['amount']} {roles['kind']} {roles['none']} {','.join(stats)}"))
    return columns.keep_existing(df, ["found", "Season", "nowhere", "Player", "c_custkey"])


QUERIES["column_rules"] = column_rules
ORACLE_SQL["column_rules"] = """
    select 'Player c_acctbal c_mktsegment None c_acctbal' as found, 2025 as "Season", c_name as "Player", c_custkey from customer where c_custkey % 10 > 2
"""


def _roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every twenty customers, laid out by a table that holds a table of news and one of names, segments and
    numbers, whose rows take turns: open cells, a table inside a cell, a cell over two columns and one over two rows, and
    the row under that. The layout's tags are never closed."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    link = say('<a href="/roster/p', k, '">', F.col("c_name"), "</a>")
    row = (
        F.when(kind == 0, say("<tr class='x'><td>", link, "<td>", F.col("c_mktsegment"), " &amp; c&ocirc<td> ", k))
        .when(kind == 1, say("<tr><td>", link, "</td><td>", F.col("c_mktsegment"), "<table><tr><td>in<td>", k, "</table></td><!-- <td>no</td> --><td>", k, "</td></tr>"))
        .when(kind == 2, say("<TR><TD colspan='2'>", link, "</TD><TD rowspan=2>", k, "</TD></TR>")).otherwise(say("<tr><td>", link, "</td><td>", F.col("c_mktsegment"), "</td></tr>"))
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "\n")
    pages = c.groupBy(F.floor(F.col("c_custkey") / 20).alias("page_id")).agg(rows.alias("rows"))
    head = "<table><tr><td><table><tr><th>Date</th><th>News</th></tr><tr><td>1</td><td>old</td></tr></table><td><TABLE id='r'><thead><tr><th>Name</th><th>Position</th><th>No.</th></tr></thead><tbody>"
    return pages.select("page_id", F.lit("http://x.edu/").alias("url"), F.concat(F.lit(head), "rows", F.lit("</tbody></TABLE>")).alias("html"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each page's first table with the right headers, and the id in their links."""
    found = table_rows(_roster_pages(spark, sf_dir), ["name", "position"], r"/roster/p([0-9]+)")
    return found.select("page_id", "row_no", F.col("cells")["Name"].alias("name"), F.col("cells")["Position"].alias("position"), F.col("cells")["No."].alias("number"), "link_id")


QUERIES["page_tables"] = page_tables
ORACLE_SQL["page_tables"] = """
    with c as (select *, cast(c_custkey as varchar) as k, c_custkey // 20 as page_id, cast(row_number() over (partition by c_custkey // 20 order by c_custkey) as integer) as row_no from customer)
    select page_id, row_no, c_name as name, case c_custkey % 4 when 0 then c_mktsegment || ' & cô' when 1 then c_mktsegment || 'in' || k when 2 then c_name else c_mktsegment end as position,
        case when c_custkey % 4 = 3 then cast(c_custkey - 1 as varchar) else k end as number, k as link_id from c
    union all -- what still spans behind the last row is a row of its own
    select page_id, row_no + 1, k, null, null, null from c where c_custkey = (select max(c_custkey) from customer) and c_custkey % 4 = 2
"""


def page_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a supplier: marked blocks that nest, a table, or links next to a title; and the photo that fits the name."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    k, name = F.col("s_suppkey").cast("string"), F.regexp_replace("s_name", "[^A-Za-z]", "")
    mail, dial = F.concat(F.lit("c"), k, F.lit("@u.edu")), F.concat(F.lit("(317) 555-"), F.lpad((F.col("s_suppkey") % 10_000).cast("string"), 4, "0"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    card = say("<div class='staff-list'><div class='staff-card'><div><img src='/", k, ".jpg' alt='", name, "'></div><h3>", name, " O&#39;", F.translate(k, "0123456789", "abcdefghij"), "</h3><div class='coach-title'>Head Coach</div><p>", mail, " ", dial, "</p></div></div>")
    table = say("<table><tr><th>Name</th><th>Title</th></tr><tr><td>", name, " T</td><td>Associate Head Coach, ", mail, "</td></tr></table>")
    link = say("<p><a href='/c'>", name, " L</a> - <b>assistant coach</b></p>")
    html = F.when(F.col("s_suppkey") % 3 == 0, card).when(F.col("s_suppkey") % 3 == 1, table).otherwise(link)
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.lit("http://u.edu/").alias("url"), html.alias("html"))
    staff = extract.staff_contacts(pages).select("page_id", "strategy", "name", "title", "email", "phone", "photo")
    best = extract.best_image(staff.where("photo is not null").select("page_id", "name"), "page_id", "name", extract.images(pages)).select("page_id", F.col("src").alias("best"))
    return staff.join(best, "page_id", "left")


QUERIES["page_staff"] = page_staff
ORACLE_SQL["page_staff"] = r"""
    with s as (select s_suppkey as k, regexp_replace(s_name, '[^A-Za-z]', '', 'g') as n, '(317) 555-' || lpad(cast(s_suppkey % 10000 as varchar), 4, '0') as dial from supplier)
    select k as page_id, 1 as strategy, n || ' O''' || translate(cast(k as varchar), '0123456789', 'abcdefghij') as name, 'Head Coach' as title, 'c' || k || '@u.edu' as email, dial as phone, '/' || k || '.jpg' as photo, '/' || k || '.jpg' as best from s where k % 3 = 0
    union all select k, 2, n || ' T', 'Associate Head Coach', 'c' || k || '@u.edu', '', null, null from s where k % 3 = 1
    union all select k, 3, n || ' L', 'assistant coach', '', '', null, null from s where k % 3 = 2
"""


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed objects, questions, reviews, grades and shares of pages made of customers."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    place = F.struct(F.col("c_name").alias("streetAddress"), F.col("c_mktsegment").alias("addressLocality"))
    school = F.to_json(F.struct(F.lit("CollegeOrUniversity").alias("@type"), F.concat(F.lit("t"), k.cast("string")).alias("telephone"), place.alias("address"), F.struct((k / 4).alias("ratingValue"), (k % 50).alias("reviewCount")).alias("aggregateRating")))
    ask = lambda q, a: F.struct(q.alias("name"), F.struct(a.alias("text")).alias("acceptedAnswer"))
    faq = F.to_json(F.struct(F.lit("FAQPage").alias("@type"), F.array(ask(F.col("c_name"), F.concat(F.lit("<b>"), "c_mktsegment", F.lit("</b>"))), ask(F.lit(" "), F.lit("none")), ask(F.lit("Where?"), k.cast("string"))).alias("mainEntity")))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    grade = F.element_at(F.array(*map(F.lit, ("A+", "B", "C-"))), (k % 3 + 1).cast("int"))
    review = F.when(k % 2 == 0, F.concat(F.lit("<div itemprop='reviewBody'>"), "c_name", F.lit("</div><div itemprop='reviewBody'> second </div><div itemprop='reviewBody'>third</div>"))).otherwise(F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")))
    shares = F.concat(F.lit("White "), (k % 60).cast("string"), F.lit("% Asian "), (k % 30).cast("string"), F.lit("%"))
    html = F.concat(script(F.lit('{"@type":"Thing"}')), script(F.concat(F.lit("["), school, F.lit("]"))), script(faq), review, F.lit("<span>"), grade, F.lit("</span> Overall Grade "), shares)
    df = spread(c).select("c_custkey", html.alias("html"), F.struct(F.when(k % 5 == 0, F.col("c_name")).alias("city"), F.lit("x").alias("other")).alias("block"))
    # each made once, as columns: several fields are taken from them
    df = df.select("*", extract.organization("html").alias("school"), extract.faqs("html").alias("asks"), extract.reviews("html", 2).alias("reviewed"), extract.label_shares(extract.page_text("html"), ["white", "asian"]).alias("share"))
    school_of, asked, said, share = (F.col(x) for x in ("school", "asks", "reviewed", "share"))
    return df.select(
        "c_custkey", school_of["phone"].alias("phone"), school_of["street"].alias("street"), school_of["city"].alias("city"), school_of["rating_value"].alias("rating"), school_of["rating_count"].alias("reviews"),
        F.array_join(F.transform(asked, lambda x: F.concat(x["question"], F.lit("="), x["answer"])), "|").alias("asked"), F.array_join(said, "|").alias("said"), extract.overall_grade("html").alias("grade"),
        F.array_join(F.transform(share, lambda x: F.concat(x["label"], F.lit("="), x["share"].cast("int").cast("string"))), "|").alias("shares"), extract.fill_nested("block", "city", F.lit("filled"))["city"].alias("filled"),
    )


QUERIES["page_objects"] = page_objects
ORACLE_SQL["page_objects"] = """
    select c_custkey, 't' || c_custkey as phone, c_name as street, c_mktsegment as city, c_custkey / 4.0::double as rating, cast(c_custkey % 50 as integer) as reviews,
        c_name || '=' || c_mktsegment || '|Where?=' || c_custkey as asked, case when c_custkey % 2 = 0 then c_name || '|second' else c_mktsegment end as said,
        case c_custkey % 3 when 0 then 'A+' when 1 then 'B' else 'C-' end as grade, 'white=' || (c_custkey % 60) || '|asian=' || (c_custkey % 30) as shares,
        case when c_custkey % 5 = 0 then c_name else 'filled' end as filled
    from customer
"""


def nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON of several depths: the object with the wanted keys, and what it changes in the dimension."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    inner = F.concat(F.lit('{"Order-Status":"'), "o_orderstatus", F.lit('","PRIORITY":"'), "o_orderpriority", F.lit('"}'))
    depth = (F.col("o_orderkey") % 9).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":[1,'), depth), inner, F.repeat(F.lit("]}"), depth))
    found = extract.find_object(o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 3, text).otherwise(F.lit("[] no json")).alias("j")), "o_orderkey", "j", ["orderstatus", "priority"])
    new = found.select("o_orderkey", F.get_json_object(F.concat(F.lit("["), F.col("found")["PRIORITY"], F.lit("]")), "$[0]").alias("o_orderpriority"), F.lit("").alias("o_orderstatus"))
    dim = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return extract.merge_fields(dim, "o_orderkey", new, ["o_orderpriority", "o_orderstatus"])


QUERIES["nested_objects"] = nested_objects
ORACLE_SQL["nested_objects"] = """
    select o_orderkey, o_orderstatus, case when o_orderkey % 4 <> 3 or o_orderkey % 2 = 0 then o_orderpriority end as o_orderpriority, o_orderkey % 4 = 1 as changed from orders
"""
