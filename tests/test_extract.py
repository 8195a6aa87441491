"""Jobs over page fragments."""

import duckdb
from pyspark.sql import functions as F

from courtlens.operators import extract, incoming, quality
from courtlens.operators.page_tables import table_rows
from courtlens.plans import ORACLE_SQL, QUERIES

PAGE = """<html><head><title>T</title><meta content="About us" name="description"></head><body>
<table><tr><th>X</th></tr><tr><td>1</td></tr></table>
<table><tr><th>No</th><th>Name</th></tr><tr><td>5</td><td><a href="/p/77">Ann &nbsp; Lo</a></td></tr><tr><td>6</td><td>Bo</td></tr></table>
<div class="staff-card"><h3>Jo Day</h3><span>Head Coach</span> jo@u.edu (555) 123-4567 <img src="jo.png" alt="Jo Day"></div>
<p itemprop="reviewBody">Good</p><p>Plain 1</p><a href="coaches">Our Coaches</a><a href="//x.org/y">y</a>
<b>A-</b> <p>B+ Overall Grade</p> liberal 30% very liberal 20%
<script type="application/ld+json">[{"@type":"FAQPage","mainEntity":[{"name":"Q","acceptedAnswer":{"text":"<b>A</b>"}}]},{"@type":"CollegeOrUniversity","telephone":"1","address":{"addressLocality":"C"}}]</script>
</body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "http://h/a/b.html", PAGE), (2, "http://h", None)], "page_id int, url string, html string")


def test_fields(spark):
    one = pages(spark).where("page_id = 1").select(
        extract.summary("html").alias("summary"), extract.reviews("html").alias("reviews"), extract.overall_grade("html").alias("grade"), extract.organization("html").alias("org"),
        extract.faqs("html").alias("faqs"), extract.label_shares(extract.page_text("html"), ["liberal", "very liberal"]).alias("shares"), extract.label_grade(F.lit("Academics b+"), "Academics").alias("own"),
    ).first()
    assert (one.summary, one.reviews, one.grade, one.org.phone, one.org.city, one.own) == ("About us", ["Good"], "B+", "1", "C", "B+")
    assert [(x.question, x.answer) for x in one.faqs] == [("Q", "A")]
    assert [(x.label, x.share) for x in one.shares] == [("liberal", 30.0), ("very liberal", 20.0)]


def test_tables_links_and_people(spark):
    p = pages(spark)
    rows = table_rows(p, ["no", "name"], r"/p/([0-9]+)").orderBy("row_no").collect()
    assert [(r.cells["No"], r.link_id) for r in rows] == [("5", "77"), ("6", None)]
    assert table_rows(p, ["zzz"]).first().cells == {"X": "1"}
    assert extract.find_link(p, ["coaches"], []).first().target == "http://h/a/coaches"
    assert {r.target for r in extract.links(p).collect()} == {"/p/77" and "http://h/p/77", "http://h/a/coaches", "http://x.org/y"}
    who = extract.staff_contacts(p).collect()
    assert [(r.strategy, r.name, r.title, r.email, r.phone, r.photo) for r in who] == [(1, "Jo Day", "Head Coach", "jo@u.edu", "(555) 123-4567", "jo.png")]
    img = extract.images(p)
    people = spark.createDataFrame([(1, "Jo Day"), (1, "Bo Day"), (2, "No")], "page_id int, name string")
    assert {r.name: r.src for r in extract.best_image(people, "page_id", "name", img).collect()} == {"Jo Day": "jo.png", "Bo Day": "jo.png", "No": None}


def test_nested(spark):
    df = spark.createDataFrame([(1, '{"a":[{"x":1},{"Very_Liberal":"3","liberal":2,"z":{"liberal":9,"veryliberal":9}}]}'), (2, "no json"), (3, None)], "k int, j string")
    found = extract.find_object(df, "k", "j", ["liberal", "veryliberal"]).collect()
    assert [(r.k, r.found["liberal"]) for r in found] == [(1, "2")]
    dim = spark.createDataFrame([(1, "old", None), (2, "old", "x")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "", "y"), (2, "new", "x")], "k int, a string, b string")
    assert {(r.k, r.a, r.b, r.changed) for r in extract.merge_fields(dim, "k", new, ["a", "b"]).collect()} == {(1, "old", "y", True), (2, "new", "x", True)}
    block = spark.createDataFrame([(1, ("", "b"))], "k int, s struct<a:string,b:string>")
    assert tuple(block.select(extract.fill_nested("s", "a", F.lit("v")).alias("s")).first().s) == ("v", "b")
    assert spark.range(1).select(extract.by_year(F.create_map(F.lit("2025"), F.lit("t")), "2024").alias("x")).first().x is None


def test_nested_to_any_depth(spark):
    """A text two thousand levels deep among shallow ones; the first object in pre-order counts, with its own keys only."""
    want = '{"A":{"b":1},"B\\u0062":"x\\"}{","c":[{"a":0,"bb":0}]}'
    rows = [
        (1, '{"a":[1,' * 2000 + want + "]}" * 2000), (2, want), (3, '[{"a":1},{"bb":{"a":2}},{"bb":5,"z":[],"a":null}]'), (4, '{"a":1,"x":"\\"bb\\":2"}'), (5, '{"a":1,"bb":2'),
        (6, '[{"a":{"a":1,"bb":1},"bb":2}]'), (7, None), (8, ""), (9, '{"a":1,"bb":2} x'), (13, '{"a":1},{"a":1,"bb":2}'), (10, '"a" : "bb"'), (2, want), (11, '{"' + "y" * 40_000 + '":"' + "z" * 200_000 + '", "a" : 1 ,\n"bb"\t: 2}'), (12, "[" * 9000 + want + "]" * 9000), (14, '{"a":1,"bb":' + "[" * 3000 + "]" * 3000 + "}"), (15, '{"a":1,"bb":2}]'),
    ]
    df = spark.createDataFrame(rows, "k int, j string").repartition(3)
    got = {}
    for r in extract.find_object(df, "k", "j", ["bb", "a"]).collect():
        got.setdefault(r.k, []).append(r.found)
    assert set(got) == {1, 2, 3, 6, 11, 12, 14} and len(got[2]) == 2 and got[14] == [None]
    assert got[1] == got[12] == got[2][:1] == [{"A": '{"b":1}', "Bb": '"x\\"}{"', "c": '[{"a":0,"bb":0}]'}]
    assert got[3] == [{"bb": "5", "z": "[]", "a": "null"}] and got[6][0]["bb"] == "2" and got[11][0]["bb"] == "2"
    plan = extract.find_object(df, "k", "j", ["bb", "a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_incoming_lines(spark):
    lines = ["x - y", "East:", "", "Ann - Rice - S (Club (1))", "bad", "Bo - Duke"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(lines)], "f int, pos int, line string")
    got = [(r.conference, r.name, r.school, r.position, r.club) for r in incoming.parse_lines(df, ["f"], "pos", "line").orderBy("pos").collect()]
    assert got == [("East", "Ann", "Rice", "S", "Club (1)"), ("East", "Bo", "Duke", "", "")]
    assert incoming.parse_lines(df, ["f"], "pos", "line", need_header=False).count() == 3


def test_log(spark):
    lines = ["Analyzing team: A", "ERROR 1", "Analyzing team: B", "WARNING", "Could not x"]
    df = spark.createDataFrame([("f", k, s) for k, s in enumerate(lines)], "source string, pos int, line string")
    assert tuple(quality.log_scan(df).first()) == (2, 1, 2, 2)


def test_references_that_were_cut_off_stay_in_fields(spark, tmp_path):
    """As the SQL of the page queries has it; the operators themselves read them as browsers do."""
    cut = "<title>A &amp; b&amp</title><h1>c &am</h1><p>&copy 1 &#38 &lt;i&gt; &amp;lt; &amp;&amp</p><a href='/x'>q &amp</a>"
    spark.createDataFrame([(1, "http://h/", cut)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_fields", "page_paragraphs", "page_links"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
        assert [tuple(r) for r in got.select(*want.columns).collect()] == want.fetchall()
    assert spark.range(1).select(extract.inner(F.lit(cut), "title").alias("t")).first().t == "A & b&"
