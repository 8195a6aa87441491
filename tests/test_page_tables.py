"""Tables of pages and character references: what browsers and pandas read from them."""

import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from courtlens.functions.references import unescape
from courtlens.operators.page_tables import table_rows, tables


def grids(spark, *pages):
    got = {}
    rows = tables(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()
    for r in sorted(rows, key=lambda r: (r.page_id, r.table_no, r.row_no)):
        got.setdefault(r.page_id, {}).setdefault(r.table_no, []).append((r.head, r.cells))
    return [[[x for x in t] for _, t in sorted(got.get(k, {}).items())] for k in range(len(pages))]


def body(*rows):
    return [(False, list(r)) for r in rows]


def head(*rows):
    return [(True, list(r)) for r in rows]


def test_closing_tags_may_miss(spark):
    closed = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    open_ = "<TABLE border><tr><th>A<th>B<tr><td>1<td>2<tr><td>3<td>4"
    loose = "<table><th>A</th><th>B</th></tr><td>1</td><td>2</td></tr><tr></tr><tr><td>3<td>4</td></table></table><td>out"
    want = [head("AB") + body("12", "34")]
    assert grids(spark, closed, open_, loose) == [want] * 3


def test_nested_tables(spark):
    page = "x<table><tr><td>a<table><tr><th>in</th></tr><tr><td>1<table><tr><td>deep</table></td></tr></table>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table><table><tr><td>next</td></tr></table>"
    assert grids(spark, page) == [[body(["ain1deepb", "c"], "de"), head(["in"]) + body(["1deep"]), body(["deep"]), body(["next"])]]


def test_parts_come_in_order(spark):
    page = "<table><tfoot><tr><th>f<td>g</tfoot><thead><tr><td>h<td>i</thead><tbody><tr><td>1<td>2<tbody><tr><th>3<th>4</table>"
    assert grids(spark, page) == [[head("hi") + body("12", "34", "fg")]]
    first = "<table><tr><th>a<th>b<tr><th>c<th>d<tr><th>e<td>f<tr><th>g<th>h</table>"
    assert grids(spark, first) == [[head("ab", "cd") + body("ef", "gh")]]


@pytest.mark.parametrize("page,want", [
    ("<tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e", ["aab", "cde"]),
    ("<tr><td rowspan=2>a<td>b<tr><td>c", ["ab", "ac"]),
    ("<tr><td>a<td rowspan='2' colspan=\"2\">b<td>c<tr><td>d<td>e", ["abbc", "dbbe"]),
    ("<tr><td>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f<td>g", ["abc", "dc", "efcg"]),
    ("<tr><td rowspan=2>a<td rowspan=3>b<tr><td>c<tr><td>d", ["ab", "abc", "db"]),
    ("<tr><td>a<td rowspan=3>b", ["ab", "b", "b"]),
    ("<tr><td rowspan=0>a<td colspan=0>b<td colspan=x>c<tr><td>d", ["abc", "d"]),
    ("<tr><td rowspan=2>a<td>b<tr><td>c<tr><td rowspan=2>d<td>e<tr><td>f<tr><td>g", ["ab", "ac", "de", "df", "g"]),
])
def test_spans(spark, page, want):
    """A cell stands wherever it spans, as in pandas: rows that are shorter get what is above at their end."""
    assert grids(spark, f"<table>{page}</table>") == [[body(*want)]]


def test_long_table_with_spans(spark):
    rows = "".join(f"<tr><td rowspan=2>{k}<td>a<tr><td>b" for k in range(600))
    (got,) = grids(spark, f"<table>{rows}</table>")[0]
    assert len(got) == 1200 and got[-1] == (False, ["599", "b"]) and got[0] == (False, ["0", "a"])


def test_text_of_cells(spark):
    page = "<table><tr><td> A\n<b>b</b>c&nbsp;&amp;lt; <!-- <td>x --><td><script>'<td>'</script>y<style>td</style></table>"
    assert grids(spark, page, None, "", "<table></table>", "no <td>cell") == [[body(["A bc &lt;", "y"])], [], [], [], []]


def test_rows_by_header(spark):
    page = (
        "<table><tr><td>layout name position<tr><td><table><tr><th rowspan=2>Name<th colspan=2>Stats<th rowspan=2>Position<th>K<tr><th>K<th>A<th>K"
        "<tr><td><a href='/p/7/'>Jo</a><td>1<td>2<td>S<td>9<td>more<tr><td>Bo</table><tr><td>rest</table>"
    )
    df = spark.createDataFrame([(1, page), (1, page), (2, "<table><tr><td>Name<td>Position<tr><td>x<td>y</table>"), (3, "<table><tr><th>Q<tr><td>q</table>")], "page_id int, html string")
    got = sorted(((r.page_id, r.row_no, r.cells, r.link_id) for r in table_rows(df, ["NAME", "position"], "/p/([0-9]+)").collect()), key=lambda x: x[:2])
    first = {"Name": "Jo", "Stats K": "1", "Stats A": "2", "Position": "S", "K": "9"}
    assert got == [(1, 1, first, "7")] * 2 + [(1, 2, {"Name": "Bo"}, None)] * 2 + [(2, 1, {"Name": "x", "Position": "y"}, None), (3, 1, {"Q": "q"}, None)]
    twice = spark.createDataFrame([(1, "<table><tr><th>A<th>A<th><th>A<tr><td>1<td>2<td>3<td>4</table>")], "page_id int, html string")
    assert table_rows(twice, []).first().cells == {"A": "1", "A.1": "2", "": "3", "A.2": "4"}


def test_one_shuffle_of_pages(spark):
    plan = tables(spark.createDataFrame([(1, "x")], "page_id int, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Join" not in plan


def test_every_reference(spark):
    said = [f"&{k}" for k in html5] + [f"&{k}x" for k in html5 if not k.endswith(";")]
    said += [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**12]]
    said += ["a &amp;lt; & b &; &#; &#x; &#x41;&#X41z &#65x &#000065; &notit; &notin; &unknown; && &", "none", "", " &Eacute;cole &ecirc; &laquo;x&raquo;"]
    df = spark.createDataFrame([(x,) for x in said] + [(None,)], "s string")
    wrong = [(r.s, r.u) for r in df.select("s", unescape(F.col("s")).alias("u")).collect() if r.u != (None if r.s is None else html.unescape(r.s))]
    assert wrong == []
