"""Tables of web pages: nested, with open cells and rows, and with cells that span rows and columns.

A page is cut in front of its table tags. The tags, a row each, are put in order by windows over a page: how many tables
are open tells whose tag it is, the tag before tells whether it has to open a row, and the next tag of the same table
ends a cell, whether or not the cell's own closing tag is there. Only tags and numbers of pieces go through the windows;
the text of a page travels once, and its cells are cut out of it at the end. A page is handled in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.functions.text import clean, text
from courtlens.functions.references import unescape

_TAGS = "table|caption|thead|tbody|tfoot|tr|td|th"
#: The most columns and rows that a cell can span, by the HTML standard.
COLUMNS, ROWS = 1000, 65534
_CELL = "struct<i:int,j:int>"
_LEFT = f"array<struct<at:int,c:{_CELL},left:int>>"


def _span(tag: Column, name: str, most: int) -> Column:
    """The number of rows or columns that a tag's attribute names, quoted or not; 1 if it names none."""
    said = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']?\s*([0-9]{{1,9}})", 1)
    given = F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(said.try_cast("int"), F.lit(1))))
    return F.when(F.lower(tag).contains(name), given).otherwise(F.lit(1))


def _tags(pages: DataFrame) -> DataFrame:
    """(uid, i, page, name, closing, columns, rows): the table tags in order; the first row of a page carries its pieces."""
    bare = F.regexp_replace(text("html"), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    pages = pages.where(F.lower("html").contains("<table")).select("page_id", F.split(bare, rf"(?i)(?=</?(?:{_TAGS})[\s/>])").alias("pieces"), F.monotonically_increasing_id().alias("uid"))
    tags = F.transform("pieces", lambda p: F.regexp_extract(p, rf"(?is)^</?(?:{_TAGS})[\s/>][^>]*>?|^</?(?:{_TAGS})>", 0))
    # the piece before the first tag has none, unless the page begins with one
    rows = pages.select("uid", F.struct("page_id", "pieces").alias("page"), F.posexplode(F.concat(F.array(F.lit("")), tags)).alias("k", "tag"))
    name = F.lower(F.regexp_extract("tag", rf"(?i)^</?({_TAGS})", 1))
    return rows.select(
        "uid", (F.col("k") - 1).alias("i"), F.when(F.col("k") == 0, F.col("page")).alias("page"), name.alias("name"), F.startswith("tag", F.lit("</")).alias("closing"),
        _span(F.col("tag"), "colspan", COLUMNS).alias("columns"), _span(F.col("tag"), "rowspan", ROWS).alias("rows"),
    ).where((F.col("i") < 0) | (F.col("name") != ""))


def _cells(pages: DataFrame) -> DataFrame:
    """(uid, page, table_no, part, row_no, i, j, head, columns, rows): the cells of all tables, each from piece i up to j."""
    name, opens = F.col("name"), ~F.col("closing")
    is_table = name == "table"
    page = Window.partitionBy("uid").orderBy("i")
    tags = _tags(pages).withColumn("_sum", F.sum(F.when(is_table & opens, 1).when(is_table, -1).otherwise(0)).over(page))
    # a closing tag without a table closes nothing
    tags = tags.withColumn("_open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(page)))
    tags = tags.withColumn("_level", F.when(is_table & ~opens, F.lag("_open", 1, 0).over(page)).otherwise(F.col("_open")))
    tags = tags.withColumn("_number", F.sum((is_table & opens).cast("int")).over(page) - 1)
    level = Window.partitionBy("uid", "_level").orderBy("i")
    tags = tags.withColumn("table_no", F.when(F.col("_level") > 0, F.last(F.when(is_table & opens, F.col("_number")), ignorenulls=True).over(level)).otherwise(-1))
    own = Window.partitionBy("uid", "table_no").orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    is_cell, is_part = name.isin("td", "th") & opens, name.isin("thead", "tbody", "tfoot")
    # a row is open after its tag and after a cell; a cell elsewhere opens one
    within = F.last(F.when(is_cell | ((name == "tr") & opens), True).when((name == "tr") | is_part | is_table, False), ignorenulls=True).over(before)
    starts = ((name == "tr") & opens) | (is_cell & ~F.coalesce(within, F.lit(False)))
    part = F.when(is_part & opens, F.when(name == "thead", 0).when(name == "tbody", 1).otherwise(3)).when(is_part | is_table, 2)
    tags = tags.withColumns({"row_no": F.sum(starts.cast("int")).over(own), "part": F.last(part, ignorenulls=True).over(own), "j": F.lead("i").over(own)})
    kept = tags.where((is_cell & (F.col("_level") > 0)) | F.col("page").isNotNull())
    return kept.select("uid", "page", F.when(F.col("page").isNull(), F.col("table_no")).otherwise(-1).alias("table_no"), F.coalesce("part", F.lit(2)).alias("part"), "row_no", "i", "j", (name == "th").alias("head"), "columns", "rows")


def _spread(rows: Column) -> Column:
    """Rows of cells as rows of a grid: a cell stands in each column and row that it spans; cells that came from rows
    above take their columns, and what still spans at the end makes rows of its own."""

    def cell(s: Column, x: Column) -> Column:
        at = F.size(s["line"])
        due = F.filter(s["rest"], lambda y, k: y["at"] <= at + k)
        begin = at + F.size(due)
        again = F.transform(F.filter(due, lambda y: y["left"] > 1), lambda y: F.struct(y["at"], y["c"], (y["left"] - 1).alias("left")))
        own = F.transform(F.sequence(F.lit(0), x["columns"] - 1), lambda k: F.struct((begin + k).alias("at"), x["c"].alias("c"), (x["rows"] - 1).alias("left")))
        return F.struct(
            F.concat(s["line"], F.transform(due, lambda y: y["c"]), F.array_repeat(x["c"], x["columns"])).alias("line"),
            F.slice(s["rest"], F.size(due) + 1, F.size(s["rest"])).alias("rest"),
            F.concat(s["next"], again.cast(_LEFT), F.filter(own, lambda y: y["left"] > 0).cast(_LEFT)).alias("next"),
        )

    none, state = F.array().cast(_LEFT), f"struct<rest:{_LEFT},lines:array<array<{_CELL}>>>"

    def row(s: Column, x: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{_CELL}>").alias("line"), s["rest"].alias("rest"), none.alias("next"))
        last = lambda r: F.concat(r["next"], F.transform(F.filter(r["rest"], lambda y: y["left"] > 1), lambda y: F.struct(y["at"], y["c"], (y["left"] - 1).alias("left"))).cast(_LEFT))
        whole = lambda r: F.struct(last(r).alias("rest"), F.concat(r["line"], F.transform(r["rest"], lambda y: y["c"])).alias("line"))
        done = F.aggregate(x, start.cast(f"struct<line:array<{_CELL}>,rest:{_LEFT},next:{_LEFT}>"), lambda a, b: cell(a, b).cast(f"struct<line:array<{_CELL}>,rest:{_LEFT},next:{_LEFT}>"), whole)
        return F.transform(F.array(done), lambda d: F.struct(d["rest"], F.concat(s["lines"], F.array(d["line"])).alias("lines")).cast(state))[0]

    def ended(s: Column) -> Column:
        more = F.coalesce(F.array_max(F.transform(s["rest"], lambda y: y["left"])), F.lit(0))
        below = F.transform(F.filter(F.sequence(F.lit(0), more), lambda k: k > 0), lambda k: F.transform(F.filter(s["rest"], lambda y: y["left"] >= k), lambda y: y["c"]))
        return F.concat(s["lines"], below)

    spans = F.exists(rows, lambda x: F.exists(x, lambda c: c["rows"] > 1))
    alone = F.transform(rows, lambda x: F.flatten(F.transform(x, lambda c: F.array_repeat(c["c"], c["columns"]))))
    return F.when(~spans, alone).otherwise(F.aggregate(rows, F.struct(none.alias("rest"), F.array().cast(f"array<array<{_CELL}>>").alias("lines")).cast(state), row, ended))


def cell_text(html: Column, glue: str = "") -> Column:
    """The text of a cell: tags give way to ``glue``, references are resolved, white space collapses."""
    return clean(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", glue)))


def page_grids(pages: DataFrame, glue: str = "") -> DataFrame:
    """(page_id, tables) of each page that has tables: array of tables in the order they open, each an array of rows
    struct<head, cells, raw>, as ``tables`` describes them."""
    rows = _cells(pages).groupBy("uid", "table_no", "part", "row_no").agg(
        F.first("page", ignorenulls=True).alias("page"), F.min("head").alias("all_th"), F.max("rows").alias("_most"),
        F.array_sort(F.collect_list(F.struct("i", "j", "columns", "rows"))).alias("own"),
    )
    table = Window.partitionBy("uid", "table_no")
    part = Window.partitionBy("uid", "table_no", "part").orderBy("row_no")
    top = F.min("all_th").over(table.orderBy("part", "row_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", F.when(F.min("part").over(table) == 0, F.col("part") == 0).otherwise(top)).withColumn("_n", F.row_number().over(part))
    # a block of rows ends where no cell spans on
    reach = F.max(F.col("_n") + F.col("_most") - 1).over(part.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.col("_n") > F.coalesce(reach, F.lit(0))).cast("int")).withColumn("_block", F.sum("_new").over(part))
    blocks = rows.groupBy("uid", "table_no", "part", "_block").agg(F.first("page", ignorenulls=True).alias("page"), F.array_sort(F.collect_list(F.struct("_n", "head", "own"))).alias("_rows"))
    lines = F.transform("_rows", lambda r: F.transform(r["own"], lambda c: F.struct(F.struct(c["i"], c["j"]).cast(_CELL).alias("c"), c["columns"], c["rows"])))
    # rows that only spanning cells make follow the last one of the block, and are what that is
    last = F.element_at("_rows", -1)
    told = F.transform(_spread(lines), lambda line, k: F.struct(
        F.col("table_no"), F.col("part"), F.coalesce(F.get("_rows", k)["_n"], last["_n"]).alias("n"), k.alias("k"),
        F.coalesce(F.get("_rows", k)["head"], last["head"]).alias("head"), line.alias("line"), F.get("_rows", k)["own"].alias("own"),
    ))
    whole = blocks.withColumn("found", F.when(F.col("table_no") >= 0, told)).groupBy("uid").agg(F.first("page", ignorenulls=True).alias("page"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    # piece by piece, as a slice would copy the whole page for each cell
    html = lambda c: F.array_join(F.transform(F.sequence(c["i"], F.coalesce(c["j"], F.size("page.pieces")) - 1), lambda k: F.get("page.pieces", k)), "")
    inner = lambda x: F.transform(F.coalesce(x["own"], F.array().cast("array<struct<i:int,j:int,columns:int,rows:int>>")), lambda c: F.regexp_replace(html(c), r"(?s)^<[^>]*>", ""))
    cut = F.transform("found", lambda x: F.struct(x["table_no"].alias("t"), x["head"].alias("head"), F.transform(x["line"], lambda c: cell_text(html(c), glue)).alias("cells"), inner(x).alias("raw")))
    numbers = F.array_distinct(F.transform("cut", lambda x: x["t"]))
    grids = F.transform(numbers, lambda t: F.transform(F.filter("cut", lambda x: x["t"] == t), lambda x: F.struct(x["head"].alias("head"), x["cells"].alias("cells"), x["raw"].alias("raw"))))
    return whole.select(F.col("page.page_id").alias("page_id"), cut.alias("cut")).select("page_id", grids.alias("tables"))


def tables(pages: DataFrame, glue: str = "") -> DataFrame:
    """(page_id, table_no, row_no, head, cells, raw): the rows of all tables of ``pages`` (page_id, html).

    Tables are numbered from 0 as they open, so a nested one follows the one it stands in; the text of a cell has that of
    the tables inside, whose rows are their own. Rows are numbered from 0: those of thead first and those of tfoot last;
    ``head``: the row is in thead, or, in a table without, among the first whose cells are all th. A cell is repeated in
    each column and row that it spans (beyond the last row, too); ``raw`` has the html of the row's own cells, each once.
    Cells and rows without closing tags end where the next begins; tables without one end with the page. Rows without
    cells, tables without rows, comments, scripts, and tags outside of tables don't count. Null and empty pages have no
    tables; repeated pages have each their own.
    """
    # the outer kind of explode, as a filter on the size of what it opens would be computed twice
    out = page_grids(pages, glue).select("page_id", F.posexplode_outer("tables").alias("table_no", "t"))
    return out.select("page_id", "table_no", F.posexplode_outer("t").alias("row_no", "r")).where("r is not null").select("page_id", "table_no", "row_no", "r.*")


def _headed(rows: Column) -> Column:
    """struct<header, body, marked> of a table's rows. A name is the texts of its column in the header rows, from top to bottom,
    each once; without such rows the first one is the header, and not ``marked`` as one. Names that come again get .1, .2
    and so on."""
    marked = F.filter(rows, lambda x: x["head"])
    lines = F.when(F.size(marked) > 0, marked).otherwise(F.slice(rows, 1, 1))
    body = F.when(F.size(marked) > 0, F.filter(rows, lambda x: ~x["head"])).otherwise(F.slice(rows, 2, F.size(rows)))
    column = lambda h, k: F.array_distinct(F.filter(F.transform(h, lambda x: F.get(x["cells"], k)), lambda c: c != ""))
    width = lambda h: F.array_max(F.transform(h, lambda x: F.size(x["cells"])))
    plain = F.transform(F.array(lines), lambda h: F.transform(F.sequence(F.lit(0), width(h) - 1), lambda k: F.array_join(column(h, k), " ")))
    times = lambda names, x, k: F.size(F.filter(F.slice(names, F.lit(1), k), lambda y: y == x))
    again = lambda names, x, k: F.when(times(names, x, k) > 0, F.concat(x, F.lit("."), times(names, x, k).cast("string"))).otherwise(x)
    header = F.transform(plain, lambda names: F.transform(names, lambda x, k: again(names, x, k)))[0]
    return F.struct(header.alias("header"), body.alias("body"), (F.size(marked) > 0).alias("marked"))


def table_rows(pages: DataFrame, required: Sequence[str], id_pattern: str | None = None) -> DataFrame:
    """(page_id, row_no, cells map<header, text>, link_id) of the first table whose header has all required words, else of
    the first whose first row has them (layout tables come thus after those inside), else of the page's first. Rows count from 1 behind the header, and columns beyond the header go. link_id comes from the
    first link in a row that fits ``id_pattern``. Null and empty pages have no rows."""
    tabled = page_grids(pages).select("page_id", F.transform("tables", _headed).alias("tables"))
    has = lambda t, w: F.exists(t["header"], lambda x: F.contains(F.lower(x), F.lit(w.lower())))
    fits = F.filter("tables", lambda t: reduce(lambda a, w: a & has(t, w), required, F.lit(True)))
    best = F.coalesce(F.get(F.filter(fits, lambda t: t["marked"]), 0), F.get(fits, 0), F.get("tables", 0))
    picked = tabled.select("page_id", best.alias("t")).select("page_id", "t.header", F.posexplode_outer("t.body").alias("k", "r")).where("r is not null")
    n = F.least(F.size("header"), F.size("r.cells"))
    pairs = F.map_from_arrays(F.slice("header", F.lit(1), n), F.slice("r.cells", F.lit(1), n))
    link = F.regexp_extract(F.array_join("r.raw", " "), id_pattern or "^$", 1 if id_pattern else 0)
    return picked.where(n > 0).select("page_id", (F.col("k") + 1).alias("row_no"), pairs.alias("cells"), F.nullif(link, F.lit("")).alias("link_id"))
