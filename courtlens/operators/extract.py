"""Extraction jobs over a table of web pages (page_id, url, html), by native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.functions.references import held, unescape
from courtlens.functions.text import clean, is_blank, text, to_null, words
from courtlens.operators.lineage import spread
from courtlens.operators.page_tables import tables

TITLES = "head coach|assistant coach|associate head coach|director of operations|coach"


def page_text(html: Column | str, unclosed: bool = True) -> Column:
    """The text of a page: scripts, styles and tags go, character references are resolved (those without semicolon only
    with ``unclosed``), white space collapses."""
    bare = F.regexp_replace(text(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return clean(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), unclosed))


def inner(html: Column | str, tag: str, k: int = 0, unclosed: bool = True) -> Column:
    """The text of the first element of a kind; empty if there is none."""
    return page_text(F.regexp_extract(text(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), unclosed)


def all_inner(html: Column | str, tag: str, unclosed: bool = True) -> Column:
    return F.transform(F.regexp_extract_all(text(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda x: page_text(x, unclosed))


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def meta(html: Column | str, name: str) -> Column:
    """The content of the meta tag of a name, whatever the order of its attributes; null if there is none."""
    tags = F.regexp_extract_all(text(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    own = F.filter(tags, lambda x: F.lower(attribute(x, "name")) == name.lower())
    return F.nullif(F.trim(attribute(F.get(own, 0), "content")), F.lit(""))


def summary(html: Column | str, unclosed: bool = True) -> Column:
    """The meta description, else the first paragraph."""
    return F.coalesce(meta(html, "description"), inner(html, "p", unclosed=unclosed))


def first_paragraphs(html: Column | str, n: int = 2, unclosed: bool = True) -> Column:
    return F.slice(F.filter(all_inner(html, "p", unclosed), lambda x: x != ""), 1, n)


def reviews(html: Column | str, n: int = 2) -> Column:
    """The first marked review bodies, else paragraphs."""
    marked = F.transform(F.regexp_extract_all(text(html), F.lit(r"(?is)<[a-z]+[^>]*itemprop=[\"']reviewBody[\"'][^>]*>(.*?)</"), F.lit(1)), lambda x: page_text(x))
    return held(F.filter(marked, lambda x: x != ""), lambda m: F.when(F.size(m) > 0, F.slice(m, 1, n)).otherwise(first_paragraphs(html, n)))


def label_grade(body: Column, label: str) -> Column:
    return F.upper(F.regexp_extract(body, rf"(?i){label}\s*([A-F][+-]?)", 1))


def overall_grade(html: Column | str) -> Column:
    """The grade in front of "Overall Grade", else the first element that is nothing but a grade."""
    said = F.regexp_extract(page_text(html), r"\b([A-F][+-]?) Overall\s+Grade", 1)
    badge = F.regexp_extract(text(html), r">\s*([A-F][+-]?)\s*<", 1)
    return F.coalesce(F.nullif(said, F.lit("")), badge)


def links(pages: DataFrame, unclosed: bool = True) -> DataFrame:
    """(page_id, url, pos, href, anchor, target): each link in order, its address resolved against the page's."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    out = pages.select("page_id", "url", F.posexplode(tags).alias("pos", "a")).withColumns({"href": F.trim(attribute(F.col("a"), "href")), "anchor": page_text("a", unclosed)})
    site = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(://[^/]+)$", "$1/")
    folder = F.regexp_replace(folder, r"[^/]*$", "")
    href = F.col("href")
    target = (
        F.when(href == "", F.col("url")).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract("url", "^([a-zA-Z]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href)).when(href.rlike("^[#?]"), F.concat(F.regexp_replace("url", r"[#?].*$", ""), href)).otherwise(F.concat(folder, href))
    )
    return out.withColumn("target", target).drop("a")


def link_rank(anchors: Sequence[str], patterns: Sequence[str]) -> Column:
    """The first of the anchors that a link's text has, else the first pattern that its address has; null if none."""
    return F.coalesce(
        *[F.when(F.contains(F.lower("anchor"), F.lit(a.lower())), k) for k, a in enumerate(anchors)], *[F.when(F.lower("href").rlike(p), len(anchors) + k) for k, p in enumerate(patterns)]
    )


def find_link(pages: DataFrame, anchors: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """(page_id, target): the first link whose text has one of the anchors, in their order, else whose address has a pattern."""
    hits = links(pages).withColumn("rank", link_rank(anchors, patterns)).where("rank is not null")
    return hits.groupBy("page_id").agg(F.min_by("target", F.struct("rank", "pos")).alias("target"))


def links_with_pick(pages: DataFrame, anchors: Sequence[str], patterns: Sequence[str], name: str = "picked", unclosed: bool = True) -> DataFrame:
    """All links, and on each the target that ``find_link`` finds on its page (null if none), from one extraction."""
    rows = links(pages, unclosed).withColumn("_r", link_rank(anchors, patterns))
    best = F.min_by("target", F.when(F.col("_r").isNotNull(), F.struct("_r", "pos"))).over(Window.partitionBy("page_id"))
    return rows.withColumn(name, best).drop("_r")


def marked_blocks(html: Column, marks: str) -> Column:
    """array<struct<pos, n, b>>: each div or li whose class holds a mark, whole, with all blocks inside it.

    ``pos`` numbers the page's block tags, and a block takes ``n`` of the pieces between them: up to the tag that closes
    it, or to the page's end if none does.
    """
    opens = lambda p: F.when(p.rlike("(?i)^<(div|li)\\b"), 1).when(p.rlike("(?i)^</(div|li)\\b"), -1).otherwise(0)
    marked = lambda p: p.rlike(rf"(?is)^<(?:div|li)\b[^>]*class=[\"'][^\"']*(?:{marks})")

    def blocks(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(True).alias("open"))
        grow = lambda s, p: F.when(s["open"], F.struct((s["n"] + 1).alias("n"), (s["depth"] + opens(p)).alias("depth"), (s["depth"] + opens(p) > 0).alias("open"))).otherwise(s)
        size = lambda i: F.aggregate(F.slice(pieces, i + 1, F.size(pieces)), start, grow, lambda s: s["n"])
        # of the last piece only the closing tag belongs to the block
        body = lambda x: F.concat(F.array_join(F.slice(pieces, x["pos"] + 1, x["n"] - 1), ""), F.regexp_replace(pieces[x["pos"] + x["n"] - 1], r"(?s)^(</[^>]*>).*$", "$1"))
        found = F.filter(F.transform(pieces, lambda p, i: F.when(marked(p), i)), lambda i: i.isNotNull())
        sized = F.transform(found, lambda i: F.struct(i.alias("pos"), size(i).alias("n")))
        return F.transform(sized, lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), body(x).alias("b")))

    return F.transform(F.array(F.split(html, r"(?i)(?=</?(?:div|li)\b)")), blocks)[0]


def staff_contacts(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, pos struct<table, row>, name, title, email, phone, photo) by the first of three strategies that
    finds anyone.

    1: blocks marked as staff, with what is nested in them, the innermost that have a name and a title; 2: rows of
    tables with a name and a title; 3: links next to a coaching title.
    """
    mail, tel = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", r"(\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ][0-9]{4})"
    title = lambda c: F.trim(F.regexp_extract(c, rf"(?i)((?:associate |assistant )?(?:{TITLES}))", 1))
    filled = lambda c: held(c, lambda x: F.when(x != "", x))
    named = F.coalesce(*[filled(inner("b", t)) for t in ("h2", "h3", "h4", "a", "strong")])
    img = attribute(F.regexp_extract("b", r"(?is)<img\b[^>]*>", 0), "src")
    fields = [F.regexp_extract("b", mail, 1).alias("email"), F.regexp_extract(page_text("b"), tel, 1).alias("phone"), F.nullif(img, F.lit("")).alias("photo")]
    one = pages.select("page_id", F.inline(marked_blocks(F.col("html"), "staff|coach"))).select("page_id", F.lit(1).alias("strategy"), "pos", named.alias("name"), title(page_text("b")).alias("title"), *fields, "n")
    inner_too = F.lead("pos").over(Window.partitionBy("page_id").orderBy("pos")) < F.col("pos") + F.col("n")
    one = one.where("name <> '' and title <> ''").withColumn("_in", F.coalesce(inner_too, F.lit(False))).where("not _in").drop("_in", "n")
    one, place = one.withColumn("pos", F.struct(F.lit(0).alias("table"), F.col("pos").alias("row"))), "struct<table:int,row:int>"
    cells = tables(pages, " ").where(F.size("cells") >= 2).withColumn("b", F.array_join("raw", " "))
    two = cells.select("page_id", F.lit(2).alias("strategy"), F.struct(F.col("table_no").alias("table"), F.col("row_no").alias("row")).cast(place).alias("pos"), F.get("cells", 0).alias("name"), title(F.get("cells", 1)).alias("title"), *fields)
    near = F.regexp_extract_all("html", F.lit(rf"(?is)(<a\b[^>]*>[^<]*</a>[^<]*(?:<[^>]*>[^<]*){{0,3}}?(?:{TITLES}))"), F.lit(1))
    three = pages.select("page_id", F.posexplode(near).alias("pos", "b")).select("page_id", F.lit(3).alias("strategy"), F.struct(F.lit(0).alias("table"), F.col("pos").alias("row")).cast(place).alias("pos"), inner("b", "a").alias("name"), title(page_text("b")).alias("title"), *fields)
    found = one.unionByName(two).unionByName(three).where("name <> '' and title <> ''")
    first = Window.partitionBy("page_id")
    return found.withColumn("_s", F.min("strategy").over(first)).where("strategy = _s").drop("_s")


def best_image(people: DataFrame, page: str, name: str, images: DataFrame) -> DataFrame:
    """(page, name, src): the first image whose alt text has all words of the name, else any of them.

    ``images``: page, pos, src, alt.
    """
    p = people.select(page, name, F.filter(words(F.lower(clean(name))), lambda w: F.length(w) > 1).alias("_w"))
    pairs = p.join(images.withColumn("_alt", F.lower(text("alt"))), page)
    has = lambda w: F.contains(F.col("_alt"), w)
    rank = F.when(F.forall("_w", has) & (F.size("_w") > 0), 0).when(F.exists("_w", has), 1)
    best = pairs.withColumn("_r", rank).where("_r is not null").groupBy(page, name).agg(F.min_by("src", F.struct("_r", "pos")).alias("src"))
    return people.select(page, name).join(best, [page, name], "left")


def images(pages: DataFrame) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return pages.select("page_id", F.posexplode(tags).alias("pos", "t")).select("page_id", "pos", attribute(F.col("t"), "src").alias("src"), attribute(F.col("t"), "alt").alias("alt"))


def json_blocks(html: Column | str) -> Column:
    """The JSON-LD scripts of a page."""
    return F.transform(F.regexp_extract_all(text(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), lambda x: F.trim(x))


def first_of_type(html: Column | str, kind: str) -> Column:
    """The first JSON-LD object of a type, as text; null if there is none. Lists of objects are looked into."""
    objects = F.flatten(F.transform(json_blocks(html), lambda x: F.coalesce(F.when(x.rlike(r"^\s*\["), F.from_json(x, "array<string>")), F.array(x))))
    return F.get(F.filter(objects, lambda x: F.get_json_object(x, "$['@type']") == kind), 0)


def organization(html: Column | str, kind: str = "CollegeOrUniversity") -> Column:
    """Typed fields of the first object of a type."""
    return held(first_of_type(html, kind), _organization)


def _organization(one: Column) -> Column:
    at = lambda path: F.get_json_object(one, path)
    return F.struct(
        at("$.telephone").alias("phone"), at("$.url").alias("website"), at("$.address.streetAddress").alias("street"), at("$.address.addressLocality").alias("city"),
        at("$.address.addressRegion").alias("state"), at("$.address.postalCode").alias("zip_code"), at("$.aggregateRating.ratingValue").try_cast("double").alias("rating_value"),
        at("$.aggregateRating.reviewCount").try_cast("int").alias("rating_count"),
    )


def faqs(html: Column | str, n: int = 3) -> Column:
    """array<struct<question, answer>> of the first FAQ object."""
    kind = "array<struct<name:string,acceptedAnswer:struct<text:string>>>"
    items = F.from_json(F.get_json_object(first_of_type(html, "FAQPage"), "$.mainEntity"), kind)
    pairs = F.transform(items, lambda x: F.struct(F.trim(x["name"]).alias("question"), page_text(x["acceptedAnswer"]["text"]).alias("answer")))
    return F.slice(F.filter(F.coalesce(pairs, F.array().cast("array<struct<question:string,answer:string>>")), lambda x: (x["question"] != "") & (x["answer"] != "")), 1, n)


#: A JSON text falls into strings, brackets, and what stands between them.
_JSON_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|[^"{}\[\]]++|"'
#: Levels of nesting up to which Spark's parser turns JSON into values.
PLAIN_NESTING = 900


def _nesting(steps: Column) -> Column:
    """struct<now, most, closed> over steps of 1 for brackets that open, -1 for those that close, and 0: how many are open
    at the end, the most at any time, and how often the last one was closed."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("closed"))
    grow = lambda s, k: F.struct((s["now"] + k).alias("now"), F.greatest(s["most"], s["now"] + k).alias("most"), (s["closed"] + F.when((s["now"] == 1) & (k < 0), 1).otherwise(0)).alias("closed"))
    return F.aggregate(steps, start, grow)


def _is_json(text: Column, nesting: Column) -> Column:
    """Whether a text is one object or list and nothing else, at any depth: the parser is made to skip it whole, which
    checks its grammar without a stack, where it stands under a key that nobody asks for."""
    asked = F.from_json(F.concat(F.lit('{"skipped":'), text, F.lit("}")), "struct<other:int,bad:string>", {"columnNameOfCorruptRecord": "bad", "maxNestingDepth": str(2**31 - 1)})
    return (nesting["now"] == 0) & (nesting["closed"] == 1) & text.rlike(r"^\s*[{\[]") & text.rlike(r"[}\]]\s*$") & asked["bad"].isNull()


def _json_marks(tokens: Column, required: Sequence[str]) -> Column:
    """array<struct<i, kind>>: the brackets (1 and 2, negative where they close) and required keys (from 10) among tokens."""
    plain = lambda x: F.when(F.contains(x, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"k":'), x, F.lit("}")), "$.k")).otherwise(x)
    number = lambda x: F.nullif(F.array_position(F.array(*map(F.lit, required)), F.regexp_replace(F.lower(plain(x)), "[^a-z]", "")), F.lit(0))
    is_key = lambda x, i: F.startswith(x, F.lit('"')) & F.coalesce(F.get(tokens, i + 1).rlike(r"^\s*:"), F.lit(False))
    kind = lambda x, i: F.when(x == "{", 1).when(x == "[", 2).when(x == "}", -1).when(x == "]", -2).when(is_key(x, i), number(x) + 9)
    return F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("i"), kind(x, i).cast("int").alias("kind"))), lambda m: m["kind"].isNotNull())


def find_object(df: DataFrame, key: str, json: str, required: Sequence[str]) -> DataFrame:
    """(key, found): the first object of each text, in pre-order, that itself has all required keys (letters only, without
    case), as map<string,string> of its values' JSON.

    One pass, whatever the depth: the brackets and required keys of a text are put in order by a window, how many brackets
    are open tells which object a key belongs to. Texts without all the keys are left out before. Null texts and texts
    that are no JSON have no row; repeated rows have each their own. found is null if what the object holds nests deeper
    than PLAIN_NESTING levels, which Spark can't turn into values; how deep it stands doesn't matter.
    """
    want = sorted(set(required))
    rows = spread(df.select(*dict.fromkeys([key, json]))).select(F.struct(F.col(key).alias("key"), F.regexp_extract_all(json, F.lit(_JSON_TOKENS), F.lit(0)).alias("tokens")).alias("row"), F.col(json).alias("_j"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("marks", _json_marks(F.col("row.tokens"), want))
    kinds = F.transform("marks", lambda m: m["kind"])
    step = lambda k: F.when(k.between(1, 2), 1).when(k < 0, -1).otherwise(0)
    has_all = F.size(F.array_intersect(kinds, F.array(*[F.lit(10 + k) for k in range(len(want))]))) == len(want)
    rows = rows.where(has_all).withColumn("_n", _nesting(F.transform(kinds, step))).where(_is_json(F.col("_j"), F.col("_n")))
    first = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("kind")))
    marks = rows.select("uid", "row", F.explode(F.concat(first, "marks")).alias("m")).select("uid", F.when(F.col("m.i") < 0, F.col("row")).alias("row"), "m.*")
    order = Window.partitionBy("uid").orderBy("i")
    marks = marks.withColumn("_open", F.sum(step(F.col("kind"))).over(order))
    marks = marks.withColumn("_level", F.when(F.col("kind") < 0, F.col("_open") + 1).otherwise(F.col("_open")))
    at = F.last(F.when(F.col("kind").between(1, 2), F.col("i")), ignorenulls=True).over(Window.partitionBy("uid", "_level").orderBy("i"))
    owned = marks.withColumn("begin", F.when(F.col("kind") != 0, at).otherwise(-1)).groupBy("uid", "begin").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max(F.when(F.col("kind") < 0, F.col("i"))).alias("end"), F.countDistinct(F.when(F.col("kind") >= 10, F.col("kind"))).alias("n"),
    )
    best = owned.groupBy("uid").agg(F.first("row", ignorenulls=True).alias("row"), F.min(F.when(F.col("n") == len(want), F.struct("begin", "end"))).alias("x")).where("x is not null")
    own = best.select(F.col("row.key").alias(key), F.slice("row.tokens", F.col("x.begin") + 1, F.col("x.end") - F.col("x.begin") + 1).alias("_t"))
    deep = _nesting(F.transform("_t", lambda x: F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)))["most"]
    values = F.transform_values(F.from_json(F.array_join("_t", ""), "map<string,variant>"), lambda k, v: F.to_json(v))
    return own.select(key, F.when(deep <= PLAIN_NESTING, values).alias("found"))


def label_shares(body: Column, labels: Sequence[str]) -> Column:
    """array<struct<label, share>> of "label 12%" pairs, longer labels first, so that none is cut short."""
    either = "|".join(sorted(labels, key=len, reverse=True))
    pattern = F.lit(rf"(?i)({either})\s*([0-9]+)%?")
    pairs = lambda s: F.zip_with(*[F.regexp_extract_all(s, pattern, F.lit(k)) for k in (1, 2)], lambda a, b: F.struct(F.lower(a).alias("label"), b.cast("double").alias("share")))
    return held(body, pairs)


def merge_fields(dim: DataFrame, key: str, found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Take found values where they are filled, and tell with ``changed`` which rows differ from before."""
    new = found.select(F.col(key).alias("_k"), *[to_null(f).alias(f"_{f}") for f in fields])
    out = dim.join(new, F.col(key) == F.col("_k"), "left")
    changed = reduce(lambda a, b: a | b, (F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)) for f in fields))
    return out.withColumn("changed", changed).withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*dim.columns, "changed")


def fill_nested(block: str, field: str, value: Column) -> Column:
    """Set a nested field only if it is blank."""
    return F.col(block).withField(field, F.when(is_blank(F.col(block)[field]), value).otherwise(F.col(block)[field]))


def by_year(stats: Column, year: Column | str) -> Column:
    """The nested block of a year out of a map; null if the year is missing."""
    return F.try_element_at(stats, F.lit(year) if isinstance(year, str) else year)
