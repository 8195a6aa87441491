"""Joins that resolve entities: fallbacks, nearest facilities, tiered name matches, overlays, contact merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.functions.numbers import haversine_miles
from courtlens.functions.text import coach_title, file_slug, index_key, phone, scorecard_key, text, to_null, words
from courtlens.operators.lineage import beside, checkpoint, is_few, shuffled

#: Similarities from which a token match is low and medium, and a sequence match counts (fixed values).
LOW, MEDIUM, RATIO = 0.60, 0.80, 0.78


def settling(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    """The columns that can settle a tie: all with an order but the ones given."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    return [f.name for f in df.schema.fields if f.name not in but and ordered(f.dataType)]


def last_by(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given, ties by the other columns; null keys are no identity and go."""
    df = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*ordinal, *settling(df, [*keys, *ordinal]))).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def first_by(df: DataFrame, keys: Sequence[Column], ordinal: Sequence[str]) -> DataFrame:
    """The first-seen row of each key, ties by the other columns."""
    w = Window.partitionBy(*keys).orderBy(*ordinal, *settling(df, ordinal))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_fallback(left: DataFrame, primary: DataFrame, on: Sequence[str], secondary: DataFrame, on2: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values by the first key, else, row by row, by the second. Both right sides have one row a key."""
    a = primary.select(*on, *[F.col(v).alias(f"_a_{v}") for v in values])
    b = secondary.select(*on2, *[F.col(v).alias(f"_b_{v}") for v in values])
    out = left.join(a, list(on), "left").join(b, list(on2), "left")
    return out.withColumns({v: F.coalesce(f"_a_{v}", f"_b_{v}") for v in values}).drop(*[f"_{s}_{v}" for s in "ab" for v in values])


def two_step(left: DataFrame, key: str, fallback: str, dim: DataFrame, dim_key: str, value: str) -> DataFrame:
    """Look the key up, else the fallback key; the whole value comes from one of the two."""
    one = dim.select(F.col(dim_key).alias("_k1"), F.struct(value).alias("_v1"))
    two = dim.select(F.col(dim_key).alias("_k2"), F.struct(value).alias("_v2"))
    out = left.join(one, F.col(key) == F.col("_k1"), "left").join(two, F.col(fallback) == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")[value]).drop("_k1", "_k2", "_v1", "_v2")


#: Sites that a point may be compared with one by one, and the width from which cubes are split no more.
MOST_SITES, LEAST_WIDTH = 100, 2.0**-20


def nearest(points: DataFrame, point: str, sites: DataFrame, site: str, cell: float = 1.0) -> DataFrame:
    """(point, site, miles) of the nearest site to each point; of equals the one with the least id.

    Both frames have lat and lon; rows without either, or with one that is no number, are left out. Equal places are
    looked up once. Places are three numbers on the unit sphere, which has neither poles nor a date line, and stand in
    cubes. A cube of points meets boxes around the sites of equally wide cubes and keeps those that can hold the nearest
    site of any of its points; what is kept is split, points and sites alike, into cubes a quarter as wide, until a cube's
    boxes hold at most MOST_SITES sites in all. So dense places are split far and empty ones hardly, and no group of
    sites meets all points. ``cell`` is kept for callers: the widths follow from the tables.
    """
    axes, known = ("_x", "_y", "_z"), "lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"

    def on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
        x, y = F.radians(lat), F.radians(lon)
        return checkpoint(df.withColumns({"_x": F.cos(x) * F.cos(y), "_y": F.cos(x) * F.sin(y), "_z": F.sin(x)}))

    placed = points.where(known).select(F.col(point).alias("_p"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    p = on_sphere(placed.select("_plat", "_plon").distinct(), "_plat", "_plon")
    stand = sites.where(known).groupBy(F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).agg(F.min(F.struct(F.col(site).alias("_s"))).alias("_b"))
    s = on_sphere(stand.select("_slat", "_slon", "_b._s"), "_slat", "_slon")
    miles = haversine_miles(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon"))
    cube = lambda width: F.struct(*[F.floor((F.col(c) + 1.0) / width).alias(c) for c in axes])
    total = lambda squares: reduce(lambda x, y: x + y, squares)
    sure = 1e-12  # more than rounding changes in a squared distance

    def cubes(df: DataFrame, width: float, t: str) -> DataFrame:
        edges = [f(c).alias(f"{t}{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]
        found = df.groupBy(cube(width).alias(t)).agg(F.count("*").alias(f"{t}n"), *edges)
        return found.withColumn(f"{t}up", F.struct(*[F.shiftright(F.col(t)[c], 2).alias(c) for c in axes]))

    edge = lambda t, n, c: F.col(f"{t}{n}{c}")
    near = total([F.pow(F.greatest(F.lit(0.0), edge("b", "lo", c) - edge("q", "hi", c), edge("q", "lo", c) - edge("b", "hi", c)), F.lit(2)) for c in axes])
    far = total([F.pow(F.greatest(edge("b", "hi", c) - edge("q", "lo", c), edge("q", "hi", c) - edge("b", "lo", c)), F.lit(2)) for c in axes])
    # widths are powers of two, so that a cube lies in one of the wider ones to the last bit
    width, out = 4.0, None
    met = cubes(p, width, "q").join(cubes(s, width, "b"), F.col("q") == F.col("b"))
    while True:
        met = met.select("q", "b", "bn", near.alias("_near"), far.alias("_far"))
        kept = checkpoint(met.join(met.groupBy("q").agg(F.min("_far").alias("_most")), "q").where(F.col("_near") <= F.col("_most") + sure).select("q", "b", "bn"))
        kept = kept.join(kept.groupBy("q").agg(F.sum("bn").alias("_all")), "q")
        last = width <= LEAST_WIDTH
        done = kept if last else kept.where(F.col("_all") <= MOST_SITES)
        chord = total([F.pow(F.col(f"_p{c}") - F.col(c), F.lit(2)) for c in axes])
        own = p.withColumn("q", cube(width)).withColumnsRenamed({c: f"_p{c}" for c in axes})
        pairs = own.join(done.select("q", "b"), "q").join(s.withColumn("b", cube(width)), "b").select("_plat", "_plon", "_slat", "_slon", "_s", chord.alias("_d"))
        # ids are compared only where the distance leaves a choice, so the many pairs are grouped by numbers alone
        close = pairs.join(pairs.groupBy("_plat", "_plon").agg(F.min("_d").alias("_least")), ["_plat", "_plon"]).where(F.col("_d") <= F.col("_least") + sure)
        best = checkpoint(close.groupBy("_plat", "_plon").agg(F.min(F.struct(miles.alias("_d"), "_s")).alias("_b")))
        out = best if out is None else out.unionByName(best)
        live = kept.where(F.col("_all") > MOST_SITES).select(F.col("q").alias("_q"), F.col("b").alias("_c"))
        if last or live.isEmpty():
            break
        width /= 4
        met = live.join(cubes(p, width, "q"), F.col("qup") == F.col("_q")).join(cubes(s, width, "b"), F.col("bup") == F.col("_c"))
    found = placed.join(out, ["_plat", "_plon"]).groupBy("_p").agg(F.min("_b").alias("_b"))
    return found.select(F.col("_p").alias(point), F.col("_b._s").alias(site), F.col("_b._d").alias("miles"))


def rarest(df: DataFrame, keys: Sequence[str], items: str, known: DataFrame, first: Callable[[Column], Column]) -> DataFrame:
    """Each row with each of its rarest items as ``w``, as many as ``first`` gives for their number. ``known``: w, times."""
    rows = df.select(*keys, F.explode(items).alias("w")).join(known, "w")
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("times", "w"))).alias("_o"))
    kept = F.slice(F.transform("_o", lambda x: x["w"]), F.lit(1), F.greatest(F.lit(0), first(F.size("_o"))).cast("int"))
    return df.join(shuffled(rows.select(*keys, kept.alias("_o"))), list(keys)).withColumn("w", F.explode("_o")).drop("_o")


def match_tokens(entities: DataFrame, entity: str, names: str, rows: DataFrame, row: str, name: str) -> DataFrame:
    """(entity, row, score, confidence): override, exact key, else the best token overlap.

    ``entities``: entity, an array of candidate names in order, and optionally ``override`` (a row id). Rows with an
    overlap of at least LOW count; ties go to the row that comes first, then to the earlier candidate. Of the n words of
    a name, rarest first, two names with that overlap share one among the first n - ceil(LOW * n) + 1 each, so they meet
    by those words alone, which loses nothing and leaves common words out.
    """
    have = "override" in entities.columns
    e = entities.select(F.col(entity).alias("e"), names, (F.col("override") if have else F.lit(None)).alias("o"))
    # keys are made once, as each step below goes through them again
    cand = checkpoint(e.select("e", F.posexplode(names).alias("c", "n")).withColumn("n", scorecard_key("n")).where("n <> ''"))
    r = checkpoint(rows.select(F.col(row).alias("r"), scorecard_key(name).alias("m")).where("m <> ''"))
    few = is_few(r)
    given = e.join(shuffled(rows.select(F.col(row).alias("r"))), F.col("o") == F.col("r")).select("e", "r", F.lit(1.0).alias("score"), F.lit("override").alias("confidence"))
    left = cand.join(shuffled(given.select("e")), "e", "left_anti")
    hits = left.join(beside(r, few), F.col("n") == F.col("m")).groupBy("e").agg(F.min(F.struct("c", "r")).alias("x"))
    exact = hits.select("e", F.col("x.r").alias("r"), F.lit(1.0).alias("score"), F.lit("high").alias("confidence"))
    tokens = lambda c: F.array_distinct(words(F.col(c)))
    a = checkpoint(left.join(shuffled(exact.select("e")), "e", "left_anti").select("e", "c", tokens("n").alias("ta")))
    b = r.select("r", tokens("m").alias("tb"))
    known = a.select(F.explode("ta").alias("w")).unionByName(b.select(F.explode("tb").alias("w"))).groupBy("w").agg(F.count("*").alias("times"))
    known = beside(known)
    first = lambda n: n - F.ceil(LOW * n - 1e-9) + 1
    met = rarest(a, ["e", "c"], "ta", known, first).join(beside(rarest(b, ["r"], "tb", known, first), few), "w")
    both = F.size(F.array_intersect("ta", "tb"))
    score = both / (F.size("ta") + F.size("tb") - both)
    best = met.withColumn("score", score).groupBy("e").agg(F.min(F.struct((-F.col("score")).alias("s"), "r", "c")).alias("x"))
    fuzzy = (
        best.select("e", F.col("x.r").alias("r"), (-F.col("x.s")).alias("score")).where(F.col("score") >= LOW)
        .withColumn("confidence", F.when(F.col("score") >= MEDIUM, "medium").otherwise("low"))
    )
    out = given.unionByName(exact).unionByName(fuzzy)
    return entities.select(F.col(entity).alias("e")).join(shuffled(out), "e", "left").select(F.col("e").alias(entity), F.col("r").alias(row), "score", "confidence")


def match_sequences(entities: DataFrame, entity: str, rows: DataFrame, row: str, method: str = "levenshtein", threshold: float = RATIO) -> DataFrame:
    """(entity, row, match_type, score): exact keys first, else the most similar key of at least the threshold.

    ``levenshtein`` is 1 - distance / longer length and runs natively; ``ratio`` is the matching-blocks ratio of the
    standard library, over Arrow batches. The two scores differ. Unmatched entities have type none and score 0. Keys
    meet by pairs of letters: those that reach the threshold differ in so few edits that some of each key's pairs, the
    rarest but for those that the edits can spoil, are left in common. Keys too short for that meet by their lengths.
    """
    e = checkpoint(entities.select(F.col(entity).alias("e")).distinct().withColumn("k", index_key("e")))
    r = checkpoint(rows.select(F.col(row).alias("r")).distinct().withColumn("m", index_key("r")))
    exact = e.join(r, F.col("k") == F.col("m")).groupBy("e").agg(F.min("r").alias("r")).withColumns({"match_type": F.lit("exact"), "score": F.lit(1.0)})
    rest = e.join(shuffled(exact.select("e")), "e", "left_anti").where("k <> ''")
    n, m = F.length("k"), F.length("m")
    able = (F.least(n, m) / F.greatest(n, m) >= threshold) if method == "levenshtein" else (2 * F.least(n, m) / (n + m) >= threshold)
    pairs = near_keys(rest, r.where("m <> ''"), method, threshold).where(able)
    if method == "levenshtein":
        scored = pairs.withColumn("score", 1 - F.levenshtein("k", "m") / F.greatest(n, m))
    else:
        scored = pairs.mapInPandas(_ratios, "e string, k string, r string, m string, score double")
    best = scored.where(F.col("score") >= threshold).groupBy("e").agg(F.min(F.struct((-F.col("score")).alias("s"), "r")).alias("x"))
    close = best.select("e", F.col("x.r").alias("r"), F.lit("similar").alias("match_type"), (-F.col("x.s")).alias("score"))
    out = e.select("e").join(shuffled(exact.unionByName(close)), "e", "left")
    return out.select(F.col("e").alias(entity), F.col("r").alias(row), F.coalesce("match_type", F.lit("none")).alias("match_type"), F.coalesce("score", F.lit(0.0)).alias("score"))


def near_keys(a: DataFrame, b: DataFrame, method: str, threshold: float) -> DataFrame:
    """(e, k, r, m): all pairs of (e, k) and (r, m) that can reach the threshold, among others."""
    # pairs of letters of a key of n letters that are spoilt at most: an edit spoils two (but an insertion one)
    if method == "levenshtein":
        longest, spoilt = 1 / threshold, lambda n: 2 * F.floor((1 - threshold) / threshold * n + 1e-9)
    else:
        longest, spoilt = (2 - threshold) / threshold, lambda n: F.floor(n * (1 - (1.5 * threshold - 1) * (1 + threshold / (2 - threshold))) + 1e-9)

    def lettered(df: DataFrame, key: str) -> DataFrame:
        two = F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(F.col(key), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        two = F.transform(F.array(two), lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).cast("string"))))[0]
        return df.withColumns({"_g": two, "_n": F.length(key)}).withColumn("_short", spoilt(F.col("_n")) >= F.col("_n") - 1)

    a, b = lettered(a, "k"), lettered(b, "m")
    known = a.select(F.explode("_g").alias("w")).unionByName(b.select(F.explode("_g").alias("w"))).groupBy("w").agg(F.count("*").alias("times"))
    known = beside(known)
    few = lambda df, keys: rarest(df.where("not _short"), keys, "_g", known, lambda n: spoilt(n + 1) + 1).select(*keys, "w")
    met = few(a, ["e", "k"]).join(beside(few(b, ["r", "m"])), "w").select("e", "k", "r", "m").distinct()
    # a pair with a short key on either side: the other one is at most so much longer
    able = F.explode(F.sequence(F.floor(F.col("_n") / longest), F.ceil(F.col("_n") * longest))).alias("_m")
    own = F.col("_n").cast("long").alias("_m")
    one = a.where("_short").select("e", "k", able).join(b.select("r", "m", own), "_m")
    two = a.where("not _short").select("e", "k", own).join(b.where("_short").select("r", "m", able), "_m")
    return met.unionByName(one.select("e", "k", "r", "m")).unionByName(two.select("e", "k", "r", "m"))


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from difflib import SequenceMatcher

    for pdf in batches:
        yield pdf.assign(score=[SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["k"], pdf["m"])])


def match_artifacts(people: DataFrame, key: str, team: str, name: str, files: DataFrame, file: str, extensions: Sequence[str] = ("jpg", "jpeg", "png", "webp"), suffixes: Sequence[str] = ("", "_university", "_college")) -> DataFrame:
    """(key, file, step): team_person.ext with the team's spellings and the extensions in order, else a file of the team
    whose name contains the person's. Case doesn't count. step is null for people without a file."""
    f = files.select(F.col(file).alias("f"), F.lower(F.col(file)).alias("l"))
    p = people.select(F.col(key).alias("p"), F.lower(file_slug(team)).alias("t"), F.lower(file_slug(name)).alias("n"))
    tried = [F.concat(F.col("t"), F.lit(s), F.lit("_"), F.col("n"), F.lit(f".{x}")) for s in suffixes for x in extensions]
    named = p.select("p", F.posexplode(F.array(*tried)).alias("rank", "l")).join(f, "l").groupBy("p").agg(F.min(F.struct("rank", "f")).alias("x"))
    exact = named.select("p", F.col("x.f").alias("f"), F.lit("name").alias("step"))
    rest = p.join(exact.select("p"), "p", "left_anti")
    first = lambda c: F.split(c, "_")[0]  # noqa: E731  blocks by the first word of the team
    loose = rest.withColumn("b", first("t")).join(f.withColumn("b", first("l")), "b").where(F.startswith("l", "t") & F.contains("l", "n"))
    held = loose.groupBy("p").agg(F.min("f").alias("f")).withColumn("step", F.lit("contains"))
    return p.select("p").join(exact.unionByName(held), "p", "left").select(F.col("p").alias(key), F.col("f").alias(file), "step")


def _merge_maps(low: Column, high: str) -> Column:
    """The keys of both maps, with the values of the higher one where it has them."""
    rest = F.map_filter(low, lambda k, _: ~F.map_contains_key(F.col(high), k))
    return F.when(F.col(high).isNull(), low).otherwise(F.map_concat(rest, F.col(high)))


def overlay(base: DataFrame, key: str, layers: Sequence[DataFrame], maps: Sequence[str] = ()) -> DataFrame:
    """Later layers win where they have a value; map columns merge key by key."""
    out = base
    for k, layer in enumerate(layers):
        values = [c for c in layer.columns if c != key]
        out = out.join(layer.withColumnsRenamed({c: f"_{k}_{c}" for c in values}), key, "left")
    for c in [c for c in base.columns if c != key]:
        own = [f"_{k}_{c}" for k, layer in enumerate(layers) if c in layer.columns]
        if c in maps:
            out = out.withColumn(c, reduce(_merge_maps, own, F.coalesce(F.col(c), F.create_map().cast(base.schema[c].dataType))))
        elif own:
            out = out.withColumn(c, F.coalesce(*reversed(own), c))
    return out.select(*base.columns)


def merge_contacts(sources: DataFrame, entity: str) -> DataFrame:
    """One row for each (entity, name, title): ``sources`` has entity, source, ordinal, name, title, email, phone.

    Titles go by their ladder; contacts are the same by name and title without case. The first appearance gives name and
    title, the first filled e-mail and phone in order of source and ordinal count; ``position`` orders the contacts.
    """
    rows = sources.select(entity, "source", "ordinal", text("name").alias("name"), coach_title("title").alias("title"), F.trim(text("email")).alias("email"), phone("phone").alias("phone"))
    rows = rows.where(F.concat("name", "title", "email", "phone") != "")
    at = F.struct("source", "ordinal")
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", at)), F.lit(""))
    out = rows.groupBy(entity, F.lower(F.trim("name")).alias("_n"), F.lower(F.trim("title")).alias("_t")).agg(
        F.min(at).alias("_at"), F.min_by("name", at).alias("name"), F.min_by("title", at).alias("title"), filled("email").alias("email"), filled("phone").alias("phone")
    )
    w = Window.partitionBy(entity).orderBy("_at", "_n", "_t")
    return out.withColumn("position", F.row_number().over(w)).drop("_n", "_t", "_at")


def resolve_aliases(df: DataFrame, name: str, aliases: DataFrame, canonical: str = "canonical") -> DataFrame:
    """Add the canonical name; names without an alias are their own. ``aliases``: alias, canonical, ordinal, last wins."""
    dim = last_by(aliases.select("alias", "canonical", "ordinal"), ["alias"], ["ordinal", "canonical"]).select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return df.join(dim, F.lower(F.trim(F.col(name))) == F.col("_a"), "left").withColumn(canonical, F.coalesce("_c", name)).drop("_a", "_c")


def fill_from(dim: DataFrame, key: str, alt_key: str, new: DataFrame, new_key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Overwrite fields by rows that name the key or else the alternative key, where they are filled; and the rows that
    match nothing."""
    news = new.select(F.col(new_key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    names = dim.select(F.col(key).alias("_key"), F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col(key).alias("n")), F.struct(F.lit(2).alias("rank"), F.col(alt_key).alias("n")))).alias("x"))
    hit = names.select("_key", "x.*").join(news, F.col("n") == F.col("_k")).groupBy("_key").agg(*[F.min_by(f"_{f}", F.when(to_null(f"_{f}").isNotNull(), F.struct("rank", "_k"))).alias(f"_{f}") for f in fields])
    out = dim.join(hit, F.col(key) == F.col("_key"), "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*dim.columns)
    return out, news.join(names.select(F.col("x.n").alias("_k")), "_k", "left_anti").select(F.col("_k").alias(new_key))
