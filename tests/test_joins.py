"""Nulls, repeated rows, ties and empty tables in the joins; idempotence; plans."""

import math
import random

from pyspark.sql import functions as F

from courtlens.functions.numbers import haversine_miles
from courtlens.operators import filters, joins, lineage, score, store
from courtlens.plans import QUERIES


def test_nearest_is_exact_everywhere(spark):
    """At the poles, over the date line, far from all sites, among ties; against all pairs."""
    rnd = random.Random(3)
    place = lambda: (rnd.choice([rnd.uniform(-90, 90), 90.0, -90.0, 89.99, -89.99, 40.0]), rnd.choice([rnd.uniform(-180, 180), 179.999, -179.999, 180.0, -180.0, 0.0]))
    crowd = [(rnd.uniform(39, 41), rnd.uniform(-87, -85)) for _ in range(80)]
    points = [(k, *place()) for k in range(250)] + [(300, None, 1.0), (301, float("nan"), 0.0)]
    for spots in ([place() for _ in range(40)] + crowd, crowd, [(90.0, 0.0), (90.0, 120.0), (-90.0, 7.0)]):
        sites = [(k, *x) for k, x in enumerate(spots)] + [(900, 1.0, None)]
        p, s = spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(sites, "s int, lat double, lon double")
        pairs = p.join(s.select("s", F.col("lat").alias("a"), F.col("lon").alias("o"))).withColumn("d", haversine_miles(F.col("lat"), F.col("lon"), F.col("a"), F.col("o"))).where("d is not null and not isnan(d)")
        want = {r.p: (r.x.s, r.x.d) for r in pairs.groupBy("p").agg(F.min(F.struct("d", "s")).alias("x")).collect()}
        for cell in (1.0, 15.0):
            got = joins.nearest(p, "p", s, "s", cell)
            assert {r.p: (r.s, r.miles) for r in got.collect()} == want and len(want) == 250
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert joins.nearest(p, "p", s.limit(0), "s", cell=20.0).count() == 0


def test_nearest_in_a_crowd_measures_few(spark, monkeypatch):
    """Many points and sites in one place, and places that repeat: not every pair is measured."""
    rnd, seen = random.Random(5), spark.sparkContext.accumulator(0)

    def counted(a, b, c, d):
        def measure(*x):
            seen.add(1)
            a, b, c, d = map(math.radians, x)
            h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
            return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 0.621371

        return F.udf(measure, "double")(a, b, c, d)

    spot = lambda: (rnd.uniform(40, 40.2), rnd.uniform(-86, -85.8))
    points, sites = [spot() for _ in range(150)] * 2, [spot() for _ in range(150)] * 2
    p = spark.createDataFrame([(k, *x) for k, x in enumerate(points)], "p int, lat double, lon double")
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(sites)], "s int, lat double, lon double")
    want = {r.p: (r.s, r.miles) for r in joins.nearest(p, "p", s, "s").collect()}
    pairs = p.join(s.select("s", F.col("lat").alias("a"), F.col("lon").alias("o"))).withColumn("d", haversine_miles(F.col("lat"), F.col("lon"), F.col("a"), F.col("o")))
    assert want == {r.p: (r.x.s, r.x.d) for r in pairs.groupBy("p").agg(F.min(F.struct("d", "s")).alias("x")).collect()}
    monkeypatch.setattr(joins, "haversine_miles", counted)
    assert {r.p: r.s for r in joins.nearest(p, "p", s, "s").collect()} == {k: v[0] for k, v in want.items()} and seen.value < 3000


def test_merge_fallback_fills_row_by_row(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    one, two = spark.createDataFrame([(1, None), (2, 5)], "id int, v int"), spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "name string, v int")
    assert {r.name: r.v for r in joins.merge_fallback(left, one, ["id"], two, ["name"], ["v"]).collect()} == {"a": 7, "b": 5, "c": 9}


def test_token_match_tiers(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c d e"), (3, "x")], "r int, name string")
    ask = spark.createDataFrame([(1, ["a b c"], None), (2, ["a b c d"], None), (3, ["a q"], None), (4, [None, ""], None), (5, ["a b c"], 3), (6, None, None)], "e int, names array<string>, override int")
    got = {r.e: (r.r, r.confidence) for r in joins.match_tokens(ask, "e", "names", rows, "r", "name").collect()}
    assert got == {1: (1, "high"), 2: (2, "medium"), 3: (None, None), 4: (None, None), 5: (3, "override"), 6: (None, None)}


def test_token_match_sends_no_entities(spark, monkeypatch):
    """Whichever side is done first or compresses well, only counted few rows go to all executors; many words are shuffled."""
    words = ["red", "blue", "old", "new", "ring", "bolt", "plate", "gear"]
    names = [f"{a} {b} {c}" for a in words[:4] for b in words for c in words[4:]]
    rows = spark.createDataFrame([(n, n) for n in names], "r string, name string")
    ask = spark.range(3000).select(F.col("id").alias("e"), F.array(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")), F.lit("old gear zz")).alias("names"))
    ask = ask.withColumn("names", F.when(F.col("e") % 3 == 0, F.slice("names", 2, 1)).otherwise(F.transform("names", lambda x: F.concat(x, F.when(F.col("e") % 3 == 1, " more").otherwise("")))))
    got = {}
    for few in (20_000, 0):
        monkeypatch.setattr(lineage, "FEW", few, raising=False)
        df = joins.match_tokens(ask, "e", "names", rows, "r", "name")
        got[few] = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BuildLeft" not in plan and ("BroadcastExchange" in plan) == (few > 0)
    assert got[0] == got[20_000] and len(got[0]) == 3000 and {x[3] for x in got[0]} >= {"high", "low"}


def test_sequence_methods(spark):
    e, r = spark.createDataFrame([("Ohio State",), ("texas tec",), ("zzz",)], "e string"), spark.createDataFrame([("ohio",), ("Texas Tech",)], "r string")
    for method in ("levenshtein", "ratio"):
        got = {x.e: (x.r, x.match_type) for x in joins.match_sequences(e, "e", r, "r", method=method).collect()}
        assert got == {"Ohio State": ("ohio", "exact"), "texas tec": ("Texas Tech", "similar"), "zzz": (None, "none")}


def test_upsert_twice_is_once(spark):
    t, u = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "n", 1)], "k int, v string, seq int")
    once = store.upsert(t, u, ["k"], ["seq"])
    want = {(1, "a"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in store.upsert(once, u, ["k"], ["seq"]).collect()}


def test_wish_list_without_a_hit_keeps_all(spark):
    df = spark.createDataFrame([(1, "Rice"), (2, "Duke (NC)")], "id int, name string")
    wish = lambda w: {r.id for r in filters.wish_list(df, "name", None, spark.createDataFrame([(w,)], "w string"), "w").collect()}
    assert wish("duke") == {2} and wish("nobody") == {1, 2}


def test_wish_list_keeps_repeated_rows(spark):
    rows = [("Rice", 1, {"a": 1}), ("Rice", 1, {"a": 1}), ("Yale", 2, None), ("RICE (TX)", 3, None), (None, 4, None)]
    df = spark.createDataFrame(rows, "name string, v int, m map<string,int>")
    got = filters.wish_list(df, "name", None, spark.createDataFrame([("rice",), ("rice",)], "w string"), "w")
    assert got.columns == ["name", "v", "m"] and sorted((r.name, r.v, r.m) for r in got.collect()) == [("RICE (TX)", 3, None), ("Rice", 1, {"a": 1}), ("Rice", 1, {"a": 1})]
    assert filters.wish_list(df, "name", None, spark.createDataFrame([("x",)], "w string"), "w").count() == 5


def test_scores(spark):
    roster = spark.createDataFrame([("A", "S", "Jr", 850, 0, 0), ("B", "MB", "Fr", 0, 0, 0)], "team string, position string, class string, assists int, kills int, digs int")
    got = {r.team: r.vb_opp_score for r in score.opportunity(roster, "team", "Setter").collect()}
    assert abs(got["A"] - 2.575) < 0.01 and got["B"] == 3.0
    assert {r.vb_opp_score for r in score.opportunity(roster, "team", None).collect()} == {2.0}
    schools = spark.createDataFrame(
        [("Alpha", None, None, "A", 3.0, 1), ("Beta", 39.7684, -86.1581, "?", 2.0, None)], "name string, lat double, lon double, tier string, vb_opp_score double, rank int"
    ).withColumns({c: F.lit(None).cast("string") for c in ("airport_code", "airport_drive_time", "airport_notes")})
    out = {r.name: r for r in score.travel_and_fit(schools, 39.7684, -86.1581).collect()}
    assert (out["Alpha"].travel_difficulty, out["Alpha"].geo_score, out["Alpha"].drive_dist_mi) == (10, 1.5, 0.0)
    assert (out["Beta"].geo_score, out["Beta"].fit_score) == (3.0, 2.2)


def test_plans_stay_native(spark):
    for name in ("team_pivot", "dq_issues", "first_seen_dedup"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_lookup_of_short_and_long_terms(spark):
    names = ["Ohio State", "Ohio", "oh", "Iowa", "A", "San José", "io", None]
    terms = ["Ohio", "OHIO", "io", "IO", "a", "", "sé", "é", "zz", "q", "wa", "hio s", "o", None]
    n, t = spark.createDataFrame([(x,) for x in [*names, "Iowa"]], "n string"), spark.createDataFrame([(x,) for x in [*terms, "a"]], "t string")
    known = {x for x in names if x is not None}
    df = filters.tiered_lookup(t, "t", n, "n")
    got = {r.term: (r.tier, r.matches, r.found, r.status) for r in df.collect()}
    assert set(got) == set(terms) and got[None][1] == 0
    for x in (x for x in terms if x is not None):
        exact, loose = {y for y in known if y == x}, {y for y in known if x.lower() in y.lower()}
        hits = exact or loose
        assert got[x] == (None if not hits else 1 if exact else 2, len(hits), min(hits) if len(hits) == 1 else None, {0: "none", 1: "ok"}.get(len(hits), "several")), x
