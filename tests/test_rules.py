"""Rules and operators on literal rows: text base, pages, incoming lines, schools, side tables, ties, and plans."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from courtlens.functions import dates
from courtlens.functions.text import clean, player_name, school_key
from courtlens.operators import aggregates, columns, extract, filters, incoming, joins, quality, ranks, score, store


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_unicode_blanks(spark):
    row = one(spark, s=" Ann  \t Lee　").select(clean("s").alias("a"), player_name(F.lit("12 Lee, Ann")).alias("b"), school_key(F.lit("The Ohio State University")).alias("c")).first()
    assert tuple(row) == ("Ann Lee", "Ann Lee", "ohio state")


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>O&#39;Neil &amp; Co&nbsp;X</p>", "O'Neil & Co X"), ("&#x27;a&#X2019;b&#8211;c", "'a’b–c"), ("&amp;lt;b&amp;gt; &lt;i&gt;", "&lt;b&gt; <i>"), ("a &unknown; &#0; b&", "a &unknown; � b&"),
        ("x<script>if (a &lt; b) {}</script>y", "x y"), ("Jos&eacute; &ldquo;Pep&rdquo; &#128512;", "José “Pep” 😀"), (None, ""),
    ],
)
def test_page_text(spark, html, want):
    assert spark.range(1).select(extract.page_text(F.lit(html))).first()[0] == want


CARDS = """
<div class="staff-list"><div class="staff-card"><div class="photo"><img src="/a.jpg"></div><div class="info"><h3>Ann O&#39;Neil</h3><div class="coach-title">Head Coach</div>
<a href="mailto:x">ann@u.edu</a><p>(317) 555-0100</p></div></div>
<li class="coach"><ul><li>Assistant Coach</li></ul><h4>Bo Lee</h4><div>bo@u.edu</div></li><div class="staff">nobody here</div></div><div>late@u.edu</div>
"""


def test_nested_staff_blocks(spark):
    pages = spark.createDataFrame([(1, "u", CARDS), (2, "u", "<div class='staff'><h3>Open End</h3> coach<div>"), (3, "u", None)], "page_id int, url string, html string")
    got = sorted((r.page_id, r.name, r.title, r.email, r.phone, r.photo) for r in extract.staff_contacts(pages).collect())
    assert got == [(1, "Ann O'Neil", "Head Coach", "ann@u.edu", "(317) 555-0100", "/a.jpg"), (1, "Bo Lee", "Assistant Coach", "bo@u.edu", "", None), (2, "Open End", "coach", "", "", None)]


def test_objects_at_any_depth(spark):
    deep = '{"a":' * 9 + '{"Label":1,"share":2,"x":"} ] { \\" ["}' + "}" * 9
    df = spark.createDataFrame([(1, deep), (2, '[{"label":3},[{"label":4,"Share":5}]]'), (3, "no json"), (4, None), (5, "7")], "k int, j string")
    got = {r.k: dict(r.found) for r in extract.find_object(df, "k", "j", ["label", "share"]).collect()}
    assert set(got) == {1, 2} and got[1]["Label"] == "1" and got[2]["Share"] == "5"
    assert extract.find_object(df.limit(0), "k", "j", ["label"]).count() == 0


def test_incoming_with_transfer_flag(spark):
    lines = ["Ann Lee - Early U - S", "Big Ten:", "Lee, Bo - U One - OH (So. Transfer)", "7 Cy - U Two - MB (Club X) - late", "only - two", "", "no parts"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string").withColumn("g", F.lit(1))
    got = [(r.conference, r["name"], r.school, r.position, r.is_transfer) for r in incoming.parse_transfers(df, ["g"], "pos", "line").orderBy("pos").collect()]
    assert got == [("", "Ann Lee", "Early U", "S", False), ("Big Ten", "Bo Lee", "U One", "OH", True), ("Big Ten", "Cy", "U Two", "MB", False)]


def test_enrich_schools(spark):
    schools = spark.createDataFrame(
        [("Alpha University", "Old", "5-1", None, None, 2.1, None), ("Beta", "Keep", "4-2", 7.0, "1-1", None, "Mine"), ("Gamma", "g", "x", None, None, None, "")],
        "name string, conference string, offense_type string, rpi_rank double, record string, vb_opp_score double, politics_label string",
    )
    pivot = spark.createDataFrame([("Alpha", "New", "6-2", "12", None, "very liberal campus", 2), ("Gamma", "G", "5-1", "3", "9-9", None, None)], "team string, conference string, offense_type string, rank string, record string, politics_label string, projected_setter_count int")
    aliases = spark.createDataFrame([("alpha university", "Alpha", 1)], "alias string, canonical string, ordinal int")
    contacts = spark.createDataFrame(
        [("Alpha", 2, 1, "Bo", "assistant coach", "bo@a.edu", ""), ("Alpha University", 1, 1, "Ann", "Head Volleyball Coach", "", "3175550100"), ("Alpha", 2, 2, "ann", "head coach", "ann@a.edu", ""), ("Beta", 1, 1, "Zed", "head", "", "")],
        "team string, source int, ordinal int, name string, title string, email string, phone string",
    )
    got = {r["name"]: r for r in score.enrich_schools(schools, "name", pivot, aliases, contacts, "S").collect()}
    a, b, g = got["Alpha University"], got["Beta"], got["Gamma"]
    assert (a.conference, a.offense_type, a.rpi_rank, a.record, a.vb_opp_score, a.politics_label) == ("New", "6-2", 12.0, "N/A", pytest.approx(2.5), "Very liberal")
    assert [tuple(c) for c in a.coaches] == [("Ann", "Head Coach", "ann@a.edu", "(317) 555-0100"), ("Bo", "Assistant Head Coach", "bo@a.edu", "")]
    assert (b.conference, b.record, b.vb_opp_score, b.politics_label, b.coaches) == ("Keep", "1-1", None, "Mine", [])
    assert (g.rpi_rank, g.record, g.vb_opp_score, g.coaches) == (3.0, "9-9", 2.5, [])


def test_side_tables_and_season_rows(spark):
    df = spark.createDataFrame([("A", "/img/logos/a.png", "", "IND", [(2024, 1), (2025, 2)]), ("B", None, "x", None, [(2023, 9)]), (None, "/c.png", "y", None, [])], "name string, logo string, air string, code string, stats array<struct<season:int,kills:int>>")
    made = columns.side_tables(df, "name", {"logo": columns.base_name("logo"), "airport": F.struct("air", "code"), "label": F.col("air")})
    assert {k: [r["name"] for r in v.orderBy("name").collect()] for k, v in made.items()} == {"logo": ["A"], "airport": ["A", "B"], "label": ["B"]}
    assert made["logo"].first().logo == "a.png"
    assert [r.s and r.s.kills for r in df.select(columns.season_row(F.col("stats"), 2025).alias("s")).collect()] == [2, 9, None]


def test_summary_rows_go(spark):
    df = spark.createDataFrame([("Ann",), ("TEAM",), ("Totals",), ("Opponent Totals",), ("Team Lee",)], "player string")
    assert {r.player for r in filters.drop_summary(df, "player").collect()} >= {"Ann", "Team Lee"}
    assert not {"TEAM", "Totals", "Opponent Totals"} & {r.player for r in filters.drop_summary(df, "player").collect()}


def test_orders_of_reports(spark):
    """Travel goes from easy to hard, pages from the best fit down; what is missing comes last."""
    rows = [("Alpha", 40, 200.0, 2.0), ("Beta", 10, 50.0, 2.9), ("Gamma", 25, 120.0, 2.3), ("Delta", None, None, None)]
    df = spark.createDataFrame(rows, "short string, travel_difficulty int, drive_dist_mi double, fit_score double")
    got = score.report_ranks(df, "short").collect()
    order = lambda c: [r.short for r in sorted(got, key=lambda r: r[c])]
    assert all(order(c) == ["Beta", "Gamma", "Alpha", "Delta"] for c in ("fit_rank", "travel_rank", "page_rank"))
    below = df.unionByName(df.limit(1).selectExpr("'Low' as short", "99 as travel_difficulty", "1d as drive_dist_mi", "-1d as fit_score"))
    got = {r.short: r for r in score.report_ranks(below, "short").collect()}
    assert (got["Delta"].fit_rank, got["Delta"].page_rank, got["Low"].page_rank, got["Low"].travel_rank) == (5, 4, 5, 4)


def test_rank_rows(spark):
    """Ranks are those of a sorted list, with nulls, ties, hot groups and equal rows; no task numbers all rows."""
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), rnd.choice([None, 1, 2, 3]), f"t{rnd.randint(0, 40)}") for _ in range(400)] + [(None, None, None)] * 60
    df = spark.createDataFrame(rows, "g string, v int, t string").repartition(5)
    got = ranks.rank_rows(df, [F.desc_nulls_last("v"), F.asc_nulls_last("t")], "n", ["g"], partitions=7)
    assert got.columns == ["g", "v", "t", "n"]
    for group in ("a", "b", None):
        mine = sorted(got.where(F.col("g").eqNullSafe(group)).collect(), key=lambda r: r.n)
        want = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or ""))
        assert [tuple(r[:3]) for r in mine] == want and [r.n for r in mine] == list(range(1, len(want) + 1))
    whole = ranks.rank_rows(df, [F.col("v")], partitions=5)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(1, 461))
    assert ranks.rank_rows(df.limit(0), [F.col("v")]).count() == 0
    clash = df.select("v", F.col("t").alias("a.b"), F.lit(1).alias("g 1"))
    assert ranks.rank_rows(clash, [F.col("v")]).columns == ["v", "a.b", "g 1", "rank"]


def test_ties_are_settled(spark):
    rows = [(1, 5, "b", {"m": 1}), (1, 5, "c", {"m": 2}), (1, 4, "z", None), (None, 9, "n", None)]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 4), "k int, o int, v string, m map<string,int>").repartition(3)
        assert [r.v for r in joins.last_by(df, ["k"], ["o"]).collect()] == ["c"]
        assert {r.v for r in joins.first_by(df.where("o = 5"), [F.col("k")], ["o"]).collect()} == {"b"}
        assert {r.v for r in store.keep_latest(df, ["k"], [F.desc("o")], 1).collect()} == {"b", "n"}


def test_run_of_an_audit(spark, tmp_path):
    """Counts come from the writes themselves, which read each table once; a run ends after it began."""
    audit, seen = store.Audit(), spark.sparkContext.accumulator(0)

    def looked(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = spark.range(1000).mapInPandas(looked, "id long")
    audit.observed("a", source).write.parquet(str(tmp_path / "a"))
    audit.observed("b", spark.range(0)).write.parquet(str(tmp_path / "b"))
    row = audit.row(spark, season=2025, notes=None).first()
    assert (row.season, row.notes, row.n_a, row.n_b) == (2025, None, 1000, 0) and seen.value == 1000
    assert row.finished > row.started
    at = datetime.datetime(2026, 1, 2, 3, 4)
    times = dates.run_times(F.lit(at))
    row = store.audit_row({"a": spark.range(3), "b": spark.range(0)}, times | {"season": 2025, "notes": None}).first()
    assert (row.started, row.season, row.notes, row.n_a, row.n_b) == (at, 2025, None, 3, 0) and row.finished > at
    assert store.audit_row({"a": spark.range(3)}, dates.run_times(F.lit(at), F.lit(at))).columns == ["started", "finished", "n_a"]


def test_current_reads_one_version(spark, tmp_path):
    for v in ("00000001", "00000002", "00000010"):
        folder = store.publish(spark.range(int(v)), str(tmp_path), v)
    now = store.current(spark, str(tmp_path))
    assert now.count() == 10 and store.current(spark, str(tmp_path), "00000010").count() == 2
    assert now.inputFiles() and all(folder in f for f in now.inputFiles())


def test_only_committed_versions_are_read(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        store.current(spark, path)
    store.publish(spark.range(3), path, "1")
    spark.range(9).write.parquet(f"{path}/data/of-one-that-died")
    spark.range(9).write.parquet(f"{path}/version=2")
    assert store.current(spark, path).count() == 3 and store.commits(spark, path).count() == 1
    with pytest.raises(ValueError):
        store.publish(spark.range(4), path, "1")
    store.publish(spark.range(4), path, "1", replace=True)
    assert store.current(spark, path).count() == 4


def test_two_publishers_cant_both_win(spark, tmp_path):
    """The second began before the first had committed."""
    path = str(tmp_path)
    store.publish(spark.range(1), path, "1")
    rival = spark.range(2).mapInPandas(lambda it: it, "id long")

    class Slow:
        sparkSession = spark

        class write:  # noqa: N801
            @staticmethod
            def parquet(to):
                store.publish(rival, path, "2")
                spark.range(5).write.parquet(to)

    with pytest.raises(store.PublishedMeanwhile):
        store.publish(Slow(), path, "3")
    assert store.current(spark, path).count() == 2
    assert [r.version for r in store.commits(spark, path).orderBy("number").collect()] == ["1", "2"]


def test_carried_values(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", None]), k, rnd.choice([None, None, None, f"v{k}"])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, pos int, v string").repartition(4)
    for chunk in (7, 50, 100_000):
        got = {(r.g, r.pos): r.last for r in ranks.carry_last(df, F.col("v"), ["g"], "pos", "last", chunk).collect()}
        now = {}
        for g, pos, v in rows:
            now[g] = v if v is not None else now.get(g)
            assert got[g, pos] == now[g]


def test_quality_rows_name_the_person(spark):
    df = spark.createDataFrame([("T", "Ann", "", "Q"), ("T", "Coach Bo", None, ""), ("U", "Cy", "S", "S")], "team string, name string, position string, position_raw string")
    staff = quality.non_player("name")
    got = {(r.check, r["name"], r.detail) for r in quality.issues(df, "team", [quality.issue("missing_position", F.col("position").isNull() | (F.col("position") == ""), F.lit("")), quality.issue("non_player", staff.isNotNull(), staff)], "name").collect()}
    assert got == {("missing_position", "Ann", ""), ("missing_position", "Coach Bo", ""), ("non_player", "Coach Bo", "coach")}
    assert [tuple(r) for r in quality.unparsed_examples(df, {"position": "position_raw"}, "name").collect()] == [("position", "Q", 1, ["Ann"])]


def keys(rnd, n):
    said = []
    for _ in range(n):
        k = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 24))).strip() or "x"
        said += [k, "".join(c for c in k if rnd.random() > 0.08) or "y", k + rnd.choice(["", "z", " zz"])]
    return sorted(set(said))


@pytest.mark.parametrize("method", ["levenshtein", "ratio"])
def test_close_keys_meet(spark, method):
    """Blocking by letter pairs loses no pair that reaches the threshold."""
    rnd = random.Random(5)
    left, right = keys(rnd, 25), keys(rnd, 25) + keys(random.Random(5), 20)
    a = spark.createDataFrame([(x, x) for x in left], "e string, k string")
    b = spark.createDataFrame([(x, x) for x in sorted(set(right))], "r string, m string")
    met = {(r.k, r.m) for r in joins.near_keys(a, b, method, 0.78).collect()}

    def levenshtein(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    like = (lambda x, y: 1 - levenshtein(x, y) / max(len(x), len(y))) if method == "levenshtein" else (lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())
    want = {(x, y) for x in left for y in set(right) if like(x, y) >= 0.78}
    assert len(want) > 50 and want <= met


def test_common_words_do_not_meet(spark):
    """Names that share only words which all have are never paired; those with enough in common are found."""
    rows = [(k, f"north south {w}") for k, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    r = spark.createDataFrame(rows, "row int, name string")
    e = spark.createDataFrame([(1, ["north south gamma x"]), (2, ["north south nothing"]), (3, ["alpha"])], "e int, names array<string>")
    got = {x.e: (x.row, x.confidence) for x in joins.match_tokens(e, "e", "names", r, "row", "name").collect()}
    assert got == {1: (2, "low"), 2: (None, None), 3: (None, None)}


def test_no_nested_loops_over_two_tables(spark):
    t = spark.createDataFrame([("abc",), ("zabcz",)], "n string")
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan(joins.match_sequences(t, "n", t.withColumnRenamed("n", "m"), "m"))
    got = {(r.term, r.status) for r in filters.tiered_lookup(spark.createDataFrame([("ABC",), ("b",), ("zabcz",), ("qqq",)], "t string"), "t", t, "n").collect()}
    assert got == {("ABC", "several"), ("b", "several"), ("zabcz", "ok"), ("qqq", "none")}


def test_first_items_of_groups(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "z"), ("b", None), (None, "q")], "g string, i string")
    assert {(r.g, r["items"], r.more) for r in aggregates.top_with_rest(df, "g", "i", 2).collect()} == {("a", "x, y", 1), ("b", "", 0)}
