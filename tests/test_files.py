"""Readers, writers, versions and streams, over files in a temporary folder."""

import json

from pyspark.sql import functions as F

from courtlens.operators import columns, quality, store
from courtlens.sources import files
from courtlens.streaming.incremental import stream_upserts


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TeamID,Player,GP\n001,Ann,3\n002,,x\n,Bo,1\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "TeamID string, Player string, GP double", ["TeamID", "GP"])
    assert [tuple(r) for r in df.collect()] == [("001", 3.0), ("002", None), (None, 1.0)]
    assert files.read_csv_text(spark, str(tmp_path / "a.csv"), "Player").count() == 2
    files.write_csv(df.coalesce(1), str(tmp_path / "out"), ["GP", "TeamID"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["GP", "TeamID"]


def test_json(spark, tmp_path):
    (tmp_path / "teams.json").write_text(json.dumps([{"team": "A", "aliases": ["a"]}, {"team": "B"}]))
    df = files.read_json_array(spark, str(tmp_path / "teams.json"), "team string, aliases array<string>, tier string", {"tier": "B"})
    assert [(r.team, r.aliases, r.tier) for r in df.orderBy("team").collect()] == [("A", ["a"], "B"), ("B", None, "B")]
    (tmp_path / "cache.json").write_text(json.dumps({"teams": {"A": {"coaches": [{"name": "X"}]}}}))
    cache = files.read_keyed_json(spark, str(tmp_path / "cache.json"), "struct<coaches:array<struct<name:string>>>", under="teams")
    found = files.lookup_keyed(df.select("team"), "team", cache, "team", "coaches").orderBy("team").collect()
    assert [[c.name for c in r.coaches] for r in found] == [["X"], []]


def test_lines(spark, tmp_path):
    (tmp_path / "incoming_players_2025.txt").write_text("a\nb")
    (tmp_path / "incoming_players_2026.txt").write_text("c")
    lines = files.read_lines(spark, str(tmp_path / "incoming_players_*.txt"))
    assert [r.year for r in files.years(lines).collect()] == [2025, 2026]
    assert [r.line for r in files.lines_of_year(lines, 2025).orderBy("pos").collect()] == ["a", "b"]
    assert [r.line for r in files.lines_of_year(lines, 1999).collect()] == ["c"]
    assert {r.file for r in files.list_files(spark, str(tmp_path)).collect()} == {"incoming_players_2025.txt", "incoming_players_2026.txt"}


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    said = [f"line {k} " + "x" * (k % 50) for k in range(5000)] + ["", "Analyzing team: A", "ERROR last", ""]
    (tmp_path / "a b+1 2025.txt").write_text("\n".join(said) + "\n")
    (tmp_path / "crlf.txt").write_bytes(b"Analyzing team: B\r\nfine\r\n\r\nWARNING")
    (tmp_path / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = files.read_lines(spark, str(tmp_path / "*.txt"))
        assert spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions() > 8
        rows = lines.orderBy("file", "pos").collect()
        assert [r.line for r in rows if r.year == 2025] == said and [r.pos for r in rows if r.file == "a b+1 2025.txt"] == list(range(len(said)))
        assert [(r.pos, r.line) for r in rows if r.file == "crlf.txt"] == [(0, "Analyzing team: B"), (1, "fine"), (2, ""), (3, "WARNING")]
        found = quality.log_scan(lines.select(F.col("file").alias("source"), "pos", "line")).first()
        assert tuple(found) == (1, 1, 2, 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_that_dont_fit_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TeamID,GP\n001,3\n002,x\n003\n004,5,6\n,7\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "TeamID string, GP double", faults=True)
    found = files.fault_rows(df, "roster").collect()
    assert {(r.check, r.entity, r.detail) for r in found} == {("unreadable_row", "roster", x) for x in ("002,x", "003", "004,5,6")}
    assert sorted(map(tuple, files.sound_rows(df).collect()), key=str) == [("001", 3.0), (None, 7.0)]
    (tmp_path / "t.json").write_text('[{"team": "A", "n": 1}, {"team": "B", "n": "many"}]')
    (tmp_path / "u.json").write_text('{"team": ')
    df = files.read_json_array(spark, str(tmp_path / "*.json"), "team string, n int", {"n": 0}, faults=True)
    assert len(files.fault_rows(df, "teams").collect()) == 2 and [tuple(r) for r in files.sound_rows(df).collect()] == [("A", 1)]


def test_versions_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2024), (2, "b", 2025)], "id int, v string, season int")
    store.publish(df, str(tmp_path / "t"), "00000001")
    store.publish(df.where("id = 1"), str(tmp_path / "t"), "00000002")
    assert store.current(spark, str(tmp_path / "t")).count() == 1
    files.write_parquet(df, str(tmp_path / "p0"))
    store.write_partitions(df, str(tmp_path / "p"), "season")
    store.write_partitions(df.where("season = 2025").withColumn("v", F.lit("c")), str(tmp_path / "p"), "season")
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a"), (2, "c")}


def test_stream_of_updates(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.publish(base, str(tmp_path / "t"), "00000000")
    base.where("id = 2").withColumn("v", F.lit("new")).withColumn("seq", F.lit(1)).write.parquet(str(tmp_path / "in"))
    q = stream_upserts(spark, str(tmp_path / "in"), "id int, v string, seq int", str(tmp_path / "t"), ["id"], ["seq"], str(tmp_path / "cp"))
    q.awaitTermination()
    assert {(r.id, r.v) for r in store.current(spark, str(tmp_path / "t")).collect()} == {(1, "a"), (2, "new")}


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Rank int, Team int, kills int")
    assert columns.resolve_column(df, ["name", "TEAM"]) == "Team"
    assert columns.resolve_column(df, ["TEAM"], ignore_case=False) is None
    assert columns.detect_columns(df, {"rank": ["rank"], "team": ["school", "team"], "record": ["record"]}) == {"rank": "Rank", "team": "Team", "record": None}
    assert columns.keep_existing(columns.ensure_columns(df, {"x": 1}), ["x", "kills", "none"]).columns == ["x", "kills"]
    assert columns.rename(df, {"Rank": "rank", "no": "x"}).columns == ["rank", "Team", "kills"]
    assert columns.stat_columns(df, df.select("Team")) == ["Rank", "kills"]
