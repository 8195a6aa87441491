"""Work on single rows is dealt to many tasks, however few the files' splits are."""

import pytest

from courtlens.operators import extract
from courtlens.operators.lineage import spread
from courtlens.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["page_objects", "document_keys"])
def test_rows_of_one_file_are_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_spread_keeps_rows(spark):
    df = spark.range(1000, numPartitions=1).selectExpr("id % 3 as k", "cast(null as string) as n")
    assert sorted(spread(df).collect()) == sorted(df.collect()) and min(spread(df).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) > 150


def test_objects_are_looked_for_in_many_tasks(spark):
    df = spark.range(1000, numPartitions=1).selectExpr("id", "concat('{\"a\":{\"k\":', id, '}}') as j")
    found = extract.find_object(df, "id", "j", ["k"])
    assert "_dealt" in found._jdf.queryExecution().toString() and {(r.id, r.found["k"]) for r in found.collect()} == {(k, str(k)) for k in range(1000)}
