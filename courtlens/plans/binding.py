"""Helpers that bind operators to the given tables.

``cycle`` walks through literals by a key, so that rules for single values run over a whole table. SQL twins cycle
through the results that the rule must give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.sources.files import read_table

Query = Callable[[SparkSession, str], DataFrame]


def cycle(key: str, values: Sequence[object]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def sql_literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def cycle_sql(key: str, values: Sequence[object]) -> str:
    return f"list_extract([{', '.join(map(sql_literal, values))}], cast({key} % {len(values)} + 1 as integer))"


def literal_query(table: str, key: str, cases: dict[str, tuple[Sequence[object], Callable[[Column], Column], Sequence[object]]]) -> tuple[Query, str]:
    """For each output column: literals, the rule, and the results it must give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, table, key)
        return df.select(key, *[rule(cycle(key, inputs)).alias(name) for name, (inputs, rule, _) in cases.items()])

    for name, (inputs, _, expected) in cases.items():
        if len(inputs) != len(expected):
            raise ValueError(f"{name} has {len(inputs)} literals and {len(expected)} results")
    columns = ", ".join(f"{cycle_sql(key, expected)} as {name}" for name, (_, _, expected) in cases.items())
    return run, f"select {key}, {columns} from {table}"


def half_even_sql(x: str, digits: int) -> str:
    return f"(round_even(({x}) * {float(10**digits)}, 0) / {float(10**digits)}::double)"
