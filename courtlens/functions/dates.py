"""Season arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_year(ts: Column) -> Column:
    """August to December belong to their own year, earlier months to the year before."""
    return F.when(F.month(ts) >= 8, F.year(ts)).otherwise(F.year(ts) - 1)


def incoming_year(ts: Column) -> Column:
    return F.when(F.month(ts) >= 8, F.year(ts) + 1).otherwise(F.year(ts))


def run_times(started: Column, finished: Column | None = None) -> dict[str, Column]:
    """started and finished of a run as two instants: when it began, and now unless another one is given."""
    return {"started": started.cast("timestamp"), "finished": F.current_timestamp() if finished is None else finished.cast("timestamp")}


def season_label(year: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))
