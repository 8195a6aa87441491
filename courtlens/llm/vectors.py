"""Embedding near-duplicates by an exact metric range join: pivots partition the vectors, the triangle inequality sets
how far a vector is copied over cell borders, and the cells join independently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.blocks import FIELDS, join_blocks, meets
from courtlens.llm.common import checkpoint, ship
from courtlens.llm.components import components

#: Vectors of a block that a task holds at once, and the most pivots (with their radii they bound what is broadcast).
BLOCK, MAX_PIVOTS = 4_096, 1_024
#: The most tasks that blocks are dealt to.
MAX_TASKS = 20_000
#: Vectors that are compared with all pivots at once.
ROWS = 2_048
#: Between cosines this near to the threshold the single-precision product doesn't decide.
UNSURE = 1e-4


def _unit(raw, width: int) -> np.ndarray:
    """Rows of unit length in double precision, padded with zeros to one width."""
    out = np.zeros((len(raw), width))
    for k, x in enumerate(raw):
        out[k, : len(x)] = x
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _assign(pivots: np.ndarray, width: int):
    """The cell of each vector (its nearest pivot) and its distance to the pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                cos = _unit(pdf["v"].iloc[a : a + ROWS], width) @ pivots.T
                yield pd.DataFrame({"cell": cos.argmax(1), "far": np.sqrt(np.maximum(0, 2 - 2 * cos.max(1)))})

    return run


def _deal(pivots: np.ndarray, width: int, parts: np.ndarray, near: np.ndarray, far: np.ndarray, radius: float, kind: str):
    """Each vector to a block of its own cell, and as a guest to blocks of the cells that a neighbour may lie in.

    A neighbour u of v lies in cell j only if v is within ``radius`` of the cell's ring about its pivot, and within
    ``radius`` of the half space nearer to pivot j than to v's own pivot. A pair of blocks meets in one of the two.
    """
    firsts = np.concatenate([[0], np.cumsum(parts)])
    between = np.sqrt(np.maximum(1e-12, 2 - 2 * pivots @ pivots.T))
    slack = radius + 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[a : a + ROWS] for whole in batches for a in range(0, len(whole), ROWS)):
            unit = _unit(pdf["v"], width)
            cos = unit @ pivots.T
            own = cos.argmax(1)
            dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
            open_ = (dist <= far + slack) & (dist >= near - slack)
            open_ &= (cos.max(1)[:, None] - cos) / between[own] <= slack
            open_[np.arange(len(own)), own] = True
            home = firsts[own] + (pdf["uid"].to_numpy().view(np.uint64) % parts[own].astype(np.uint64)).astype(np.int64)
            row, cell = np.nonzero(open_ & (parts > 0))
            times = parts[cell]
            row, block = np.repeat(row, times), np.repeat(firsts[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            mine = home[row]
            both = meets(block, mine)
            row, block = row[both], block[both]
            data = np.zeros((len(unit), width), dtype=kind)
            for k, x in enumerate(pdf["v"]):
                data[k, : len(x)] = x
            for a in range(0, len(row), 4_096):
                r, b = row[a : a + 4_096], block[a : a + 4_096]
                yield pd.DataFrame({
                    "block": b, "guest": (b != home[r]), "uid": pdf["uid"].to_numpy()[r], "n": pdf["n"].to_numpy()[r],
                    "unit": [data[x].tobytes() for x in r],
                })

    return run


def _load(kind: str):
    """Rows of unit length from vectors as they came, which have single precision if the table's have."""

    def load(raw: list[bytes]) -> np.ndarray:
        rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    return load


def _hits(threshold: float):
    def hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, right = np.zeros((len(a), len(b)), dtype=bool), b.astype(np.float32).T
        for k in range(0, len(a), 1_024):
            cos = a[k : k + 1_024].astype(np.float32) @ right
            out[k : k + 1_024] = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < UNSURE)):
                out[k + i, j] = a[k + i] @ b[j] >= threshold
        return out

    return hits


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are joined once and counted by weight, so a large group of copies is one vector. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing and are kept. Shorter vectors count as
    padded with zeros. Rows with equal ids stay separate rows; a null id is no component's id unless it stands alone.
    Equal vectors are recognised by a 64-bit hash of their components. An empty table gives an empty table; other
    columns are ignored, whatever their names.
    """
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # no negative zeros
    rows = rows.withColumn("uid", F.when(F.coalesce(finite, F.lit(False)), F.xxhash64("v")))
    one = checkpoint(
        rows.where("uid is not null").groupBy("uid").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("v").alias("v"))
    )
    facts = one.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    found = one.select("uid", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("links")).limit(0)
    if facts["n"]:
        width, count = facts["width"], int(min(max_pivots, max(1, facts["n"] // block)))
        pivots = _unit([x["v"] for x in one.orderBy(F.xxhash64("uid"), "uid").limit(count).select("v").collect()], width)
        parts, near, far = np.zeros(count, dtype=np.int64), np.full(count, np.inf), np.full(count, -np.inf)
        cells = one.select("v").mapInPandas(_assign(pivots, width), "cell int, far double").groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far"))
        for x in cells.collect():
            parts[x["cell"]], near[x["cell"]], far[x["cell"]] = -(-x["n"] // block), x["near"], x["far"]
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        # several blocks a task where there are very many
        spread = max(2, min(MAX_TASKS, int(parts.sum())))
        dealt = (
            one.select("uid", "n", "v").mapInPandas(_deal(pivots, width, parts, near, far, radius, kind), "block long, guest boolean, uid long, n long, unit binary")
            .repartition(spread, "block").sortWithinPartitions("block", "guest", "uid")
        )
        linked = checkpoint(dealt.mapInArrow(join_blocks(_load(kind), _hits(threshold)), FIELDS))
        counts = linked.where("other is null").groupBy("uid").agg(F.sum("links").alias("links"))
        nodes = components(linked.where("other is not null"), "uid", "other")
        found = counts.join(nodes.withColumnRenamed("node", "uid"), "uid", "left")
    members = one.select("uid", "least", "n").join(found, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    members = members.join(least, "component").select("uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "uid").join(members, "uid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("uid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
