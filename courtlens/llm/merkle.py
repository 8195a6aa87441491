"""Merkle manifests: a hash tree over a dataset, with a proof for each row, by a cogrouped exchange of subtrees.

A row's leaf is the sha256 of its columns. The leaves of each group, in order of the key, are reduced eight at a time to
the group's subroot, and the subroots likewise to the root. A subtree of some levels (of 8**4 leaves) is a superblock:
the leaves are dealt by superblock and reduced to its node by native expressions; the nodes above, one for thousands of
rows, are reduced level by level; on the way down each superblock gets the runs of eight that its ancestors stand in.
Then leaves and these outer nodes are cogrouped by superblock, where one pass reduces the leaves again, joins each leaf's
proof from siblings inside and outside, and folds leaf and proof to the root. No task sees more than a superblock.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint, column, ship
from courtlens.operators.ranks import rank_rows

#: Nodes of a run, and levels of a superblock.
RUN, LEVELS = 8, 4
_PROOF = "array<struct<at:int,others:array<string>>>"


def leaf_hash(*values: Column) -> Column:
    """sha256 of values: each ``-`` if null, else its length in UTF-8 bytes, a colon, and itself as text."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def _upper(nodes: Column) -> Column:
    """The nodes above: sha256 of each run's digests as text."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * RUN + 1, F.lit(RUN)), ""), 256))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """(group, idx, digest, kids) of the levels above (group, idx, digest), up to a node a group.

    The first node of a group, if it has no neighbour, is the group's only one and goes up as it is; any other run is
    hashed. The number of levels follows from the largest index, which is all that reaches the driver.
    """
    out, most = [], nodes.agg(F.max("idx")).first()[0] or 0
    while most > 0:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = nodes.groupBy("group", F.floor(F.col("idx") / RUN).cast("long").alias("idx")).agg(kids.alias("kids"))
        nodes = checkpoint(up.withColumn("digest", F.when(_alone(), F.get("kids", 0)).otherwise(F.sha2(F.array_join("kids", ""), 256))))
        out.append(nodes)
        most //= RUN
    return out


def _alone() -> Column:
    return (F.col("idx") == 0) & (F.size("kids") == 1)


def _paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(group, idx, path) of the nodes below ``levels``: the runs from a node to the group's top, and on with the ``path``
    that ``top`` (group, path) has for it."""
    paths = top.select("group", F.lit(0).cast("long").alias("idx"), "path")
    for level in reversed(levels):
        run = lambda k: F.array(F.struct(k.cast("int").alias("at"), F.col("kids").alias("nodes"), F.lit(True).alias("inner")))
        kids = level.join(paths, ["group", "idx"]).select("group", "idx", "kids", "path", F.posexplode("kids").alias("k", "_d"))
        paths = kids.select("group", (F.col("idx") * RUN + F.col("k")).alias("idx"), F.when(_alone(), F.col("path")).otherwise(F.concat(run(F.col("k")), "path")).alias("path"))
    return paths


def _sha(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _finish(levels: int, proofs: bool):
    """Reduce a superblock's leaves, join each leaf's proof from there and from the outer nodes, and fold it to the root."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        tree = [[x.encode() for x in leaves["leaf"]]]
        while len(tree) <= levels and (len(tree[-1]) > 1 or leaves["idx"].iloc[0] > 0):
            own = tree[-1]
            tree.append([_sha(own[k : k + RUN]) for k in range(0, len(own), RUN)])
        above = [(int(g["own"].to_numpy().argmax()), [x.encode() for x in g["digest"]], bool(g["inner"].iloc[0])) for _, g in outer[outer["level"] >= 0].sort_values(["level", "at"]).groupby("level")]
        subroot, root = tree[-1][0], b""
        for k, (at, nodes, inner) in enumerate(above):
            if inner and nodes[at] != subroot:
                raise ValueError("a superblock doesn't reduce to the node that the tree has for it")
            subroot = _sha(nodes) if inner else subroot
        around = [(nodes[:at], nodes[at + 1 :]) for at, nodes, _ in above]
        far = b"".join(x for before, after in around for x in (*before, *after))

        def fold(digest: bytes, runs: list[tuple[list[bytes], list[bytes]]]) -> bytes:
            for before, after in runs:
                digest = _sha([*before, digest, *after])
            return digest

        root = fold(tree[-1][0], around)
        proof, folded, paths = [], [], []
        for k, other in enumerate(leaves["other"]):
            inside, at = [], k
            for nodes in tree[:-1]:
                first = at - at % RUN
                inside.append((nodes[first:at], nodes[at + 1 : first + RUN]))
                at //= RUN
            near = b"".join(x for before, after in inside for x in (*before, *after))
            proof.append(hashlib.sha256(near + far).hexdigest())
            folded.append(fold(tree[0][k] if other is None else other.encode(), inside + around).decode())
            if proofs:
                paths.append([{"at": len(before), "others": [x.decode() for x in (*before, *after)]} for before, after in inside + around])
        out = leaves[["group", "key", "leaf"]].assign(subroot=subroot.decode(), root=root.decode(), proof_sha256=proof, folded_root=folded)
        return out.assign(proof=paths) if proofs else out

    return run


def manifest(docs: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", altered: dict[str, Column] | None = None, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, and with ``proofs`` its ``proof``.

    ``columns`` make the leaf. Leaves of a group ascend by key (null first, ties by the leaf); groups ascend bytewise as
    text (null first). ``proof``: for each run on the way to the root, where the row's node stands in it and the digests
    of the others; proof_sha256 is the hash of all of them in a row. ``altered`` replaces columns by what was read later:
    folded_root is what the row as it is then and the proof fold to, and verified whether that is the root.

    Nulls in any column have a mark of their own, unlike empty texts; repeated rows are leaves each; texts of any length
    are hashed where they are read; other columns, whatever their names, play no part; an empty table gives no row.
    """
    ship(docs.sparkSession)
    kind = docs.select(column(key)).schema[0].dataType
    now = {c: (altered or {}).get(c, column(c)) for c in columns}
    changed = leaf_hash(*now.values()) if altered else F.lit(None).cast("string")
    # null sorts before every text
    group_key = F.coalesce(F.concat(F.lit("="), column(group).cast("string")), F.lit(""))
    leaves = docs.select(column(key).alias("_key"), group_key.alias("group"), leaf_hash(*map(column, columns)).alias("leaf"), changed.alias("other"))
    leaves = rank_rows(checkpoint(leaves), [F.asc_nulls_first("_key"), F.col("leaf")], "n", ["group"])
    size = RUN**levels
    leaves = leaves.select("group", F.floor((F.col("n") - 1) / size).cast("long").alias("idx"), ((F.col("n") - 1) % size).alias("pos"), F.col("_key").cast("string").alias("key"), "leaf", "other")
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf"))), lambda x: x["leaf"])
    step = lambda nodes, _: F.when((F.size(nodes) > 1) | (F.col("idx") > 0), _upper(nodes)).otherwise(nodes)
    blocks = leaves.groupBy("group", "idx").agg(own.alias("nodes")).select("group", "idx", F.get(F.aggregate(F.array_repeat(F.lit(0), levels), F.col("nodes"), step), 0).alias("digest"))
    blocks = checkpoint(blocks)
    above = _levels(blocks)
    tops = (above[-1] if above else blocks).select("group", "digest")
    ranked = checkpoint(rank_rows(tops, [F.col("group")], "n").select(F.lit("").alias("group"), (F.col("n") - 1).alias("idx"), "digest", F.col("group").alias("of")))
    none = F.array().cast("array<struct<at:int,nodes:array<string>,inner:boolean>>").alias("path")
    over = _paths(_levels(ranked.drop("of")), docs.sparkSession.range(1).select(F.lit("").alias("group"), none))
    outside = F.transform("path", lambda x: x.withField("inner", F.lit(False))).alias("path")
    paths = _paths(above, ranked.join(over, ["group", "idx"]).select(F.col("of").alias("group"), outside))
    outer = paths.select("group", "idx", F.posexplode_outer("path").alias("level", "run")).select("group", "idx", "level", F.col("run.at").alias("own_at"), "run.inner", F.posexplode_outer("run.nodes").alias("at", "digest"))
    outer = outer.select(F.col("group").alias("of"), F.col("idx").alias("block"), F.coalesce("level", F.lit(-1)).alias("level"), "at", (F.col("own_at") == F.col("at")).alias("own"), "inner", "digest")
    fields = "group string, key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", proof {_PROOF}" * proofs
    made = leaves.groupBy("group", "idx").cogroup(outer.groupBy("of", "block")).applyInPandas(_finish(levels, proofs), fields)
    rest = ["proof"] * proofs
    return made.select(F.col("key").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *rest)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    joined = lambda x, d: F.concat(F.array_join(F.slice(x["others"], F.lit(1), x["at"]), ""), d, F.array_join(F.slice(x["others"], x["at"] + 1, F.lit(RUN)), ""))
    return F.aggregate(proof, leaf, lambda d, x: F.sha2(joined(x, d), 256))
