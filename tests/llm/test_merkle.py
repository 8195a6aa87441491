"""Merkle manifests against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tests.llm.corpus import documents

from courtlens.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, **now):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (now.get(c, r[c]) for c in COLUMNS)))


def tree(nodes):
    """All levels up to the single node, and each node's siblings on its way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([sha("".join(own[k : k + 8])) for k in range(0, len(own), 8)])
    ways = []
    for k in range(len(nodes)):
        way = []
        for own in levels[:-1]:
            first = k - k % 8
            way.append((own[first:k], own[k + 1 : first + 8]))
            k //= 8
        ways.append(way)
    return levels[-1][0], ways


def brute(rows, now):
    groups = {}
    for r in rows:
        groups.setdefault("" if r.lang is None else "=" + r.lang, []).append(r)
    names = sorted(groups, key=lambda x: x.encode())
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))
    sorts = {g: sorted(groups[g], key=order) for g in names}
    made = {g: tree([leaf(r) for r in sorts[g]]) for g in names}
    root, outer = tree([made[g][0] for g in names])
    out = []
    for g, above in zip(names, outer):
        for r, way in zip(sorts[g], made[g][1]):
            way = way + above
            folded = leaf(r, text=now(r))
            for before, after in way:
                folded = sha("".join([*before, folded, *after]))
            siblings = "".join(x for before, after in way for x in (*before, *after))
            out.append((r.doc_id, leaf(r), made[g][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


def lowered(r):
    return r.text.translate(str.maketrans("AÄW", "aÄw")) if r.text and r.doc_id is not None and r.doc_id % 2 == 0 else r.text


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    langs = ["en"] * 60 + ["de"] * 8 + ["x"] * 9 + ["é", "z", None, "", "aa", "ab", "ac", "ad", "ae", "af", "ag"]
    rows = [(k if k % 50 else None, f"Text A{k}", rnd.choice(langs), rnd.choice(["a", None]), rnd.choice([None, k])) for k in range(700)]
    rows += [(900, "W", "en", None, 1)] * 20 + [(None, None, None, None, None)] * 11
    return documents(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).cache()


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(docs, levels):
    want = brute(docs.collect(), lowered)
    clash = docs.withColumns({c: F.lit("x") for c in ("group", "leaf", "n", "idx", "pos", "_key", "key", "other", "rank", "a.b")})
    now = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "AW", "aw")).otherwise(F.col("text"))
    got = merkle.manifest(clash, altered={"text": now}, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(x[-1] for x in want) and any(not x[-1] for x in want)


def test_proofs_lead_to_the_root(docs):
    got = merkle.manifest(docs, proofs=True, levels=2)
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0 and got.where("not verified").count() == 0
    told = F.sha2(F.array_join(F.flatten(F.transform("proof", lambda x: x["others"])), ""), 256)
    assert got.where(told != F.col("proof_sha256")).count() == 0
    assert got.where(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    rows = [(k, "t", "en", "s", 1) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, merkle.manifest(docs, levels=1).collect()), key=str) == brute(docs.collect(), lambda r: r.text) if n else merkle.manifest(docs).count() == 0


def test_other_keys_and_large_numbers(spark):
    docs = spark.createDataFrame([(2**62 + 1, "a"), (2**62, "b"), (None, "c")], "k long, v string").withColumn("g", F.lit(1))
    got = merkle.manifest(docs, "k", ("k", "v"), "g").collect()
    assert {r.k for r in got} == {2**62 + 1, 2**62, None} and len({r.root for r in got}) == 1
    assert got[0].root == sha(sha("-1:c") + sha(f"19:{2**62}1:b") + sha(f"19:{2**62 + 1}1:a"))
