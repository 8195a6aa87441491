"""Periodic runs against plain comparison of all periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.corpus import documents

from courtlens.llm import periodic
from courtlens.llm.queries import op12_runs

SF = "/root/testdata/sf0.001"


def brute(w, shortest=12):
    """All stretches of at least two periods, by every period; the smallest period of each."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k + p < len(w):
            a = k
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k - a >= p:
                out.setdefault((a, k + p), p)
            k += 1
    return sorted(((a, b - a, q) for (a, b), q in out.items() if b - a >= max(shortest, 2 * q)), key=lambda x: (x[0], x[2]))


def spoilt(u, times, at, letter):
    w = list(u * times)
    for k in at:
        w[k % len(w)] = letter
    return w


letters = st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=40)
rounds = st.builds(spoilt, letters, st.integers(1, 12), st.lists(st.integers(0, 400), max_size=2), st.sampled_from([b"a", b"c"]))
pieces = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=4), st.integers(1, 60)), min_size=1, max_size=6)
joined = pieces.map(lambda parts: [x for u, n in parts for x in (u * n)[:n]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(letters, rounds, joined), max_size=4))
def test_runs_are_all_runs(texts):
    for shortest in (2, 12):
        assert periodic.runs_of(texts, shortest) == [brute(w, shortest) for w in texts]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("name", ["one letter", "fibonacci", "touching", "blocks", "thue", "steps"])
def test_hard_texts(name):
    rnd = random.Random(4)
    w = {
        "one letter": [b"a"] * 3000,
        "fibonacci": fibonacci(900),
        "touching": ([b"a", b"b"] * 60 + [b"a"]) * 2 + [b"c"] + ([b"a", b"b", b"c"] * 40 + [b"a"]) * 2,
        "blocks": ([b"a"] * 90 + [b"b"]) * 5 + ([b"a"] * 91 + [b"b"]) * 3,
        "thue": [b"ab"[bin(k).count("1") % 2 :][:1] for k in range(700)],
        "steps": [x for n in range(1, 40) for x in [b"a"] * n + [b"b"]],
    }[name]
    other = [rnd.choice([b"a", b"b"]) for _ in range(500)]
    assert periodic.runs_of([w, other, [], w], 4) == [brute(w, 4), brute(other, 4), [], brute(w, 4)]


def test_each_part_of_the_method_is_needed(monkeypatch):
    w = ([b"a", b"b"] * 60 + [b"a"]) * 2
    assert periodic.runs_of([w]) == [brute(w)]
    with monkeypatch.context() as m:
        m.setattr(periodic, "touching", lambda *_: None)
        assert periodic.runs_of([w]) != [brute(w)]
    rnd = random.Random(1)
    w = [b"%d" % rnd.randrange(1000) for _ in range(40)] * 3
    with monkeypatch.context() as m:
        m.setattr(periodic, "synchronising", lambda h, *_: periodic.np.zeros(0, dtype=int))
        assert periodic.runs_of([w]) == [[]] and brute(w)


def test_long_text_is_quick():
    rnd = random.Random(2)
    w = [b"%d" % rnd.randrange(50_000) for _ in range(200_000)]
    w += w[-30_000:] * 2
    (got,) = periodic.runs_of([w])
    assert (170_000, 90_000, 30_000) in got or any(q == 30_000 and n >= 90_000 for _, n, q in got)


def test_find_runs(spark):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns with the operator's own names."""
    extra = spark.createDataFrame([(200, " ".join(["x y z"] * 30), "en", "a", 0), (200, " ".join(["x y z"] * 30), "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents(spark).unionByName(extra)
    rows = docs.collect()
    clash = docs.withColumns({c: F.lit("x") for c in ("_text", "_c0", "start", "length", "words", "runs")})
    got = periodic.find_runs(clash)
    assert got.columns == [*docs.columns, "_text", "_c0", "start", "length", "words", "n_words", "runs", "collapsed"]
    want = []
    for r in rows:
        w = (r.text or "").encode().split()
        runs = brute(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        want.append(repr((r.doc_id, r.text, len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    assert sorted(repr((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got.collect()) == sorted(want)
    assert [r.collapsed for r in got.where("doc_id = 200").collect()] == ["x y z"] * 2
    assert periodic.find_runs(docs.limit(0)).count() == 0
    assert [(r.n_words, r.runs) for r in periodic.find_runs(spark.createDataFrame([(None,)], "t string"), "t").collect()] == [(0, [])]


def test_longest_run_settles_ties(spark):
    make = lambda runs: spark.createDataFrame([(runs,)], "runs array<struct<start:long,length:long,period:long>>").select(periodic.longest_run(F.col("runs")).alias("x")).first().x
    assert make([]) is None
    assert tuple(make([(5, 12, 2), (1, 20, 3), (1, 20, 2), (0, 14, 7), (9, 20, 1)])) == (1, 20, 2)


def test_looped_texts(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 37))) for k in range(400)] + [(None, "a b"), (7, None), (9, "")]
    got = spark.createDataFrame(rows, "k long, t string").select("k", "t", periodic.looped(F.col("t"), F.col("k")).alias("x")).collect()
    changed = 0
    for r in got:
        w = (r.t or "").split()
        h = 1 if r.k is None else zlib.crc32(str(r.k).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.x.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        else:
            assert r.x == r.t
    assert changed > 20


def test_query(spark):
    """The registered query against plain comparison on all documents of the smallest tables."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_runs(spark, SF).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        w, h = (docs[r.doc_id] or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone))]
        assert tuple(r) == (r.doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha), r.doc_id
