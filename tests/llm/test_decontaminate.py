"""Benchmark passages in documents against a plain search for every window."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.corpus import documents

from courtlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def brute(text, items, window):
    """(words, hit words with their places, ids)."""
    w = split(text)
    plain, hit, ids = [x for x, _, _ in w], set(), set()
    for item, said in items:
        own = [x for x, _, _ in split(said)]
        for k in range(max(1, len(own) - window + 1)) if own else ():
            part = own[k : k + window]
            for a in range(len(plain) - len(part) + 1):
                if plain[a : a + len(part)] == part:
                    hit.update(range(a, a + len(part)))
                    ids.add("" if item is None else str(item))
    return len(w), hit, sorted(ids), w


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(9)
    base = documents(spark)
    texts = [r.text for r in base.collect() if r.text]
    items = [(k, " ".join(rnd.choice(texts).split()[:14]), None) for k in range(12)]
    items += [(10, "Wort1 naïve Ähre", "the of"), (200, "", " -- "), (None, "Don't", None), (3, "x", "und DER"), (7, None, " ".join(["w"] * 12)), (7, "日本語テキスト", None)]
    said = [("Über École, naïve ÄHRE ... wort1 NAÏVE Ähre!",), ("w\x85w don’t",), ("-- ?? ",), ("WORT1 NAÏVE",)]
    extra = spark.createDataFrame([(300 + k, x, "en", "a", 0) for k, (x,) in enumerate(said)], base.schema)
    bench = spark.createDataFrame(items, "item_id long, question string, answer string")
    return base.unionByName(extra).cache(), bench, [(k, t) for k, q, a in items for t in (q, a) if t is not None]


@pytest.mark.parametrize("part,window", [(4_000_000, 10), (60, 10), (200, 3)])
def test_find_benchmark(case, part, window):
    docs, bench, items = case
    clash = docs.withColumns({c: F.lit("x") for c in ("_text", "_c0", "_row", "item_id", "window", "hits", "question")})
    got = decontaminate.find_benchmark(clash, bench, texts=("question", "answer"), window=window, part=part)
    assert got.columns == [*docs.columns, "_text", "_c0", "_row", "item_id", "window", "question", "n_words", "n_hit", "hits", "items", "contaminated"]
    want = []
    for r in docs.collect():
        n, hit, ids, w = brute(r.text, items, window)
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k - 1:
                spans[-1][1], spans[-1][3] = k, w[k][2]
            else:
                spans.append([k, k, w[k][1], w[k][2]])
        want.append(repr((r.doc_id, r.text, n, len(hit), [tuple(s) for s in spans], ids, bool(hit))))
    rows = got.collect()
    assert sorted(repr((r.doc_id, r.text, r.n_words, r.n_hit, [tuple(s) for s in r.hits], r["items"], r.contaminated)) for r in rows) == sorted(want)
    assert sum(r.contaminated for r in rows) > 5 and any(not r.contaminated for r in rows)


def test_places_are_those_of_the_original(case):
    docs, bench, _ = case
    for r in decontaminate.find_benchmark(docs, bench, texts=("question",)).where("n_hit > 0").collect():
        for s in r.hits:
            assert [x for x, _, _ in split(r.text[s.begin : s.end])] == [x for x, _, _ in split(r.text)][s.first : s.last + 1]


def test_empty_tables(spark, case):
    docs, bench, _ = case
    assert decontaminate.find_benchmark(docs.limit(0), bench, texts=("question",)).count() == 0
    none = decontaminate.find_benchmark(docs, bench.limit(0), texts=("question",)).collect()
    assert len(none) == docs.count() and not any(r.contaminated or r.n_hit or r["items"] for r in none)
    assert {r.n_words for r in none if r.text is None} == {0}
    blank = spark.createDataFrame([(1, "?!"), (2, None)], "item_id long, text string")
    assert not decontaminate.find_benchmark(docs, blank).where("contaminated").count()


def test_long_text(spark):
    rnd = random.Random(3)
    w = [f"t{rnd.randrange(9000)}" for _ in range(150_000)]
    w[149_980:149_990] = [f"q{k}" for k in range(10)]
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(f"Q{k}," for k in range(10)))], "item_id long, text string")
    r = decontaminate.find_benchmark(docs, bench).first()
    assert (r.n_words, r.n_hit, r["items"], r.hits[0].first) == (150_000, 10, ["5"], 149_980)
