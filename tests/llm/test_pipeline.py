"""Each stage of the corpus pipeline on the awkward table, and the whole on the smallest tables."""

import collections
import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.corpus import documents

from courtlens.llm import bpe
from courtlens.llm.queries import ORACLE_SQLS


def test_stages(spark):
    docs = documents(spark)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, "").cache()
        assert tuple(kept.columns) == names
        if k == 0:
            gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
            assert gone == {102, 103, 104, 105}
        if k == 1:
            ids = [r.doc_id for r in kept.collect()]
            assert len(ids) == len(set(ids)) and 100 not in ids and 3 in ids and 4 in ids and None not in ids
        if k == 2:
            assert all(r.n_chars == len(r.text) for r in kept.where("doc_id = 0").collect())
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    rows = out.collect()
    assert len(rows) == kept.count() and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def words(text):
    return (text or "").encode().split()


def one_of_each_class(docs):
    """The ids that stay: the least of each class of texts linked by a Jaccard similarity of 0.8 of five-word shingles."""
    sets = {}
    for r in docs:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    least = {k: k for k in sets}
    find = lambda k: k if least[k] == k else find(least[k])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {find(k) for k in ids}


def without_repeats(docs):
    """The words of each document that no window of 35 words covers which also starts elsewhere."""
    seen = collections.Counter(tuple(w[i : i + 35]) for r in docs for w in [words(r.text)] for i in range(len(w) - 34))
    out = {}
    for r in docs:
        w = words(r.text)
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out[r.doc_id] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_run_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before it kept, against plain loops, SQL and the library; run() gives the last one's rows."""
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    clean, unique, cut, mixed, coded = kept
    lettered = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")}
    assert len(clean) >= 0.97 * len(lettered) and {r.doc_id for r in clean} <= lettered
    assert {r.doc_id for r in unique} == one_of_each_class(clean) and len(unique) == len({r.doc_id for r in unique})
    left = without_repeats(unique)
    assert {r.doc_id: words(r.text) for r in cut} == left
    whole = {r.doc_id: r.text for r in unique}
    assert all(r.n_chars == len(r.text) if len(left[r.doc_id]) < len(words(whole[r.doc_id])) else r.text == whole[r.doc_id] for r in cut)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    times = {k: n // size for k, size, n in con.sql(f"select doc_id, size, taken from ({ORACLE_SQLS['op6_mix']})").fetchall() if size}
    assert collections.Counter(r.doc_id for r in mixed if words(r.text)) == {k: n for k, n in times.items() if n}
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = {r.doc_id: np.array(enc.encode_ordinary(r.text), "<u4").tobytes() for r in mixed}
    assert len(coded) == len(mixed) and all(bytes(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in coded)
    assert {(r.doc_id, r.decoded_sha256) for r in coded} == {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed}
    again = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.ids_sha256) for r in coded)


CLASHING = ("spans", "score", "_text", "lang_pred", "n_words", "_doc", "_whole", "_d0", "_c1", "size", "copies", "uid", "with.dot")


def test_stages_with_clashing_columns(spark):
    """Columns named like those that the stages work with come back as they were, row by row, and decide nothing."""
    plain = documents(spark)
    mark = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "source")
    docs = plain.withColumns({f"`{c}`" if "." in c else c: F.concat(F.lit(f"{c}:"), mark) for c in CLASHING if "." not in c}).withColumn("with.dot", F.concat(F.lit("with.dot:"), mark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept, same = stage(spark, docs, "").cache(), stage(spark, plain, "")
        assert kept.columns == docs.columns
        rows = kept.collect()
        for r in rows:
            own = "|".join(["none" if r["doc_id"] is None else str(r["doc_id"])] + ([r["source"]] if r["source"] is not None else []))
            assert all(r[c] == f"{c}:{own}" for c in CLASHING)
        names = plain.columns
        assert sorted(map(str, kept.select(*names).collect())) == sorted(map(str, same.select(*names).collect()))
