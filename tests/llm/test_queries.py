"""The registered queries themselves: SQL twins where there are some, the libraries or a plain loop for the others."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from courtlens.llm import bpe, quality
from courtlens.llm.queries import ORACLE_SQLS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQLS))
def test_query_matches_sql(spark, con, name):
    want = con.sql(ORACLE_SQLS[name])
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def rows(con):
    return con.sql("select doc_id, coalesce(text, ''), lang from documents order by doc_id").fetchall()


def test_fingerprint_query(spark, con):
    docs = rows(con)
    got = {r.doc_id: r for r in QUERIES["op1_fingerprint"](spark, SF).collect()}
    down = docs[::-1]
    for (k, text, _), (_, after, _) in zip(down, down[1:] + down[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    same = {}
    for k, text, _ in docs:
        assert same.setdefault(text, got[k].fingerprint) == got[k].fingerprint


def test_token_query(spark, con):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, []
    for k, text, _ in rows(con):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op3_tokens"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_bpe_query(spark, con):
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = [(k, len(ids := enc.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t, _ in rows(con)]
    assert sorted(map(tuple, QUERIES["op5_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_language_query(spark, con):
    docs = {k: lang for k, _, lang in rows(con)}
    got = QUERIES["op9_language"](spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == docs[r.doc_id] for r in got if r.held_out and docs[r.doc_id]]
    assert np.mean(held) > 0.95


def test_quality_query(spark, con):
    docs = rows(con)
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    labels = {k: q for k, q in con.sql("select doc_id, quality from labels").fetchall() if zlib.crc32(str(k).encode()) % 3 != 1}
    stats = {k: np.array(quality.statistics(t), dtype=np.float32) for k, t, _ in docs}
    known = [k for k in labels if k in stats]
    x, y = np.stack([stats[k] for k in known]), np.array([labels[k] for k in known], dtype=float)
    forest = quality.fit_forest(x, y)
    want = forest.scores(np.stack([stats[k] for k, _, _ in docs]))
    near = [abs(got[k].score - s) for (k, _, _), s in zip(docs, want)]
    assert max(near) < 1e-6 and all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
