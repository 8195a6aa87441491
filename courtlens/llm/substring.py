"""Substring deduplication by relative Lempel-Ziv parsing.

Reference blocks are chosen by content: each window of 35 words picks the 8-gram in it with the least hash, its anchor,
and the windows in a row that pick the same anchor occurrence form one block. Every block of every document is indexed by
its anchor, in a table that Spark deals by anchor. What repeats is decided by that index: of blocks that share an anchor,
those with equal digests repeat whole, and where they differ, which is at the boundaries of factors, the windows are
checked one by one. Blocks and windows are equal if 128-bit digests of their words are; hashes only choose anchors.

The greedy parse then puts a document's repeated blocks and windows together to factors, each with a reference, and the
factors are the spans that go. It describes what goes and can't change it: the union of the parts is the same however
they are chained. A parse that extends each factor against every indexed reference finds the same words, as a word goes
exactly if it lies in a window that stands elsewhere too; it would compare a common passage with all its places, where
equal digests meet once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint, column, map_column, release, ship, slices, tidy

#: Words of a window: the shortest factor that counts. Words of an anchor.
WINDOW, ANCHOR = 35, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION = np.uint64((1 << 28) - 1)


def split_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (and end)."""
    return hashed([split_words(x) for x in texts])


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    flat = np.empty(first[-1], dtype=object)
    flat[:] = list(chain.from_iterable(words))
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)), first


class Digests:
    """128-bit digests of ranges of the words of some texts, over the words themselves."""

    def __init__(self, words: list[list[bytes]]):
        self.text = b" ".join(chain.from_iterable(words)) + b" "
        sizes = np.fromiter((len(w) + 1 for x in words for w in x), dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two numbers of 64 bits for each range."""
        text, blake = self.text, hashlib.blake2b
        found = b"".join(blake(text[a:b], digest_size=16).digest() for a, b in zip(self.at[begin].tolist(), self.at[end].tolist()))
        return np.frombuffer(found, dtype="<i8").reshape(-1, 2).T


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on."""
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : k + len(total)]
    return mix(total)


def blocks(texts: list[str], window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64) -> tuple:
    """(text, first window, windows, anchor hash, digest) of each block; a window counts by its first word.

    ``bits`` of the words' hashes are used, which says how often different anchors fall together, but never what is equal.
    """
    split = [split_words(x) for x in texts]
    words, first = hashed(split)
    if len(words) < window:
        return (*(np.zeros(0, dtype=np.int64) for _ in range(4)), np.zeros((2, 0), dtype=np.int64))
    words = words >> np.uint64(64 - bits)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    gram = grams(words, anchor)
    least = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    size, width = 1, window - anchor + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    begin = np.flatnonzero(np.arange(len(words)) + window <= first[doc + 1])
    at = (least[begin] & _POSITION).astype(np.int64)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(begin) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate([head, [len(begin)]]))
    start = begin[head]
    return doc[start], start - first[doc[start]], count, gram[at[head]].view(np.int64), Digests(split).of(start, start + count - 1 + window)


def _blocks(window: int, anchor: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts], 1_500_000):
                doc, start, count, at, digest = blocks(texts[a:b], window, anchor, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b][doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(at), *map(pa.array, digest)],
                    ["doc", "start", "n", "anchor", "b1", "b2"],
                )
            del texts
            tidy()

    return run


def _windows(window: int):
    """The digest of each window of the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in slices([len(x) for x in texts], 1_500_000):
                split = [split_words(x) for x in texts[a:b]]
                first = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
                base = np.concatenate([np.full(len(p), first[k]) for k, p in enumerate(parts[a:b])])
                doc = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts[a:b])]).astype(np.int64)
                start = np.array([x["start"] for p in parts[a:b] for x in p], dtype=np.int64)
                count = np.array([x["n"] for p in parts[a:b] for x in p], dtype=np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                times = np.repeat(np.array([x["times"] for p in parts[a:b] for x in p], dtype=np.int64), count)
                start, doc, base = np.repeat(start, count) + step, np.repeat(doc, count), np.repeat(base, count).astype(np.int64)
                digest = Digests(split).of(base + start, base + start + window)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][doc]), pa.array(start.astype(np.int32)), *map(pa.array, digest), pa.array(times)], ["doc", "start", "w1", "w2", "times"])
            del texts, parts
            tidy()

    return run


def _place(kind) -> Column:
    return kind(F.struct("doc", "start")).alias("first" if kind is F.min else "last")


def repeated_blocks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """(doc, parts) of documents (doc, text): the runs (start, n, ref, at) of windows whose words also start elsewhere.

    ``ref`` and ``at`` are the document and first word of another occurrence: of a whole block its first one (for that
    itself the last), of a single window at a factor's boundary likewise. Rows with the same doc have the same parts.
    """
    spark = docs.sparkSession
    ship(spark)
    found = docs.mapInArrow(_blocks(window, anchor, bits), "doc long, start int, n int, anchor long, b1 long, b2 long")
    index = checkpoint(
        found.groupBy("anchor").agg(F.count("*").alias("times"), *(f(b).alias(f"{k}{b}") for b in ("b1", "b2") for k, f in (("lo", F.min), ("hi", F.max))))
        .where("times > 1").select("anchor", F.expr("lob1 <> hib1 or lob2 <> hib2").alias("mixed"))
    )
    release(spark)
    # blocks of an anchor whose blocks are all equal need no digest to be told apart
    only = lambda c: F.when(F.col("mixed"), F.col(c)).otherwise(F.lit(0)).alias(c)
    hits = checkpoint(found.join(index, "anchor").select("doc", "start", "n", "mixed", "anchor", only("b1"), only("b2")))
    release(spark)
    # of equal blocks one is looked into for all of them; should its row be there twice, its windows count as repeated anyway
    block = ["anchor", "b1", "b2"]
    equal = checkpoint(hits.groupBy(*block).agg(F.bool_or("mixed").alias("mixed"), F.count("*").alias("times"), F.min(F.struct("doc", "start", "n")).alias("one"), _place(F.max)))
    parts = equal.where("mixed").select("one.*", "times").groupBy("doc").agg(F.collect_set(F.struct("start", "n", "times")).alias("parts"))
    windows = checkpoint(docs.join(parts, "doc").select("doc", "text", "parts").mapInArrow(_windows(window), "doc long, start int, w1 long, w2 long, times long"))
    release(spark)
    again = windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("w1", "w2")
    same = checkpoint(windows.join(again, ["w1", "w2"]))
    release(spark)
    single = same.where("times = 1").join(same.groupBy("w1", "w2").agg(_place(F.min), _place(F.max)), ["w1", "w2"]).select("doc", "start", F.lit(1).alias("n"), "first", "last")
    several = equal.where("not mixed or times > 1").select(*block, F.struct("one.doc", "one.start").alias("first"), "last")
    whole = hits.drop("mixed").join(several, block).select("doc", "start", "n", "first", "last")
    own = (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))
    ref = lambda c: F.when(own, F.col(f"last.{c}")).otherwise(F.col(f"first.{c}"))
    out = checkpoint(whole.unionByName(single).groupBy("doc").agg(F.collect_set(F.struct("start", "n", ref("doc").alias("ref"), ref("start").alias("at"))).alias("parts")))
    release(spark)
    return out


def parse(parts: list[dict], window: int) -> list[dict]:
    """The factors (begin, finish, ref, at) of a document, by a greedy parse over its repeated blocks and windows.

    A factor begins at the first part behind the last one and takes in the next part as long as that begins in the
    document and in the same reference right where the factor's windows end.
    """
    out: list[dict] = []
    end = -1
    for x in sorted(parts, key=lambda x: (x["start"], -x["n"])):
        last = out[-1] if out else None
        if last and x["start"] == end and x["ref"] == last["ref"] and x["at"] - last["at"] == x["start"] - last["begin"]:
            last["finish"] = max(last["finish"], x["start"] + x["n"] - 1 + window)
        else:
            out.append({"begin": x["start"], "finish": x["start"] + x["n"] - 1 + window, "ref": x["ref"], "at": x["at"]})
        end = x["start"] + x["n"]
    return out


def _covered(n: int, factors: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.array([x["begin"] for x in factors], dtype=np.int64), 1)
    np.add.at(edge, np.minimum(n, np.array([x["finish"] for x in factors], dtype=np.int64)), -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone and the white space before them."""
    kept, last = [], 0
    ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        kept.append(text[last : ends[a - 1][1] if a else 0])
        last = ends[b - 1][1]
    return "".join(kept) + text[last:]


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, digest: bool = False, key: str = "doc_id", bits: int = 64) -> DataFrame:
    """Remove each word that lies in a window whose word sequence also starts anywhere else, its own document included.

    All columns stay; ``text`` becomes the kept text (documents that lose nothing keep theirs untouched; null stays
    null), and n_words, n_removed, the removed ``spans`` (first word, end) and the ``factors`` they come from (begin,
    finish, and the reference: a hash of the row and its first word) are added; they replace columns of those names.
    With ``digest`` the text gives way to kept_sha256, the SHA-256 of the kept words joined by one space. Windows are
    judged on the input. Repeated rows are documents of their own, so they lose what they share, and equal keys with
    different texts are different documents; null keys are keys like others. Null and empty texts, and those below
    ``window`` words, lose nothing; an empty table gives an empty table. Other columns may have any names.
    """
    mine = ("n_words", "n_removed", "spans", "factors", "kept_sha256", text)
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in mine}
    identity = [F.coalesce(column(c).cast("string"), F.lit("\0")) for c in (key, text) if c in docs.columns]
    rows = docs.select(*(column(c).alias(n) for c, n in names.items()), column(text).alias("_text"), F.xxhash64(*identity).alias("_doc"))
    found = repeated_blocks(rows.select(F.col("_doc").alias("doc"), F.coalesce("_text", F.lit("")).alias("text")), window, bits=bits)
    found = found.select(F.col("doc").alias("_doc"), F.col("parts").alias("_parts"))
    joined = rows.join(found, "_doc", "left").select(*names.values(), F.struct(F.col("_text").alias("text"), F.col("_parts").alias("parts")).alias("_both"))

    def make(both: list[dict]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for x in both:
            words, factors = split_words(x["text"] or ""), parse(x["parts"] or [], window)
            gone = _covered(len(words), factors)
            removed = int(gone.sum())
            if digest:
                kept = hashlib.sha256(b" ".join(compress(words, ~gone) if removed else words)).hexdigest()
            else:
                kept = _cut(x["text"], gone) if removed else x["text"]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            for store, v in zip(out, (kept, len(words), removed, [{"begin": int(a), "finish": int(b)} for a, b in zip(edges[::2], edges[1::2])], factors)):
                store.append(v)
        return out

    fields = f"{'kept_sha256' if digest else '_kept'} string, n_words long, n_removed long, spans array<struct<begin:int,finish:int>>, factors array<struct<begin:int,finish:int,ref:bigint,at:int>>"
    out = map_column(joined, "_both", fields, make, size=lambda x: len(x["text"] or ""))
    return out.withColumnsRenamed({n: c for c, n in names.items()} | {"_kept": text})
