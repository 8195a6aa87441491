"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries agree, and encoded.

Vocabulary files are read by path on the executors; they are installed with the ``public_tokenizers`` package there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.common import map_column, ship, tidy

#: Code points of a chunk, and of the text behind it that the next chunk reads too.
CHUNK, OVERLAP = 65_536, 1_024
#: A boundary is sure if at least this many code points follow it in the chunk (no alternative looks further ahead).
AHEAD = 4


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of one piece of text that begins and ends at pre-token boundaries."""
    return np.asarray(encoding(path, pattern).encode_ordinary(text), dtype="<u4")


def decode_ids(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """Decoding concatenates the raw bytes of the ids."""
    return encoding(path, pattern).decode_bytes(ids.tolist())


@lru_cache(maxsize=2)
def _pretokens(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_pretokens(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of a stitched piece, each pre-token by itself: what follows the piece can't change how its end is split."""
    bpe, out = encoding(path, pattern), []
    for piece in _pretokens(pattern).findall(text):
        out += bpe.encode_ordinary(piece)
    return np.asarray(out, dtype="<u4")


def bounds(n: int, text: str, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The sure boundaries in chunk n's first and last overlap, as positions in the document."""
    ends = np.fromiter((m.end() for m in _pretokens(pattern).finditer(text)), dtype=np.int64)
    ends = ends[ends <= len(text) - AHEAD]
    return (ends[ends <= overlap] + n * chunk).tolist(), (ends[ends >= chunk] + n * chunk).tolist()


def _cut(chunk: int, overlap: int):
    """Each text (the last column) as its chunks with their numbers, read once from front to back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(range(batch.num_columns - 1))
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for a in range(0, len(text), 64 * chunk):
                    begins = range(a, min(len(text), a + 64 * chunk), chunk)
                    own = keys.take(pa.array([row] * len(begins)))
                    made = [pa.array([b // chunk for b in begins], pa.int32()), pa.array([text[b : b + chunk + overlap] for b in begins], pa.string())]
                    yield pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, "chunk_no", "piece"])
            tidy()

    return run


def encode(docs: DataFrame, path: str, pattern: str, key: Column | str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_key, ids): every whole text as little-endian unsigned 32-bit ids.

    A text of at most ``chunk`` code points is one chunk and is encoded where it is read. Longer ones are cut into
    chunks that overlap; each chunk is pre-tokenised from its own start, and chunk i hands over to chunk i + 1 at the
    first boundary that both found in the overlap: from there on both must go on alike, since matching only looks ahead.
    A document with an overlap in which no boundary agrees (one unbroken run) is encoded whole. Null texts are empty and
    get no ids; each repeated row gets its own result. Other columns are ignored; an empty table gives an empty table.
    """
    if overlap >= chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    ship(docs.sparkSession)
    key = F.col(key) if isinstance(key, str) else key
    rows = docs.select(key.alias("doc_key"), F.coalesce(text, F.lit("")).alias("text"))
    n = F.char_length("text")
    ids = lambda texts: [[encode_text(x, path, pattern).tobytes() for x in texts]]
    short = map_column(rows.where(n <= chunk), "text", "ids binary", ids)
    doc = ("doc_key", "h", "times")
    long = rows.where(n > chunk).groupBy("doc_key", "text").agg(F.count("*").alias("times")).select("doc_key", F.xxhash64("text").alias("h"), "times", "text")
    cut = T.StructType([*long.schema.fields[:3], T.StructField("chunk_no", T.IntegerType()), T.StructField("piece", T.StringType())])
    pieces = long.mapInArrow(_cut(chunk, overlap), cut).repartition(*doc, "chunk_no").withColumn("_x", F.struct("chunk_no", "piece"))
    length = lambda x: len(x["piece"])
    ends = lambda xs: list(zip(*(bounds(x["chunk_no"], x["piece"], pattern, chunk, overlap) for x in xs)))
    w = Window.partitionBy(*doc)
    order = w.orderBy("chunk_no")
    begin = F.when(F.col("chunk_no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tails").over(order), "heads")))
    stitched = (
        map_column(pieces, "_x", "heads array<bigint>, tails array<bigint>", ends, size=length)
        .withColumn("begin", begin).withColumn("finish", F.lead("begin").over(order))
        .withColumn("torn", F.max(F.col("begin").isNull()).over(w)).drop("heads", "tails")
    )

    def ranges(xs: list[dict]) -> list:
        own = lambda x, k: None if x[k] is None else x[k] - x["chunk_no"] * chunk
        return [[encode_pretokens(x["piece"][own(x, "begin") : own(x, "finish")], path, pattern).tobytes() for x in xs]]

    parts = stitched.where(~F.col("torn")).repartition(*doc, "chunk_no").select(*doc, "chunk_no", F.struct("chunk_no", "piece", "begin", "finish").alias("_x"))
    joined = (
        map_column(parts, "_x", "ids binary", ranges, size=length)
        .groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))).alias("parts"))
        .select("doc_key", "times", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
    whole = (
        stitched.where("torn").groupBy(*doc)
        .agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.substring("piece", 1, chunk).alias("piece")))).alias("parts"))
        .select("doc_key", "times", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("text"))
    )
    long = joined.unionByName(map_column(whole, "text", "ids binary", ids))
    return short.unionByName(long.select("doc_key", "ids", F.explode(F.array_repeat("ids", F.col("times").cast("int"))).alias("_again")).drop("_again"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_key, data): the bytes of (doc_key, ids), row by row: null keys and repeated rows are rows like others, no ids
    (b"") decode to no bytes, any number of ids is decoded whole; an empty table gives an empty table, and other columns,
    whatever their names, are ignored."""
    make = lambda rows: [[decode_ids(np.frombuffer(x, "<u4"), path, pattern) for x in rows]]
    return map_column(encoded.select("doc_key", "ids"), "ids", "data binary", make, 8_000_000)


def digests(encoded: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_key, n_tokens, ids_sha256, decoded_sha256) of (doc_key, ids), decoding the ids; with ``keep_ids`` also ids.

    Row by row: null keys and repeated rows are rows like others, no ids (b"") have the digests of nothing, any number of
    ids is one row's; an empty table gives an empty table, and other columns, whatever their names, are ignored.
    """

    def make(rows: list[bytes]) -> list:
        out: list[list] = [[], [], []]
        for raw in rows:
            ids = np.frombuffer(raw, "<u4")
            plain = repr(ids.tolist())[1:-1].replace(" ", "")
            for store, v in zip(out, (len(ids), hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(decode_ids(ids, path, pattern)).hexdigest())):
                store.append(v)
        return [*out, rows] if keep_ids else out

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_column(encoded.select("doc_key", "ids"), "ids", fields, make, 4_000_000)
