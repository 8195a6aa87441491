"""Token-ID output: documents are tokenised, coded in records and written in key order; readers get the ids back.

The file format is a Parquet dataset of records: ``shard`` (a range of keys) and ``seq`` order the records, ``keys`` are
the documents in it and ``data`` the coded ids (see ``coder``). Spark writes and reads it, so any store will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import is_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtlens.llm import coder
from courtlens.llm.common import column, map_column, shared_dir, ship, slices

#: Ids of a record, characters that a task tokenises at a time, and pieces whose ids a worker remembers.
RECORD, TEXT, CACHE = 65_536, 10_000_000, 1_200_000
#: Documents of a shard, and the most shards.
SHARD_ROWS, MAX_SHARDS = 2_000, 20_000
#: White space before a space, or beside the end of a line.
_ODD_SPACE, _ODD_LINE = re.compile(r"\s "), re.compile(r"\s\n|\n\s")
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?*#$%&"
#: A word of Latin letters and marks behind it: for a byte-level pre-tokenizer these are two pre-tokens.
_PLAIN = re.compile(rf"(\0?[{_LETTERS}]+)([{_MARKS}]*)")
_known: dict[str, dict[str, bytes]] = {}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple:
    """The tokenizer of a file, with its own treatment of special tokens, and the id of a line's end if it goes by byte-level
    pre-tokens (else None)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    parts = json.loads(Path(path).read_text(encoding="utf-8"))
    before, model, added = parts.get("pre_tokenizer") or {}, parts["model"], parts.get("added_tokens", [])
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    alone = all(not re.search(rf"\s|[{_LETTERS}{_MARKS}]$", x["content"]) and not x.get("lstrip") and not x.get("rstrip") for x in added)
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    tok = Tokenizer.from_file(path)
    line = tok.encode("\n", add_special_tokens=False).ids
    return tok, line[0] if level and alone and plain and len(line) == 1 and not parts.get("normalizer") and not parts.get("post_processor") else None


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _said(piece: str) -> str:
    """The text of a piece: it follows a space, unless a zero character says that it doesn't."""
    return piece[1:] if piece[:1] == "\0" else " " + piece


def _fresh(tok, line: int, pieces: set[str], known: dict[str, bytes]) -> dict[str, bytes]:
    """Ids of pieces by the library: plain words a line each, so that many go to it at once, all others one by one."""
    plain, stems, behind, rest, marks, got = [], [], [], [], {}, {}
    for p in pieces:
        found = _PLAIN.fullmatch(p)
        if found:
            plain.append(p)
            stems.append(found[1])
            behind.append(found[2])
        else:
            rest.append(p)
    words = list(set(stems).difference(known))
    for a in range(0, len(words), 20_000):
        part = words[a : a + 20_000]
        ids = np.array(tok.encode_batch_fast(["\n".join(map(_said, part))], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts, data = (4 * np.flatnonzero(ids == line)).tolist(), ids.tobytes()
        got.update(zip(part, (data[x:y] for x, y in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)), strict=True))
    for p, word, mark in zip(plain, stems, behind):
        if mark:
            if mark not in marks:
                marks[mark] = _packed(tok.encode(mark, add_special_tokens=False).ids)
            got[p] = (got.get(word) or known[word]) + marks[mark]
        elif p not in got:
            got[p] = known[p]
    for a in range(0, len(rest), 20_000):
        part = rest[a : a + 20_000]
        got.update(zip(part, (_packed(x.ids) for x in tok.encode_batch_fast([_said(p) for p in part], add_special_tokens=False))))
    return got


def _pieces(text: str) -> list[str] | None:
    """A text cut in front of each space and around the end of each line, if no space or end of a line meets white space."""
    lines = "\n" in text
    if (text.replace("\n", "") if lines else text).isprintable():  # then it has no other white space
        odd, odd_line = "  " in text or (lines and "\n " in text), lines and (" \n" in text or "\n\n" in text)
    else:
        odd, odd_line = "\0" in text or _ODD_SPACE.search(text), lines and _ODD_LINE.search(text)
    if odd:
        return None
    if lines and not odd_line:
        text = text.replace("\n", " \0\n \0")
    return ("\0" + text).split(" ")


def tokenize(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids (32 bits) of each whole text by the tokenizers library, which adds no special tokens; what of a text matches a
    special token gets that token's id, as the library's default is.

    A byte-level pre-token never goes from a character on to a space, nor over the end of a line with none beside it, so
    under such a vocabulary a text falls into pieces there, and each distinct piece needs the library only once. Other
    texts go to it whole, as do all under other vocabularies.
    """
    tok, line = tokenizer(path)
    known = _known.setdefault(path, {})
    pieces = [None if line is None else _pieces(text or "") for text in texts]
    flat = list(chain.from_iterable(p for p in pieces if p))
    found = list(map(known.get, flat))
    lacking = list(compress(range(len(found)), map(is_, found, repeat(None))))
    if lacking:
        got = _fresh(tok, line, {flat[k] for k in lacking}, known)
        for k in lacking:
            found[k] = got[flat[k]]
        if len(known) + len(got) > CACHE:
            known.clear()
        known.update(got)
    at, out = 0, []
    for text, p in zip(texts, pieces):
        data = _packed(tok.encode(text or "", add_special_tokens=False).ids) if p is None else b"".join(found[at : at + len(p)])
        out.append(np.frombuffer(data, "<u4"))
        at += len(p or ())
    return out


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            shard, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for a, b in slices([len(x or "") for x in texts], TEXT):
                docs = [np.append(x, np.uint32(end)) for x in tokenize(texts[a:b], path)]
                at = np.flatnonzero(np.diff(shard[a:b])) + 1
                cuts = []
                for lo, hi in zip([0, *at.tolist()], [*at.tolist(), b - a]):
                    cuts += [(lo + x, lo + y) for x, y in slices([len(d) for d in docs[lo:hi]], RECORD)]
                blocks = [coder.pack(docs[x:y]) for x, y in cuts]
                coded = iter(coder.encode(list(chain.from_iterable(blocks))))
                data = [coder.record([len(d) for d in docs[x:y]], own, [next(coded) for _ in own]) for (x, y), own in zip(cuts, blocks)]
                keys = batch.column(1).slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[a:b][[x for x, _ in cuts]]), pa.array(np.arange(seq, seq + len(cuts))),
                        pa.ListArray.from_arrays(pa.array([x for x, _ in cuts] + [b - a], pa.int32()), keys),
                        pa.array([sum(len(d) for d in docs[x:y]) for x, y in cuts], pa.int64()), pa.array(data, pa.binary()),
                    ],
                    ["shard", "seq", "keys", "n_tokens", "data"],
                )
                seq += len(cuts)

    return run


def write(docs: DataFrame, to: str, path: str, end: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, each with the id ``end`` behind it, in ascending order of the key.

    ``path``: a vocabulary of the tokenizers library. Null texts are empty, null keys come first, and equal keys go by the
    hash of their text; very long texts are tokenised whole; repeated rows, whatever their number, are documents of their
    own. Shards are ranges of key and hash, and of a number for each row, so that no key and no text makes one large. Other
    columns, whatever their names, are ignored. An empty table gives no record.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(key).cast("long").alias("key"), column(text).alias("text"), F.xxhash64(column(text)).alias("h"), F.monotonically_increasing_id().alias("row"))
    number = max(1, min(MAX_SHARDS, rows.count() // SHARD_ROWS))
    dealt = rows.repartitionByRange(number, "key", "h", "row").sortWithinPartitions("key", "h", "row").select(F.spark_partition_id().cast("long").alias("shard"), "key", "text")
    dealt.mapInArrow(_write(path, end), "shard long, seq long, keys array<bigint>, n_tokens long, data binary").write.parquet(to)


def read_ids(records: DataFrame, fields: str, make) -> DataFrame:
    """Decode records and give for each document (shard, seq, key, at, ...): where its ids begin in the record, and
    the columns ``fields`` that ``make`` computes from the list of id arrays."""

    def run(data: list[bytes]) -> list:
        parsed = [coder.parse(x) for x in data]
        ids = iter(coder.decode([c for _, _, coded in parsed for c in coded], [n for _, sizes, _ in parsed for n in sizes]))
        out = []
        for sizes, blocks, _ in parsed:
            whole = np.concatenate([np.zeros(0, dtype=np.int64), *(next(ids) for _ in blocks)])
            ends = np.cumsum(sizes)
            docs = [whole[a:b] for a, b in zip(ends - sizes, ends)]
            cols = make(docs)
            out.append([dict(zip(("at", *names), row)) for row in zip((ends - sizes).tolist(), *cols)])
        return [out]

    names = [x.split()[0] for x in fields.split(", ")]
    typed = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in fields.split(", "))
    rows = map_column(records.select("shard", "seq", "keys", "data"), "data", f"docs array<struct<at:bigint,{typed}>>", run, 4_000_000)
    return rows.select("shard", "seq", F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("shard", "seq", F.col("x.keys").alias("key"), "x.docs.*")


def digests(spark: SparkSession, at: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of the documents in a token file, from the ids that are read back.

    Starts add up in two steps: the shards' sums (a row a shard) and the records' within their shard. Null keys come
    first, repeated documents are rows each, an empty text is its end id alone, a long one a record by itself; a file
    without records gives an empty table. The file has no other columns.
    """
    records = spark.read.parquet(at)

    def make(docs: list[np.ndarray]) -> list[list[int]]:
        return [[len(x) for x in docs], [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]]

    docs = read_ids(records, "n_tokens bigint, ids_crc32 bigint", make)
    own = records.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    return docs.join(own, ["shard", "seq"]).join(shards, "shard").select(
        "key", (F.col("outer") + F.col("inner") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
