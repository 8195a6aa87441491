"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Text is normalised by lower-casing A to Z and reducing it to words (letters and digits of ASCII, and all beyond ASCII)
with one blank between. The patterns are windows of ten words of the items, whole words on both ends; an item of fewer
words is one window. Each document is scanned once, and what is found is mapped back to places in the original text.

The windows are gathered by Spark, each once, and counted in characters before anything is sent around. Up to PART of
them make one automaton, which every Python worker builds for itself. A larger benchmark is dealt into several automata
of that size by the windows' hashes; documents are then scanned once for each of them, one after the other, and a
document's finds are put together by its row number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint, column, map_column

#: Words of a window. Characters of the windows in one automaton (some 45 bytes of memory each).
WINDOW, PART = 10, 4_000_000
#: A word of a normalised text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
_SPAN = "struct<first:bigint,last:bigint,begin:bigint,end:bigint>"
_built: dict[object, object] = {}


def normalised(text: str) -> bytes:
    """The words of a text in lower case with one blank between, as UTF-8."""
    return b" ".join(text.encode("utf-8").translate(_PLAIN).split())


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the text, in code points."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = np.frombuffer(_PLAIN, dtype=np.uint8)[raw] != 32
    edge, point = np.diff(word), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]


def windows(benchmark: DataFrame, item: str = "item_id", texts: Sequence[str] = ("text",), window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window of the items' texts, and the ids, as strings, of the items that have it.

    A null or wordless text has none; a null id is written as an empty string; rows with equal ids are one item.
    """
    each = F.filter(F.array(*[column(c).cast("string") for c in texts]), lambda x: x.isNotNull())
    rows = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), F.explode(each).alias("t"))
    words = F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    rows = rows.select("item", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = F.transform(starts, lambda k: F.array_join(F.slice("w", k, F.lit(window)), " "))
    return rows.select("item", F.explode(F.array_distinct(each)).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(key: object, found: list[str]):
    """The automaton of a part, built once a worker, which keeps one at a time."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        out = ahocorasick.Automaton()
        for k, x in enumerate(found):
            out.add_word(f" {x} ".encode().decode("latin-1"), (k, x.count(" ") + 1))
        if found:
            out.make_automaton()
        _built[key] = out
    return _built[key]


def scan_text(text: str, automaton) -> tuple[int, list[tuple[int, int, int, int]], set[int]]:
    """The number of words; the stretches of words that windows cover, with their places; the numbers of those windows."""
    plain = normalised(text)
    n_words = plain.count(b" ") + 1 if plain else 0
    # bytes as characters, so that the automaton goes by bytes
    hits = [(at, k, n) for at, (k, n) in automaton.iter(f" {plain.decode('latin-1')} ")] if n_words and len(automaton) else []
    if not hits:
        return n_words, [], set()
    at, _, n = np.array(hits).T
    ends = np.searchsorted(np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32), at - 1) + 1
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, ends - n, 1)
    np.add.at(step, ends, -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    begin, end = places(text)
    return n_words, list(zip(first.tolist(), last.tolist(), begin[first].tolist(), end[last].tolist())), {k for _, k, _ in hits}


def _scan(docs: DataFrame, text: str, part: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``items`` instead of the text, by the windows of one part."""
    rows = part.collect()  # PART characters and the items' ids
    sent = docs.sparkSession.sparkContext.broadcast(([r.window for r in rows], [r["items"] for r in rows]))
    key = f"{docs.sparkSession.sparkContext.applicationId} {sent._jbroadcast.id()}"

    def make(texts: list[str | None]) -> list[list]:
        found, items = sent.value
        own, out = _automaton(key, found), ([], [], [])
        for x in texts:
            n_words, spans, which = scan_text(x or "", own)
            out[0].append(n_words)
            out[1].append([dict(zip(("first", "last", "begin", "end"), s)) for s in spans])
            out[2].append(sorted({i for k in which for i in items[k]}))
        return list(out)

    return map_column(docs, text, f"n_words bigint, hits array<{_SPAN}>, items array<string>", make)


def merged(hits: Column) -> Column:
    """Stretches of several parts as those of their union, in order."""
    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.when(x["last"] > last["last"], F.struct(last["first"], x["last"], last["begin"], x["end"])).otherwise(last).cast(_SPAN)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(hits), F.array().cast(f"array<{_SPAN}>"), add)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", texts: Sequence[str] = ("text",), window: int = WINDOW, part: int = PART) -> DataFrame:
    """Add what of a benchmark each document holds: ``n_words``; ``n_hit`` words inside an occurrence of a window; ``hits``,
    the stretches of such words (first and last word, begin and end as code points of the original text); ``items``, the
    ids of the items with occurring windows, sorted as strings; ``contaminated`` (n_hit > 0).

    ``texts``: the columns of the benchmark with questions and answers; each is an item's text by itself. Null, empty and
    wordless texts hold nothing; very long texts are scanned whole, once an automaton; repeated rows are marked alike;
    without a benchmark nothing is contaminated; an empty table gives an empty table. Columns of the names that are added
    give way to them; other columns pass unchanged.
    """
    added = ("n_words", "n_hit", "hits", "items", "contaminated")
    rest = [c for c in docs.columns if c not in added]
    rows = docs.select(*(column(c).alias(f"_c{k}") for k, c in enumerate(rest)), column(text).alias("_text"))
    found = checkpoint(windows(benchmark, item, texts, window))
    size = found.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    parts = -(-size // part)
    if parts <= 1:
        out = _scan(rows, "_text", found)
    else:
        rows = checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
        scanned = [_scan(rows.select("_row", "_text"), "_text", found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)) for k in range(parts)]
        both = reduce(DataFrame.unionByName, scanned).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        both = both.select("_row", "n_words", merged(F.col("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))
        out = rows.drop("_text").join(both, "_row")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(rest)), "n_words", n_hit.alias("n_hit"), "hits", "items", (F.size("hits") > 0).alias("contaminated"))
