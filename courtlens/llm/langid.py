"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import column, map_column, ship, slices, tidy

#: Letter trigrams are hashed into this many counts a language, which bounds the model whatever the corpus.
BUCKETS = 1 << 16
#: Nats that a change of language costs, and letters of one language in a script below which it is no candidate there.
SWITCH, RARE = 14.0, 0.002
#: Words after which a long text is cut into runs that are labelled side by side.
RUN = 32_768
#: First code points of the script ranges that matter for candidates (fixed values of the Unicode blocks).
SCRIPTS = (
    ("other", 0x0), ("latin", 0x41), ("greek", 0x370), ("cyrillic", 0x400), ("armenian", 0x530), ("hebrew", 0x590),
    ("arabic", 0x600), ("indic", 0x900), ("thai", 0xE00), ("tibetan", 0xF00), ("georgian", 0x10A0), ("hangul", 0x1100),
    ("ethiopic", 0x1200), ("khmer", 0x1780), ("latin", 0x1E00), ("greek", 0x1F00), ("other", 0x2000), ("kana", 0x3040),
    ("han", 0x3400), ("hangul", 0xAC00), ("other", 0xD7FC), ("han", 0xF900), ("latin", 0xFB00), ("arabic", 0xFB50),
    ("other", 0xFF00), ("han", 0x20000),
)
_NAMES = sorted({name for name, _ in SCRIPTS})
_STARTS = np.array([start for _, start in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for name, _ in SCRIPTS])


@dataclass
class Words:
    """The words of a few texts: hashed trigrams of each position, and where words and texts begin."""

    grams: np.ndarray  # of every position inside words and right behind them
    at: np.ndarray  # word of each gram
    script: np.ndarray  # of each word
    letters: np.ndarray  # of each word
    first: np.ndarray  # first word of each text, and the end


def words_of(texts: list[str]) -> Words:
    joined = "\n\n".join(texts) + "\n\n"
    lower = joined.lower()
    if len(lower) != len(joined):  # a few capitals have two code points in lower case
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(lower.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    table = np.zeros(0x110000, dtype=np.int8)  # 2 for letters, 1 for marks, which go with the word they stand in
    for c in np.flatnonzero(seen):
        table[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
    kind = table[codes]
    inside = kind > 0
    c0 = np.where(inside, codes, 0).astype(np.uint32)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begin)
    c1 = np.concatenate([[0], c0[:-1]]).astype(np.uint32)
    c2 = np.concatenate([[0, 0], c0[:-2]]).astype(np.uint32)
    mixed = (c0 * np.uint32(2654435761)) ^ (c1 * np.uint32(2246822519)) ^ (np.where(c1 > 0, c2, 0) * np.uint32(3266489917))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    used = inside.copy()
    used[1:] |= inside[:-1]
    at = np.cumsum(begin) - 1
    where = np.flatnonzero(used)
    ends = np.cumsum([len(x) + 2 for x in texts])
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    letters = np.bincount(at[kind == 2], minlength=len(starts)) if len(starts) else np.zeros(0, dtype=int)
    script = _SCRIPT[np.searchsorted(_STARTS, codes[starts], side="right") - 1] if len(starts) else np.zeros(0, dtype=int)
    return Words((mixed[where] >> np.uint32(16)).astype(np.int64), at[where], script, letters, first)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=False):
            texts = group["text"].tolist()
            g = grams.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            s = scripts.setdefault(lang, np.zeros(len(_NAMES), dtype=np.int64))
            for a, b in slices([len(x) for x in texts], 1_000_000):
                w = words_of(texts[a:b])
                g += np.bincount(w.grams, minlength=BUCKETS)
                s += np.bincount(w.script, weights=w.letters, minlength=len(_NAMES)).astype(np.int64)
        tidy()
    for lang in grams:
        for kind, counts in ((0, grams[lang]), (1, scripts[lang])):
            k = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "kind": kind, "bucket": k, "n": counts[k]})


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # log probability, bucket x language
    allowed: np.ndarray  # script x language


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count the trigrams and scripts of all rows by language; rows with a null text or language teach nothing.

    Each task counts its rows, and Spark adds the counts up; the driver gets at most BUCKETS counts a language.
    """
    ship(docs.sparkSession)
    counted = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
        .mapInPandas(_count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(counted["lang"].unique())
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    for k, name in enumerate(langs):
        own = counted[counted["lang"] == name]
        for kind, out in ((0, counts), (1, scripts)):
            rows = own[own["kind"] == kind]
            out[rows["bucket"].to_numpy(), k] = rows["n"].to_numpy()
    scores = np.log(counts + 0.3) - np.log(counts.sum(0) + 0.3 * BUCKETS)
    allowed = scripts >= RARE * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True
    return Model(langs, scores.astype(np.float32), allowed)


def _forward(scores: np.ndarray, begin: np.ndarray, sizes: np.ndarray, enter: np.ndarray, switch: float, back: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The totals behind the last word of each run of words, which comes with the totals before its first word; and what
    was taken off all totals of a run on the way to keep them small.

    Runs go step by step together, longest first, so a step is a few array operations. As any change costs the same, a
    word's best predecessor is either the same label or the best label so far. ``back`` gets what backtracking needs.
    """
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # runs with more than t words
    total, out, off = enter.astype(scores.dtype), np.empty_like(enter, dtype=scores.dtype), np.zeros(len(enter))
    for t in range(sizes[0]):
        k = active[t]
        if k < len(total):
            out[k : len(total)] = total[k:]
            total = total[:k]
        at = begin[:k] + t
        top = total.argmax(1)
        most = total[np.arange(k), top]
        off[:k] += most
        total = total - most[:, None]
        move = total < -switch
        total[move] = -switch
        total += scores[at]
        if back:
            back[0][at], back[1][at] = move, top
    out[: len(total)] = total
    return out, off


def _backward(begin: np.ndarray, sizes: np.ndarray, end: np.ndarray, back: tuple, labels: np.ndarray | None) -> np.ndarray:
    """From the label of each run's last word back to the label before its first word; ``labels`` gets all between."""
    changed, best = back
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    state = end.copy()
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        at, now = begin[:k] + t, state[:k]
        if labels is not None:
            labels[at] = now
        state[:k] = np.where(changed[at, now], best[at], now)
    return state


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH, run: int = RUN) -> np.ndarray:
    """The best label of each word. scores: word x label; the words of text k are first[k] to first[k + 1].

    Long texts are cut into runs of ``run`` words. What a run makes of each label before it is found for all runs at
    once, then handed on from run to run; so the steps of a long text are those of a run, and its runs.
    """
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(scores):
        return labels
    n = scores.shape[1]
    parts = -(-np.diff(first) // run)
    text = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[:-1][text] + number * run
    sizes = np.minimum(first[1:][text] - begin, run)
    follows, ends = number > 0, number == parts[text] - 1
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    enter = np.zeros((len(text), n))
    if not ends.all():
        inner = np.flatnonzero(~ends)  # all of the same size: what each makes of each label before it
        each = np.where(np.eye(n, dtype=bool), 0.0, -1e9)
        made, off = _forward(scores.astype(np.float64), np.repeat(begin[inner], n), np.repeat(sizes[inner], n), np.tile(each, (len(inner), 1)), switch)
        made = (made + off[:, None]).reshape(len(inner), n, n)
        for i, k in enumerate(inner):
            reached = (enter[k][:, None] + made[i]).max(0)
            enter[k + 1] = reached - reached.max()
    begin_, sizes_ = begin[order], sizes[order]
    back = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int16)
    final = _forward(scores, begin_, sizes_, enter[order], switch, back)[0].argmax(1)[place]
    if follows.any():
        inner = np.flatnonzero(follows)
        inner = inner[np.argsort(-sizes[inner], kind="stable")]
        before = np.zeros((len(text), n), dtype=np.int64)
        before[inner] = _backward(np.repeat(begin[inner], n), np.repeat(sizes[inner], n), np.tile(np.arange(n), len(inner)), back, None).reshape(-1, n)
        for k in np.flatnonzero(follows)[::-1]:
            final[k - 1] = before[k, final[k]]
    _backward(begin_, sizes_, final[order], back, labels)
    return labels


def label_words(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    w = words_of(texts)
    scores = np.empty((len(w.script), len(model.langs)), dtype=np.float32)
    for k in range(len(model.langs)):
        scores[:, k] = np.bincount(w.at, weights=model.scores[:, k][w.grams], minlength=len(w.script))
    scores[~model.allowed[w.script]] = -1e4
    return w, viterbi(scores, w.first, switch)


def _shares(w: Words, labels: np.ndarray, n: int, langs: int) -> np.ndarray:
    doc = np.repeat(np.arange(n), np.diff(w.first))
    return np.bincount(doc * langs + labels, weights=w.letters, minlength=n * langs).reshape(n, langs)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """Add lang_pred and score to the columns ``keep`` (all but the text by default).

    lang_pred is the language of most letters, score its share of the letters. Texts that are null or have no letter
    (combining marks are none) are ``und`` with score 0, as is every text if nothing was learned; of equal shares the
    first language in alphabetical order counts. With ``spans`` there is also the list of (first word, end, lang).
    Repeated rows get equal results; the whole text counts, however long (a word is one step for all texts of a batch).
    Columns of ``keep`` pass unchanged whatever their names, but for those called like a result, which it replaces. An
    empty table gives an empty table.
    """
    made = ["lang_pred", "score"] + ["spans"] * spans
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = {f"_c{k}": c for k, c in enumerate(c for c in keep if c not in made)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list:
        m, n = shared.value, len(texts)
        labelled, share, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        if m.langs:
            w, labels = label_words([x or "" for x in texts], m, switch)
            by = _shares(w, labels, n, len(m.langs))
            total = by.sum(1)
            share = by.max(1) / np.maximum(total, 1)
            labelled = [m.langs[k] if t else "und" for k, t in zip(by.argmax(1), total)]
            for i in range(n if spans else 0):
                own = labels[w.first[i] : w.first[i + 1]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
                found[i] = [{"begin": x, "finish": y, "lang": m.langs[own[x]]} for x, y in zip(cuts, cuts[1:])]
        return [labelled, share, found][: 3 if spans else 2]

    fields = "lang_pred string, score double" + ", spans array<struct<begin:int,finish:int,lang:string>>" * spans
    inner = docs.select(*(column(c).alias(n) for n, c in names.items()), column(text).alias("_whole"))
    return map_column(inner, "_whole", fields, make, 1_000_000).withColumnsRenamed(names)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part
