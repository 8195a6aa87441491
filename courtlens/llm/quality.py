"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint, map_column

FEATURES = (
    "chars", "words", "lines", "word_len", "word_len_spread", "line_words", "upper", "digit", "space", "symbol", "punct",
    "exclaim", "non_ascii", "distinct_words", "top_word", "repeated_lines", "repeated_line_chars", "first_upper_words",
    "symbol_words", "packed", "distinct_bigrams", "short_words", "long_words", "stops", "letters_only_words", "entropy",
)
#: Labelled rows that the classifier is fitted on at most, chosen by hash; quantile bins of a feature.
SAMPLE, BINS = 20_000, 64

_CLASS = np.zeros(256, dtype=np.int64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 punctuation, 7 '!', 8 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 7 if _c == "!" else 6 if _c in ".,;:?'\"()-" else 5 if _b > 32 else 0


def statistics(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text; null counts as empty, for which they are 0."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    freq = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=freq, minlength=9)
    n, words, lines = len(data), text.split(), text.split("\n")
    k = max(1, len(words))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    seen = Counter(lines)
    again = {x: c for x, c in seen.items() if c > 1 and x.strip()}
    pairs = len(set(zip(words, words[1:])))
    distinct = list(counts)
    alpha = sum(counts[x] for x in distinct if x.isalpha())
    capital = sum(counts[x] for x in distinct if x[:1].isupper())
    odd = sum(counts[x] for x in distinct if not x[-1:].isalnum() and x[-1:] not in ".,;:?!\"')")
    p = freq[freq > 0] / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lens.mean(), lens.std(), len(words) / len(lines),
        kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n,
        len(counts) / k, max(counts.values(), default=0) / k, sum(c - 1 for c in again.values()) / len(lines),
        sum((c - 1) * len(x) for x, c in again.items()) / len(text), capital / k, odd / k, len(zlib.compress(data, 1)) / n,
        pairs / k, float((lens <= 3).mean()), float((lens >= 12).mean()), sum(c for _, c in counts.most_common(10)) / k, alpha / k,
        float(-(p * np.log2(p)).sum()),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats): the statistics of every whole text, very long ones too; a null text is an empty one, a null key a key
    like others. Repeated rows are rows each; an empty table gives an empty table; other columns, whatever their names,
    are ignored."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_column(rows, "text", "stats array<float>", lambda texts: [[statistics(x) for x in texts]])


@dataclass
class Forest:
    """Complete trees of one depth as arrays: inner nodes (tree x 2^depth - 1), leaves (tree x 2^depth)."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, l2: float = 2.0) -> Forest:
    """Boost on the logistic loss; splits come from gradient histograms over quantile bins. No rows: score 0.5 for all."""
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
        return Forest(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = bins + np.arange(x.shape[1]) * BINS
    width = x.shape[1] * BINS
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    out: tuple[list, list, list] = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, low = 2**level, 2**level - 1
            slot = ((at - low)[:, None] * width + flat).ravel()
            hist = [np.bincount(slot, weights=np.repeat(v, x.shape[1]), minlength=nodes * width).reshape(nodes, x.shape[1], BINS) for v in (g, h)]
            left_g, left_h = hist[0].cumsum(2), hist[1].cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            pick = gain.reshape(nodes, -1).argmax(1)
            for node in range(nodes):
                f, b = divmod(int(pick[node]), BINS)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[low + node], limit[low + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        total += value[leaf]
        for store, v in zip(out, (feature, limit, value)):
            store.append(v)
    return Forest(*(np.stack(v) for v in out), base)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on (key, stats) joined with (key, label). At most ``sample`` labelled rows, those with the least key hashes.

    Null labels and keys teach nothing; a key with several labels counts with their mean, rounded; repeated rows of stats
    count each. Without a labelled row the forest scores all alike. Other columns are ignored.
    """
    one = labels.where("key is not null and label is not null").groupBy("key").agg(F.round(F.avg("label")).cast("int").alias("label"))
    rows = (
        stats.join(one, "key").select("stats", "label", F.xxhash64("key").alias("h"))
        .orderBy("h", "stats").limit(sample).select("stats", "label").toPandas()
    )
    x = np.array(rows["stats"].tolist(), dtype=np.float32).reshape(len(rows), len(FEATURES))
    return fit_forest(x, rows["label"].to_numpy(dtype=np.float64))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """(key, score) of (key, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    make = lambda rows: [shared.value.scores(np.array(rows, dtype=np.float32).reshape(len(rows), len(FEATURES)))]
    return map_column(stats, "stats", "score double", make)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, score) of every row of ``docs``; ``labels``: (key, label). Statistics are computed once and written.

    Null and empty texts have statistics and so a score; texts of any length are read whole; repeated rows and null keys
    are scored row by row; an empty table gives an empty table; other columns, whatever their names, are ignored.
    """
    stats = checkpoint(features(docs, key, text))
    return score(stats, fit(stats, labels, sample))
