"""Periodic runs in texts, found with string synchronising sets.

A run is a stretch of words with smallest period q and at least 2q words that no neighbour extends. The words of many
texts stand in one array of numbers, each text ended by a number of its own, and are looked at in scales of t = 4, 8, 16,
... words. The context of a position is the t words from it on, known by a hash that doubles from scale to scale; of each
t contexts in a row the one whose hash is least synchronises, except for highly periodic contexts (period of at most t/3),
which never do. Places with equal words choose alike, so a run whose period p is from 2t - 1 to 4t - 2 has two of its
synchronising positions p apart, with equal contexts: those pairs propose p. Fewer than t/3 words apart a context that
isn't highly periodic can't recur, so a position has at most twelve partners. Two sorts of runs are supplied otherwise:

* periods up to 6, of which highly periodic regions are made at first, by comparing the words with those 1 to 6 later;
* runs whose whole first period lies in one highly periodic region and the second in the next (like abababa abababa):
  the regions are runs of one smaller period r that touch, and p is known modulo r.

Each proposal is extended word by word in both directions, so hashes decide only what is looked at. What fits with two
periods goes by its extent; its smallest proposal is its period, as all divisors are proposed as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import WORD, column, map_column

#: Words of the shortest run that is reported, and the longest period that is found by plain comparison.
SHORTEST, SMALL = 12, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, each text with a number of its own behind it; and where each text begins."""
    first = np.cumsum([0] + [len(w) + 1 for w in words])
    flat = list(chain.from_iterable(words))
    known = dict(zip(dict.fromkeys(flat), count()))
    out = np.empty(first[-1], dtype=np.int64)
    own = np.ones(len(out), dtype=bool)
    own[first[1:] - 1] = False
    out[own] = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    out[~own] = -1 - np.arange(len(words))
    return out, first


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windowed(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` (a power of two) values in a row."""
    done = 1
    while done < width:
        x, done = best(x[: len(x) - done], x[done:]), 2 * done
    return x


class Stretches:
    """Maximal stretches in which words are equal to those ``p`` later, one for each extent and proposed period."""

    def __init__(self, t: np.ndarray) -> None:
        self.t, self.found = t, set()
        self._last: dict[int, tuple[list[int], list[int]]] = {}

    def take(self, a: int, b: int, p: int) -> None:
        if b - a >= 2 * p:
            self.found.add((a, b, p))

    def covers(self, at: int, p: int) -> bool:
        """Whether ``at`` and ``at + p`` lie in a stretch of period p that was extended before."""
        begins, ends = self._last.get(p, ((), ()))
        k = bisect_left(begins, at + 1) - 1
        return k >= 0 and at + p < ends[k]

    def extend(self, at: int, p: int) -> None:
        """The stretch of period p around ``at`` (whose word is that at ``at + p``)."""
        if self.covers(at, p):
            return
        t, step, hi = self.t, 32, at
        while True:
            n = min(step, len(t) - p - hi)
            differ = np.flatnonzero(t[hi : hi + n] != t[hi + p : hi + p + n])
            if len(differ) or n < step:
                hi += int(differ[0]) if len(differ) else n
                break
            hi, step = hi + n, 2 * step
        step, lo = 32, at
        while True:
            n = min(step, lo)
            differ = np.flatnonzero(t[lo - n : lo] != t[lo + p - n : lo + p])
            if len(differ) or n < step:
                lo -= n - 1 - int(differ[-1]) if len(differ) else n
                break
            lo, step = lo - n, 2 * step
        if hi > lo:
            begins, ends = self._last.setdefault(p, ([], []))
            k = bisect_left(begins, lo)
            begins.insert(k, lo)
            ends.insert(k, hi + p)
            self.take(lo, hi + p, p)

    def smallest(self) -> dict[tuple[int, int], int]:
        """The smallest period of each extent."""
        out: dict[tuple[int, int], int] = {}
        for a, b, p in self.found:
            out[a, b] = min(p, out.get((a, b), p))
        return out


def small_periods(t: np.ndarray, out: Stretches) -> None:
    for p in range(1, SMALL + 1):
        same = np.zeros(max(0, len(t) - p) + 2, dtype=np.int8)
        same[1:-1] = t[: len(same) - 2] == t[p:]
        edge = np.diff(same)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= p
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            out.take(x, y + p, p)


def synchronising(h: np.ndarray, width: int, never: np.ndarray) -> np.ndarray:
    """Positions that have the least hash among some ``width`` contexts in a row; those of ``never`` have none."""
    key = np.where(never, np.uint64(2**64 - 1), h)
    least = _windowed(key, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = _windowed(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero((chosen == key) & ~never)


def highly_periodic(n: int, width: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Which contexts of ``width`` words have a period of at most a third of that."""
    ends = [(a, b - width) for (a, b), q in runs.items() if 3 * q <= width <= b - a]
    step = np.zeros(n + 1, dtype=np.int64)
    if ends:
        a, b = np.array(ends).T
        np.add.at(step, a, 1)
        np.add.at(step, b + 1, -1)
    return np.cumsum(step)[:n] > 0


def proposals(t: np.ndarray, levels: list[np.ndarray], width: int, never: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, periods) of synchronising pairs with equal contexts that lie in a stretch of two periods, by the hashes."""
    h, (low, high) = levels[-1], (2 * width - 1, 4 * width - 2)
    at = synchronising(h, width, never[: len(h)])
    at = at[np.argsort(h[at], kind="stable")]
    same, found_at, found_p = h[at], [], []
    for k in range(1, len(at)):
        near = np.flatnonzero((same[k:] == same[:-k]) & (at[k:] - at[:-k] <= high))
        if not len(near):
            break
        p = at[near + k] - at[near]
        found_at.append(at[near][p >= low])
        found_p.append(p[p >= low])
    at, p = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_at, found_p))
    # the contexts go on alike for how long, up to a period? a stretch of two periods has p pairs of equal words
    right, left = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        own, n = levels[k], 1 << k
        for _ in range(4 if k == len(levels) - 1 else 1):
            able = right + p < len(own)
            able[able] = own[right[able]] == own[(right + p)[able]]
            right[able] += n
            able = left >= n
            able[able] = own[left[able] - n] == own[left[able] + p[able] - n]
            left[able] -= n
    enough = right - left >= p
    return at[enough], p[enough]


def touching(t: np.ndarray, runs: dict[tuple[int, int], int], out: Stretches) -> None:
    """Runs over two highly periodic regions of one period r that touch: every p that fits, as p is known modulo r."""
    by = sorted((q, a, b) for (a, b), q in runs.items() if b - a >= 6 * q - 1)
    for (r, x, y), (q, x2, y2) in zip(by, by[1:]):
        if q != r or x2 > y:
            continue
        root, over, size = t[x2 : x2 + r].tobytes(), t[x : x + 2 * r].tobytes(), t.itemsize
        at = over.find(root)
        while at >= 0 and at % size:
            at = over.find(root, at + 1)
        if at < 0:
            continue
        most = min(y - x, y2 - x2, (y2 - x) // 2)
        for p in range((x2 - x - at // size) % r or r, most + 1, r):
            if p in (x2 - x, y2 - y):
                out.extend(max(x, x2 - p), p)
            else:
                out.take(max(x, x2 - p), min(y + p, y2), p)


def _runs(words: list[list[bytes]], shortest: int) -> list[list[tuple[int, int, int]]]:
    t, first = numbered(words)
    out = Stretches(t)
    small_periods(t, out)
    longest = max(map(len, words), default=0)
    levels, width = [_mixed(t.astype(np.uint64) * _MIX + _MIX)], 1
    while 4 * width - 2 <= longest:
        if 2 * width - 1 > SMALL:
            never = highly_periodic(len(t), width, out.smallest()) if out.found else np.zeros(len(t), dtype=bool)
            at, p = proposals(t, levels, width, never)
            order = np.lexsort((at, p))
            for a, q in zip(at[order].tolist(), p[order].tolist()):
                out.extend(a, q)
        h = levels[-1]
        levels.append(_mixed(h[: len(h) - width] * _MIX + h[width:]))
        width *= 2
    touching(t, out.smallest(), out)
    made: list[list[tuple[int, int, int]]] = [[] for _ in words]
    flat = sorted((a, q, b) for (a, b), q in out.smallest().items() if b - a >= max(shortest, 2 * q))
    docs = np.searchsorted(first, [a for a, _, _ in flat], side="right") - 1
    for k, (a, q, b) in zip(docs.tolist(), flat):
        made[k].append((a - int(first[k]), b - a, q))
    return made


def runs_of(words: list[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    Texts of like length are looked at together, so that short ones don't go through the scales of long ones.
    """
    made: list[list[tuple[int, int, int]]] = [[] for _ in words]
    alike: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        alike.setdefault(len(w).bit_length() // 2, []).append(k)
    for own in alike.values():
        for k, runs in zip(own, _runs([words[k] for k in own], shortest)):
            made[k] = runs
    return made


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for a, n, q in runs:
        step[a + q] += 1
        step[a + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist()) if not x]


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, digest: bool = False) -> DataFrame:
    """Add ``n_words``, ``runs`` (array<struct<start, length, period>> in words from 0, by start, then period) and
    ``collapsed``: the text without what runs repeat, each to its first period, in words with one blank between; with
    ``digest`` the sha256 of runs and of that text instead (``runs_sha256``, ``collapsed_sha256``).

    A null or empty text has no words and no run; repeated rows have the same runs; an empty table gives an empty table.
    Very long texts are handled whole, in memory in proportion to their words. Columns of the names that are added give
    way to them; other columns pass unchanged.
    """
    fields = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>"}
    fields |= {"runs_sha256": "string", "collapsed_sha256": "string"} if digest else {"collapsed": "string"}
    rest = [c for c in docs.columns if c not in fields]
    rows = docs.select(*(column(c).alias(f"_c{k}") for k, c in enumerate(rest)), F.coalesce(column(text), F.lit("")).alias("_text"))

    def make(texts: list[str]) -> list[list]:
        words = [x.encode("utf-8").split() for x in texts]  # of bytes, this takes ASCII white space only
        found = runs_of(words, shortest)
        told = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
        left = [b" ".join(kept(w, runs)) for w, runs in zip(words, found)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        if digest:
            lines = ["".join(f"{a},{n},{q}\n" for a, n, q in runs).encode() for runs in found]
            return [[len(w) for w in words], told, [sha(x) for x in lines], [sha(x) for x in left]]
        return [[len(w) for w in words], told, [x.decode("utf-8") for x in left]]

    made = map_column(rows, "_text", ", ".join(f"{k} {v}" for k, v in fields.items()), make)
    return made.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(rest)), *fields)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, ties by the smallest start, then period; null if there is none."""
    return F.aggregate(
        runs, F.get(runs, 0),
        lambda best, x: F.when((x["length"] > best["length"]) | ((x["length"] == best["length"]) & (F.struct(x["start"], x["period"]) < F.struct(best["start"], best["period"]))), x).otherwise(best),
    )


def looped(text: Column, key: Column) -> Column:
    """A text whose key's crc32 ends in 0 with a tail that goes round: h = crc32 of the key in decimal, g = h div 10, n
    words, and each word i >= a = g % n is word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Others as they are."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    h = F.crc32(key.cast("string").cast("binary"))
    inner = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g"))), lambda x: _round(x["w"], x["g"]))
    return F.when((h % 10 == 0) & (F.coalesce(text, F.lit("")).rlike(WORD)), F.get(inner, 0)).otherwise(text)


def _round(w: Column, g: Column) -> Column:
    n = F.size(w).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + F.pmod(i - a, p)).cast("int")))
    return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")
