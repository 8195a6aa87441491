"""N-gram Jaccard join by chosen paths.

Word shingles form sets; each set is embedded as SIGNATURE tokens (i, least hash i). A run splits all sets recursively:
the path so far chooses one token position, and sets that share the token there go on together. Buckets that have become
small are compared by brute force on the embedded tokens; runs repeat until pairs at the threshold meet with the target
probability, and more often for sets whose buckets are split deeper. Sets that may be alike form families, within which
pairs are compared exactly on the whole sets; sets whose sizes rule the threshold out don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.blocks import FIELDS, join_blocks
from courtlens.llm.common import checkpoint, column, map_column, release, ship, tidy
from courtlens.llm.components import components
from courtlens.llm.substring import mix, word_hashes

#: Words of a shingle and tokens of an embedded set.
WORDS, SIGNATURE = 5, 64
#: Splits before a bucket is compared, at most, and the size from which a bucket is split further.
SHALLOW, DEEP, SMALL = 3, 5, 64
#: Sets of a family that one task compares with others at a time, and bucket sizes (24 bytes each) up to which they are
#: broadcast; beyond that they are joined by shuffles, of which Spark splits skewed parts.
BLOCK, BROADCAST = 512, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.RandomState(20).randint(0, 2**63 - 1, SIGNATURE).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of n words in a row of each text; of all words, if there are fewer; none without words."""
    words, first = word_hashes([x or "" for x in texts])
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : k + len(total)]
    total = mix(total)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                short = short * _BASE + w
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def embed(texts: list[str | None], n: int = WORDS) -> list[list]:
    """(uid, sig, size): a 64-bit key of the whole set, its embedded tokens and its size; null for texts without words."""
    sets = shingles(texts, n)
    uid, sig, size = [None] * len(sets), [None] * len(sets), [len(x) or None for x in sets]
    some = [k for k, x in enumerate(sets) if len(x)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        begin = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
        keys = mix(np.add.reduceat(mix(flat ^ _BASE), begin)).view(np.int64)
        least = np.stack([np.minimum.reduceat(flat * odd, begin) for odd in _ODD], axis=1)
        least = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        for j, k in enumerate(some):
            uid[k], sig[k] = int(keys[j]), least[j]
    return [uid, sig, size]


def runs_for(threshold: float, recall: float, depth: int = SHALLOW) -> int:
    """Runs after which a pair at the threshold has met in a bucket after ``depth`` splits with the target probability.

    All runs draw from the same embedded tokens: the chance is averaged over how many of them agree.
    """
    agree = [(math.comb(SIGNATURE, k) * threshold**k * (1 - threshold) ** (SIGNATURE - k), (k / SIGNATURE) ** depth) for k in range(SIGNATURE + 1)]
    missed = lambda runs: sum(p * (1 - met) ** runs for p, met in agree)
    low, high = 0, 1
    while missed(high) > 1 - recall:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > 1 - recall else (low, mid)
    return high


def _alike(least: float):
    """Links of sets within buckets, sorted by bucket, whose embedded tokens agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            size = batch.column(2).flatten()
            bucket, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = size.to_numpy().reshape(len(bucket), -1)
            if rest is not None:
                bucket, uid, sig = (np.concatenate(x) for x in zip(rest, (bucket, uid, sig)))
            a, b = [], []
            for k in range(1, len(bucket)):
                same = np.flatnonzero(bucket[k:] == bucket[:-k])
                if not len(same):
                    break
                for at in range(0, len(same), 16_384):
                    i = same[at : at + 16_384]
                    i = i[(sig[i] == sig[i + k]).mean(1) >= least]
                    a.append(uid[i])
                    b.append(uid[i + k])
            keep = bucket == bucket[-1] if len(bucket) else slice(0)
            rest = (bucket[keep], uid[keep], sig[keep])
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])
            del batch, size, sig, a, b
            tidy()

    return run


def _meet(sets: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the runs from first to last: (bucket, uid) of buckets to compare, links (a, b) of those that stay large after
    all splits, and the sets (uid) that were in a bucket which is split further."""
    rows = sets.select("uid", "sig", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("run"))
    for d in range(1, DEEP + 1):  # each path builds on the column before it
        before = F.col(f"p{d - 1}") if d > 1 else F.xxhash64("run")
        rows = rows.withColumn(f"p{d}", F.xxhash64(before, F.element_at("sig", (F.pmod(before, F.lit(SIGNATURE)) + 1).cast("int"))))
    active = rows.select("uid", *(f"p{d}" for d in range(SHALLOW, DEEP + 1)))
    small, dense, crowded = None, None, None
    for d in range(SHALLOW, DEEP + 1):
        sizes = active.groupBy(F.col(f"p{d}").alias("bucket")).agg(F.count("*").alias("size"), F.min("uid").alias("least")).where("size > 1")
        sizes = checkpoint(sizes)
        few = sizes.count() <= BROADCAST
        met = active.withColumn("bucket", F.col(f"p{d}")).join(F.broadcast(sizes) if few else sizes, "bucket")
        met = checkpoint(met.select("uid", "bucket", "size", "least", *(f"p{x}" for x in range(d + 1, DEEP + 1))))
        few = met.where(F.col("size") <= SMALL).select("bucket", "uid")
        small = few if small is None else small.unionByName(few)
        large = met.where(F.col("size") > SMALL)
        crowded = large.select("uid").distinct() if crowded is None else crowded
        dense = large.select(F.col("uid").alias("a"), F.col("least").alias("b"))
        active = large.drop("bucket", "size", "least")
        if active.isEmpty():
            break
    return small, dense, crowded


def candidates(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) that join the sets (uid, sig) which may be alike into families.

    A pair meets in a bucket of SHALLOW splits with the target probability. If that bucket is split further, both of its
    sets take part in as many more runs as a pair needs to stay together through DEEP splits. Each part may miss half
    of what the target lets go.
    """
    runs, more = (runs_for(threshold, (1 + recall) / 2, depth) for depth in (SHALLOW, DEEP))
    small, dense, crowded = _meet(sets, 1, runs)
    crowded = checkpoint(sets.join(crowded, "uid", "left_semi"))
    if more > runs and not crowded.isEmpty():
        small, dense = (x.unionByName(y) for x, y in zip((small, dense), _meet(crowded, runs + 1, more)))
    slack = 4.5 * math.sqrt(threshold * (1 - threshold) / SIGNATURE)
    close = (
        small.join(sets, "uid").select("bucket", "uid", "sig").repartition("bucket").sortWithinPartitions("bucket", "uid")
        .mapInArrow(_alike(threshold - slack), "a long, b long")
    )
    return close.unionByName(dense)


def _load(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in raw]


def _hits(threshold: float):
    share = threshold / (1 + threshold)

    def hits(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact Jaccard on whole sets: common members by products of the columns that two sets or more have."""
        own = a is b
        rows = a if own else a + b
        sizes = np.array([len(x) for x in rows])
        flat = np.concatenate(rows)
        value, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rows)), sizes)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[col]
        row, col = row[keep], number[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width, step = int(shared.sum()), 8_192
        common = np.zeros((len(a), len(a) if own else len(b)), dtype=np.float32)
        for c in range(0, width, step):
            lo, hi = np.searchsorted(col, [c, c + step])
            part = np.zeros((len(rows), min(step, width - c)), dtype=np.float32)
            part[row[lo:hi], col[lo:hi] - c] = 1
            common += part @ part.T if own else part[: len(a)] @ part[len(a) :].T
        total = sizes[: len(a)][:, None] + (sizes if own else sizes[len(a) :])[None, :]
        return common >= share * total - 1e-9 * total

    return hits


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.9999, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(key, row, component, class_id, n_links, empty) of every row: its class of near-duplicates and its links.

    Two documents are linked if their sets of word shingles have a Jaccard similarity of at least ``threshold``; a class
    is what hangs together by links, and its id the least key in it. Documents with equal sets are compared once and
    counted by weight. Texts of fewer than ``words`` words have one shingle; those without words (empty, null) link with
    nothing, and their class is their own key. Repeated rows link with each other; null keys are no class id, unless
    all keys of the class are null. So classes may share an id; ``component`` tells them apart and is null without words.
    ``row`` is a hash of key and text that tells rows apart; ``empty`` marks rows without words. Sets are told apart by 64 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), text).alias("row"), F.col(text).alias("text"))
    all_rows = checkpoint(map_column(rows, "text", "uid long, sig array<int>, size int", lambda x: embed(x, words)))
    sets = checkpoint(all_rows.where("uid is not null").groupBy("uid").agg(F.count("*").alias("n"), F.min("key").alias("least"), *(F.min(c).alias(c) for c in ("row", "sig", "size"))))
    release(spark)
    families = checkpoint(components(candidates(sets.select("uid", "sig"), threshold, recall), "a", "b").withColumnRenamed("node", "uid").withColumnRenamed("component", "family"))
    release(spark)
    # sizes of linked sets are of one class or of two neighbouring ones
    width = math.log(1 / threshold) * (1 + 1e-9) if threshold < 1 else 1e-9
    members = families.join(sets.select("uid", "n", "row", F.floor(F.log(F.col("size").cast("double")) / width).alias("cls")), "uid")
    sizes = members.groupBy("family", "cls").agg(F.ceil(F.count("*") / block).alias("parts"))
    above = sizes.select("family", (F.col("cls") - 1).alias("cls"), F.col("parts").alias("above"))
    members = members.join(sizes, ["family", "cls"]).join(above, ["family", "cls"], "left").withColumn("home", F.pmod(F.xxhash64("uid"), "parts"))
    texts = rows.dropDuplicates(["row"]).join(members, "row").select("uid", "n", "family", "cls", "parts", "above", "home", "text")
    data = map_column(texts, "text", "data binary", lambda x: [[s.astype("<u8").tobytes() for s in shingles(x, words)]])
    # of two different blocks of a class one visits the other; the blocks of a class visit all those of the class above
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = F.filter(numbers("parts"), lambda b: (b == F.col("home")) | ((((b + F.col("home")) % 2 == 0) == (b < F.col("home"))) & (b != F.col("home"))))
    visits = F.concat(
        F.transform(own, lambda b: F.struct(F.col("cls").alias("c"), b.alias("b"))),
        F.when(F.col("above").isNotNull(), F.transform(numbers("above"), lambda b: F.struct((F.col("cls") + 1).alias("c"), b.alias("b")))).otherwise(F.array().cast("array<struct<c:bigint,b:bigint>>")),
    )
    dealt = (
        data.select("uid", "n", "family", "cls", "home", "data", F.explode(visits).alias("v"))
        .select(F.xxhash64("family", "v.c", "v.b").alias("block"), ((F.col("v.c") != F.col("cls")) | (F.col("v.b") != F.col("home"))).alias("guest"), "uid", "n", "data")
        .repartition("block").sortWithinPartitions("block", "guest", "uid")
    )
    linked = checkpoint(dealt.mapInArrow(join_blocks(_load, _hits(threshold)), FIELDS))
    release(spark)
    counts = linked.where("other is null").groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(linked.where("other is not null"), "uid", "other").withColumnRenamed("node", "uid")
    found = sets.select("uid", "least", "n").join(counts, "uid", "left").join(classes, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = found.groupBy("component").agg(F.min("least").alias("class_id"))
    found = found.join(least, "component").select("uid", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "class_id")
    return all_rows.select("key", "row", "uid").join(found, "uid", "left").select(
        F.col("key").alias(key), "row", "component", F.when(F.col("uid").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("uid").isNull().alias("empty"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates, the one with the least key (null only if all are); rows without words
    (null, empty) all stay, unless they repeat a row's key and text. Texts of any length count whole; an empty table gives
    an empty table; other columns, whatever their names, pass unchanged."""
    found = join(docs, key, text, threshold).withColumnRenamed(key, "_key")
    best = found.where("not empty").groupBy("component").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "row")).alias("x")).select(F.col("x.row").alias("_row"))
    kept = best.unionByName(found.where("empty").select(F.col("row").alias("_row"))).distinct()
    inner = [column(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*inner, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.col(text)).alias("_row"))
    return rows.join(kept, "_row").dropDuplicates(["_row"]).select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)))
