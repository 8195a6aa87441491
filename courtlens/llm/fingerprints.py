"""Document fingerprints by invertible Bloom lookup sketches. Native operations only.

A text is cut into paragraph units and each unit hashed to a 64-bit digest. A digest adds itself to one cell of each
subtable of a sketch: a count, the xor of the digests and the xor of their check hashes. The sketches of two versions
subtract cell by cell; a cell left with one digest gives it away, and taking it out of its other cells frees more
(peeling), until all digests that differ are known. The published fingerprints, which are sketches of one small size,
are subtracted first, row by row. Only where peeling gets stuck do larger sketches of both versions follow, with another
seed and of a size that fits the difference as the stuck sketch shows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint

#: A unit is a paragraph; long ones are cut behind the first sentence end past UNIT_MIN characters, or at UNIT_MAX.
UNIT_MIN, UNIT_MAX = 96, 255
UNITS = rf"[^\n]{{{UNIT_MIN},{UNIT_MAX}}}?[.!?](?=\s|$)|[^\n]{{1,{UNIT_MAX}}}"
#: Subtables of a sketch, cells of a subtable of the base sketch, and the fewest of a larger one.
TABLES, PLACES, LARGER = 3, 8, 32
CELLS = TABLES * PLACES
#: Peeling rounds of one larger sketch, tries with sketches that are each four times as large, and digests of a partition.
ROUNDS, TRIES, PART = 5, 12, 150_000
#: Documents of a bucket of consecutive ids, and the most buckets (which bounds what is broadcast).
BUCKET_ROWS, MAX_BUCKETS = 2_000, 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row, not at each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def units(text: Column) -> Column:
    """The distinct digests of the units of a text; blank units don't count. The empty text has none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _places(digest: Column, seed: int, places: Column) -> list[Column]:
    """The cell of a digest in each subtable; ``places`` is their number of cells."""
    return [F.pmod(F.xxhash64(F.lit(3 * seed + t), digest), places) + t * places for t in range(TABLES)]


def _check(digest: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(-seed - 1), digest)


def sketch(digests: Column, seed: int = 0) -> Column:
    """The cells (n, key, check) of the base sketch of an array of digests."""
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("n", "key", "check")))
    add = lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["check"].bitwiseXOR(x["check"]).alias("check"))
    cells = lambda d: F.struct(d.alias("key"), _check(d, seed).alias("check"), *(x.alias(f"p{t}") for t, x in enumerate(_places(d, seed, F.lit(PLACES).cast("long")))))

    def table(keyed: Column, t: int) -> Column:
        numbers = F.sequence(F.lit(t * PLACES).cast("long"), F.lit((t + 1) * PLACES - 1).cast("long"))
        return F.transform(numbers, lambda i: F.aggregate(F.filter(keyed, lambda x: x[f"p{t}"] == i), zero, add))

    return let(F.transform(digests, cells), lambda keyed: F.concat(*(table(keyed, t) for t in range(TABLES))))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of the differences of two base sketches."""
    less = lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check"))
    return F.zip_with(a, b, less)


def peel_base(cells: Column) -> Column:
    """struct(plus, minus, stuck, empty) of a difference of base sketches: the digests on either side only, whether
    some cells resist, and how many cells were empty at first, which says how large the difference is."""
    blank = lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)
    state = lambda cells, plus, minus, more: F.struct(cells.alias("cells"), plus.alias("plus"), minus.alias("minus"), more.alias("more"))
    zero = F.lit(0).cast("long")

    def step(s: Column, _: Column) -> Column:
        def remove(p: Column) -> Column:
            out = lambda c: F.struct((c["n"] - p["n"]).alias("n"), c["key"].bitwiseXOR(p["key"]).alias("key"), c["check"].bitwiseXOR(p["check"]).alias("check"))
            left = lambda at: F.transform(s["cells"], lambda c, i: F.when(F.array_contains(at, i.cast("long")), out(c)).otherwise(c))
            cells = let(F.array(*_places(p["key"], 0, F.lit(PLACES).cast("long"))), left)
            return F.when(p.isNull(), state(s["cells"], s["plus"], s["minus"], F.lit(False))).otherwise(
                state(cells, s["plus"] + (p["n"] == 1).cast("long"), s["minus"] + (p["n"] == -1).cast("long"), F.lit(True))
            )

        pure = F.get(F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"], 0))), 0)
        return F.when(s["more"], let(pure, remove)).otherwise(s)

    done = lambda s: F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"), F.exists(s["cells"], lambda c: ~blank(c)).alias("stuck"))
    peeled = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), state(d, zero, zero, F.lit(True)), step, done)
    return let(cells, lambda d: let(peeled(d), lambda x: F.struct(x["plus"].alias("plus"), x["minus"].alias("minus"), x["stuck"].alias("stuck"), F.size(F.filter(d, blank)).alias("empty"))))


STATE = ("n", "key", "chk", "plus", "minus")


def _row(kind: int, id_: Column, **values: Column) -> Column:
    """A row of the peeling state: kind 0 a cell, 1 a digest just recovered, 2 the tally of those recovered."""
    cells = [values.get(x, F.lit(0)).cast("long").alias(x) for x in STATE]
    return F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), *cells)


def _regroup(rows: DataFrame, made: Column, combine: bool) -> DataFrame:
    """Replace each row by the rows of an array, then bring rows of one cell (or digest) together."""
    group = ("rid", "pair", "places", "kind", "id")
    rows = rows.select("rid", "pair", "places", F.explode(made).alias("x")).select("rid", "pair", "places", "x.*")
    if not combine:
        return rows.groupBy(*group).agg(*(F.max(x).alias(x) for x in STATE))
    rows = rows.groupBy(*group).agg(*((F.bit_xor if x in ("key", "chk") else F.sum)(x).alias(x) for x in STATE))
    return rows.where("kind = 2 or n <> 0 or key <> 0 or chk <> 0")


def _cells(n: Column, key: Column, seed: int) -> list[Column]:
    return [_row(0, at, n=n, key=key, chk=_check(key, seed)) for at in _places(key, seed, F.col("places"))]


def peel(pairs: DataFrame, seed: int) -> DataFrame:
    """(rid, pair, plus, minus, stuck): how many digests are on either side only, and how many cells resist.

    ``pairs``: rid, pair, places, a, b (digest arrays). Adding a's digests and b's with a minus to the same cells is
    the difference of their sketches. A round finds the pure cells, brings equal finds together, and takes each digest
    out of its cells. All rounds group by rid and more, so the one shuffle by rid serves them all.
    """
    signed = lambda c, n: F.transform(c, lambda d: F.struct(F.lit(n).alias("n"), d.alias("key")))
    entries = pairs.select("rid", "pair", "places", F.explode(F.concat(signed("a", 1), signed("b", -1), F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"))))).alias("e"))
    entries = entries.select("rid", "pair", "places", "e.*")
    tally = _row(2, F.lit(0))
    state = _regroup(entries, F.when(F.col("n") == 0, F.array(tally)).otherwise(F.array(*_cells(F.col("n"), F.col("key"), seed))), True)
    same = F.struct("kind", "id", *STATE)
    n, key = F.col("n"), F.col("key")
    pure = (F.col("kind") == 0) & (F.abs("n") == 1) & (F.col("chk") == _check(key, seed))
    for _ in range(ROUNDS):
        state = _regroup(state, F.when(pure, F.array(same, _row(1, key, n=n, key=key))).otherwise(F.array(same)), False)
        out = [*_cells(-n, key, seed), _row(2, F.lit(0), plus=(n == 1).cast("long"), minus=(n == -1).cast("long"))]
        state = _regroup(state, F.when(F.col("kind") == 1, F.array(*out)).otherwise(F.array(same)), True)
    return state.groupBy("rid", "pair").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.count_if(F.col("kind") == 0).alias("stuck"))


def expected(empty: Column, both: Column) -> Column:
    """How many digests differ if ``empty`` of the base sketch's cells are empty; all of ``both`` if none is."""
    guess = F.ceil(F.log(F.greatest(empty, F.lit(1)) / F.lit(float(CELLS))) / F.log(F.lit(1 - 1 / PLACES)))
    return F.when(empty == 0, both).otherwise(F.least(both, guess.cast("int")))


def differences(versions: DataFrame) -> DataFrame:
    """(rid, pair, plus, minus) of rows (rid, pair, empty, a, b) whose base sketches didn't peel: ``a`` and ``b`` are the
    digests, ``empty`` the cells that the base sketches' difference left empty. Sketches grow until all are recovered."""
    wanted = F.greatest(F.lit(LARGER), expected(F.col("empty"), F.size("a") + F.size("b"))).cast("double")
    todo = versions.withColumn("places", F.pow(F.lit(2.0), F.ceil(F.log2(wanted))).cast("long")).drop("empty")
    found = None
    for level in range(1, TRIES + 1):
        load = todo.agg(F.sum((F.size("a") + F.size("b")).cast("long"))).first()[0] or 0
        now = checkpoint(peel(todo.repartition(max(1, -(-load // PART)), "rid"), level))
        done = now.where("stuck = 0").drop("stuck")
        found = done if found is None else found.unionByName(done)
        stuck = now.where("stuck > 0").select("rid", "pair")
        if stuck.isEmpty():
            return found
        todo = todo.join(stuck, ["rid", "pair"]).withColumn("places", 4 * F.col("places"))
    raise RuntimeError("sketches don't peel at any size")  # each try fails by chance alone


def likeness(n: Column, plus: Column, minus: Column) -> Column:
    """Share of units in common, 0 to 1, from the recovered differences of a version of n units; two versions without
    units are alike."""
    both = n + minus
    return F.when(both == 0, F.lit(1.0)).otherwise((n - plus) / both)


def fingerprint(cells: Column) -> Column:
    """A base sketch as text: for each cell the count, the key and half the check, in base 64."""
    part = lambda c: F.concat(
        F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(F.shiftrightunsigned(c["check"], 32)), 8, "0")
    )
    return F.base64(F.unhex(F.array_join(F.transform(cells, part), "")))


def with_next(docs: DataFrame, key: str, columns: list[str], bucket_rows: int = BUCKET_ROWS, tie: list[str] | None = None) -> DataFrame:
    """Add ``next_<column>`` of the next row in descending order of the key; behind the last row comes the first.

    Rows are dealt to buckets of consecutive keys, whose limits are quantiles, and each bucket also gets the first row
    of the bucket that follows. Equal keys go by the hash of the columns ``tie`` (all, if none are named), by which a key
    with very many rows is dealt to several buckets; null keys come last. Rows that are equal in key and hash, if very
    many, stand for one row in that order: all but one of them have their own columns next, and they are made again from
    it in many tasks. There are at most some 2 * MAX_BUCKETS buckets, and a row of fixed size for each is broadcast.
    """
    from pyspark.ml.feature import Bucketizer

    rows = docs.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(-1.7e308))).withColumn("_tie", F.xxhash64(*(tie or columns)))
    n = docs.count()
    number, size = max(1, min(MAX_BUCKETS, n // bucket_rows)), max(bucket_rows, n // MAX_BUCKETS)
    # at most MAX_BUCKETS / 2 keys have so many rows, and as many pairs of key and hash
    same = checkpoint(rows.groupBy("_at", "_tie").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")))
    # keys that are one number as doubles are not split
    split = F.min("lo").eqNullSafe(F.max("hi"))
    hot = same.groupBy("_at").agg(F.sum("n").alias("n"), F.sum(F.when((F.col("n") > 2 * size) & F.col("lo").eqNullSafe(F.col("hi")), 1).otherwise(F.col("n"))).alias("left"), split.alias("_one")).where((F.col("n") > 2 * size) & F.col("_one"))
    hot = checkpoint(hot.select("_at", F.ceil(F.col("left") / size).alias("_parts")))
    many = same.where((F.col("n") > 2 * size) & F.col("lo").eqNullSafe(F.col("hi"))).select("_at", "_tie", F.lit(True).alias("_many"))
    cuts = {*(rows.approxQuantile("_at", [k / number for k in range(1, number)], 1 / (4 * number)) if number > 1 else [])}
    for x in hot.collect():
        cuts |= {x["_at"], math.nextafter(x["_at"], math.inf)}
    rows = rows.join(F.broadcast(many), ["_at", "_tie"], "left")
    once = rows.where("_many").groupBy(*docs.columns, "_at", "_tie").agg(F.count("*").alias("_times"))
    rows = rows.where("_many is null").drop("_many").withColumn("_times", F.lit(1).cast("long")).unionByName(once)
    rows = Bucketizer(splits=[float("-inf"), *(sorted(cuts) or [0.0]), float("inf")], inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(rows)
    share = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * F.col("_parts"))
    rows = rows.join(F.broadcast(hot), "_at", "left").withColumn("_sub", F.coalesce(F.least(share, F.col("_parts") - 1), F.lit(0)))
    order, first = (F.desc_nulls_last(key), "_tie"), (F.col(key), F.bitwise_not(F.col("_tie")))
    tops = rows.groupBy("_bucket", "_sub").agg(F.max(F.struct(first[0].alias("key"), first[1].alias("tie"))).alias("top"))
    down, place = Window.orderBy(F.desc("_bucket"), "_sub"), F.struct(F.col("_bucket").alias("b"), F.col("_sub").alias("s"))
    last = F.last(place).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("_bucket", "_sub", "top", F.coalesce(F.lag(place).over(down), last).alias("to"))
    marked = rows.join(F.broadcast(tops), ["_bucket", "_sub"])
    is_top = first[0].eqNullSafe(F.col("top.key")) & (first[1] == F.col("top.tie"))
    to = lambda b, s, guest: F.struct(b.alias("b"), s.alias("s"), F.lit(guest).alias("guest"))
    own = to(F.col("_bucket"), F.col("_sub"), False)
    places = F.when(is_top, F.array(own, to(F.col("to.b"), F.col("to.s"), True))).otherwise(F.array(own))
    dealt = marked.select(*docs.columns, "_tie", "_times", F.explode(places).alias("_to"))
    w = Window.partitionBy("_to.b", "_to.s").orderBy("_to.guest", *order)
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("not _to.guest").drop("_to")
    # the copies of a row that stands for many, in lots that are made in tasks of their own
    lots = out.where("_times > 1").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 2) / size))))
    lots = lots.repartition(*(F.col(c) for c in (key, "_tie", "_lot"))).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(size), F.col("_times") - 1 - F.col("_lot") * size))))
    copies = lots.select(*docs.columns, *(F.col(c).alias(f"next_{c}") for c in columns))
    return out.drop("_tie", "_times").unionByName(copies)


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare it with that and with the next document.

    The edited text has its last third (rounded down, in code points) replaced by as many of the first code points of
    the next document in descending key order. Null texts are empty; null keys come last and equal keys go by the hash of
    their text; repeated rows are documents of their own; a lone document is its own next; an empty table gives an empty
    table. Other columns are ignored. Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).
    """
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    rows = with_next(whole.withColumn("u", units(F.col("t"))), "doc_id", ["t", "u"], tie=["t"])
    k = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring("next_t", F.lit(1), k))
    rows = rows.withColumn("n_chars", F.char_length("t").cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "u", "next_u", units(F.col("edited")).alias("e"))
    both = F.struct(sketch(F.col("u")).alias("u"), sketch(F.col("e")).alias("e"), sketch(F.col("next_u")).alias("n"))
    base = lambda s: F.struct(
        fingerprint(s["u"]).alias("fingerprint"), fingerprint(s["e"]).alias("edited_fingerprint"),
        peel_base(subtract(s["u"], s["e"])).alias("edited"), peel_base(subtract(s["u"], s["n"])).alias("next"),
    )
    rows = rows.withColumn("base", let(both, base))
    stuck_edited, stuck_next = F.col("base.edited.stuck"), F.col("base.next.stuck")
    rows = checkpoint(rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", "edited_sha256", "base", F.size("u").cast("long").alias("n"),
        F.when(stuck_edited | stuck_next, F.col("u")).alias("u"), F.when(stuck_edited, F.col("e")).alias("e"), F.when(stuck_next, F.col("next_u")).alias("next_u"),
    ))
    stuck = lambda pair, b: rows.where(f"base.{pair}.stuck").select("rid", F.lit(pair).alias("pair"), F.col(f"base.{pair}.empty").alias("empty"), F.col("u").alias("a"), F.col(b).alias("b"))
    found = differences(stuck("edited", "e").unionByName(stuck("next", "next_u")))
    wide = found.groupBy("rid").agg(*(F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{p}_{c}") for p in ("edited", "next") for c in ("plus", "minus")))
    known = lambda p, c: F.when(F.col(f"base.{p}.stuck"), F.col(f"{p}_{c}")).otherwise(F.col(f"base.{p}.{c}"))
    return rows.join(wide, "rid", "left").select(
        "doc_id", "n_chars", "edited_sha256", "base.fingerprint", "base.edited_fingerprint",
        *(likeness(F.col("n"), known(p, "plus"), known(p, "minus")).alias(f"near_{p}") for p in ("edited", "next")),
    )
