"""A context-mixing range coder for token ids, in independent blocks that numpy codes side by side.

A block is cut into runs, and runs of like ids (those of one language, say) are a kind. It begins with its distinct ids
and their counts in each kind. The runs then advance together, and each id is coded by a mixture of three predictions:
order 0, the counts of the run's kind; order 1 and order 2, the id that follows the last id, or the last two, as far as
seen in any run of the block. Their shares depend on how sure both guesses are, and move to whichever prediction gave the
ids that came (each is credited with its part of the probability). Ids have up to 32 bits.

All runs of a call advance one id a step, so that a step is a few array operations over the runs. Counts are known
before, so an id's place among them is one look at a table. Weights are whole numbers, and divisions are rounded alike
everywhere; the coder is a range coder with 50-bit range, 16-bit output and carries.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, ids of a run, and runs that are coded side by side.
BLOCK, RUN, LANES = 65_536, 512, 8_192
#: The most that a guess weighs against order 0, and places for what followed two ids.
_MOST, _PLACES = 32.0, 1 << 16
#: The most kinds of runs in a block, the fewest runs a kind is made for, the ids that tell them apart, and how often runs are dealt anew.
_KINDS, _KIND_RUNS, _TELLING, _ROUNDS = 4, 8, 512, 3
#: States of the two guesses (sureness 0 to 3 each, equal or not), and what is shared out among predictions at each id.
_STATES, _CREDIT = 32, 32
#: Shares move at each of the first steps, and at one of so many later ones.
_EARLY, _EVERY = 32, 4
#: The next sureness of a guess by 2 * sureness + hit. A number stays while its guess is surer than 1, else the one that came is next.
_SURER = np.array([1, 1, 1, 2, 1, 3, 2, 3], dtype=np.int32)
_BITS, _LEAST = 50, 1 << 34
_MAGIC = b"CMR3"


def _runs(n: int) -> int:
    return -(-n // RUN)


class _Layout:
    """Runs of some blocks, the longest first; runs of a block stay in their order."""

    def __init__(self, sizes: list[int]):
        n, number = np.array(sizes, dtype=np.int64), np.array([_runs(x) for x in sizes], dtype=np.int64)
        block = np.repeat(np.arange(len(n)), number)
        self.first = np.cumsum(number) - number
        run = np.arange(len(block)) - self.first[block]
        step = -(-n // np.maximum(number, 1))[block]
        length = np.minimum(n[block] - run * step, step)
        self.order = np.argsort(-length, kind="stable")
        self.block, self.length = block[self.order], length[self.order]
        self.start = (np.cumsum(n) - n)[self.block] + (run * step)[self.order]
        self.place = np.argsort(self.order)
        self.active = np.searchsorted(-self.length, -np.arange(length.max(initial=0)), side="left").tolist()


def _at(table: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Values at places that are all within the table, which goes unchecked."""
    return table.take(i, mode="clip")


class _Models:
    """What each block has learned so far, shared by its runs. Tables are flat, a stretch for each block (those of counts
    for each kind of a block); guesses hold number * 4 + sureness."""

    def __init__(self, at: _Layout, counts: list[np.ndarray], kinds: list[np.ndarray]):
        number = np.array([c.shape[0] for c in counts], dtype=np.int64)
        distinct = np.array([c.shape[1] for c in counts], dtype=np.int64)
        b, rows = at.block, [row for c in counts for row in c]
        kind = (np.repeat(np.cumsum(number) - number, [len(x) for x in kinds]) + np.concatenate([np.zeros(0, dtype=np.int64), *kinds]))[at.order]
        width, n = np.repeat(distinct, number), np.array([int(x.sum()) for x in rows], dtype=np.int64)
        # where each number begins among the counts, and the last one ends; the number at each place
        self.begin = np.concatenate([np.zeros(0, dtype=np.int32), *(np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(x, dtype=np.int32)]) for x in rows)])
        self.slot = np.concatenate([np.zeros(0, dtype=np.uint16), *(np.repeat(np.arange(len(x), dtype=np.uint16), x) for x in rows), np.zeros(1, dtype=np.uint16)])
        self.own, self.places = (np.cumsum(width + 1) - width - 1)[kind].astype(np.int32), (np.cumsum(n) - n)[kind].astype(np.int32)
        self.narrow, self.wide, self.states = (np.cumsum(distinct) - distinct)[b], b * _PLACES, b * _STATES
        self.table1, self.table2 = np.zeros(int(distinct.sum()), dtype=np.int32), np.zeros(len(counts) * _PLACES, dtype=np.int32)
        self.n = n[kind].astype(np.int32)
        state = np.arange(_STATES)
        self.w0 = np.tile(np.full(_STATES, 6.0 * _CREDIT), len(counts))
        self.w1, self.w2 = np.tile(1.0 * ((state >> 1) & 3) * _CREDIT, len(counts)), np.tile(2.0 * (state >> 3) * _CREDIT, len(counts))
        self.p, self.q = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self._share()

    def _share(self) -> None:
        self.share1, self.share2 = np.minimum(self.w1 / self.w0, _MOST), np.minimum(self.w2 / self.w0, _MOST)

    def guess(self, k: int) -> None:
        """The guesses for the next id of the first k runs, and their weights."""
        n, p = self.n[:k], self.p[:k]
        self.i1 = self.narrow[:k] + p
        self.i2 = self.wide[:k] + ((self.q[:k] * 40_503 + p * 5) & (_PLACES - 1))
        v1, v2 = _at(self.table1, self.i1), _at(self.table2, self.i2)
        self.s1, self.s2, self.sure1, self.sure2 = v1 >> 2, v2 >> 2, v1 & 3, v2 & 3
        self.j = self.states[:k] + ((self.sure2 << 3) + (self.sure1 << 1) + (self.s1 == self.s2))
        self.m1, self.m2 = (_at(self.share1, self.j) * n).astype(np.int32), (_at(self.share2, self.j) * n).astype(np.int32)
        self.total = n + self.m1 + self.m2

    def interval(self, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the number x lies in the mixture: what comes before it, and its own part."""
        i = self.own[:k] + x
        self.e1, self.e2 = x == self.s1, x == self.s2
        begin = _at(self.begin, i)
        self.part = _at(self.begin, i + 1) - begin + self.m1 * self.e1 + self.m2 * self.e2
        return begin + self.m1 * (x > self.s1) + self.m2 * (x > self.s2), self.part

    def find(self, k: int, at: np.ndarray) -> np.ndarray:
        """The number at a place of the mixture. What a guess adds stands behind its counts; the lower guess's is taken out first."""
        own = self.own[:k] + 1
        swap, low, high = self.s1 > self.s2, np.minimum(self.s1, self.s2), np.maximum(self.s1, self.s2)
        m_low = self.m1 + swap * (self.m2 - self.m1)
        over = at - _at(self.begin, own + low)
        out = np.minimum(np.maximum(over, 0), m_low)
        hit_low = (over == out) & (out < m_low)
        at = at - out
        m_high = self.m1 + self.m2 - m_low
        over = at - _at(self.begin, own + high)
        out = np.minimum(np.maximum(over, 0), m_high)
        hit_high = (over == out) & (out < m_high)
        x = _at(self.slot, self.places[:k] + (at - out)).astype(np.int32)
        x += hit_high * (high - x)
        x += hit_low * (low - x)
        return x

    def learn(self, t: int, x: np.ndarray) -> None:
        if t < _EARLY or t % _EVERY == 0:
            n = len(self.w0)
            self.w0 += np.bincount(self.j, minlength=n) * _CREDIT
            for e, m, w in ((self.e1, self.m1, self.w1), (self.e2, self.m2, self.w2)):
                hit = np.flatnonzero(e)
                credit = np.bincount(_at(self.j, hit), weights=np.floor(_at(m, hit) * float(_CREDIT) / _at(self.part, hit)), minlength=n)
                w += credit
                self.w0 -= credit
            self._share()
        for table, i, s, sure, e in ((self.table1, self.i1, self.s1, self.sure1, self.e1), (self.table2, self.i2, self.s2, self.sure2, self.e2)):
            number = x + (sure > 1) * (s - x)
            table[i] = (number << 2) | _at(_SURER, (sure << 1) + e)  # the last run wins
        self.p, self.q = x.astype(np.int64), self.p


def _numbers(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block in ascending order, and the number of each id among them."""
    if len(block) and block.max() < 1 << 16:
        seen = np.bincount(block) > 0
        return np.flatnonzero(seen), (np.cumsum(seen) - 1)[block]
    ids, number = np.unique(block, return_inverse=True)
    return ids.astype(np.int64), number


def _kinds(number: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each kind, kind of each run): the runs that other kinds cost most begin one, then each goes to its cheapest."""
    runs = _runs(len(number))
    run = np.arange(len(number)) // -(-len(number) // runs)
    each = np.bincount(run * distinct + number, minlength=runs * distinct).reshape(runs, distinct)
    most, kind = min(_KINDS, runs // _KIND_RUNS), np.zeros(runs, dtype=np.int64)
    if most > 1:
        h = each[:, _frequent(each)[:_TELLING]].astype(np.float32)
        base, length = h.sum(0) * (4 / h.sum()), h.sum(1) + 1
        cost = lambda c: length[:, None] * np.log2(c.sum(1) + 4) - h @ np.log2(c + base).T
        centers, dear = np.zeros((0, h.shape[1]), dtype=np.float32), cost(h.sum(0)[None]).min(1) / length
        while len(centers) < most:
            centers = np.concatenate([centers, h[dear.argmax()][None]])
            dear = cost(centers).min(1) / length
        for _ in range(_ROUNDS):
            kind = cost(centers).argmin(1)
            centers = np.stack([h[kind == k].sum(0) for k in np.unique(kind)])
        kind = np.unique(kind, return_inverse=True)[1]
    return np.stack([each[kind == k].sum(0) for k in range(kind.max() + 1)]), kind


def _frequent(counts: np.ndarray) -> np.ndarray:
    """Numbers by falling counts: what is looked up often lies close together."""
    return np.argsort(-counts.sum(0), kind="stable")


def _put_table(ids: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> bytes:
    """Gaps between ids, counts by kind and kinds of runs, a byte each, those of 255 or more apart."""
    parts = (np.diff(ids, prepend=-1) - 1, counts.reshape(-1), kinds)
    large = np.concatenate([x[x > 254] for x in parts]).astype("<u4")
    out = b""
    for x in (*(np.minimum(x, 255).astype(np.uint8) for x in parts), large):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        out += z.compress(x.tobytes()) + z.flush()
    return out


def _take_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for kind in (np.uint8, np.uint8, np.uint8, "<u4"):
        z = zlib.decompressobj(-15)
        parts.append(np.frombuffer(z.decompress(data), kind).astype(np.int64))
        data = z.unused_data
    gaps, counts, kinds, large = parts
    cut = int((gaps == 255).sum())
    gaps[gaps == 255], counts[counts == 255] = large[:cut], large[cut:]
    return np.cumsum(gaps + 1) - 1, counts.reshape(-1, len(gaps)), kinds


def _groups(sizes: list[int]):
    """(start, end) of blocks in a row, in parts of about the same number of runs, LANES and a block's at most."""
    runs = [_runs(n) for n in sizes]
    most = -(-sum(runs) // max(1, -(-sum(runs) // LANES)))
    start = lanes = 0
    for k, n in enumerate(runs):
        if lanes >= most:
            yield start, k
            start, lanes = k, 0
        lanes += n
    if len(sizes) > start:
        yield start, len(sizes)


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Code each array of at most BLOCK ids below 2^32 by itself into little-endian 16-bit words."""
    out: list = []
    for a, b in _groups([len(x) for x in blocks]):
        made = iter(_encode([x for x in blocks[a:b] if len(x)]))
        out += [next(made) if len(x) else np.zeros(0, dtype="<u2") for x in blocks[a:b]]
    return out


def _carry(words: np.ndarray, lane: int, j: int) -> None:
    """A carry runs on over words that are full, which is rare."""
    while words[j, lane] == 0xFFFF:
        words[j, lane] = 0
        j -= 1
    words[j, lane] += 1


def _encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    at = _Layout([len(x) for x in blocks])
    lanes, steps = len(at.block), len(at.active)
    tables = [(ids, number, *_kinds(number, len(ids))) for ids, number in map(_numbers, blocks)]
    orders = [_frequent(counts) for _, _, counts, _ in tables]
    flat_numbers = np.concatenate([np.argsort(order).astype(np.uint16).take(x) for order, (_, x, _, _) in zip(orders, tables)] + [np.zeros(steps, dtype=np.uint16)])
    numbers = flat_numbers[at.start[None, :] + np.arange(steps)[:, None]]
    width = 2 * steps + 8
    # words by place, then run: runs that are about as far on write side by side
    words = np.zeros((width, lanes), dtype=np.uint16)
    flat, pos = words.reshape(-1), np.arange(lanes)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << _BITS) - 1, dtype=np.int64)
    models = _Models(at, [x[:, order] for order, (_, _, x, _) in zip(orders, tables)], [x for _, _, _, x in tables])
    for t, k in enumerate(at.active):
        x = numbers[t, :k].astype(np.int32)
        models.guess(k)
        start, own = models.interval(k, x)
        part = _part(span[:k], models.total)
        new_low, new_span = low[:k] + part * start, part * own
        lane = np.flatnonzero(new_low >> _BITS)
        if len(lane):
            before = pos[lane] - lanes
            flat[before] += 1
            for i in lane[flat[before] == 0].tolist():  # it runs on over words that were full, which is rare
                _carry(words, i, int(pos[i]) // lanes - 2)
            new_low[lane] &= (1 << _BITS) - 1
        while (short := new_span < _LEAST).any():
            i, shift = pos[:k], short * 16
            flat[i] = new_low >> (_BITS - 16)  # counts only where the place moves on
            i += short * lanes
            new_low = (new_low << shift) & ((1 << _BITS) - 1)
            new_span <<= shift
        low[:k], span[:k] = new_low, new_span
        models.learn(t, x)
    # one word says where in the last range a code lies; what follows it is read as zeros
    value, ends = low + span - 1, pos // lanes
    for lane in np.flatnonzero(value >> _BITS).tolist():
        _carry(words, lane, int(ends[lane]) - 1)
    flat[pos] = (value >> (_BITS - 16)) & 0xFFFF
    words, out = np.ascontiguousarray(words[: ends.max(initial=0) + 1].T), []
    for block, (ids, _, counts, kinds) in enumerate(tables):
        coded = []
        for lane in at.place[at.first[block] : at.first[block] + _runs(len(blocks[block]))].tolist():
            coded.append(words[lane, : ends[lane] + 1])
        table = _put_table(ids, counts, kinds)
        head = np.frombuffer(struct.pack("<I", len(table)) + table + bytes(len(table) % 2), "<u2")
        out.append(np.concatenate([head, np.array([len(x) for x in coded], dtype=np.uint16), *coded]).astype("<u2"))
    return out


def _part(span: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A range over its number of parts. The quotient is rounded, so one less is never too much."""
    return (span / total).astype(np.int64) - 1


def decode(coded: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each coded block, of which there are ``sizes``."""
    out: list = []
    for a, b in _groups(sizes):
        made = iter(_decode([x for x, n in zip(coded[a:b], sizes[a:b]) if n], [n for n in sizes[a:b] if n]))
        out += [next(made) if n else np.zeros(0, dtype=np.int64) for n in sizes[a:b]]
    return out


def _decode(coded: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    at = _Layout(sizes)
    lanes, steps = len(at.block), len(at.active)
    tables, parts = [], []
    for words, n in zip(coded, sizes):
        tables.append(_take_table(words.tobytes()[4:]))
        head = 2 + (int(words[0]) + (int(words[1]) << 16) + 1) // 2
        ends = head + _runs(n) + np.cumsum(words[head : head + _runs(n)].astype(np.int64))
        parts += [words[a:b] for a, b in zip([head + _runs(n), *ends[:-1].tolist()], ends.tolist())]
    width = max((len(x) for x in parts), default=0) + 8
    words = np.zeros((lanes, width), dtype=np.uint16)
    for lane, k in enumerate(at.order.tolist()):
        words[lane, : len(parts[k])] = parts[k]
    first = words[:, :4].astype(np.int64)
    # the range has 50 bits: three whole words and the top of the fourth; from then on it takes the rest of a word and the top of the next
    code = (first[:, 0] << 34) | (first[:, 1] << 18) | (first[:, 2] << 2) | (first[:, 3] >> 14)
    flat = np.ascontiguousarray(((words[:, 3:-1] << 2) | (words[:, 4:] >> 14)).T).reshape(-1)
    pos = np.arange(lanes)
    span = np.full(lanes, (1 << _BITS) - 1, dtype=np.int64)
    numbers = np.zeros((steps, lanes), dtype=np.uint16)
    orders = [_frequent(counts) for _, counts, _ in tables]
    models = _Models(at, [x[:, order] for order, (_, x, _) in zip(orders, tables)], [x for _, _, x in tables])
    for t, k in enumerate(at.active):
        models.guess(k)
        part = _part(span[:k], models.total)
        # both are below 2^51, so the quotient is never rounded up to a whole number
        x = models.find(k, np.minimum((code[:k] / part).astype(np.int32), models.total - 1))
        start, own = models.interval(k, x)
        new_code, new_span = code[:k] - part * start, part * own
        while (short := new_span < _LEAST).any():
            i, shift = pos[:k], short * 16
            new_code = (new_code << shift) | (_at(flat, i) * short)
            i += short * lanes
            new_span <<= shift
        code[:k], span[:k] = new_code, new_span
        numbers[t, :k] = x
        models.learn(t, x)
    by_lane, out = np.ascontiguousarray(numbers.T), []
    for block, n in enumerate(sizes):
        own = at.place[at.first[block] : at.first[block] + _runs(n)].tolist()
        out.append(tables[block][0][orders[block]].take(np.concatenate([by_lane[lane, : at.length[lane]] for lane in own])))
    return out


def pack(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Cut the ids of documents in a row into the blocks of one record."""
    ids = np.concatenate([np.zeros(0, dtype=np.uint32), *docs])
    return [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]


def record(sizes: list[int], blocks: list[np.ndarray], coded: list[np.ndarray]) -> bytes:
    """Magic, counts of documents and blocks, ids of each document; ids, words and CRC-32 of each block; the words."""
    data = [x.tobytes() for x in coded]
    head = _MAGIC + struct.pack("<II", len(sizes), len(blocks)) + np.array(sizes, dtype="<u4").tobytes()
    rows = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(d)) for b, c, d in zip(blocks, coded, data))
    return head + rows + b"".join(data)


def parse(data: bytes) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """(ids of each document, ids of each block, coded blocks) of a record, whose checksums must hold."""
    if data[:4] != _MAGIC:
        raise ValueError("not a record of coded ids")
    docs, blocks = struct.unpack_from("<II", data, 4)
    sizes, at = np.frombuffer(data, "<u4", docs, 12), 12 + 4 * docs
    rows = [struct.unpack_from("<III", data, at + 12 * k) for k in range(blocks)]
    at += 12 * blocks
    coded = []
    for k, (_, n, crc) in enumerate(rows):
        part = data[at : at + 2 * n]
        if zlib.crc32(part) != crc:
            raise ValueError(f"block {k} is damaged")
        coded.append(np.frombuffer(part, "<u2"))
        at += 2 * n
    return sizes, [r[0] for r in rows], coded
