"""Joining blocks of rows with their guests in a stream, and keeping only link counts and connecting links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from courtlens.llm.common import tidy

FIELDS = "uid long, links long, other long"
#: Guests that are compared with a block at once.
GUESTS = 1_024


def spread(hit: np.ndarray) -> np.ndarray:
    """The least row that each row reaches through a symmetric matrix of links."""
    label = np.arange(len(hit))
    while True:
        new = np.minimum(np.where(hit, label[None, :], len(hit)).min(1, initial=len(hit)), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meets(block: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Whether rows of ``home`` visit ``block``: of two different blocks, one visits the other, each about as often."""
    return (block == home) | ((((block + home) % 2 == 0) == (block < home)) & (block != home))


class Links:
    """What a task found: (uid, links, null) counts, (uid, 0, other) links that connect."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []

    def count(self, uid: np.ndarray, links: np.ndarray) -> None:
        some = links > 0
        self.parts.append((uid[some], links[some], np.zeros(some.sum(), dtype=np.int64), False))

    def connect(self, uid: np.ndarray, other: np.ndarray) -> None:
        self.parts.append((uid, np.zeros(len(uid), dtype=np.int64), other, True))

    def batch(self) -> pa.RecordBatch:
        parts, self.parts = self.parts, []
        join = lambda k: np.concatenate([np.zeros(0, dtype=np.int64)] + [p[k] for p in parts])
        mask = np.concatenate([np.zeros(0, dtype=bool)] + [np.full(len(p[0]), not p[3]) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(join(0)), pa.array(join(1)), pa.array(join(2), mask=mask)], ["uid", "links", "other"])


class _Block:
    def __init__(self, number: int, load: Callable, hits: Callable):
        self.number, self.load, self.hits = number, load, hits
        self.uid, self.n, self.raw = [], [], []
        self.done = False

    def finish(self) -> None:
        """All own rows are there: link them with each other."""
        if self.done:
            return
        self.done, m = True, len(self.raw)
        self.uid, self.n = np.array(self.uid, dtype=np.int64), np.array(self.n, dtype=np.int64)
        self.rows = self.load(self.raw)
        self.raw = []
        self.links, self.label = np.zeros(m, dtype=np.int64), np.arange(m)
        if m > 1:
            hit = self.hits(self.rows, self.rows)
            hit |= hit.T
            np.fill_diagonal(hit, False)
            self.links = np.rint(hit @ self.n.astype(np.float64)).astype(np.int64)
            some = np.flatnonzero(self.links)
            self.label[some] = some[spread(hit[np.ix_(some, some)])] if len(some) else some

    def guests(self, uid: np.ndarray, n: np.ndarray, raw: list, out: Links) -> None:
        self.finish()
        for a in range(0, len(raw) if len(self.uid) else 0, GUESTS):
            hit = self.hits(self.rows, self.load(raw[a : a + GUESTS]))
            if not hit.any():
                continue
            self.links += np.rint(hit @ n[a : a + GUESTS].astype(np.float64)).astype(np.int64)
            own = uid[a : a + GUESTS]
            out.count(own, np.rint(self.n.astype(np.float64) @ hit).astype(np.int64))
            home, away = np.nonzero(hit)
            pairs = np.unique(away * len(self.uid) + self.label[home])
            out.connect(own[pairs // len(self.uid)], self.uid[pairs % len(self.uid)])

    def close(self, out: Links) -> None:
        self.finish()
        out.count(self.uid, self.links)
        other = self.label != np.arange(len(self.uid))
        out.connect(self.uid[other], self.uid[self.label[other]])


def join_blocks(load: Callable[[list[bytes]], object], hits: Callable[[object, object], np.ndarray]):
    """For mapInArrow over (block, guest, uid, n, data), sorted by block, guest and uid, own rows first; gives FIELDS.

    Rows that repeat a uid in a block are left out. A task holds one block and some guests at a time. ``load`` turns data into what ``hits`` compares: it returns the
    matrix of links between two lots of rows. ``n`` weighs a row in the counts of others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out, last = None, Links(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            uid, n, data = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            first = np.ones(len(uid), dtype=bool)
            first[1:] = (uid[1:] != uid[:-1]) | (number[1:] != number[:-1]) | (guest[1:] != guest[:-1])
            first[0] = (number[0], guest[0], uid[0]) != last
            last = (number[-1], guest[-1], uid[-1])
            if not first.all():
                number, guest, uid, n, data = number[first], guest[first], uid[first], n[first], data.filter(pa.array(first))
            cuts = np.flatnonzero((np.diff(number) != 0) | (guest[1:] != guest[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                if a == b:
                    continue
                if block is None or block.number != number[a]:
                    if block is not None:
                        block.close(out)
                    block = _Block(int(number[a]), load, hits)
                raw = data.slice(a, b - a).to_pylist()
                if guest[a]:
                    block.guests(uid[a:b], n[a:b], raw, out)
                else:
                    block.uid += uid[a:b].tolist()
                    block.n += n[a:b].tolist()
                    block.raw += raw
            yield out.batch()
            tidy()
        if block is not None:
            block.close(out)
            yield out.batch()

    return run
