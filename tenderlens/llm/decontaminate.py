"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are compared as UTF-8 bytes in lower case (by Unicode) with every run of ASCII white space as
one space. A benchmark item is cut into windows of ``WINDOW`` bytes, ``STRIDE`` apart (a shorter
item is one window). A document leaks an item if some window lies in it within the edit budget,
``BUDGET`` percent of the window's bytes. So an exact quote of ``WINDOW`` + ``STRIDE`` - 1 bytes
(87) is surely found, wherever in the item it starts; a shorter one only if it covers a window.

1. Q-gram lemma: a window of m bytes within e edits shares at least m + 1 - q - q * e of its
   ``GRAM``-byte grams with the place, all on diagonals that differ by at most e. Diagonals fall
   into bands of twice the budget, one budget apart, so one band holds them all. Distinct grams are
   counted per (document, window, band); regions below the bound are dropped.
2. Verification: the window is aligned with the region in the band by dynamic programming, all
   regions of a slice side by side.

The items are an index of bounded size that every task holds: items are dealt into indexes of at
most ``INDEX_BYTES`` normalised bytes and the documents are read once for each, so any number of
items is searched whole.

Items that are null or have fewer bytes than a gram are no evidence and are skipped. A null text
is empty and leaks nothing. Equal items all count; repeated rows give repeated results; null keys
stay null; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.suffixes import words_at
from tenderlens.llm.texts import (
    LOWER, SPACE, Texts, bounded_batches, filter_rows, mix, slices, utf8)

U64 = np.uint64
WINDOW = 80
STRIDE = 8
GRAM = 10
BUDGET = 7.5
# An index takes some 200 bytes for every byte of its items.
INDEX_BYTES = 1 << 21
SLICE = 1 << 20
FILTER_BITS = 22

SCHEMA = "doc_id long, item_id long, n_windows long, n_edits long"

_plain = LOWER.copy()
_plain[SPACE] = 32


def normalised(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as they are compared, and the start and end of each text in them."""
    t = Texts([b if b.isascii() else b.decode().lower().encode() for b in bodies])
    data = _plain[t.data]
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    # The byte between two texts stays, so that texts do not touch.
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[t.start], at[t.end]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    if len(data) < GRAM:
        return np.zeros(0, U64)
    word, n = words_at(data), len(data) - GRAM + 1
    return mix(word[:n] * U64(0x9E3779B97F4A7C15)
               + word[GRAM - 8:n + GRAM - 8] * U64(0xC2B2AE3D27D4EB4F))


class Index:
    """Windows of benchmark items and where their grams stand."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item, self.windows = [], []
        grams, window, offset = [], [], []
        for item, body in items:
            data, start, end = normalised([body])
            text = data[start[0]:end[0]].tobytes().strip()
            if len(text) < GRAM:
                continue
            size = min(WINDOW, len(text))
            starts = list(range(0, len(text) - size + 1, STRIDE))
            if starts[-1] != len(text) - size:
                starts.append(len(text) - size)
            for s in starts:
                piece = np.frombuffer(text[s:s + size], np.uint8)
                found = gram_hashes(piece)
                grams.append(found)
                window.append(np.full(len(found), len(self.item)))
                offset.append(np.arange(len(found)))
                self.item.append(item)
                self.windows.append(piece)
        self.count = len(self.item)
        if not self.count:
            return
        grams, window, offset = map(np.concatenate, (grams, window, offset))
        order = np.argsort(grams, kind="stable")
        grams, self.window, self.offset = grams[order], window[order], offset[order]
        self.first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        self.grams = grams[self.first]
        self.times = np.diff(np.append(self.first, len(grams)))
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[self.grams >> U64(64 - FILTER_BITS)] = True
        self.size = np.array([len(w) for w in self.windows])
        # The budget may not be so large that no gram need be shared.
        self.edits = np.minimum((self.size * BUDGET / 100).astype(int),
                                (self.size - GRAM) // GRAM)
        self.bound = self.size + 1 - GRAM - GRAM * self.edits
        self.step = max(1, int(self.edits.max()))
        self.pattern = np.full((self.count, int(self.size.max())), -1, np.int16)
        for i, piece in enumerate(self.windows):
            self.pattern[i, :len(piece)] = piece

    def search(self, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        """Row, window and edits of every window that a text holds within its budget."""
        none = (np.zeros(0, np.int64),) * 3
        if not self.count:
            return none
        data, start, end = normalised(bodies)
        hashed = gram_hashes(data)
        at = np.flatnonzero(self.present[hashed >> U64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.grams, hashed[at]), len(self.grams) - 1)
        hit = self.grams[place] == hashed[at]
        at, place = at[hit], place[hit]
        row = np.searchsorted(start, at, "right") - 1
        inside = (row >= 0) & (at + GRAM <= end[row])
        at, place, row = at[inside], place[inside], row[inside]
        if not len(at):
            return none
        times = self.times[place]
        ends = np.cumsum(times)
        entry = np.arange(int(ends[-1])) + np.repeat(self.first[place] - (ends - times), times)
        window, offset = self.window[entry], self.offset[entry]
        row = np.repeat(row, times)
        # Diagonal from the start of the text; at least minus the window's size.
        diagonal = np.repeat(at, times) - start[row] - offset + WINDOW
        regions = []
        for shift in (0, 1):
            band = (diagonal + shift * self.step) // (2 * self.step)
            regions.append(self._regions(row, window, band, offset, shift))
        row, window, low = (np.concatenate(x) for x in zip(*regions))
        if not len(row):
            return none
        edits = self._align(data, start, end, row, window, low)
        good = edits <= self.edits[window]
        return row[good], window[good], edits[good]

    def _regions(self, row, window, band, offset, shift):
        """(row, window, first diagonal) of the bands with enough distinct grams."""
        width = int(band.max()) + 1 if len(band) else 1
        key = (row * self.count + window) * width + band
        # Most keys hold few grams: count before sorting out repeated ones.
        order = np.lexsort((offset, key))
        key, offset = key[order], offset[order]
        new = np.append(True, key[1:] != key[:-1])
        fresh = new | np.append(True, offset[1:] != offset[:-1])
        head = np.flatnonzero(new)
        distinct = np.add.reduceat(fresh.astype(np.int64), head)
        key = key[head]
        which = key // width % self.count
        use = distinct >= self.bound[which]
        key, which = key[use], which[use]
        low = (key % width) * 2 * self.step - shift * self.step - WINDOW
        return key // width // self.count, which, low

    def _align(self, data, start, end, row, window, low) -> np.ndarray:
        """Least edits between each window and a part of its region, in the band.

        Cell d of step i compares the window's byte i with the text's byte low + i + d. A region
        starts anywhere in the band for free and ends anywhere.
        """
        out = np.empty(len(row), np.int64)
        lanes = 4096
        for a in range(0, len(row), lanes):
            r, w = row[a:a + lanes], window[a:a + lanes]
            size, budget = self.size[w], self.step
            # Half-open band of diagonals, widened by the budget on both sides.
            width = 2 * self.step + 2 * budget
            base = start[r] + low[a:a + lanes] - budget
            steps = np.arange(width)
            cost = np.zeros((len(r), width), np.int64)
            done = np.full(len(r), 1 << 30, np.int64)
            for i in range(int(size.max())):
                place = base[:, None] + steps + i
                outside = (place < start[r][:, None]) | (place >= end[r][:, None])
                text = data[np.clip(place, 0, len(data) - 1)].astype(np.int16)
                text[outside] = -2
                step = cost + (text != self.pattern[w, i][:, None])
                # A byte of the window without partner: from the next diagonal of the step before.
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                # Bytes of the text without partner: along the step, by a running minimum.
                cost = np.minimum.accumulate(step - steps, 1) + steps
                last = size == i + 1
                done[last] = cost[last].min(1)
            out[a:a + lanes] = done
        return out


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[list]:
    """Items dealt into lists of at most ``INDEX_BYTES``. An item is one row, as it is read."""
    groups, size = [[]], 0
    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item_id"),
                            F.col(f"`{text}`").cast("string").alias("body")) \
        .filter("body is not null").orderBy("item_id", "body")
    for item, body in rows.toLocalIterator():
        body = body.encode()
        if groups[-1] and size + len(body) > INDEX_BYTES:
            groups.append([])
            size = 0
        groups[-1].append((item, body))
        size += len(body)
    return groups


class _Held:
    """An index that a Python worker builds once from broadcast items."""

    _built: dict[int, Index] = {}

    def __init__(self, spark, items: list):
        self.items = spark.sparkContext.broadcast(items)

    def get(self) -> Index:
        key = id(type(self)), hash(tuple(self.items.value))
        if key not in self._built:
            self._built.clear()
            self._built[key] = Index(self.items.value)
        return self._built[key]


def _hits(held: _Held):
    def run(batches):
        index = held.get()
        for batch in batches:
            keys, bodies = (batch.column(i).to_pylist() for i in (0, 1))
            rows = []
            for low, high in slices(bodies, SLICE):
                found: dict[tuple[int, int], dict[int, int]] = {}
                for row, window, edits in zip(*(x.tolist() for x in
                                                index.search(bodies[low:high]))):
                    best = found.setdefault((low + row, index.item[window]), {})
                    best[window] = min(edits, best.get(window, edits))
                rows += [(keys[row], item, len(best), min(best.values()))
                         for (row, item), best in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    ["doc_id", "item_id", "n_windows", "n_edits"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows found, least edits) of every document that leaks an item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = utf8(docs, key, text)
    return reduce(DataFrame.unionByName, (
        rows.mapInArrow(_hits(_Held(spark, items)), SCHEMA) for items in indexes(benchmark)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def keep(held):
        def run(bodies):
            index, marks = held.get(), np.ones(len(bodies), bool)
            for low, high in slices(bodies, SLICE):
                marks[low + index.search(bodies[low:high])[0]] = False
            return marks
        return run

    for items in indexes(benchmark):
        docs = filter_rows(docs, text, keep(_Held(spark, items)))
    return docs
