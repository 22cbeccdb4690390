"""Texts of a batch as one byte array, cut into words and hashed spans by array operations.

Words are found on UTF-8 bytes: every separator here is ASCII and no byte of a longer character
is, so the result equals that on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 22
# Bytes in an Arrow batch between Spark and Python, so that long texts do not add up.
BATCH_BYTES = 1 << 22

U64 = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(df: DataFrame, key: str, text: str, key_as: str = "doc_id") -> DataFrame:
    """Key and text bytes alone, under names of our own; a null text is empty."""
    return df.select(F.col(f"`{key}`").cast("long").alias(key_as),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
                     .alias("body"))


def byte_set(*members: int | bytes) -> np.ndarray:
    """256 booleans, true at the members."""
    out = np.zeros(256, bool)
    for m in members:
        out[list(m) if isinstance(m, bytes) else m] = True
    return out


SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_SPACE = ~SPACE
#: An ASCII capital to its small letter, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


class SpanHash:
    """64-bit hashes of any spans of a byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(CODE[data] * power[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        spread = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(spread + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


class Texts:
    """Texts one after the other with a line feed before, between and after them."""

    def __init__(self, bodies: list[bytes]):
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.data = np.frombuffer(b"\n" + b"\n".join(bodies) + b"\n", np.uint8)
        self.start = 1 + np.cumsum(sizes + 1) - sizes - 1
        self.end = self.start + sizes

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes that ``inside`` marks (not the line feed)."""
        marks = inside[self.data]
        edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        return edges[0::2], edges[1::2]

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the sorted ``starts`` lie in each text."""
        return np.searchsorted(starts, self.end) - np.searchsorted(starts, self.start)

    def owners(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self)), counts)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.end] - total[self.start]


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int,
                  whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, the text and the first word of each.

    With ``whole_if_short`` a text of fewer words gives one hash of all its words.
    """
    last = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(words)) + width <= last[owner]) if len(words) else owner
    total = np.full(len(at), width, U64)
    for j in range(width):
        total = mix(total) + words[at + j] * U64(2 * j + 3)
    total, owner = mix(total), owner[at]
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            first, extra = (last - counts)[short], np.zeros(len(short), U64)
            extra += counts[short].astype(U64)
            for j in range(width - 1):
                more = counts[short] > j
                extra[more] = mix(extra[more]) + words[first[more] + j] * U64(2 * j + 3)
            total = np.concatenate([total, mix(extra)])
            owner, at = np.concatenate([owner, short]), np.concatenate([at, first])
    return total, owner, at


def equal_neighbours(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (hash, owner) together, and where a row equals the one before."""
    joined = hashes + mix(owner.astype(U64) + U64(1))
    order = np.argsort(joined)
    return order, joined[order][1:] == joined[order][:-1]


def slices(bodies: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most ``limit`` bytes, or one row."""
    low = size = 0
    for i, body in enumerate(bodies):
        if i > low and size + len(body) > limit:
            yield low, i
            low, size = i, 0
        size += len(body)
    if low < len(bodies):
        yield low, len(bodies)


def per_slice(work):
    """A function for ``mapInArrow`` from one of (keys, bodies) lists to a dict of columns."""
    def run(batches):
        for batch in batches:
            keys, bodies = (batch.column(i).to_pylist() for i in (0, 1))
            for low, high in slices(bodies):
                out = work(keys[low:high], bodies[low:high])
                yield pa.RecordBatch.from_pydict(out)
    return run


def filter_rows(docs: DataFrame, text: str, keep) -> DataFrame:
    """The rows whose text bytes pass, with all columns as they are, in one pass.

    ``keep(bodies)`` gives a boolean for each text; a null text is empty.
    """
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(at).cast(pa.string()), "")
            bodies = [x.encode() for x in column.to_pylist()]
            marks = [keep(bodies[low:high]) for low, high in slices(bodies)]
            if marks:
                yield batch.filter(pa.array(np.concatenate(marks)))

    return docs.mapInArrow(run, docs.schema)
