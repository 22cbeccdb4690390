"""Which 64-bit tokens stand in two or more documents, without a row per token.

Documents are dealt into shards of bounded bytes. Each shard announces its distinct tokens, packed
per bucket (a range of the tokens' high bits) as sorted 32-bit remainders; a bucket compares the
announcements of all shards and answers each with the tokens that are shared. A bucket's width
follows the amount of text, so two different tokens are taken for one with the same small chance
at any size; callers only use the answer to leave out what cannot match, so such a chance costs
time, never a result. A token of a third of all documents arrives once per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U64 = np.uint64
SHARD_BYTES = 1 << 21
BUCKET_TOKENS = 1 << 19
#: Stands for a null document id: greater than all others.
NO_ID = (1 << 63) - 1

ANNOUNCED = "bucket int, shard int, low binary, times binary"
ANSWERED = "shard int, bucket int, low binary, times binary"


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of ``utf8`` rows."""
    return docs.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0


def sharded(docs: DataFrame, total: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """``utf8`` rows (and further columns) with their shard, and the number of shards."""
    shards = max(1, -(-total // shard_bytes))
    return docs.withColumn("shard", F.pmod(
        F.xxhash64("doc_id", F.octet_length("body")), F.lit(shards)).cast("int")), shards


def order_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids and bodies of a shard, always in the same order: by id, then by body."""
    ids = table.column("doc_id").to_pylist()
    bodies = table.column("body").to_pylist()
    keys = [NO_ID if i is None else i for i in ids]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], bodies[i]))
    return np.array([keys[i] for i in order], np.int64), [bodies[i] for i in order], order


def rows_of(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return order_of(table)[:2]


def buckets_for(tokens: int, bucket_tokens: int = BUCKET_TOKENS) -> int:
    return max(1, -(-tokens // bucket_tokens))


def place(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and remainder of each token."""
    return ((tokens >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), \
        tokens.astype(np.uint32)


def distinct(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens and the number of different documents each stands in."""
    if not len(tokens):
        return tokens, np.zeros(0, np.int64)
    order = np.lexsort((docs, tokens))
    t, d = tokens[order], docs[order]
    new_token = np.append(True, t[1:] != t[:-1])
    new_doc = new_token | np.append(True, d[1:] != d[:-1])
    at = np.flatnonzero(new_token)
    return t[at], np.add.reduceat(new_doc.astype(np.int64), at)


def announce(shard: int, tokens: np.ndarray, times: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket with tokens; ``times`` is cut at 65535."""
    bucket, low = place(tokens, buckets)
    times = np.minimum(times, 65535).astype(np.uint16)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) \
        if len(bucket) else np.zeros(1, np.int64)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.table({
        "bucket": pa.array([int(bucket[a]) for a, _ in parts], pa.int32()),
        "shard": pa.array([shard] * len(parts), pa.int32()),
        "low": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
        "times": pa.array([times[a:b].tobytes() for a, b in parts], pa.binary())})


def _compare(table: pa.Table) -> pa.Table:
    """Tokens of a bucket that at least two documents have, for each shard that has them."""
    low = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    times = [np.frombuffer(x, np.uint16) for x in table.column("times").to_pylist()]
    joined = np.sort(np.concatenate(low).astype(U64) << U64(16)
                     | np.concatenate(times).astype(U64))
    token = joined >> U64(16)
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    total = np.add.reduceat((joined & U64(65535)).astype(np.int64), at)
    shared = total > 1
    token = token[at][shared].astype(np.uint32)
    # Answers need the size of a count only: the largest power of two in it.
    total = np.log2(total[shared]).astype(np.uint8)
    out = []
    for shard, own in zip(table.column("shard").to_pylist(), low):
        place_ = np.searchsorted(token, own)
        place_[place_ == len(token)] = 0
        hit = token[place_] == own if len(token) else np.zeros(len(own), bool)
        if hit.any():
            out.append((shard, own[hit].tobytes(), total[place_[hit]].tobytes()))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "shard": pa.array([r[0] for r in out], pa.int32()),
        "bucket": pa.array([bucket] * len(out), pa.int32()),
        "low": pa.array([r[1] for r in out], pa.binary()),
        "times": pa.array([r[2] for r in out], pa.binary())})


def shared_tokens(shards: DataFrame, tokens_of, buckets: int) -> DataFrame:
    """Answers for each shard. ``tokens_of(ids, bodies)`` gives tokens and their document ids."""
    def run(key, table):
        found, times = distinct(*tokens_of(*rows_of(table)))
        return announce(key[0].as_py(), found, times, buckets)

    return compared(shards.groupBy("shard").applyInArrow(run, ANNOUNCED))


def compared(announced: DataFrame) -> DataFrame:
    return announced.groupBy("bucket").applyInArrow(_compare, ANSWERED)


class Shared:
    """The answers to a shard, to look tokens up in."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        keys, times = [np.zeros(0, U64)], [np.zeros(0, np.uint8)]
        for bucket, low, n in zip(*(table.column(c).to_pylist()
                                    for c in ("bucket", "low", "times"))):
            keys.append(np.frombuffer(low, np.uint32).astype(U64) | U64(bucket) << U64(32))
            times.append(np.frombuffer(n, np.uint8))
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys)
        self.keys, self.times = keys[order], times[order]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """Documents that have each token, rounded down to a power of two; 0 if not shared."""
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        bucket, low = place(tokens, self.buckets)
        key = low.astype(U64) | bucket.astype(U64) << U64(32)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, np.left_shift(1, self.times[at].astype(np.int64)), 0)
