"""Removal of byte strings that repeat across documents, by suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller
id. Only strings that may stand in two documents are sorted:

1. Every string has a minimizer, the least hash of the ``GRAM``-byte grams in it; equal strings
   have equal minimizers. ``sharing`` finds the minimizers that two documents have.
2. Strings next to each other with the same, shared minimizer are cut out as one segment; segments
   are dealt by minimizer, so equal strings meet. Equal segments of a shard are sent once. Strings
   of a minimizer that very many documents have are dealt one by one, by their own hash.
3. Where they meet, distinct segments are laid end to end in blocks of at most ``BLOCK`` bytes.
   Each block gets a suffix array by Larsson-Sadakane refinement (sorted to the depth WIDTH, only
   groups that still agree are sorted again) and Kasai's common prefixes, made in lanes; neighbours with
   WIDTH common bytes are equal strings and take the smallest document id among them. Strings of a
   minimizer that lies in several blocks are merged across the blocks by binary search.
4. What goes is sent back to the shard of the text as ranges.

The result does not depend on any of the sizes. A null text is empty; a null id counts as larger
than all others; rows with the same id do not take from each other; a text of fewer bytes than
WIDTH keeps them all. Kept bytes need not be UTF-8 at a cut: ``deduplicated`` drops the rest of a
broken character. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tenderlens.llm.sharing import (
    NO_ID, SHARD_BYTES, Shared, announce, buckets_for, compared, distinct, order_of, rows_of,
    sharded, total_bytes, ANNOUNCED)
from tenderlens.llm.texts import SpanHash, Texts, bounded_batches, slices, utf8

U64 = np.uint64
WIDTH = 50
GRAM = 20
BLOCK = 1 << 18
#: Documents from which on a minimizer's strings are dealt by their own hash.
HOT = 1 << 14
SLICE = 1 << 20

SENT = "part int, shard int, body binary, size binary, least binary, doc binary, copy binary"
ANSWER = "shard int, row binary, start binary, stop binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as an integer; zeros follow the end."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,)).astype(U64)


def minimizers(data: np.ndarray) -> np.ndarray:
    """The minimizer of the string that starts at each byte."""
    word = words_at(data)
    n = len(data) - GRAM + 1
    h = word[:n] * U64(0x9E3779B97F4A7C15)
    h += word[8:n + 8] * U64(0xC2B2AE3D27D4EB4F)
    h += word[GRAM - 8:n + GRAM - 8] * U64(0x165667B19E3779F9)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    span, left = 1, WIDTH - GRAM + 1
    while span * 2 <= left:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:len(h) - (left - span)], h[left - span:]) if left > span else h


def segments(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Row, start in the row, number of strings and minimizer of each segment, for a slice."""
    t = Texts(bodies)
    if len(t.data) < WIDTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    least = minimizers(t.data)
    long = t.end - t.start >= WIDTH
    change = np.zeros(len(t.data) + 1, np.int8)
    change[t.start[long]] = 1
    change[t.end[long] - WIDTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(change, dtype=np.int8)[:len(least)])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    value = least[at]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]))
    first = np.flatnonzero(new)
    row = np.searchsorted(t.start, at[first], "right") - 1
    return row, at[first] - t.start[row], np.diff(np.append(first, len(at))), value[first]


def _all_segments(bodies):
    for low, high in slices(bodies, SLICE):
        yield low, high, segments(bodies[low:high])


def _announce(buckets: int):
    def run(key, table):
        ids, bodies = rows_of(table)
        tokens, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for low, _, (row, _, _, value) in _all_segments(bodies):
            tokens.append(value)
            docs.append(ids[row + low])
        return announce(key[0].as_py(), *distinct(np.concatenate(tokens), np.concatenate(docs)),
                        buckets)
    return run


def _spans(data: bytes, start: np.ndarray, size: np.ndarray) -> bytes:
    return b"".join([data[a:a + n] for a, n in zip(start.tolist(), size.tolist())])


def _cut_out(buckets: int, parts: int, hot: int):
    """Segments with shared minimizers, dealt by minimizer; equal ones of a shard once.

    A minimizer of ``hot`` documents or more would fill a part: its strings are sent one by one
    and dealt by their own hash, which stands in the minimizer's place.
    """
    def run(key, table, answers):
        out = []
        if table.num_rows and answers.num_rows:
            ids, bodies = rows_of(table)
            shared = Shared(answers, buckets)
            found = []
            for low, high, (row, start, strings, value) in _all_segments(bodies):
                times = shared.count(value)
                use = times > 0
                if not use.any():
                    continue
                times = times[use]
                row, start, strings, value = row[use], start[use], strings[use], value[use]
                t = Texts(bodies[low:high])
                many = times >= hot
                if many.any():
                    n = np.where(many, strings, 1)
                    last = np.cumsum(n)
                    start = np.repeat(start, n) + np.arange(int(last[-1])) \
                        - np.repeat(last - n, n)
                    row, value, many = (np.repeat(x, n) for x in (row, value, many))
                    strings = np.repeat(np.where(times >= hot, 1, strings), n)
                begin, size = t.start[row] + start, strings + WIDTH - 1
                hashed = SpanHash(t.data).of(begin, begin + size)
                value = np.where(many, hashed, value)
                found.append((hashed, value, row + low, start, size, begin, t.data.tobytes()))
            if found:
                out = _deal(found, ids, key[0].as_py(), parts)
        names = [f.split()[0] for f in SENT.split(",")]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array(c, t) for c, t in
                         zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)
    return run


def _deal(found: list, ids: np.ndarray, shard: int, parts: int) -> list[tuple]:
    hashed, value, row, start, size, begin = (np.concatenate([f[i] for f in found])
                                              for i in range(6))
    source = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    datas = [f[6] for f in found]
    part = (value >> U64(32)) * U64(parts) >> U64(32)
    # By part, minimizer and content; the first of equal segments is sent.
    order = np.lexsort((hashed, value))
    hashed, value, row, start, size, begin, source, part = (
        x[order] for x in (hashed, value, row, start, size, begin, source, part))
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (value[1:] != value[:-1]))
    which = np.cumsum(new) - 1
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        first = a + np.flatnonzero(new[a:b])
        body = b"".join([datas[s][x:x + n] for s, x, n in zip(
            source[first].tolist(), begin[first].tolist(), size[first].tolist())])
        copies = np.stack([row[a:b], start[a:b], which[a:b] - which[a]]).astype(np.uint32)
        out.append((int(part[a]), shard, body, size[first].astype(np.uint32).tobytes(),
                    value[first].tobytes(), ids[row[a:b]].tobytes(), copies.tobytes()))
    return out


def _sorted_pairs(high: np.ndarray, low: np.ndarray, at: np.ndarray, bits: int):
    """``at`` in order of (high, low), and where a pair differs from the one before it."""
    if 3 * bits + 1 <= 64:
        packed = np.sort(high.astype(U64) << U64(2 * bits + 1) | low.astype(U64) << U64(bits)
                         | at.astype(U64))
        both = packed >> U64(bits)
        return (packed & U64((1 << bits) - 1)).astype(np.int64), \
            np.append(True, both[1:] != both[:-1])
    by = np.lexsort((low, high))
    high, low = high[by], low[by]
    return at[by], np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))


def _refined(order, new, rank, follow_rank, step: int, bits: int) -> None:
    """Sort each group of ``order`` that agrees so far by the rank of what follows, in place.

    ``rank`` takes the new ranks; ``follow_rank`` holds those that are compared (it may be the
    same). Groups of one are done.
    """
    n, total = len(order), len(rank)
    slot = np.flatnonzero(~(new & np.append(new[1:], True)))
    if not len(slot):
        return
    at = order[slot]
    follow = np.full(len(at), total, np.int64)
    inside = at + step < total
    follow[inside] = follow_rank[at[inside] + step]
    at, first = _sorted_pairs(rank[at], follow, at, bits)
    order[slot] = at
    new[slot] = first
    rank[at] = np.maximum.accumulate(np.where(first, slot, 0))


def suffix_array(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` positions sorted by the ``depth`` bytes that start there.

    Larsson-Sadakane: ranks of all positions by a few bytes, then by twice as many, until the
    depth is at most three times theirs; from there on only the wanted positions are sorted, by
    the ranks of what follows. A group that agrees so far is sorted, a group of one is done. Bytes
    behind the end count as 255, which UTF-8 never holds.
    """
    n = len(data)
    bits = max(1, int(n - 1).bit_length())
    taken = min(depth, (64 - bits) // 8, 5)
    key = np.zeros(n, U64)
    padded = np.append(data, np.full(taken, 255, np.uint8))
    for j in range(taken):
        key = key << U64(8) | padded[j:n + j]
    packed = np.sort(key << U64(bits) | np.arange(n, dtype=U64))
    order = (packed & U64((1 << bits) - 1)).astype(np.int64)
    group = packed >> U64(bits)
    new = np.append(True, group[1:] != group[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while taken * 3 < depth:
        _refined(order, new, rank, rank, taken, bits)
        taken *= 2
    # From here on the wanted positions alone, against the ranks by ``taken`` bytes.
    order = order[wanted[order]]
    if not len(order):
        return order
    known = rank[order]
    new = np.append(True, known[1:] != known[:-1])
    fine = np.zeros(n, np.int64)
    fine[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    done = taken
    while done < depth:
        step = min(done, depth - taken)
        _refined(order, new, fine, rank, step, bits)
        done = step + taken
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, lanes: int = 16) -> np.ndarray:
    """Common bytes (at most ``depth``) of each position in order with the one before it.

    Kasai's rule, that the value at a text position is at least that of the position before less
    one, in lanes: positions i, i + lanes, ... advance together. The rule needs the position after
    the earlier neighbour to be sorted, too, and to stand before this one; ties at ``depth`` and
    positions that are not wanted may break it, and the comparison starts anew there.
    """
    n = len(data)
    word = words_at(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(n + 1, len(order), np.int64)
    place[order] = np.arange(len(order))
    common = np.zeros(n, np.int64)
    lane_of = (order % lanes).astype(np.uint8)
    by_lane = np.argsort(lane_of, kind="stable")
    edges = np.searchsorted(lane_of[by_lane], np.arange(lanes + 1))
    for lane in range(lanes):
        at = order[by_lane[edges[lane]:edges[lane + 1]]]
        at = at[before[at] >= 0]
        if lane:
            after = before[at - 1] + 1
            holds = (after > 0) & (place[after] < place[at])
            common[at] = np.where(holds, np.maximum(common[at - 1] - 1, 0), 0)
        have, other = common[at], before[at]
        while len(at):
            # Eight bytes at a time; the lowest bit that differs tells how many are equal.
            differ = word[at + have] ^ word[other + have]
            same = differ == 0
            lowest = differ & (~differ + U64(1))
            lowest[same] = 1
            have += np.where(same, 8, np.log2(lowest.astype(float)).astype(np.int64) >> 3)
            have = np.minimum(have, np.minimum(depth, n - np.maximum(at, other)))
            common[at] = have
            more = same & (have < depth) & (np.maximum(at, other) + have < n)
            at, other, have = at[more], other[more], have[more]
    return common[order]


def first_documents(body: np.ndarray, size: np.ndarray, value: np.ndarray,
                    doc: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each byte of distinct segments (sorted by minimizer) that starts a string, the smallest
    document id of all equal strings; ``doc`` is the smallest id of each segment."""
    total = len(body)
    ends = np.cumsum(size)
    starts = ends - size
    first = np.full(total, NO_ID, np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    is_start = np.arange(total) <= (ends - WIDTH)[owner]
    first[is_start] = doc[owner[is_start]]
    cuts, low = [], 0
    for i in range(len(size)):
        if ends[i] - starts[low] > block and i > low:
            cuts.append((low, i))
            low = i
    cuts.append((low, len(size)))
    for low, high in cuts:
        a, b = int(starts[low]), int(ends[high - 1])
        order = suffix_array(body[a:b], is_start[a:b], WIDTH)
        new = common_prefixes(body[a:b], order, WIDTH) < WIDTH
        new[0] = True
        order = order + a
        head = np.flatnonzero(new)
        least = np.minimum.reduceat(first[order], head)
        first[order] = np.repeat(least, np.diff(np.append(head, len(order))))
    _merge_blocks(body, first, is_start, owner, value, cuts)
    return first


def _merge_blocks(body, first, is_start, owner, value, cuts) -> None:
    """Strings of a minimizer that lies in several blocks take the smallest id of all blocks."""
    edge = {int(value[low]) for low, _ in cuts[1:]} & {int(value[high - 1]) for _, high in cuts}
    if not edge:
        return
    wanted = np.isin(value, np.fromiter(edge, U64, len(edge)))
    chosen = np.flatnonzero(is_start & wanted[owner])
    block = np.searchsorted([low for low, _ in cuts], owner[chosen], "right")
    raw = body.tobytes()
    merged = least = None
    sorted_blocks = []
    for b in range(1, len(cuts) + 1):
        at = chosen[block == b]
        if not len(at):
            continue
        # The last byte keeps numpy from dropping zero bytes at the end of a string.
        keys = np.array([raw[i:i + WIDTH] + b"\x01" for i in at.tolist()], f"S{WIDTH + 1}")
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        sorted_blocks.append((keys, at))
        if merged is None:
            new = np.append(True, keys[1:] != keys[:-1])
            merged, least = keys[new], first[at][new].copy()
            continue
        place = np.minimum(np.searchsorted(merged, keys), len(merged) - 1)
        hit = merged[place] == keys
        np.minimum.at(least, place[hit], first[at[hit]])
        fresh, ids = keys[~hit], first[at[~hit]]
        if len(fresh):
            new = np.append(True, fresh[1:] != fresh[:-1])
            fresh, ids = fresh[new], ids[new]
            place = np.searchsorted(merged, fresh)
            merged, least = np.insert(merged, place, fresh), np.insert(least, place, ids)
    for keys, at in sorted_blocks:
        first[at] = least[np.searchsorted(merged, keys)]


def _judge(block: int):
    """For a part of the minimizers: what goes, as ranges for each shard."""
    def run(key, table):
        n = table.num_rows
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        size = [np.frombuffer(x, np.uint32).astype(np.int64) for x in column["size"]]
        value = np.concatenate([np.frombuffer(x, U64) for x in column["least"]])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in column["doc"]])
        copies = [np.frombuffer(x, np.uint32).astype(np.int64).reshape(3, -1)
                  for x in column["copy"]]
        counts = [len(s) for s in size]
        each = [c.shape[1] for c in copies]
        row, start, which = (np.concatenate([c[i] for c in copies]) for i in range(3))
        which = which + np.repeat(np.cumsum(counts) - counts, each)
        source = np.repeat(np.arange(n), each)
        size = np.concatenate(size)
        at = np.cumsum(size) - size
        body = b"".join(column["body"])
        del column["body"], copies
        # Equal strings have equal minimizers: one range of minimizers after the other.
        order = np.argsort(value, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_copy = np.argsort(place[which], kind="stable")
        copy_place = place[which[by_copy]]
        found = [(np.zeros(0, np.int64),) * 4]
        for low, high in _ranges(value[order], size[order], 4 * block):
            chosen = order[low:high]
            a, b = np.searchsorted(copy_place, (low, high))
            own = by_copy[a:b]
            gone = _judge_range(body, at[chosen], size[chosen], value[chosen],
                                copy_place[a:b] - low, doc[own], start[own], block)
            found.append((source[own][gone[0]], row[own][gone[0]], *gone[1:]))
        source, row, start, stop = (np.concatenate([f[i] for f in found]) for i in range(4))
        by = np.argsort(source, kind="stable")
        source, row, start, stop = (x[by] for x in (source, row, start, stop))
        edges = np.searchsorted(source, np.arange(n + 1))
        out = [(column["shard"][s], *(x[a:b].astype(np.uint32).tobytes()
                                      for x in (row, start, stop)))
               for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        names = [f.split()[0] for f in ANSWER.split(",")]
        kinds = [pa.int32()] + [pa.binary()] * 3
        return pa.table([pa.array(c, t) for c, t in
                         zip(zip(*out) if out else [[]] * 4, kinds)], names=names)
    return run


def _ranges(value: np.ndarray, size: np.ndarray, limit: int):
    """Ranges of segments of about ``limit`` bytes; the segments of a minimizer stay together."""
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    ends = np.cumsum(size)
    low = 0
    while low < len(value):
        high = int(np.searchsorted(ends, ends[low] - size[low] + limit, "right"))
        k = int(np.searchsorted(new, max(high, low + 1)))
        # Back to the start of a minimizer, or on to the next one if there is none.
        cut = int(new[k - 1]) if high < len(value) and int(new[k - 1]) > low else \
            int(new[k]) if k < len(new) else len(value)
        cut = len(value) if high >= len(value) else cut
        yield low, cut
        low = cut


def _judge_range(body: bytes, at, size, value, which, doc, start, block):
    """(copy, start, stop) of what goes, for copies ``which`` of the given segments."""
    data = np.frombuffer(_spans(body, at, size), np.uint8)
    ends = np.cumsum(size)
    hashed = SpanHash(data).of(ends - size, ends)
    order = np.lexsort((hashed, value))
    new = np.append(True, (hashed[order][1:] != hashed[order][:-1])
                    | (value[order][1:] != value[order][:-1]))
    number = np.empty(len(size), np.int64)
    number[order] = np.cumsum(new) - 1
    kept = order[new]
    data = np.frombuffer(_spans(body, at[kept], size[kept]), np.uint8)
    which = number[which]
    least = np.full(len(kept), NO_ID, np.int64)
    np.minimum.at(least, which, doc)
    first = first_documents(data, size[kept], value[kept], least, block)
    # Every copy's strings against its own document id.
    strings = size[kept] - WIDTH + 1
    base = np.cumsum(size[kept]) - size[kept]
    out = []
    total = np.cumsum(strings[which])
    cuts = np.searchsorted(total, np.arange(0, int(total[-1]) + (1 << 20), 1 << 20), "right")
    cuts = np.unique(np.append(cuts, len(which)))
    for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()):
        if b <= a:
            continue
        n_strings = strings[which[a:b]]
        last = np.cumsum(n_strings)
        offset = np.arange(int(last[-1])) - np.repeat(last - n_strings, n_strings)
        gone = first[np.repeat(base[which[a:b]], n_strings) + offset] \
            < np.repeat(doc[a:b], n_strings)
        copy = np.repeat(np.arange(a, b), n_strings)[gone]
        offset = offset[gone]
        if not len(offset):
            continue
        head = np.flatnonzero(
            np.append(True, (copy[1:] != copy[:-1]) | (offset[1:] != offset[:-1] + 1)))
        tail = np.append(head[1:], len(offset)) - 1
        out.append((copy[head], start[copy[head]] + offset[head],
                    start[copy[head]] + offset[tail] + WIDTH))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(o[i] for o in out)]) for i in range(3))


def _kept(ids, bodies, answers):
    """Id, bytes, removed bytes, removed runs and kept bytes of each row of a shard."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    at = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(int(sizes.sum()) + len(bodies) + 1, np.int32)
    for row, start, stop in zip(*(answers.column(c).to_pylist() for c in ("row", "start", "stop"))):
        row, start, stop = (np.frombuffer(x, np.uint32).astype(np.int64)
                            for x in (row, start, stop))
        np.add.at(change, at[row] + start, 1)
        np.add.at(change, at[row] + stop, -1)
    gone = np.cumsum(change) > 0
    for i, (doc, body) in enumerate(zip(ids.tolist(), bodies)):
        mask = gone[at[i]:at[i] + len(body)]
        removed = int(mask.sum())
        runs = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
        kept = np.frombuffer(body, np.uint8)[~mask].tobytes() if removed else body
        yield None if doc == NO_ID else doc, len(body), removed, runs, kept


def _digest(key, table, answers):
    rows = [(*r[:4], hashlib.sha256(r[4]).hexdigest())
            for r in _kept(*rows_of(table), answers)] if table.num_rows else []
    names = [f.split()[0] for f in DIGESTS.split(",")]
    return pa.table([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.string()])], names=names)


def _text(key, table, answers):
    if not table.num_rows:
        return pa.table({"kept": pa.array([], pa.string()), "rest": table.column("rest")})
    ids, bodies, order = order_of(table)
    kept = [r[4].decode(errors="ignore") for r in _kept(ids, bodies, answers)]
    return pa.table({"kept": pa.array(kept, pa.string()),
                     "rest": table.column("rest").combine_chunks().take(pa.array(order))})


def _apply(rows, finish, schema, shard_bytes, block, hot) -> DataFrame:
    bounded_batches(rows.sparkSession)
    total = total_bytes(rows)
    shards, count = sharded(rows, total, shard_bytes)
    buckets = buckets_for(2 * total // (WIDTH - GRAM + 2))
    by_shard = shards.groupBy("shard")
    answers = compared(by_shard.applyInArrow(_announce(buckets), ANNOUNCED))
    sent = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(_cut_out(buckets, count, hot), SENT)
    ranges = sent.groupBy("part").applyInArrow(_judge(block), ANSWER)
    return by_shard.cogroup(ranges.groupBy("shard")).applyInArrow(finish, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text",
            shard_bytes: int = SHARD_BYTES, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, bytes, removed bytes, maximal removed runs and digest of what is kept."""
    return _apply(utf8(docs, key, text), _digest, DIGESTS, shard_bytes, block, hot)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shard_bytes: int = SHARD_BYTES, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """All rows and columns, with the kept text; a null text becomes empty."""
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"),
        rest.alias("rest"))
    kind = T.StructType([T.StructField("kept", T.StringType()), rows.schema["rest"]])
    out = _apply(rows, _text, kind, shard_bytes, block, hot)
    return out.select(*(
        F.col("kept").alias(text) if c == text
        else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns))
