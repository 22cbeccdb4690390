"""Similarity join of texts on word n-grams, with token-combination prefixes.

Two texts link when 100 * intersection >= percent * union of their sets of n-gram hashes (64 bits).
``similar`` gives one row per document with its set size and its component.

1. Which documents can have a partner. A partner has all but ``slack`` = n - ceil(percent * n / 100)
   of a document's n tokens, so a document with more tokens that stand nowhere else has none.
   ``sharing`` first looks at a fixed share of the hash range, then, for the documents that are
   left, at all their tokens. That also gives the frequencies that order the tokens.
2. Signatures. Tokens are ordered: unshared, rare, frequent (more than ``FREQUENT`` documents), each
   by hash. Frequent tokens fall into ``classes`` by hash; the prefix is extended by one token for
   each class: two partners then share 1 + classes tokens of their prefixes, so either a rare one,
   which is a signature, or two of the same class, whose combination is a signature. The number
   of classes follows the size of the larger text (a power of two), so a text writes combinations
   for its own size and for that of a larger partner.
3. Ties. Documents with a common signature are tied to one centre per signature, first within a
   shard, then across shards (a signature of a third of all documents is one row per shard). Ties
   are verified, which joins most groups of copies without comparing all their pairs.
4. Pairs. What is left are documents with a common signature in different components. They are
   paired by signature, if the positional bound allows a link: tokens before the first common one
   are not common. Signatures are dealt into buckets, and each bucket packs its pairs by blocks of
   documents; the pairs of a hot signature are made by a join instead. A set is sent once for each
   pair of blocks that needs it, not once for each pair. A group that has been joined makes no pairs, and neither do documents whose own
   tokens alone exceed what a partner may lack. Pairs are verified, and all links give the
   components. Equal texts are compared as one.

The result does not depend on any of these sizes. Every row is a document of its own, also with a
repeated id; ``component_id`` is the least id. Null ids count as absent for that; a null or empty
text has an empty set, no link, and its own id as component. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.components import components
from tenderlens.llm.sharing import (
    ANNOUNCED, NO_ID, SHARD_BYTES, Shared, announce, buckets_for, compared, distinct, order_of,
    rows_of, sharded, shared_tokens, total_bytes)
from tenderlens.llm.texts import (
    LOWER, NOT_SPACE, SpanHash, Texts, bounded_batches, mix, slices, utf8, window_hashes)
from tenderlens.sources.staging import stage

U64 = np.uint64
SLICE = 1 << 20
SAMPLED = 0.25
FREQUENT = 1024
#: Entries of a signature from which on its pairs are made by a join, which Spark can split.
HOT_ENTRIES = 1 << 15
BUCKET_ENTRIES = 1 << 20
#: Documents of a block, when pairs are verified block by block.
BLOCK_DOCS = 512
#: Rows of 16 bytes that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1 << 20

FOUND = """kind int, bucket int, node long, doc_id long, n long, other long, own long,
    tokens binary, more binary, signatures array<long>, places array<long>"""
DOC, LIVE, EDGE, SIGNATURES = range(4)


def token_sets(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after the other, and their number."""
    tokens, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, high in slices(bodies, SLICE):
        t = Texts(bodies[low:high])
        t.data = LOWER[t.data]
        starts, ends = t.spans(NOT_SPACE)
        grams, owner, _ = window_hashes(SpanHash(t.data).of(starts, ends), t.counts(starts),
                                        width, whole_if_short=True)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[:len(grams)]
        tokens.append(grams[new])
        sizes.append(np.bincount(owner[new], minlength=high - low))
    return np.concatenate(tokens), np.concatenate(sizes)


def slack(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a partner may lack."""
    return sizes - -(-percent * sizes // 100)


def _per_doc(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


_SAMPLE_LIMIT = U64(int(SAMPLED * 2 ** 64))


def _sampled(width: int, ids, bodies):
    tokens, sizes = token_sets(bodies, width)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    use = tokens < _SAMPLE_LIMIT
    return tokens[use], rows[use]


def _split(answers: pa.Table) -> tuple[pa.Table, pa.Table]:
    import pyarrow.compute as pc

    return tuple(answers.filter(pc.equal(answers.column("step"), i)) for i in (0, 1))


def _possible(tokens, sizes, sample: Shared, percent: int) -> np.ndarray:
    """Which texts may have a partner, after a look at the sampled tokens."""
    unshared = (tokens < _SAMPLE_LIMIT)
    unshared[unshared] = sample.count(tokens[unshared]) < 2
    return (sizes > 0) & (_per_doc(unshared, sizes) <= slack(sizes, percent))


def _announce_possible(width: int, percent: int, sample_buckets: int, buckets: int):
    def run(key, table, answers):
        tokens = np.zeros(0, U64)
        rows = np.zeros(0, np.int64)
        if table.num_rows:
            tokens, sizes = token_sets(rows_of(table)[1], width)
            alive = _possible(tokens, sizes, Shared(answers, sample_buckets), percent)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            tokens, rows = tokens[alive[rows]], rows[alive[rows]]
        return announce(key[0].as_py(), *distinct(tokens, rows), buckets)
    return run


def classes(level: int, percent: int) -> int:
    """Number of classes of frequent tokens for pairs whose larger text has [2^level, 2^(level+1))
    tokens; none where a text is too short to share one token more for each class."""
    return ((100 - percent) << level) // 400 if level >= 6 else 0


def signatures(tokens: np.ndarray, times: np.ndarray, percent: int,
               frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one text from its tokens and the number of documents that have each, and how
    many of its tokens cannot be common if the signature is the first thing in common: those
    before a single token, or those that stand nowhere else."""
    n = len(tokens)
    free = int(slack(np.array([n]), percent)[0])
    rank = np.where(times < 2, 0, np.where(times <= frequent, 1, 2))
    order = np.lexsort((mix(tokens), rank))
    unshared = int((rank == 0).sum())
    out, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    largest = 100 * n // percent
    for level in range(n.bit_length() - 1, largest.bit_length()):
        extra = classes(level, percent)
        place = np.arange(unshared, min(n, free + 1 + extra))
        prefix = order[place]
        single = (rank[prefix] < 2) | (extra == 0)
        out.append(mix(tokens[prefix[single]]))
        places.append(place[single])
        if not extra:
            continue
        token = np.sort(tokens[prefix[~single]])
        group = (mix(token + U64(1)) % U64(extra)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        token, group = token[by], group[by]
        for step in range(1, len(token)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            out.append(mix(mix(token[:-step][same] + U64(level)) + token[step:][same]))
            places.append(np.full(len(out[-1]), unshared))
    out, places = np.concatenate(out), np.concatenate(places)
    order = np.lexsort((places, out))
    out, places = out[order], places[order]
    new = np.append(True, out[1:] != out[:-1])[:len(out)]
    return out[new], places[new]


def _table(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in FOUND.split(",")]
    kinds = [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
    return pa.table([pa.array(c, t) for c, t in
                     zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def _star(sig: np.ndarray, node: np.ndarray, own: np.ndarray):
    """The centre of each signature (fewest tokens of its own, then least node) and its own tokens;
    (node, centre, signatures) for each node that is no centre there."""
    order = np.lexsort((node, own, sig))
    sig, node, own = sig[order], node[order], own[order]
    new = np.append(True, sig[1:] != sig[:-1])[:len(sig)]
    centre = node[new][np.cumsum(new) - 1] if len(sig) else node
    tie = np.stack([node, centre], 1)[node != centre]
    tie, times = np.unique(tie, axis=0, return_counts=True) if len(tie) \
        else (tie, np.zeros(0, np.int64))
    return sig[new], node[new], own[new], tie[:, 0], tie[:, 1], times


def _find(width: int, percent: int, sample_buckets: int, buckets: int, sig_buckets: int,
          frequent: int):
    """All documents of a shard, the sets of those that may link, ties, and packed signatures."""
    def run(key, table, answers):
        if not table.num_rows:
            return _table([])
        shard = key[0].as_py()
        ids, bodies, order = order_of(table)
        tokens, sizes = token_sets(bodies, width)
        hashed = table.column("hash").to_numpy()[order].tolist()
        del bodies
        base = shard << 32
        out = [(DOC, None, base | i, None if d == NO_ID else d, n, h, None, None, None, None, None)
               for i, (d, n, h) in enumerate(zip(ids.tolist(), sizes.tolist(), hashed))]
        sample, full = (Shared(a, b) for a, b in zip(_split(answers), (sample_buckets, buckets)))
        alive = _possible(tokens, sizes, sample, percent)
        times = np.zeros(len(tokens), np.int64)
        mask = np.repeat(alive, sizes)
        times[mask] = full.count(tokens[mask])
        own = _per_doc(times < 2, sizes)
        alive &= own <= slack(sizes, percent)
        ends = np.cumsum(sizes)
        sig, node = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(alive).tolist():
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            found, places = signatures(tokens[a:b], times[a:b], percent, frequent)
            sig.append(found)
            node.append(np.full(len(found), base | i, np.int64))
            shared = tokens[a:b][times[a:b] > 1]
            out.append((LIVE, None, base | i, None if ids[i] == NO_ID else int(ids[i]), b - a,
                        None, int(own[i]), shared.tobytes(), None, found.astype(np.int64),
                        places))
        sig, node = np.concatenate(sig), np.concatenate(node)
        sig, centre, priority, *ties = _star(sig, node, own[node & 0xFFFFFFFF])
        # The centre that a document shares most signatures with.
        order = np.lexsort((ties[1], -ties[2], ties[0]))
        ties = [x[order] for x in ties]
        best = np.append(True, ties[0][1:] != ties[0][:-1])[:len(order)]
        out += [(EDGE, None, a, None, None, b, None, None, None, None, None)
                for a, b in zip(ties[0][best].tolist(), ties[1][best].tolist())]
        bucket = ((sig >> U64(32)) * U64(sig_buckets) >> U64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(sig)) \
            if len(sig) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out.append((SIGNATURES, int(bucket[a]), None, None, None, None, None,
                        sig[a:b].tobytes(),
                        np.stack([centre[a:b], priority[a:b]]).tobytes(), None, None))
        return _table(out)
    return run


def _tie(table: pa.Table) -> pa.Table:
    """Ties across shards, from the centres that each shard has for the bucket's signatures."""
    sig = np.concatenate([np.frombuffer(x, U64) for x in table.column("tokens").to_pylist()])
    both = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1)
                           for x in table.column("more").to_pylist()], 1)
    a, b, times = _star(sig, both[0], both[1])[3:]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "times": pa.array(times, pa.int64())})


def _verify(percent: int):
    """The pairs that link."""
    def run(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            common = np.fromiter((
                len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), True))
                for x, y in zip(batch.column("t_a").to_pylist(), batch.column("t_b").to_pylist())),
                np.int64, len(a))
            good = 100 * common >= percent * (n_a + n_b - common)
            yield pa.RecordBatch.from_pydict({"a": a[good], "b": b[good]})
    return run


def _possible_pair(percent: int, place_a: str, place_b: str) -> str:
    """SQL condition: the tokens behind the places suffice for a link."""
    return f"{100 + percent} * least(n_a - {place_a}, n_b - {place_b}) >= {percent} * (n_a + n_b)"


def _verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (a, b, n_a, n_b)."""
    side = live.select("node", "tokens")
    return (pairs.join(side.toDF("a", "t_a"), "a").join(side.toDF("b", "t_b"), "b")
            .select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(_verify(percent),
                                                                     "a long, b long"))


def _tied(ties: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links among the ties."""
    own = live.select("node", "n", "own")
    pairs = (ties.distinct().join(own.toDF("a", "n_a", "own_a"), "a")
             .join(own.toDF("b", "n_b", "own_b"), "b")
             .filter(_possible_pair(percent, "own_a", "own_b")))
    return _verified(pairs, live, percent)


def _pairs_in(percent: int, blocks: int):
    """Distinct pairs of a bucket of signatures, packed; entries of a signature are compared by distance
    in their order, all signatures at once."""
    def run(table):
        order = np.argsort(table.column("signature").to_numpy(), kind="stable")
        signature, node, n, root, place = (table.column(c).to_numpy()[order] for c in (
            "signature", "node", "n", "root", "place"))
        known = np.sort(node)
        known = known[np.append(True, known[1:] != known[:-1])[:len(known)]]
        number = np.searchsorted(known, node)
        sizes = np.zeros(len(known), np.int64)
        sizes[number] = n
        at, held = np.arange(len(order)), 0
        found = [np.zeros(0, np.int64)]
        for step in range(1, len(order)):
            at = at[at + step < len(order)]
            at = at[signature[at] == signature[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            least = np.minimum(n[x] - place[x], n[y] - place[y])
            use = (root[x] != root[y]) & ((100 + percent) * least >= percent * (n[x] + n[y]))
            x, y = number[x[use]], number[y[use]]
            found.append(np.minimum(x, y) * len(known) + np.maximum(x, y))
            held += len(x)
            if held > 1 << 21:
                found, held = [_distinct(np.concatenate(found))], 0
        pairs = _distinct(np.concatenate(found))
        low, high = pairs // max(1, len(known)), pairs % max(1, len(known))
        return _packed(np.stack([known[low], known[high], sizes[low], sizes[high]], 1), blocks)
    return run


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[:len(keys)]]


def _packed(pairs: np.ndarray, blocks: int) -> pa.Table:
    """Pairs (a, b, n_a, n_b) as one row for each pair of blocks."""
    block = (mix(pairs[:, :2].astype(U64)) % U64(blocks)).astype(np.int64)
    key = block[:, 0] * blocks + block[:, 1]
    order = np.argsort(key, kind="stable")
    pairs, key = pairs[order], key[order]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) \
        if len(key) else np.zeros(1, np.int64)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.table({"pair": pa.array([int(key[a]) for a, _ in parts], pa.int64()),
                     "packed": pa.array([pairs[a:b].tobytes() for a, b in parts], pa.binary())})


PACKED = "pair long, packed binary"


def _needed(batches):
    """(node, pair of blocks) of all documents of packed pairs."""
    for batch in batches:
        for pair, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = np.unique(np.frombuffer(packed, np.int64).reshape(-1, 4)[:, :2])
            yield pa.RecordBatch.from_pydict({"node": nodes, "pair": np.full(len(nodes), pair)})


def _verify_blocks(percent: int):
    """Links among the pairs of two blocks, once for each."""
    def run(key, packed, sides):
        pairs = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *(
            np.frombuffer(x, np.int64).reshape(-1, 4)
            for x in packed.column("packed").to_pylist())]), axis=0)
        sets = {n: np.frombuffer(t, U64) for n, t in zip(
            sides.column("node").to_pylist(), sides.column("tokens").to_pylist())}
        common = np.fromiter((len(np.intersect1d(sets[a], sets[b], True))
                              for a, b in pairs[:, :2].tolist()), np.int64, len(pairs))
        good = 100 * common >= percent * (pairs[:, 2] + pairs[:, 3] - common)
        return pa.table({"a": pairs[good, 0], "b": pairs[good, 1]})
    return run


def _verified_blocks(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links among packed pairs: a set is sent once for each pair of blocks that needs it."""
    need = pairs.mapInArrow(_needed, "node long, pair long").distinct()
    sides = live.select("node", "tokens").join(need, "node").select("pair", "node", "tokens")
    return pairs.groupBy("pair").cogroup(sides.groupBy("pair")).applyInArrow(
        _verify_blocks(percent), "a long, b long")


def _paired(live: DataFrame, label: DataFrame, percent: int, hot: int,
            block_docs: int) -> DataFrame:
    """Links between components, among all pairs with a common signature that may link."""
    entry = (live.select("node", "n", "signatures", "places").join(label, "node", "left")
             .withColumn("root", F.coalesce("root", "node"))
             .select("node", "n", "root", F.explode(F.arrays_zip("signatures", "places")).alias("s"))
             .selectExpr("node", "n", "root", "s.signatures signature", "s.places place"))
    several = (entry.groupBy("signature")
               .agg(F.min("root").alias("low"), F.max("root").alias("up"), F.count("*").alias("size"))
               .filter("low < up").select("signature", (F.col("size") > hot).alias("hot")))
    entry = stage(entry.join(several, "signature"), "entries")
    buckets = max(1, -(-entry.count() // BUCKET_ENTRIES))
    blocks = max(1, -(-live.count() // block_docs))
    pairs = (entry.filter("not hot").withColumn(
        "bucket", F.pmod(F.xxhash64("signature"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(_pairs_in(percent, blocks), PACKED))
    names = ("node", "n", "root", "place")
    left, right = (entry.filter("hot").select("signature", *(
        F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
    of_hot = (left.join(right, "signature")
              .filter(f"root_a <> root_b and node_a < node_b and "
                      f"{_possible_pair(percent, 'place_a', 'place_b')}")
              .selectExpr("node_a a", "node_b b", "n_a", "n_b").distinct())

    def pack(batches):
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            yield from _packed(rows, blocks).to_batches()

    pairs = stage(pairs.unionByName(of_hot.mapInArrow(pack, PACKED)), "pairs")
    return _verified_blocks(pairs, live, percent)


def similar(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text",
            **sizes) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _members(docs, width, percent, key, text, **sizes).drop("text_hash")


def representatives(docs: DataFrame, width: int, percent: int, key: str = "doc_id",
                    text: str = "text", **sizes) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Rows that share this id stay together; a row without id goes if a row with id is similar.
    """
    gone = stage(_members(docs, width, percent, key, text, **sizes)
                 .filter("component_id is not null and not component_id <=> doc_id")
                 .select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash"))
                 .distinct(), "gone")
    gone = _small(gone)
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    named = docs.withColumn("_text_hash", F.xxhash64(body))
    return named.join(gone, docs[key].cast("long").eqNullSafe(gone["_gone"])
                      & (named["_text_hash"] == gone["_hash"]), "left_anti").drop("_text_hash")


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its number of rows is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _members(docs: DataFrame, width: int, percent: int, key: str, text: str, **sizes) -> DataFrame:
    """Set size, component and text hash of every row. Equal texts are compared once."""
    bounded_batches(docs.sparkSession)
    rows = utf8(docs, key, text).withColumn("hash", F.xxhash64("body")) \
        .withColumn("digest", F.md5("body"))
    copies = _small(stage(rows.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"))
        .filter("copies > 1").drop("copies"), "copies"))
    marked = rows.join(copies, "digest", "left")
    first = marked.filter("least is null or doc_id = least").select("doc_id", "body", "hash")
    found = stage(_compared(first, width, percent, **sizes), "members")
    others = marked.filter("least is not null and not doc_id <=> least").select(
        F.col("doc_id"), F.col("least"), F.col("hash").alias("text_hash"))
    of_copies = _small(stage(
        found.join(copies.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .withColumnRenamed("doc_id", "least").distinct(), "of_copies"))
    copied = others.join(of_copies, ["least", "text_hash"]).drop("least").withColumn(
        "component_id", F.expr("if(n_shingles = 0, doc_id, component_id)"))
    return found.unionByName(copied)


def _compared(rows: DataFrame, width: int, percent: int, shard_bytes: int = SHARD_BYTES,
              frequent: int = FREQUENT, hot: int = HOT_ENTRIES,
              block_docs: int = BLOCK_DOCS) -> DataFrame:
    total = total_bytes(rows)
    shards, _ = sharded(rows, total, shard_bytes)
    by_shard = shards.groupBy("shard")
    # About one word in six bytes.
    sample_buckets, buckets = buckets_for(int(total * SAMPLED / 6)), buckets_for(total // 6)
    sample = shared_tokens(shards, partial(_sampled, width), sample_buckets)
    full = compared(by_shard.cogroup(sample.groupBy("shard")).applyInArrow(
        _announce_possible(width, percent, sample_buckets, buckets), ANNOUNCED))
    answers = sample.withColumn("step", F.lit(0)).unionByName(full.withColumn("step", F.lit(1)))
    found = stage(by_shard.cogroup(answers.groupBy("shard")).applyInArrow(
        _find(width, percent, sample_buckets, buckets, buckets, frequent), FOUND), "found")
    live = found.filter(f"kind = {LIVE}").select("node", "n", "own", "tokens", "signatures",
                                                 "places")
    across = found.filter(f"kind = {SIGNATURES}").select("bucket", "tokens", "more") \
        .groupBy("bucket").applyInArrow(_tie, "a long, b long, times long")
    across = across.groupBy("a", "b").agg(F.sum("times").alias("times")).groupBy("a").agg(
        F.max(F.struct("times", F.expr("-b"))).alias("best")).selectExpr("a", "-best.col2 b")
    ties = found.filter(f"kind = {EDGE}").selectExpr("node a", "other b").unionByName(across)
    links = stage(_tied(ties, live, percent), "tied")
    label = stage(components(links), "joined")
    more = stage(_paired(live, label, percent, hot, block_docs), "paired")
    if not more.isEmpty():
        label = stage(components(links.unionByName(more)), "all_joined")
    documents = found.filter(f"kind = {DOC}").selectExpr("node", "doc_id", "n", "other text_hash")
    least = stage(documents.join(label, "node").groupBy("root")
                  .agg(F.min("doc_id").alias("component_id")), "least_ids")
    return (documents.join(label.join(least, "root").select("node", "component_id"), "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash"))
