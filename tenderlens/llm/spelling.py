"""Groups of spelling variants: words one edit apart, and the frequent form each belongs to.

Words are runs of letters (``RUN``), lower-cased in A to Z only, that occur often enough over all
documents. As a stated noise, a run whose checksum with its document's id is a multiple of
``NOISE`` loses one code point first.

Search is by a frequency-vector trie: the letters of a word are counted in ``GROUPS`` letter groups,
and words are arranged by successive counts. An inserted code point is a surplus of one in one
group, a deleted one a deficit of one, a replaced one both or neither; so depth-first search spends
a budget of one each and reaches every word one edit away. Words of a leaf are verified.

The trie is cut below its first levels into parts of at most ``PART`` words, as deep as the words
and partitions at hand need; a word is searched for in every part its budget allows it to reach. Parts that stay
larger at the deepest cut are dealt over blocks, against blocks of the words searched for. Roots
are found by doubling: each round joins every word's target with that word's own.

Null and empty texts have no words; a null id is written ``null`` in the checksum. Repeated rows
count again. Other columns are ignored, whatever their names. Ties between forms go to the word
that is least in code-point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlens.sources.staging import stage

RUN = "[A-Za-zÀ-ÿ]+"
NOISE = 199
LEAST_CHARS, LEAST_TIMES = 6, 5
#: A form is at least so many times as frequent as the word.
MORE_FREQUENT = 5

GROUPS = 16
#: Levels that a cut of the trie may use; eight bits hold a count, larger ones share a part.
DEEPEST = 7
#: Most words of a part; fewer where the cluster has more partitions than that gives parts.
PART, LEAST_PART = 1 << 15, 1 << 10
#: Code points of words that are compared as rows of an array; longer words one by one.
WIDTH = 40
#: Pairs that are verified at a time.
PAIRS = 1 << 18


# --- words

def words(docs: DataFrame, key: str, text: str, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of all words."""
    capitals = "".join(map(chr, range(65, 91)))
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long").cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0)))
        .alias("run"))
    runs = runs.filter(F.char_length("run") >= LEAST_CHARS).select(
        "id", F.translate("run", capitals, capitals.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = "int(h % char_length(run))"
    word = F.when(F.col("h") % NOISE == 0, F.expr(
        f"concat(substring(run, 1, {cut}), substring(run, {cut} + 2))")).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= LEAST_CHARS)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least))


class Words:
    """Words with their code points, one row each, and their counts by letter group."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), self.sizes)
        # Neighbouring residues, most of them rare letters, stand far apart in the trie.
        group = (13 * (points % GROUPS).astype(np.int64) + 12) % GROUPS
        self.counts = np.bincount(row * GROUPS + group, minlength=len(texts) * GROUPS) \
            .reshape(-1, GROUPS).astype(np.int32)
        start = np.cumsum(self.sizes) - self.sizes
        column = np.arange(len(points)) - np.repeat(start, self.sizes)
        self.points = np.zeros((len(texts), WIDTH + 1), np.uint32)
        inside = column < WIDTH
        self.points[row[inside], column[inside]] = points[inside]
        three = np.uint64(1) << (np.uint64(21) * np.arange(3, dtype=np.uint64))
        wide = points.astype(np.uint64)
        #: The first three and the last three code points; one edit leaves one of them as it is.
        self.head = sum(wide[start + i] * three[i] for i in range(3)) if len(points) else wide
        self.tail = sum(wide[start + self.sizes - 3 + i] * three[i] for i in range(3)) \
            if len(points) else wide


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between two texts."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i:] == b[i + 1:] if len(a) < len(b) else
                       len(a) == len(b) and a[i + 1:] == b[i + 1:])


def verified(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which pairs (word i of a, word j of b) are one edit apart."""
    out = np.zeros(len(i), bool)
    likely = np.flatnonzero((a.head[i] == b.head[j]) | (a.tail[i] == b.tail[j]))
    size_a, size_b = a.sizes[i[likely]], b.sizes[j[likely]]
    long = np.maximum(size_a, size_b) > WIDTH
    for at in likely[long].tolist():
        out[at] = one_edit(a.texts[i[at]], b.texts[j[at]])
    at, size_a, size_b = likely[~long], size_a[~long], size_b[~long]
    x, y = a.points[i[at]], b.points[j[at]]
    swap = (size_a > size_b)[:, None]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    differs = x != y
    even = size_a == size_b
    # Up to the first difference as they stand, behind it with the longer word one ahead.
    shifted = x[:, :-1] != y[:, 1:]
    behind = np.maximum.accumulate(differs, axis=1)[:, :-1]
    longer = np.abs(size_a - size_b) == 1
    out[at] = np.where(even, differs.sum(1) == 1, longer & ~(shifted & behind).any(1))
    return out


# --- the trie

def search(index: Words, queries: Words):
    """Pairs (query, word of the index) one edit apart, in chunks.

    A node of the trie is a range of the sorted vectors. Every node is visited once, with all
    queries that reach it and what is left of their budgets.
    """
    if not index.texts or not queries.texts:
        return
    order = np.lexsort(index.counts.T[::-1])
    sorted_ = index.counts[order]
    new = np.append(True, (sorted_[1:] != sorted_[:-1]).any(1))
    leaf = np.flatnonzero(new)
    ends = np.append(leaf[1:], len(order))
    vectors, asked = sorted_[leaf], queries.counts
    every = np.arange(len(queries.texts))
    ones = np.ones(len(every), np.int8)
    todo = [(0, 0, len(leaf), every, ones, ones)]
    found_q, found_leaf, waiting = [], [], 0
    while todo:
        depth, low, high, q, surplus, deficit = todo.pop()
        if high - low == 1:
            # A single path: its rest is spent at once.
            rest = vectors[low, depth:] - asked[q, depth:]
            q = q[(np.maximum(rest, 0).sum(1) <= surplus)
                  & (np.maximum(-rest, 0).sum(1) <= deficit)]
            if len(q):
                found_q.append(q)
                found_leaf.append(np.full(len(q), low))
                waiting += len(q) * (ends[low] - leaf[low])
                if waiting >= PAIRS:
                    yield from _leaves(index, queries, order, leaf, ends, found_q, found_leaf)
                    found_q, found_leaf, waiting = [], [], 0
            continue
        column = vectors[low:high, depth]
        at = np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), high - low)
        own = asked[q, depth]
        for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
            change = column[start] - own
            fits = (change <= surplus) & (-change <= deficit)
            if fits.any():
                c = change[fits]
                todo.append((depth + 1, low + start, low + end, q[fits],
                             (surplus[fits] - (c > 0)).astype(np.int8),
                             (deficit[fits] - (c < 0)).astype(np.int8)))
    if waiting:
        yield from _leaves(index, queries, order, leaf, ends, found_q, found_leaf)


def _leaves(index, queries, order, leaf, ends, found_q, found_leaf):
    """Verified pairs of queries and all words of the leaves they reached."""
    q, at = np.concatenate(found_q), np.concatenate(found_leaf)
    sizes = ends[at] - leaf[at]
    last = np.cumsum(sizes)
    for low in range(0, int(last[-1]), PAIRS):
        # Pair number p belongs to the reached leaf whose running total first exceeds p.
        p = np.arange(low, min(low + PAIRS, int(last[-1])))
        own = np.searchsorted(last, p, "right")
        i, j = q[own], order[leaf[at[own]] + p - (last[own] - sizes[own])]
        good = verified(queries, i, index, j)
        yield i[good], j[good]


# --- parts of the trie

def packed(counts: np.ndarray, depth: int) -> np.ndarray:
    """The first counts of each vector as one number."""
    cut = np.minimum(counts[:, :depth], 255).astype(np.int64)
    return (cut << (8 * np.arange(depth))).sum(1)


def reachable(counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) for every part of the trie a row's budget reaches, each once."""
    rows, parts = [], []
    first = counts[:, :depth]
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up == down and up >= 0:
                continue
            moved = first.copy()
            if up >= 0:
                moved[:, up] += 1
            if down >= 0:
                moved[:, down] -= 1
            row = np.flatnonzero((moved >= 0).all(1))
            rows.append(row)
            parts.append(packed(moved[row], depth))
    rows, parts = np.concatenate(rows), np.concatenate(parts)
    both = np.unique(np.stack([rows, parts], 1), axis=0)
    return both[:, 0], both[:, 1]


def part_sizes(found: DataFrame) -> DataFrame:
    """(depth, part, size) at every possible cut."""
    def run(batches):
        for batch in batches:
            counts = Words(batch.column(0).to_pylist()).counts
            depth = np.repeat(np.arange(1, DEEPEST + 1), len(counts))
            part = np.concatenate([packed(counts, d) for d in range(1, DEEPEST + 1)])
            yield pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int32()), "part": part})

    return (found.select("word").mapInArrow(run, "depth int, part long")
            .groupBy("depth", "part").agg(F.count("*").alias("size")))


def dealt(found: DataFrame, part: int | None) -> DataFrame:
    """Words as rows of the trie's parts and as queries to the parts they reach.

    (part, block, query_block, asked, word, n); both roles of a part meet in its blocks.
    """
    sizes = stage(part_sizes(found), "parts")
    rows = sizes.groupBy("depth").agg(F.max("size").alias("most"), F.sum("size").alias("all")) \
        .collect()
    most = {r.depth: r.most for r in rows}
    if part is None:
        partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = max((r["all"] for r in rows), default=0) // partitions
        part = min(PART, max(LEAST_PART, share))
    depth = next((d for d in range(1, DEEPEST + 1) if most.get(d, 0) <= part), DEEPEST)

    def run(batches):
        for batch in batches:
            counts = Words(batch.column(0).to_pylist()).counts
            row, to = reachable(counts, depth)
            row = np.concatenate([np.arange(len(counts)), row])
            to = np.concatenate([packed(counts, depth), to])
            asked = np.arange(len(row)) >= len(counts)
            # In pieces, so that the parts of a batch do not add up.
            for low in range(0, len(row), 1 << 16):
                piece = slice(low, low + (1 << 16))
                taken = batch.take(pa.array(row[piece]))
                yield pa.RecordBatch.from_pydict({
                    "part": to[piece], "asked": asked[piece], "word": taken.column(0),
                    "n": taken.column(1)})

    rows = found.select("word", "n").mapInArrow(
        run, "part long, asked boolean, word string, n long")
    if most.get(depth, 0) <= part:
        return rows.withColumns({"block": F.lit(0), "query_block": F.lit(0)})
    large = sizes.filter((F.col("depth") == depth) & (F.col("size") > part)).select(
        "part", F.ceil(F.col("size") / part).cast("int").alias("blocks"))
    rows = rows.join(large, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), "blocks").cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (rows.withColumn("block", F.explode(F.when(F.col("asked"), every)
                                               .otherwise(F.array(own))))
            .withColumn("query_block", F.explode(F.when(F.col("asked"), F.array(own))
                                                 .otherwise(every))).drop("blocks"))


def _near_in_part(table: pa.Table) -> pa.Table:
    """For each word searched for: how many words are near it, and the most frequent of them."""
    asked = table.column("asked").to_numpy()
    texts, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    own, other = np.flatnonzero(~asked), np.flatnonzero(asked)
    own = own[np.argsort(np.array([texts[i] for i in own], object), kind="stable")]
    index, queries = Words([texts[i] for i in own]), Words([texts[i] for i in other])
    near = np.zeros(len(other), np.int64)
    # Words stand in code-point order, so the least rank is the least (-n, word).
    frequency = n[own]
    rank = np.empty(len(own), np.int64)
    by_rank = np.lexsort((np.arange(len(own)), -frequency))
    rank[by_rank] = np.arange(len(own))
    best = np.full(len(other), len(own), np.int64)
    for i, j in search(index, queries):
        near += np.bincount(i, minlength=len(other))
        np.minimum.at(best, i, rank[j])
    hit = np.flatnonzero(near)
    top = by_rank[best[hit]]
    return pa.table({"word": pa.array([queries.texts[i] for i in hit], pa.string()),
                     "near": pa.array(near[hit], pa.int64()),
                     "top_n": pa.array(frequency[top], pa.int64()),
                     "top": pa.array([index.texts[i] for i in top.tolist()], pa.string())})


def neighbours(found: DataFrame, part: int | None = None) -> DataFrame:
    """(word, near, top, top_n) of the words that have near words among ``found`` (word, n).

    ``part`` bounds the words of a part; without it, an even share of them for each partition.
    """
    def run(key, table):
        return _near_in_part(table)

    partial = dealt(found, part).groupBy("part", "block", "query_block").applyInArrow(
        run, "word string, near long, top_n long, top string")
    return partial.groupBy("word").agg(
        F.sum("near").alias("near"),
        F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("top"))).alias("best")
    ).select("word", "near", "best.top", (-F.col("best.less")).alias("top_n"))


# --- groups

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word along the forms.

    A form is more frequent than its word by a factor, so there is no circle, and the chains are
    as short as a logarithm of the frequencies; rounds are a logarithm of that.
    """
    hops = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stage(hops.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        if hops.filter("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
             least: int = LEAST_TIMES, part: int | None = None) -> DataFrame:
    """Every word with its form, the root of its group, and its counts."""
    found = stage(words(docs, key, text, least), "words")
    near = found.join(neighbours(found, part), "word", "left")
    has_form = F.col("top_n") >= MORE_FREQUENT * F.col("n")
    near = stage(near.select(
        "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("top")).alias("form"),
        F.when(has_form, F.col("top_n")).alias("form_n")), "near")
    last = roots(near.filter("form is not null"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
