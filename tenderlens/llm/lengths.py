"""Token counts by a linear longest-match automaton: greedy word-piece lengths without pieces.

The vocabulary is a trie of UTF-8 bytes with failure links and, for each link, the number of
pieces it completes ("popped"), as published for linear-time word-piece tokenisation: a word is
read once; where the trie has no edge, the popped count is added and the failure link followed.
A word is read with one marker in front of it, and every piece of the vocabulary takes part: the
marker alone is one token where no piece joins it to the first character, and a character without
a piece of its own is one token for each of its bytes.

Words are runs of characters other than ASCII white space. A word that the vocabulary cannot cover,
as one without byte pieces may not, counts as one unknown token. ``n_tokens`` sums over a text's
words; every distinct word of a slice of texts runs through the automaton once and its length is
joined back by position.

A null text is empty and has no tokens. Rows are counted one by one; null keys stay null; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenderlens.llm.pieces import MARK
from tenderlens.llm.texts import NOT_SPACE, SpanHash, Texts, per_slice, utf8

SCHEMA = "doc_id long, n_words long, n_unknown long, n_tokens long"


class LongestMatch:
    """Node 0 starts a word, node 1 continues one; both are roots of their own part.

    An empty starting piece is the marker alone: node 0 pops it and goes on at node 1.
    """

    def __init__(self, starting: set[bytes], continuing: set[bytes]):
        edges: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = edges[node].get(byte)
                    if child is None:
                        child = edges[node][byte] = len(edges)
                        edges.append({})
                        final.append(False)
                        parent.append((node, byte))
                    node = child
                final[node] = node != 1
        fail, popped = [-1] * len(edges), [0] * len(edges)
        if final[0]:
            fail[0], popped[0] = 1, 1
        layer = [0, 1]
        while layer:
            layer = [child for node in layer for child in edges[node].values()]
            for node in layer:
                if final[node]:
                    fail[node], popped[node] = 1, 1
                    continue
                above, byte = parent[node]
                at, count = fail[above], popped[above]
                while at != -1 and byte not in edges[at]:
                    count += popped[at]
                    at = fail[at]
                if at != -1:
                    fail[node], popped[node] = edges[at][byte], count
        self.edges, self.fail, self.popped = edges, fail, popped

    def length(self, word: bytes) -> int:
        """Number of pieces, or -1 if greedy matching fails."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = count = 0
        for byte in word:
            following = edges[node].get(byte)
            while following is None:
                count += popped[node]
                node = fail[node]
                if node == -1:
                    return -1
                following = edges[node].get(byte)
            node = following
        while node != 1:
            count += popped[node]
            node = fail[node]
            if node == -1:
                return -1
        return count


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, single = [], set()
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            single.add(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i)):
            names.append(model.id_to_piece(i))
    return LongestMatch({n[1:].encode() for n in names if n.startswith(MARK)},
                        {n.encode() for n in names} | single)


def _count(path: str):
    def work(keys, bodies):
        match = automaton(path)
        t = Texts(bodies)
        starts, ends = t.spans(NOT_SPACE)
        counts = t.counts(starts)
        hashes = SpanHash(t.data).of(starts, ends)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        raw, first = t.data.tobytes(), order[new]
        lengths = np.fromiter((match.length(raw[a:b]) for a, b in
                               zip(starts[first].tolist(), ends[first].tolist())),
                              np.int64, len(first))[which]
        unknown = np.bincount(t.owners(counts)[lengths < 0], minlength=len(t))
        total = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return {"doc_id": pa.array(keys, pa.int64()), "n_words": counts, "n_unknown": unknown,
                "n_tokens": total[bounds[1:]] - total[bounds[:-1]] + unknown}
    return work


def token_counts(docs: DataFrame, path: str, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Words, unknown words and greedy word-piece tokens of every row."""
    return utf8(docs, key, text).mapInArrow(per_slice(_count(path)), SCHEMA)
