"""Spelling variants against brute force over deletions; the trie against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tenderlens.llm import spelling
from tenderlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=5):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    without = defaultdict(set)  # a word without one code point, marked, to the words
    for w in n:
        for i in range(len(w)):
            without[w[:i] + "*" + w[i + 1:]].add(w)
            without["-" + w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= without[w[:i] + "*" + w[i + 1:]]
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
        near[w] |= without["-" + w]
        near[w].discard(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_matches_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = found(QUERIES["op12_spelling"](spark, FOLDER))
    assert len(got) > 5000 and got == brute(rows)
    assert any(r[1] != r[2] for r in got if r[1] is not None)


def noisy(seed):
    """Texts of few letters, so that many words are near, with long words and chains of forms."""
    rnd = random.Random(seed)
    chain = ["abcabc" + "a" * i for i in range(5)]
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(400)]
    words += [w for i, c in enumerate(chain) for w in [c] * 6 ** i]
    words += ["x" * 60, "x" * 61, "x" * 61 + "y", "x" * 39, "x" * 40, "x" * 41, "y" + "x" * 300]
    return [(i, " ".join(rnd.choice(words) for _ in range(300)) + " ÉCOLES×÷ Straße") for i in
            range(40)]


@pytest.mark.parametrize("part", [1 << 15, 20, 3])
def test_parts_and_blocks(spark, part):
    rows = noisy(1) + [(50, None), (51, ""), (None, "nullid abcabc " * 9), (None, None),
                       (7, "repeat repeats " * 5), (7, "repeat repeats " * 5), (52, "1 2 3")]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows],
                                 "doc_id long, text string, word string, n int, part int")
    assert found(spelling.variants(docs, part=part)) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "tiny"), (2, None)], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(docs.limit(0)).count() == 0


def test_search_reaches_every_pair():
    rnd = random.Random(5)
    texts = sorted({"".join(rnd.choice("abcdeïé") for _ in range(rnd.randint(6, 9)))
                    for _ in range(3000)} | {"z" * n for n in range(30, 60)})
    words = spelling.Words(texts)
    got = {(texts[i], texts[j]) for q, w in spelling.search(words, words)
           for i, j in zip(q.tolist(), w.tolist())}
    assert len(texts) > 2000 and got == {(a, b) for a in texts for b in texts
                   if abs(len(a) - len(b)) < 2 and spelling.one_edit(a, b)}


@pytest.mark.parametrize("a, b, want", [
    ("abcdef", "abcdef", False), ("abcdef", "abxdef", True), ("abcdef", "abdef", True),
    ("abcdef", "bacdef", False), ("abcdef", "abcdefgh", False), ("aaaaaa", "aaaaaaa", True),
    ("abcdef", "xabcdef", True), ("abcdef", "abcdeg", True), ("abcdef", "bcdefg", False)])
def test_one_edit(a, b, want):
    assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == want
    x, y = spelling.Words([a]), spelling.Words([b])
    one = np.zeros(1, np.int64)
    assert spelling.verified(x, one, y, one).tolist() == [want]
    assert spelling.verified(y, one, x, one).tolist() == [want]
