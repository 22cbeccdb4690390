"""Exact quotes of every length and start: found from the stated length on."""

import random

import duckdb

from tenderlens.llm import decontaminate
from tenderlens.llm.decontaminate import STRIDE, WINDOW, Index

FOLDER = "/root/testdata/sf0.001"
SURE = WINDOW + STRIDE - 1


def items(n):
    rows = duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()
    plain = [decontaminate.normalised([t.encode()]) for t, in rows]
    texts = [data[a[0]:b[0]].tobytes().strip() for data, a, b in plain]
    return [t for t in texts if len(t) > SURE + 40 and t.isascii()][:n]


def test_quotes_from_the_stated_length_on():
    own = items(12)
    assert len(own) == 12
    index = Index(list(enumerate(own)))
    for size in (SURE, SURE + 1, SURE + 13):
        bodies, want = [], []
        for i, text in enumerate(own):
            for start in range(len(text) - size + 1):
                bodies.append(b"zq# " + text[start:start + size] + b" #qz")
                want.append((len(bodies) - 1, i))
        row, window, edits = index.search(bodies)
        found = {(r, index.item[w]) for r, w in zip(row.tolist(), window.tolist())}
        assert found >= set(want)


def test_short_quotes_and_other_texts_are_left_alone():
    own, rnd = items(12), random.Random(1)
    index = Index(list(enumerate(own)))
    bodies = [t[s:s + 60] for t in own for s in range(0, len(t) - 60, 7)]
    bodies += [bytes(rnd.sample(t, len(t))) for t in own]
    assert not len(index.search(bodies)[0])
