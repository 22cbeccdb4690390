"""Licence expressions of any size against a brute-force evaluator."""

import itertools
import random
import re

import pytest

from tenderlens.llm import licenses


def brute(text):
    """Alternatives by trying every truth value of every operand: minimal sets that fulfil it."""
    names = sorted(set(re.findall(r"x\d+", text)))
    code = re.sub(r"x\d+", lambda m: f"v['{m[0]}']", text.replace("AND", "and").replace("OR", "or"))
    good = [frozenset(n for n, on in zip(names, bits) if on)
            for bits in itertools.product([0, 1], repeat=len(names))
            if eval(code, {"v": dict(zip(names, bits))})]
    return {a for a in good if not any(b < a for b in good)}


def test_small_expressions_match_truth_tables():
    rnd = random.Random(3)

    def make(depth):
        if depth == 0 or rnd.random() < 0.3:
            return f"x{rnd.randint(0, 5)}"
        return f"({make(depth - 1)} {rnd.choice(['AND', 'OR'])} {make(depth - 1)})"

    for _ in range(200):
        text = make(3)
        found = licenses.expression_of(text)
        minimal = {a for a in found if not any(b < a for b in found)}
        assert minimal == brute(text), text


def scanned(line):
    row = licenses.scan(f"// SPDX-License-Identifier: {line}\n".encode())
    return row[5], row[6], row[7]


@pytest.mark.parametrize("pairs", [1, 2, 6, 7, 40])
def test_score_and_kind_of_answer_do_not_depend_on_the_size(pairs):
    line = " AND ".join(f"(MIT OR X{i}-lib)" for i in range(pairs))
    labels, score, obligations = scanned(line)
    assert score == pytest.approx(1 / (1 + pairs))  # MIT and one unknown name a pair
    assert set(labels.split(",")) == {"mit", *(f"x{i}-lib" for i in range(pairs))}
    if pairs <= 6:
        assert obligations.split("|")[0] == "+".join(sorted(f"x{i}-lib" for i in range(pairs))) \
            or "mit" in obligations.split("|")
    else:
        assert obligations == "+".join(sorted(f"(mit|x{i}-lib)" for i in range(pairs)))


@pytest.mark.parametrize("line, want", [
    ("(MIT OR ISC) AND Zlib", "isc+zlib|mit+zlib"),
    ("MIT AND MIT", "mit"), ("MIT OR MIT", "mit"),
    ("(MIT OR ISC) WITH Font-exception", "isc with font-exception|mit with font-exception")])
def test_written_alternatives(line, want):
    assert scanned(line)[2] == want


def test_long_and_deep_expressions():
    many = " OR ".join(f"n{i}" for i in range(3000))
    assert scanned(many)[2].count("|") == 2999
    deep = "".join(f"a{i} AND (b{i} OR (" for i in range(1500)) + "MIT" + "))" * 1500
    labels, score, obligations = scanned(deep)
    assert score == pytest.approx(1 / 3001) and "mit" in obligations
