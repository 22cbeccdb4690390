"""Components against brute force on texts with planted copies, for several layouts."""

import random

import pytest

from tenderlens.llm import jaccard


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
        grams = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)] if least[find(i)] is not None else d)
                   for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=12, size=9):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    rows = [(None, "nul key"), (900, None), (901, ""), (902, " \n\t"), (903, "Two words"),
            (904, "two  WORDS"), (905, "nul key"), (905, "same id again, other text")]
    i = 0
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.choice([6, 30, 80, 200, 500]))
        for _ in range(rnd.randint(1, size)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 30))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            text = " ".join(words)
            if rnd.random() < .3:
                text += " " + passage
            rows.append((i, text if rnd.random() < .8 else text.upper()))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent, options", [
    (4, 85, {}),
    (5, 80, {"shard_bytes": 4000, "frequent": 3}),
    (4, 85, {"shard_bytes": 4000, "frequent": 2, "hot": 3, "block_docs": 7}),
    (3, 60, {"shard_bytes": 9000, "frequent": 5}),
])
def test_components_match_brute_force(spark, width, percent, options):
    rows = corpus(width * 7 + len(options))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.similar(docs, width, percent, **options).collect()]
    assert sorted(got, key=str) == brute(rows, width, percent)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y")],
        "doc_id long, text string, node long, tokens string")
    assert [tuple(r) for r in jaccard.similar(docs, 4, 85).orderBy("doc_id").collect()] == \
        [(1, 2, 1), (2, 2, 1)]
    assert jaccard.similar(docs.limit(0), 4, 85).count() == 0
