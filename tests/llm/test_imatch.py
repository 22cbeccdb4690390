"""I-Match fingerprints against the same in DuckDB, on edge cases and under a shuffled lookup."""

import duckdb
import pyarrow as pa
import pytest

from tenderlens.llm import imatch

WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(900)]


def text(seed, n):
    return " ".join(WORDS[(seed * 31 + i * i) % (40 + 9 * seed)] for i in range(n))


ROWS = [(i, text(i, 20 + 9 * i)) for i in range(60)] + [
    (100, None), (101, ""), (102, " \n\t.,;"), (103, "one"), (104, "ONE"), (105, "😀 é\x00ß ▁"),
    (106, "x" * 200_000), (107, "only here and " * 3), (None, text(3, 50)), (None, "another"),
    (108, text(4, 56)), (108, text(4, 56)), (108, text(4, 56)), (108, text(5, 65)),
    (109, text(59, 4000)), (109, None), (109, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, b"b", 1, "t", 2) for r in ROWS],
                                 "doc_id long, text string, body binary, row int, own string, "
                                 "copies int")


def expected(rows):
    con = duckdb.connect()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                      "text": pa.array([r[1] for r in rows], pa.string())})
    con.register("documents", table)
    return sorted(con.execute(imatch.SQL).fetchall(), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_match_sql(docs, monkeypatch):
    found = got(imatch.fingerprints(docs))
    assert found == expected(ROWS)
    monkeypatch.setattr(imatch, "MOST_BROADCAST", -1)
    assert got(imatch.fingerprints(docs)) == found


def test_equal_texts_have_equal_fingerprints(docs):
    by_text = {}
    ids = {d: t or "" for d, t in ROWS if d is not None and d < 108}
    for r in imatch.fingerprints(docs).collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in ids:
            by_text.setdefault(ids[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in by_text.values())
    assert by_text[""] != by_text[" \n\t.,;"]


def test_small_tables(docs):
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = imatch.fingerprints(docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert got(imatch.fingerprints(docs.filter("doc_id = 108"))) == \
        expected([r for r in ROWS if r[0] == 108])


def test_likeness_follows_common_terms(spark):
    """Over many texts, likeness lies near the share of lexicon terms in common."""
    base = [[f"t{(i * 37 + j * 101) % 5000}" for j in range(120)] for i in range(300)]
    rows = [(2 * i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(2 * i + 1, " ".join(w[:90] + [f"u{i}x{j}" for j in range(30)]))
             for i, w in enumerate(base)]
    found = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    near = [r.near_next for r in found.filter("doc_id % 2 = 0").collect()]
    far = [r.near_next for r in found.filter("doc_id % 2 = 1").collect()]
    assert 0.45 < sum(near) / len(near) < 0.75  # 90 of 150 terms in common
    assert sum(far) / len(far) < 0.1


def test_no_python_in_the_plan(docs):
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
