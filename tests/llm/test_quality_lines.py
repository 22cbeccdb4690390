"""Lines that fail are gone from the documents that are kept."""

import duckdb

import corpus_pipeline
from tenderlens.llm import quality

FOLDER = "/root/testdata/sf0.001"
GOOD = "One two three four five six seven eight nine ten, eleven and some more words to go on."


def expected(text):
    lines = text.split("\n")
    left = [x for x in lines if not quality.line_fails(
        x.encode(), len([w for w in x.translate(dict.fromkeys(b"\t\v\f\r", " ")).split(" ") if w]))]
    return "\n".join(left)


def test_failed_lines_are_removed(spark):
    nav, rights = "Home | News | Contact", "All rights reserved."
    texts = [GOOD, f"{nav}\n{GOOD}\n{GOOD[::-1]}", f"{GOOD}\n{GOOD[::-1]}\n{rights}",
             f"{nav}\n\n{GOOD} é中\r\n{rights}\n \n{GOOD[::-1]}\n", f"{GOOD}\n{GOOD[::-1]}\n{rights}\n",
             nav, "", None, f"{nav}\n{nav}\n{GOOD}"]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert quality.clean(docs).schema == docs.schema
    assert got.keys() == {r.doc_id for r in quality.keep_good(docs).collect()} >= {0, 1, 2, 3, 4}
    assert (got[0].text, got[1].text) == (GOOD, f"{GOOD}\n{GOOD[::-1]}")
    assert (got[2].text, got[4].text) == (f"{GOOD}\n{GOOD[::-1]}", f"{GOOD}\n{GOOD[::-1]}\n")
    assert all(r.text == expected(texts[i]) and r.n_chars == len(r.text) and r.lang == "x"
               for i, r in got.items())
    assert quality.quality(quality.clean(docs)).filter("n_failed_lines > 0").count() == 0


def test_pipeline_passes_cleaned_texts_on(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    footer = "\nAll rights reserved."
    docs = docs.withColumn("text", corpus_pipeline.F.concat("text", corpus_pipeline.F.lit(footer)))
    source = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = corpus_pipeline.good_quality(spark, docs, FOLDER).collect()
    kept = duckdb.sql(quality.SQL.replace(
        "FROM documents", f"FROM (SELECT doc_id, text || '{footer}' AS text FROM "
                          f"'{FOLDER}/documents.parquet')")).filter("kept").project("doc_id")
    assert sorted(r.doc_id for r in out) == sorted(d for d, in kept.fetchall()) and out
    assert all(r.text == expected(source[r.doc_id]) and r.n_chars == len(r.text) for r in out)
    assert not any(footer in r.text for r in out)
