"""Text that only copies of one article have is no template; what different pages share is."""

import pytest

from tenderlens.llm import html

LAYOUTS = {"article": "<body><article>{}</article></body>",
           "plain": "<body><p>home <a href=/>of the long named news site</a></p><div>{}</div></body>"}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("tasks", [1, 4])
def test_copies_of_an_article(spark, layout, tasks):
    copy = "<p>copied</p><blockquote>words of someone</blockquote><ul><li>one</li><li>two</li></ul>" \
        "<section><b>all rights</b></section>"
    bodies = [copy] * 6 + [f"<p>other {i}</p><section><b>all rights</b></section>"
                           for i in range(6)]
    pages = spark.createDataFrame([(i, "https://a.example/", LAYOUTS[layout].format(b))
                                   for i, b in enumerate(bodies)],
                                  "page_id long, url string, html string").repartition(tasks)
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert {got[i] for i in range(6)} == {"copied words of someone one two"}
    assert [got[6 + i] for i in range(6)] == [f"other {i}" for i in range(6)]


def test_copies_alone_and_a_few_pages(spark):
    rows = [(i, "https://a.example/", "<p>same</p>") for i in range(9)]
    rows += [(10 + i, "https://b.example/", f"<p>text {i}</p><div>shared</div>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert all(got[i] == "same" for i in range(9))
    assert all(got[10 + i] == f"text {i} shared" for i in range(4))
