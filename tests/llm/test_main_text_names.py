"""Names of furniture that are part of a longer class, or stand on what holds the article."""

import pytest

from tenderlens.llm import html

ARTICLES = {
    "body": "<body class='home no-sidebar'><div><p>text {0}</p></div></body>",
    "whole": "<body class='sidebar'><main class=header><p>text {0}</p></main></body>",
    "article": "<body class='has-header'><article class='post comments-open'><p>text {0}</p>"
               "</article></body>",
    "div": "<body><div id=content class='content with-sidebar'><p>text {0}</p></div></body>",
    "ancestor": "<body><div class=widget><div class=banner>buy {0}</div><article><p>text {0}</p>"
                "</article></div></body>",
    "comments": "<body><article class=post><p>text {0}</p></article><div id=comments>"
                "<article class=comment-body><p>first {0}</p></article></div></body>",
    "only": "<body><div class=related><article class='post social'><p>text {0}</p></article></div>"
            "</body>",
    "class": "<body><div class='page hidden'>no {0}</div><div hidden>no {0}</div>"
             "<div class='ad big'>no {0}</div><div><p>text {0}</p></div></body>",
}


@pytest.mark.parametrize("pages_of_host", [1, 7])
def test_names_do_not_empty_a_page(spark, pages_of_host):
    rows = [(f"{name}-{i}", f"https://{name}.example/{i}",
             f"<!DOCTYPE html><html>{body.format(i)}</html>")
            for name, body in ARTICLES.items() for i in range(pages_of_host)]
    pages = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert {r[0]: got[n] for n, r in enumerate(rows)} == \
        {r[0]: f"text {r[0].rsplit('-', 1)[1]}" for r in rows}


def test_a_name_that_drops_on_one_page_only(spark):
    """The same element holds the article on one page and an advertisement on others."""
    bodies = ["<div class=promo><main><p>long read</p></main></div>"] + \
        [f"<div class=promo><p>buy {i}</p></div><main><p>text {i}</p></main>" for i in range(6)]
    pages = spark.createDataFrame([(i, "https://a.example/", f"<body>{b}</body>")
                                   for i, b in enumerate(bodies)],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == {0: "long read", **{i + 1: f"text {i}" for i in range(6)}}
