"""Deeply nested and very long pages."""

import time

import pytest

from tenderlens.llm import html


def extracted(source):
    root = html.page_template(source)
    again = html.unpack(root.pack())
    return html.extract(source, again)


@pytest.mark.parametrize("depth", [10, 249, 250, 251, 252, 900, 5000])
def test_nested_elements_keep_their_text(depth):
    inner = "".join(f"<div>t{i} " for i in range(depth)) + "deep" + "</div>" * depth
    want = " ".join(f"t{i}" for i in range(depth)) + " deep"
    assert extracted(f"<body><article>{inner} end</article></body>") == want + " end"
    # Behind the last closing tag the tree is where it would be without the depth.
    nav = f"<body>{'<div>' * depth}<nav><div><p>menu</p>more</div></nav>{'</div>' * depth}" \
        "<article><p>text</p></article></body>"
    assert extracted(nav) == "text"


def test_deep_navigation_is_dropped_with_what_it_holds():
    depth = 400
    page = f"<article>{'<div>' * depth}one <nav>x<ul><li>y</li></ul>z</nav> two" \
        f"{'</div>' * depth} three</article>"
    assert extracted(page) == "one two three"


def test_deep_page_does_not_stop_the_others(spark):
    rows = [(i, "https://a.example/", f"<article><p>text {i}</p></article>") for i in range(4)]
    rows += [(9, "https://b.example/", "<div>" * 5000 + "deep"), (10, "https://a.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == {**{i: f"text {i}" for i in range(4)}, 9: "deep", 10: ""}


def test_alternating_siblings_take_little_time():
    def page(n, word):
        return "<article>" + "".join(f"<h2>{word} {i}</h2><p>{i} text</p>" for i in range(n)) \
            + "</article>"

    begun = time.time()
    root = html.page_template(page(2500, "one"))
    html.merge(root, html.page_template(page(2400, "two")))
    text = html.extract(page(2300, "three"), root)
    assert time.time() - begun < 20
    assert text == " ".join(f"three {i} {i} text" for i in range(2300))
