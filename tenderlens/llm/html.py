"""Main text of web pages by wrapper induction.

Each page is parsed to a tree of blocks and text runs. Siblings with the same label that follow
each other are folded into one node, so a template does not grow with the length of its pages.
The folded trees of all pages of a host are aligned by simple tree matching into one template,
first within a task, then across tasks (one template per task and host is shuffled, so a host with
a third of all pages is no hot group). A template node knows on how many pages it stands, whether
its text was the same on all of them, up to ``MIN_PAGES`` different hashes of these pages' other
text, and how much of its text stands in links.

Reading a page, its tree is aligned with its host's template; a text run is content if its slot

- does not lie under an element that is never content (``DROPPED`` tags, a whole class, id or role
  in ``FURNITURE``, hidden elements); html, body, main, article and what holds one of them are never
  dropped by such a name (an article whose own names tell of furniture, such as one comment, saves
  what holds it only on a page that would have no article else),
- lies in the article (or main) element, if the page has one,
- does not stand mostly in links, outside an article,
- is no template text: the same on at least ``MIN_PAGES`` pages of which no two have the same other
  text, so copies of one article count as one page.

A page whose html is null, empty or without content gives an empty text; one without url belongs
to the host "". Repeated rows give repeated results; null keys stay null; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.texts import bounded_batches
from tenderlens.sources.staging import stage

MIN_PAGES = 5
MOST_LINKED = 0.5
#: Elements nested deeper stand beside each other at this depth, as browsers do at some depth; what
#: lies in a dropped one stays dropped, and no text is lost or moved.
DEEPEST = 250

# Elements of HTML by their part in the page.
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "nav",
    "header", "footer", "aside", "form", "button", "select", "textarea", "input", "dialog", "menu",
}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ARTICLE = {"article", "main"}
#: Elements that no name drops.
KEPT = ARTICLE | {"html", "body"}
#: An element that opens ends one of these that is open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote",
              "nav", "aside", "header", "footer", "form"}
# Names in class, id and role of parts that are not the article.
FURNITURE = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "gdpr",
    "header", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}

_tag = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_names = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_hidden = re.compile(r"""(?i)(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|"""
                     r"""style\s*=\s*["'][^"']*display\s*:\s*none)""")
_word = re.compile(r"[a-z]+")


class Node:
    """An element or, with the label ``#``, a run of text; also a node of a template."""

    __slots__ = ("label", "kids", "dropped", "named", "text", "pages", "value", "others", "chars",
                 "linked", "into")

    def __init__(self, label: str, dropped: bool = False, text: str = ""):
        self.label, self.dropped, self.named, self.text = label, dropped, False, text
        self.kids: list[Node] = []
        self.pages, self.value, self.chars, self.linked = 1, None, 0, 0
        self.others: list[int] = []
        self.into: Node | None = None

    def slot(self) -> Node:
        node = self
        while node.into is not None:
            node = node.into
        return node

    def pack(self) -> list:
        return [self.label, int(self.dropped), self.pages, self.value, self.chars, self.linked,
                self.others, [k.pack() for k in self.kids]]


def unpack(packed: list) -> Node:
    node = Node(packed[0], bool(packed[1]))
    node.pages, node.value, node.chars, node.linked, node.others = packed[2:7]
    node.kids = [unpack(k) for k in packed[7]]
    return node


def parse(html: str) -> Node:
    """The tree of blocks; inline elements vanish but for the share of text in links."""
    root = Node("page")
    stack, runs, linked = [root], [], [0, 0]
    link = 0

    def holder():
        return stack[min(len(stack) - 1, DEEPEST)]

    def close_run():
        text = " ".join("".join(runs).split())
        runs.clear()
        if text:
            node = Node("#", text=text)
            node.chars, node.linked = len(text), min(linked[0], len(text))
            node.value = xxhash.xxh64_intdigest(text.encode(errors="replace")) >> 1
            # Beyond the depth a run lies beside the element it stands in, unless that is dropped.
            (stack[-1] if stack[-1].dropped else holder()).kids.append(node)
        linked[0] = 0

    def add(text):
        if text:
            text = unescape(text)
            runs.append(text)
            if link:
                linked[0] += len(text)

    at, size = 0, len(html)
    while at < size:
        match = _tag.search(html, at)
        if match is None:
            add(html[at:])
            break
        add(html[at:match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name, attributes = name.lower(), match[3]
        if match[1]:
            if name == "a":
                link = 0
            if name in INLINE and not any(n.label.startswith(name + ".") for n in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].label.split(".", 1)[0] == name:
                    close_run()
                    del stack[depth:]
                    link = 0
                    break
            continue
        names, tokens, hidden = [], [], False
        if attributes:
            tokens = [t for m in _names.finditer(attributes)
                      for t in (m[2] or m[3] or m[4] or "").lower().split()]
            names = [n for t in tokens for n in _word.findall(t)]
            hidden = _hidden.search(_names.sub(" ", attributes)) is not None
        named = name not in KEPT and not FURNITURE.isdisjoint(tokens)
        furniture = named or hidden
        if name in RAW:
            end = re.compile(rf"(?i)</{re.escape(name)}[\s/>]").search(html, at)
            at = end.start() if end else size
            close_run()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                runs.append(" ")
            continue
        if name in INLINE and not furniture:
            if name == "a":
                link = 1
            continue
        close_run()
        link = 0
        if name not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                open_name = stack[depth].label.split(".", 1)[0]
                if open_name == "p" or open_name in ENDS.get(name, ()):
                    del stack[depth:]
                    break
                if open_name in CONTAINERS:
                    break
        label = f"{name}.{'-'.join(names) or 'hidden'}" if names or furniture else name
        node = Node(label, furniture or name in DROPPED)
        node.named = named and not hidden and name not in DROPPED
        if len(stack) > DEEPEST and stack[-1].dropped:
            node.dropped, node.named = True, stack[-1].named
        holder().kids.append(node)
        stack.append(node)
    close_run()
    _spare(root, False)
    if not _has_article(root):
        _spare(root, True)
    _mark_dropped(root)
    return root


def _spare(node: Node, any_article: bool) -> bool:
    """Keeps what was dropped by name but holds a part of the page that is not; whether the node
    holds an article or main element. Articles with names of furniture count on demand only."""
    name, _, names = node.label.partition(".")
    holds = name in KEPT and (any_article or name != "article"
                              or FURNITURE.isdisjoint(names.split("-")))
    if node.dropped and not node.named:
        return False
    for kid in node.kids:
        holds = _spare(kid, any_article) or holds
    if holds:
        node.dropped = False
    return holds


def _has_article(node: Node) -> bool:
    return not node.dropped and (node.label.split(".", 1)[0] in ARTICLE
                                 or any(map(_has_article, node.kids)))


def _mark_dropped(node: Node) -> None:
    """A node that is dropped is never aligned with one that is not."""
    if node.dropped:
        node.label += "!" if "." in node.label else ".!"
    for kid in node.kids:
        _mark_dropped(kid)


def matching(a: Node, b: Node) -> int:
    """Size of the largest simple tree matching of two trees."""
    if a.label != b.label:
        return 0
    return _table(a.kids, b.kids)[-1][-1] + 1


def _table(left: list[Node], right: list[Node]) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for j, y in enumerate(right):
            best = max(above[j + 1], row[j])
            if x.label == y.label:
                best = max(best, above[j] + matching(x, y))
            row.append(best)
        rows.append(row)
    return rows


def _pairs(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """Index pairs of aligned children, in order. Equal labels at both ends are aligned first, the
    rest by the matching, so long lists that differ in few places cost little."""
    shorter, head, tail = min(len(left), len(right)), 0, 0
    while head < shorter and left[head].label == right[head].label:
        head += 1
    while tail < shorter - head and left[-1 - tail].label == right[-1 - tail].label:
        tail += 1
    ends = [(i, i) for i in range(head)]
    ends += [(len(left) - k, len(right) - k) for k in range(tail, 0, -1)]
    if head + tail == shorter:
        return ends
    middle = _middle(left[head:len(left) - tail], right[head:len(right) - tail])
    return ends[:head] + [(head + i, head + j) for i, j in middle] + ends[head:]


def _middle(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    rows, i, j, out = _table(left, right), len(left), len(right), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: Node, b: Node, one_page: bool = False, grow: bool = True) -> None:
    """Align b with a and add it to a. With ``one_page`` both are parts of the same page; without
    ``grow`` a stays as it is and b's nodes only learn their slots."""
    b.into = a
    if grow:
        a.chars += b.chars
        a.linked += b.linked
        if one_page:
            if a.value is not None and b.value is not None:
                a.value = (a.value * 1000003 + b.value) & (2 ** 62 - 1)
        else:
            a.pages += b.pages
            if a.value != b.value:
                a.value, a.others = None, []
            elif a.value is not None and len(a.others) < MIN_PAGES and a.others != b.others:
                a.others = sorted({*a.others, *b.others})[:MIN_PAGES]
    pairs = _pairs(a.kids, b.kids)
    placed = {j: i for i, j in pairs}
    for i, j in pairs:
        merge(a.kids[i], b.kids[j], one_page, grow)
    if grow and len(placed) < len(b.kids):
        kids, taken = [], 0
        for j, kid in enumerate(b.kids):
            if j in placed:
                kids += a.kids[taken:placed[j] + 1]
                taken = placed[j] + 1
            else:
                kids.append(kid)
        a.kids = kids + a.kids[taken:]


def fold(node: Node) -> Node:
    """A template of one page: runs of siblings with the same label become one node."""
    out = Node(node.label, node.dropped)
    out.value, out.chars, out.linked = node.value, node.chars, node.linked
    node.into = out
    for kid in node.kids:
        folded = fold(kid)
        if out.kids and out.kids[-1].label == folded.label:
            merge(out.kids[-1], folded, one_page=True)
        else:
            out.kids.append(folded)
    return out


def page_template(html: str) -> Node:
    """A template of one page whose text nodes know the hash of the page's other text: that of its
    article or else all that may be content."""
    root = fold(parse(html))
    found = _candidates(root)
    inside = any(within for _, within in found)
    counted = {id(n): n.value for n, within in found if within or not inside}
    total = sum(counted.values())
    for node, _ in found:
        node.others = [(total - counted.get(id(node), 0)) & (2 ** 62 - 1)]
    return root


def _candidates(root: Node) -> list[tuple[Node, bool]]:
    """Text nodes that are not dropped and, outside an article, not mostly links; whether they lie
    in an article."""
    found: list[tuple[Node, bool]] = []

    def walk(node, inside):
        if node.dropped:
            return
        inside = inside or node.label.split(".", 1)[0] in ARTICLE
        if node.label == "#" and (inside or node.linked <= MOST_LINKED * node.chars):
            found.append((node, inside))
        for kid in node.kids:
            walk(kid, inside)

    walk(root, False)
    return found


def content_slots(template: Node) -> set[int]:
    """Ids of the template's text nodes that hold content."""
    found = _candidates(template)
    if any(inside for _, inside in found):
        found = [(n, inside) for n, inside in found if inside]
    return {id(n) for n, _ in found if n.value is None or len(n.others) < MIN_PAGES}


def content(page: Node, template: Node, slots: set[int]) -> str:
    """Text of a page whose tree has been aligned with its template."""
    out = []

    def walk(node, inside):
        if node.dropped:
            return
        if node.label == "#":
            slot = node.slot()
            # A run that found no place in the template is judged by where it stands.
            if id(slot) in slots or slot.pages == 0 and inside:
                out.append(node.text)
            return
        inside = inside or node.label.split(".", 1)[0] in ARTICLE
        for kid in node.kids:
            walk(kid, inside)

    walk(page, False)
    return " ".join(out)


def extract(html: str, template: Node) -> str:
    page = parse(html)
    folded = fold(page)
    _mark_new(folded)
    merge(template, folded, grow=False)
    return content(page, template, content_slots(template))


def _mark_new(node: Node) -> None:
    node.pages = 0
    for kid in node.kids:
        _mark_new(kid)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?"
                                                    r"([^/?#:]*)", 1), F.lit("")))


def _induce(batches):
    """One template for each host of a task."""
    found: dict[str, Node] = {}
    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = page_template(html)
            if host in found:
                merge(found[host], page)
            else:
                found[host] = page
    hosts = sorted(found)
    yield pa.RecordBatch.from_pydict({
        "host": pa.array(hosts, pa.string()),
        "template": pa.array([json.dumps(found[h].pack()) for h in hosts], pa.string())})


def _combine(table: pa.Table) -> pa.Table:
    packed = sorted(table.column("template").to_pylist())
    root = unpack(json.loads(packed[0]))
    for other in packed[1:]:
        merge(root, unpack(json.loads(other)))
    return pa.table({"host": [table.column("host")[0].as_py()],
                     "template": [json.dumps(root.pack())]})


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and template (JSON) of every host."""
    kind = "host string, template string"
    return (pages.select(_host(F.col(f"`{url}`")).alias("host"),
                         F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
            .mapInArrow(_induce, kind).groupBy("host").applyInArrow(_combine, kind))


def _extract(batches):
    known: dict[str, tuple[Node, set[int]]] = {}
    for batch in batches:
        keys, urls, bodies, packed = (batch.column(i) for i in range(4))
        out = []
        for html, template in zip(bodies.to_pylist(), packed.to_pylist()):
            if template not in known:
                if len(known) > 1000:
                    known.clear()
                root = unpack(json.loads(template))
                known[template] = root, content_slots(root)
            root, slots = known[template]
            page = parse(html)
            folded = fold(page)
            _mark_new(folded)
            merge(root, folded, grow=False)
            out.append(content(page, root, slots))
        yield pa.RecordBatch.from_pydict({
            "page_id": keys, "url": urls, "text": pa.array(out, pa.string()),
            "n_chars": pa.array(map(len, out), pa.int64())})


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url",
              html: str = "html") -> DataFrame:
    """Main text of every row. Templates are written to the shared folder, so their size is known
    when the planner chooses between broadcasting them and shuffling the pages by host."""
    bounded_batches(pages.sparkSession)
    found = stage(templates(pages, url, html), "templates")
    page = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"),
                        F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("body"),
                        _host(F.col(f"`{url}`")).alias("host"))
    return page.join(found, "host").select("page_id", "url", "body", "template") \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
