"""Operators without SQL against brute force, round trips and libraries; defined edge cases."""

import hashlib
import html as entities
import re

import duckdb
import pytest

import corpus_pipeline
from tenderlens.llm import (
    chat, decontaminate, html, jaccard, lengths, licenses, pieces, quality, queries, suffixes, warc)
from tenderlens.llm.queries import QUERIES, tokenizer

FOLDER = "/root/testdata/sf0.001"
EDGES = [(1, ""), (2, None), (None, "no id"), (4, "   \n\t "), (5, "same"), (5, "same"),
         (60006, "x" * 300_000), (7, "a " * 100_000), (8, "é\x00ß 😀 ▁▁ \r\n"), (9, "ends with space ")]


def rows_of(name):
    return duckdb.sql(f"select * from '{FOLDER}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return [(d, t) for d, t, *_ in rows_of("documents")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(
        [(d, t, "x", 1, 2) for d, t in EDGES],
        "doc_id long, text string, body string, shard int, node long")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- sentence pieces

def expected_pieces(rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    out = []
    for d, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        out.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)),
                    sha(model.decode(ids).encode())))
    return sorted(out, key=str)


def test_pieces_match_library(spark, texts, edges):
    got = QUERIES["op2_sentencepiece"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=str) == expected_pieces(texts)
    path = tokenizer("piece_bpe_32k.model")
    assert sorted(map(tuple, pieces.digests(edges, path).collect()), key=str) == \
        expected_pieces(EDGES)
    back = pieces.decode(pieces.encode(edges, path), path).collect()
    assert sorted((tuple(r) for r in back), key=str) == \
        sorted(((d, (t or "").replace("▁", " ")) for d, t in EDGES), key=str)


# --- main text

def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def test_main_text_of_all_pages(spark):
    got = {r.page_id: r for r in QUERIES["op3_main_text"](spark, FOLDER).collect()}
    for page_id, url, source in rows_of("pages"):
        inner = source[source.index("<article>") + 9:source.index("</article>")]
        inner = re.sub(r"<(?:/?p|/?h1|br)>", " ", inner)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert got[page_id].text == want
        assert (got[page_id].url, got[page_id].n_chars) == (url, len(want))


def test_main_text_layouts(spark):
    article = "<nav><a href='/'>home</a></nav><div class='cookie notice'>ok?</div>" \
        "<main><h1>T{0}</h1><p>one &amp; {0}<p>t<b>w</b>o<br>x<div class=ad>buy</div>" \
        "<p>Written by the team</p><form><p>name</p></form>" \
        "<section id=comments><p>first!</p></section></main><footer><p>f</p></footer>"
    plain = "<div id=sidebar>side</div><div><p>body {0} <a href=x>link</a></p></div>" \
        "<div><a href=a>more</a> <a href=b>links {0}</a></div>"
    rows = [(i, "https://a.example/x", page(article.format(i))) for i in range(6)]
    rows += [(10 + i, "http://b.example:80/", page(plain.format(i))) for i in range(2)]
    rows += [(20, None, None), (21, "c", ""), (22, "https://d.example", "no tags < at > all"),
             (None, "https://e.example", "<article>x<script>if (a<b) '</p>'</script>y</article>"),
             (23, "https://f.example", "<article><p>" + "long " * 50_000),
             (24, "https://g.example", "<p title='a>b' hidden>no</p><p>yes</p>")]
    pages = spark.createDataFrame([(*r, "h") for r in rows],
                                  "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert all(got[i] == f"T{i} one & {i} two x" for i in range(6)) or \
        all(got[i] == f"T{i} one & {i} two x Written by the team" for i in range(6))
    assert [got[10], got[11]] == ["body 0 link", "body 1 link"]
    assert (got[20], got[21], got[22], got[None]) == ("", "", "no tags < at > all", "x y")
    assert got[23] == ("long " * 50_000).strip() and got[24] == "yes"
    assert html.main_text(pages.limit(0)).count() == 0


def test_tree_matching():
    a = html.fold(html.parse("<ul><li>1</li></ul><p>x</p>"))
    b = html.fold(html.parse("<div></div><ul><li>1</li><li>2</li></ul>"))
    assert html.matching(a, b) == 4
    html.merge(a, b)
    assert [k.label for k in a.kids] == ["div", "ul", "p"]


# --- quality

def test_quality_edges(spark, edges):
    got = quality.quality(edges).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGES) and by[1].n_words == 0 and by[2].base_failed
    assert by[7].n_repeat_words == 100_000 and by[8].word_chars == 6
    kept = quality.keep_good(spark.createDataFrame(
        [(1, "One two three four five six seven eight nine ten eleven."), (2, "a | b | c | d"),
         (None, None)], "doc_id long, text string"))
    assert [tuple(r)[0] for r in kept.collect()] == [1]


# --- licences

def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_license_phrases_match_brute_force(spark, texts, edges):
    got = QUERIES["op5_licenses"](spark, FOLDER).collect()
    assert sorted((r.doc_id, *r[1:6]) for r in got) == \
        sorted((d, *brute_base(t)) for d, t in texts)
    tricky = [(1, "GNU General\nPublic-License gnu general public license apache LICENSE"),
              (2, "cc by cc by, mité license; MIT license"), (3, "apache license mit license")]
    rows = tricky + EDGES
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, *r[1:6]) for r in found.collect()), key=str) == \
        sorted(((d, *brute_base(t)) for d, t in rows), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <=
               set(r.labels.split(",")) for r in found.collect())


@pytest.mark.parametrize("line, want", [
    ("MIT", ["mit"]),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["apache-2.0+bsd-3-clause", "bsd-3-clause+mit"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT",
     ["gpl-2.0-only with classpath-exception-2.0", "mit"]),
    ("MIT and ISC or Zlib more text here", ["isc+mit", "zlib"]),
    ("(MIT OR", ["mit"]), ("", []), ("OR", []), ("MIT */ x", ["mit"]),
])
def test_license_expressions(line, want):
    assert sorted("+".join(sorted(a)) for a in licenses.expression_of(line)) == want


# --- WARC

def test_warc_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNK_CHARS", 700)
    big = "ä\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 100
    rows = [(1, "http://a/", big), (3, "http://b/\r\nX: y", big), (2, None, big), (4, "c", "small"),
            (5, "c", "small"), (6, "d", None), (7, "e", "\r\n"), (8, "f", "x" * 999 + "\r"),
            (-9, "g", "y" * 1000), (-8, "g", "y" * 1000), (None, "h", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows],
                                  "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for page_id, _, source in rows:
        data = (source or "").encode()
        assert by[page_id].payload_bytes == len(data)
        assert by[page_id].payload_digest == hashlib.sha1(data).hexdigest()
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == \
        {1: 3, 2: 3, -9: -8, None: -8}
    assert by[3].n_chunks > 1 and by[3].url == "http://b/%0D%0AX: y"
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- token counts

def test_token_counts_match_word_piece(spark, texts, edges):
    from tokenizers import models

    path = tokenizer("piece_bpe_32k.model")
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # The marker starts every word; a byte piece stands as one private character, and a character
    # without a piece is spelled by those of its bytes.
    names = {"##" + chr(0xE000 + b): b for b in range(256)}
    single = set()
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        names.setdefault(p if p[0] == "▁" else "##" + p, len(names))
        single |= {p} if len(p) == 1 else set()
    names["[UNK]"] = len(names)
    library = models.WordPiece(names, unk_token="[UNK]", continuing_subword_prefix="##",
                               max_input_chars_per_word=10 ** 6)
    cache = {}

    def count(word):
        if word not in cache:
            spelled = "".join(c if c in single else
                              "".join(chr(0xE000 + b) for b in c.encode()) for c in word)
            cache[word] = len(library.tokenize("▁" + spelled))
        return cache[word]

    for rows, df in ((texts, QUERIES["op8_token_counts"](spark, FOLDER)),
                     (EDGES, lengths.token_counts(edges, path))):
        want = [(d, sum(count(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")))
                for d, t in rows if len(t or "") < 250_000]
        got = [(r.doc_id, r.n_tokens) for r in df.collect() if r.doc_id != 60006]
        assert sorted(got, key=str) == sorted(want, key=str)


# --- chat

def test_chat_escapes_and_masks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_CHARS", 60)
    nasty = ["<|end|>", "<\\|text|>", "\\<|", "\n\n x", " ", "", "😀é<", "|", "</s>[INST]"]
    rows = [(1, i, "assistant" if i % 2 else "user", nasty[i % 9] + str(i)) for i in range(40)]
    rows += [(2, 0, None, None), (2, 1, "assistant", "<|end|>"), (3, None, "<|text|>", "a"),
             (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (None, 1, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in
           chat.format_digests(turns, tokenizer("byte_bpe_50k.json")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode())
        spoken = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(spoken), sha(spoken.encode()))
    assert all(chat.unescape(chat.escape(x)) == x and not chat._turn.search(chat.escape(x))
               for x in nasty)
    parts = chat.formatted_turns(turns, tokenizer("byte_bpe_50k.json")).collect()
    assert sum(sum(r.loss) for r in parts) == sum(r.loss_tokens for r in got.values())


# --- decontamination

def test_decontamination(spark, edges):
    item = "The quick brown fox jumps over the lazy dog, while seven wizards quietly box up " \
        "jars of liquid glue for the expedition to the far northern harbour of Jökulsárlón."
    edited = item.replace("wizards", "wizzards").replace("glue", "blue")
    broken = re.sub(r"[aeiou]", "#", item)
    rows = [(1, "before " + item + " after"), (2, "x\n" + item.upper().replace(" ", "\n  ")),
            (3, "pre " + edited + " post"), (4, broken), (5, item[:50]), (6, item[30:125]),
            (7, ""), (8, None), (None, item), (9, "w " * 50_000 + item), (10, item[:60] + item[110:])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "tiny", 0), (None, "", 0),
                                   (4, "twelve chars", 0)], "item_id long, text string, doc_id int")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in (1, 2, 3, 6, None, 9)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8, 10]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(edges, bench).count() == 0


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_alignment_everywhere(texts):
    import random

    rnd = random.Random(3)
    items = [t.encode()[:150] for _, t in rows_of("benchmark")][:6]
    index = decontaminate.Index(list(enumerate(items)))
    bodies = []
    for i in range(24):
        words = list(items[i % 6].decode(errors="ignore"))
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(words))
            words[at:at + rnd.randint(0, 1)] = rnd.choice(["", "q", "zz"])
        bodies.append(("lead " + "".join(words) + " tail").encode())
    found = {(r, w): e for r, w, e in zip(*(x.tolist() for x in index.search(bodies)))}
    for r, body in enumerate(bodies):
        data, start, end = decontaminate.normalised([body])
        text = data[start[0]:end[0]].tobytes()
        for w, window in enumerate(index.windows):
            if w % 2:
                continue
            best = edit_distance_inside(window.tobytes(), text)
            assert (best <= index.edits[w]) == ((r, w) in found)
            if (r, w) in found:
                assert found[r, w] == best


# --- repeated byte strings

def brute_gone(rows, width=suffixes.WIDTH):
    """(id, bytes, a mark for every byte that goes) of each row."""
    first = {}
    keys = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(keys):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i:i + width], d)
    for (d, _), (k, b) in zip(rows, keys):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < k:
                gone[i:i + width] = b"\1" * width
        yield d, b, gone


def brute_kept(rows):
    return {d: bytes(x for x, g in zip(b, gone) if not g) for d, b, gone in brute_gone(rows)}


def brute_removed(rows):
    return sorted(((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    sha(bytes(x for x, g in zip(b, gone) if not g)))
                   for d, b, gone in brute_gone(rows)), key=str)


def planted(texts):
    cut = texts[0][1][:200]
    rows = [(d, t) for d, t in texts[:120]] + [
        (9000, "x" * 49), (9001, "x" * 49), (9002, "y" * 50), (9003, "y" * 5000),
        (9004, cut[:50]), (9005, "é" * 80 + cut), (9006, "é" * 80 + cut), (None, cut + "!"),
        (None, cut + "!"), (9007, None), (9008, ""), (9009, "\x00" * 60), (9010, "\x00" * 70),
        (9011, cut + cut), (9011, cut + "?")]
    return rows + [(9100 + i, f"{i} intro {cut[20:150]} outro {i * 7}") for i in range(60)]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 20_000, "block": 2000},
                                   {"shard_bytes": 50_000, "hot": 4, "block": 500}])
def test_suffixes_match_brute_force(spark, texts, sizes):
    rows = planted(texts)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, rest string")
    got = sorted(map(tuple, suffixes.digests(docs, **sizes).collect()), key=str)
    assert got == brute_removed(rows)
    kept = suffixes.deduplicated(docs, **sizes)
    assert kept.columns == docs.columns
    # Ids that stand once; bytes of a character broken by a cut are dropped.
    want = {d: b for d, b in brute_kept(rows).items() if sum(d == e for e, _ in rows) == 1}
    left = {r.doc_id: r.text for r in kept.collect() if r.doc_id in want}
    assert left == {d: b.decode(errors="ignore") for d, b in want.items()}
    assert suffixes.digests(docs.limit(0)).count() == 0


# --- the pipeline

def test_pipeline_stages(spark, texts):
    import duckdb as db

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    verdict = dict(db.sql(quality.SQL.replace(
        "FROM documents", f"FROM '{FOLDER}/documents.parquet'")).project("doc_id, kept").fetchall())
    good = corpus_pipeline.good_quality(spark, docs, FOLDER)
    assert good.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(d for d, _ in rows) == sorted(d for d, k in verdict.items() if k)

    from tests.llm.test_jaccard import brute
    single = corpus_pipeline.near_duplicates(spark, good, FOLDER)
    component = {d: c for d, _, c in brute(rows, 5, 80)}
    rows2 = [(r.doc_id, r.text) for r in single.select("doc_id", "text").collect()]
    assert single.columns == docs.columns
    assert sorted(rows2) == sorted(r for r in rows if component[r[0]] == r[0])

    unique = corpus_pipeline.repeated_passages(spark, single, FOLDER)
    assert unique.columns == docs.columns
    rows3 = [(r.doc_id, r.text, r.n_chars) for r in unique.collect()]
    want = {d: (n, removed) for d, n, removed, *_ in brute_removed(rows2)}
    assert len(rows3) == len(rows2) and all(n == len(t) for _, t, n in rows3)
    # At a cut, the rest of a broken character goes as well.
    assert all(0 <= want[d][0] - want[d][1] - len(t.encode()) <= 40 for d, t, _ in rows3)

    clean = corpus_pipeline.benchmark_leaks(spark, unique, FOLDER)
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    items = [t for _, t in rows_of("benchmark")]
    squeeze = lambda t: " ".join(t.lower().split())
    assert not any(squeeze(i) in squeeze(t) for d, t, _ in rows3 if d in ids for i in items)
    out = corpus_pipeline.token_ids(spark, clean, FOLDER)
    assert sorted(map(tuple, out.collect()), key=str) == \
        expected_pieces([(d, t) for d, t, _ in rows3 if d in ids])
    assert queries.QUERIES.keys() >= {"op1_decontamination"} and jaccard.FREQUENT > 1
