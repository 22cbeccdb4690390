"""Token counts of words that need the marker alone or byte pieces, against the full vocabulary."""

import re

import pytest

from tenderlens.llm import lengths
from tenderlens.llm.queries import QUERIES, tokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    return model, {model.id_to_piece(i) for i in range(model.vocab_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def greedy(word, pieces, longest):
    """Longest match over all pieces; a character without a piece counts its bytes."""
    rest, count = "▁" + word, 0
    while rest:
        size = next((n for n in range(min(longest, len(rest)), 0, -1) if rest[:n] in pieces), 0)
        count += 1 if size else len(rest[0].encode())
        rest = rest[size or 1:]
    return count


def test_numbers_cjk_and_accents(spark, vocabulary):
    model, pieces = vocabulary
    same = ["2024", "中文字符处理系统", "ß", "ç", "7", "3.14", "𓀀", "\x01", "▁▁"]
    rows = [(i, w) for i, w in enumerate(same)]
    docs = spark.createDataFrame([*rows, (100, "ñandú être 2024\n中文 straße"), (101, "")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in
           lengths.token_counts(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert [got[i].n_tokens for i, _ in rows] == [len(model.encode(w)) for w in same]
    assert (got[0].n_tokens, got[1].n_tokens) == (5, 9)
    longest = max(map(len, pieces))
    assert got[100].n_tokens == sum(greedy(w, pieces, longest) for w in
                                    "ñandú être 2024 中文 straße".split())
    assert got[101].n_tokens == 0 and all(r.n_unknown == 0 for r in got.values())


def test_all_documents(spark, vocabulary):
    pieces = vocabulary[1]
    longest, cache, want = max(map(len, pieces)), {}, []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    for d, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for w in words:
            if w not in cache:
                cache[w] = greedy(w, pieces, longest)
        want.append((d, len(words), 0, sum(cache[w] for w in words)))
    got = map(tuple, QUERIES["op8_token_counts"](spark, FOLDER).collect())
    assert sorted(got) == sorted(want)
