"""Quality rules, line first: lines that fail a rule go, documents that lose too much go with them.

Rules for a line with at least one word (a word is a run of characters other than ASCII white
space; w is their number):

- navigation: two or more of ``| > » ›``, and more than one for every five words
- punctuation: 20 words or more with less than one mark in 50 words, or ``!!`` after more than a
  quarter of the words
- boilerplate: a phrase of ``PHRASES`` in any case, or more symbols of ``# * $ % & <`` than a
  quarter of the words

A document is kept if it passes the base rules (``MIN_WORDS`` words, at most ``MAX_REPEATED``
percent of them in repeated 5-word windows) and its failed lines hold at most ``MAX_LOST`` percent
of the code points of its words. ``quality`` measures and judges, ``clean`` gives the kept documents
without their failed lines; lines without words stay. Null and empty texts have no words and are not kept. Rows are
judged one by one, so repeated rows give repeated results; a null key stays null. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tenderlens.llm.texts import (
    NOT_SPACE, SpanHash, Texts, byte_set, equal_neighbours, filter_rows, per_slice, slices,
    utf8, window_hashes)

MIN_WORDS = 10
MAX_REPEATED = 20
MAX_LOST = 30
WINDOW = 5
SYMBOLS = byte_set(b"#*$%&|<>")

# Phrases of page furniture.
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "share this", "sign up for", "subscribe to our", "terms of service",
    "terms of use",
)
_phrase = re.compile("|".join(PHRASES).encode())
_separator = re.compile("[|>]|»|›".encode())
_mark = re.compile("[.!?:;,]|。|！|？|、|，|；|：|…".encode())

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,
    n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long,
    lost_chars long"""


def line_fails(line: bytes, words: int) -> bool:
    if words == 0:
        return False
    separators = len(_separator.findall(line))
    if separators >= 2 and separators * 5 > words:
        return True
    if line.count(b"!!") * 4 > words:
        return True
    if sum(line.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<")) * 4 > words:
        return True
    if words >= 20 and len(_mark.findall(line)) * 50 < words:
        return True
    return _phrase.search(line.lower()) is not None


def _per_line(t: Texts, word_chars: np.ndarray, words: np.ndarray, starts: np.ndarray):
    """Duplicate lines, failed lines and the word characters of failed lines, for each text, and
    where the failed lines start and end."""
    breaks = np.flatnonzero(t.data == 10)
    start, end = breaks[:-1] + 1, breaks[1:]
    owner = np.searchsorted(t.start, start, "right") - 1
    first, last = np.searchsorted(starts, start), np.searchsorted(starts, end)
    used = last > first
    start, end, owner, first, last = (x[used] for x in (start, end, owner, first, last))
    order, same = equal_neighbours(SpanHash(t.data).of(start, end), owner)
    repeats = np.bincount(owner[order[1:][same]], minlength=len(t))
    raw = t.data.tobytes()
    fails = np.fromiter((line_fails(raw[a:b], n) for a, b, n in
                         zip(start.tolist(), end.tolist(), (last - first).tolist())),
                        bool, len(start))
    chars = np.concatenate([[0], np.cumsum(word_chars)])
    lost = np.bincount(owner[fails], (chars[last] - chars[first])[fails], len(t)).astype(np.int64)
    failed = np.bincount(owner[fails], minlength=len(t))
    return repeats, failed, lost, start[fails], end[fails]


def _measure(keys: list, bodies: list[bytes]) -> dict:
    return _judge(keys, bodies)[0]


def _judge(keys: list, bodies: list[bytes]) -> tuple[dict, list[bytes]]:
    """The measures of the texts and the texts without their failed lines."""
    t = Texts(bodies)
    starts, ends = t.spans(NOT_SPACE)
    counts = t.counts(starts)
    leading = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    word_chars = leading[ends] - leading[starts]
    owner = t.owners(counts)
    chars = np.bincount(owner, word_chars, len(t)).astype(np.int64)

    hashes = SpanHash(t.data).of(starts, ends)
    windows, window_owner, at = window_hashes(hashes, counts, WINDOW)
    order, same = equal_neighbours(windows, window_owner)
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts) + WINDOW, bool)
    for j in range(WINDOW):
        covered[at[twice] + j] = True
    repeated = np.bincount(owner[covered[: len(starts)]], minlength=len(t))

    duplicates, failed, lost, start, end = _per_line(t, word_chars, counts, starts)
    base_failed = (counts < MIN_WORDS) | (100 * repeated > MAX_REPEATED * counts)
    measures = {
        "doc_id": pa.array(keys, pa.int64()), "n_words": counts, "word_chars": chars,
        "n_symbols": t.per_text(SYMBOLS[t.data]), "n_dup_lines": duplicates,
        "n_repeat_words": repeated, "base_failed": base_failed,
        "kept": ~base_failed & (100 * lost <= MAX_LOST * chars),
        "n_failed_lines": failed, "lost_chars": lost,
    }
    return measures, _without(t, bodies, failed, start, end)


def _without(t: Texts, bodies: list[bytes], failed: np.ndarray, start: np.ndarray,
             end: np.ndarray) -> list[bytes]:
    """The texts without the lines at ``start`` to ``end``, ``failed`` of them in each text; each
    goes with the line feed behind it or, as the last line, with the one before what is left."""
    out, last = list(bodies), np.cumsum(failed)
    for i in np.flatnonzero(failed).tolist():
        own = slice(last[i] - failed[i], last[i])
        parts, at = [], 0
        for a, b in zip((start[own] - t.start[i]).tolist(), (end[own] - t.start[i]).tolist()):
            parts.append(bodies[i][at:a])
            at = b + 1
        if at > len(bodies[i]):
            out[i] = b"".join(parts).removesuffix(b"\n")
        else:
            out[i] = b"".join(parts) + bodies[i][at:]
    return out


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of every document; one row per input row, see the module's text."""
    return utf8(docs, key, text).mapInArrow(per_slice(_measure), SCHEMA)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose verdict is ``kept``, with their columns and texts as they are."""
    return filter_rows(docs, text, lambda bodies: _measure([None] * len(bodies), bodies)["kept"])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose verdict is ``kept``, their texts without the lines that failed; other
    columns as they are, but ``n_chars``, if there is one, follows the text."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(at).cast(pa.string()), "")
            bodies = [x.encode() for x in column.to_pylist()]
            marks, texts = [], []
            for low, high in slices(bodies):
                measures, left = _judge([None] * (high - low), bodies[low:high])
                marks.append(measures["kept"])
                texts += [x.decode() for x in left]
            if marks:
                yield batch.set_column(at, batch.schema.field(at),
                                       pa.array(texts, batch.schema.field(at).type)) \
                    .filter(pa.array(np.concatenate(marks)))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType))


_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = r"[\x20\x09-\x0D]+"


def _count(value: str, characters: str) -> str:
    return f"(length({value}) - length(regexp_replace({value}, '{characters}', '', 'g')))"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM d
), word AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words
), windows AS (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
         AS g FROM word
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows
                    WHERE len(g) = {WINDOW}) WHERE n > 1
), repeated AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) AS o(j) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), used AS (
  SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS w,
         length(regexp_replace(line, '{_SPACES}', '', 'g')) AS chars,
         {_count("line", "[|>»›]")} AS separators,
         length(line) - length(replace(line, '!!', ' ')) AS shouts,
         {_count("line", "[#*$%&<]")} AS symbols,
         {_count("line", "[.!?:;,。！？、，；：…]")} AS marks,
         regexp_matches(lower(line), '{"|".join(PHRASES)}') AS phrase
  FROM lines
), judged AS (
  SELECT r, line, chars, (separators >= 2 AND separators * 5 > w) OR shouts * 4 > w
         OR symbols * 4 > w OR (w >= 20 AND marks * 50 < w) OR phrase AS fails
  FROM used WHERE w > 0
), by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS failed,
         coalesce(sum(chars) FILTER (fails), 0) AS lost
  FROM judged GROUP BY r
), measured AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{_SPACES}', '', 'g'))
         AS word_chars, {_count("text", "[#*$%&|<>]")} AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         coalesce(failed, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_chars
  FROM d JOIN words USING (r) LEFT JOIN repeated USING (r) LEFT JOIN by_line USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
           AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept,
       CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
FROM measured
"""
