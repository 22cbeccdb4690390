"""I-Match fingerprints that survive edits: hashes of several randomised lexicon subsets.

A term is a run of ASCII letters and digits and of all characters beyond ASCII, in lower case. The
lexicon holds the terms whose inverse document frequency ln(documents / documents with the term)
lies from ``LEAST_IDF`` to ``MOST_IDF``; it is counted over all rows, copies included. A term's
number, 60 bits of its MD5, puts it into one of ``SUBSETS`` << level equal lexicon subsets drawn at
random, of which the first ``SUBSETS`` are hashed: for each that holds terms of the document, its
distinct terms are sorted and hashed to 16 bits. The level follows the document's own number of
distinct terms, so that about one of them falls into a subset, and the next level is hashed as well,
so that texts of nearly equal size have a level in common. Likeness is the share of equal hashes
among the subsets that either text has terms in, at the finer level of the two texts; it estimates
the share of lexicon terms in common, at any length. Texts two levels apart are not alike (0).

Everything is DataFrame work on JVM functions. Terms are looked up in the lexicon by a broadcast
only where its counted size allows; it has at most e^MOST_IDF terms for every distinct term of an
average document, whatever the corpus holds. Otherwise by a shuffle.

Null texts are empty. A text without a term in the band is hashed by all its drawn terms, and one
without any term by its bytes; such a text is like equal ones only. Equal texts have equal
fingerprints. Documents follow each other by id, null ids last, different texts of one id in an
order of their digests; equal rows are kept as one with a count and follow each other. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.sources.staging import stage

LEAST_IDF, MOST_IDF = 2, 7
SUBSETS = 64
# Lexicon entries (a number and a flag each) that a broadcast may hold: some 100 MB.
MOST_BROADCAST = 1 << 21

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# --- terms

def distinct_terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def number(term: Column) -> Column:
    """60 bits of a term's MD5."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long")


def lexicon(texts: DataFrame) -> tuple[DataFrame, int]:
    """Numbers of the terms in the band, as a written table, and how many there are.

    ``texts`` has one row per document with its text as ``body``.
    """
    documents = texts.count()
    idf = F.log(F.lit(float(max(documents, 1))) / F.col("n"))
    found = stage(texts.select(F.explode(distinct_terms("body")).alias("term"))
                  .groupBy("term").agg(F.count("*").alias("n"))
                  .filter((idf >= LEAST_IDF) & (idf <= MOST_IDF))
                  .select(number(F.col("term")).alias("id")).distinct(), "lexicon")
    return found, found.count()


def level(terms: str) -> Column:
    """The least level at which a subset gets at most one of so many distinct terms on average."""
    return F.expr(f"if({terms} <= {SUBSETS}, 0, "
                  f"length(bin(({terms} - 1) div {SUBSETS})))").cast("int")


def drawn(df: DataFrame, side: str) -> DataFrame:
    """Adds ``<side>_level`` and ``<side>_ids``, the numbers of the distinct terms of the text
    ``<side>`` that fall into hashed subsets; drops the text and keeps its digest."""
    terms, at, ids = f"{side}_terms", f"{side}_level", f"{side}_ids"
    return (df.withColumn(terms, distinct_terms(side))
            .withColumn(at, level(f"size({terms})"))
            .withColumn(ids, F.transform(terms, number))
            .withColumn(ids, F.expr(
                f"filter({ids}, t -> t % shiftleft({SUBSETS}L, {at}) < {SUBSETS})"))
            .withColumn(f"{side}_sha256", F.sha2(F.col(side).cast("binary"), 256))
            .drop(terms, side))


# --- fingerprints

def hashes(ids: str, at: str) -> Column:
    """Two hex digits of subset and four of the hash of its sorted terms, by subset."""
    subset = f"t % shiftleft({SUBSETS}L, {at})"
    return F.expr(f"""transform(
        array_sort(array_distinct(transform(filter({ids}, t -> {subset} < {SUBSETS}),
                                            t -> {subset}))),
        s -> concat(lpad(lower(hex(s)), 2, '0'), substr(md5(cast(array_join(transform(
            array_sort(filter({ids}, t -> {subset} = s)), t -> cast(t as string)), ',')
            as binary)), 1, 4)))""")


def with_fingerprint(df: DataFrame, side: str) -> DataFrame:
    """Adds ``<side>_print``: level, hashes at it and at the next, or a digest of the text."""
    at, ids = f"{side}_level", f"{side}_ids"
    coarse, fine = hashes(ids, at), hashes(ids, f"({at} + 1)")
    text = F.concat(F.lit("-"), F.substring(f"{side}_sha256", 1, 16))
    marks = F.concat(F.col(at).cast("string"), F.lit(":"), F.array_join(coarse, ""),
                     F.lit("/"), F.array_join(fine, ""))
    return df.withColumn(f"{side}_print", F.when(F.size(ids) == 0, text).otherwise(marks))


def likeness(one: str, other: str) -> Column:
    """Likeness of two fingerprints, from 0 to 1."""
    def at(mark):
        return f"cast(split_part({mark}, ':', 1) as int)"

    def part(mark, other_mark):
        chosen = f"if({at(mark)} < {at(other_mark)}, 2, 1)"
        marks = f"split_part(split_part({mark}, ':', 2), '/', {chosen})"
        return f"regexp_extract_all({marks}, '.{{6}}', 0)"

    a, b = part(one, other), part(other, one)
    subsets = " , ".join(f"transform({x}, e -> left(e, 2))" for x in (a, b))
    return F.expr(f"""cast(case when {one} = {other} then 1
        when {one} like '-%' or {other} like '-%' then 0
        when abs({at(one)} - {at(other)}) > 1 then 0
        else coalesce(size(array_intersect({a}, {b})) / nullif(size(array_union({subsets})), 0), 0)
        end as double)""")


def fingerprinted(df: DataFrame, sides: list[str], key: list[str], words: DataFrame,
                  broadcast: bool) -> DataFrame:
    """``df`` with ``<side>_ids`` cut down to the lexicon and a fingerprint for each side.

    ``key`` names rows uniquely. Where ``df`` is partitioned by a column of it, only the lexicon
    moves.
    """
    for side in sides:
        df = drawn(df, side)
    lists = [f"{side}_ids" for side in sides]
    rest = [c for c in df.columns if c not in key and c not in lists]
    # The rest of a row travels with one of its terms.
    items = ", ".join(f"transform({ids}, t -> struct({i} as side, t as id, cast(null as "
                      f"{_struct(df, rest)}) as rest))" for i, ids in enumerate(lists))
    first = f"array(struct(-1 as side, -1L as id, struct({', '.join(rest)}) as rest))"
    terms = df.select(*key, F.explode(F.expr(f"concat({first}, {items})")).alias("item")) \
        .select(*key, "item.*")
    known = words.withColumn("known", F.lit(True))
    terms = terms.join(F.broadcast(known) if broadcast else known, "id", "left")
    out = terms.groupBy(*key).agg(
        F.collect_list(F.when(F.col("side") >= 0, F.struct("side", "known", "id"))).alias("items"),
        F.first("rest", ignorenulls=True).alias("rest")).select(*key, "rest.*", "items")
    for i, side in enumerate(sides):
        every, band = (f"transform(filter(items, x -> x.side = {i}{more}), x -> x.id)"
                       for more in ("", " and x.known"))
        out = out.withColumn(lists[i], F.expr(f"if(size({band}) > 0, {band}, {every})"))
    out = out.drop("items")
    for side in sides:
        out = with_fingerprint(out, side)
    return out.drop(*lists, *(f"{side}_level" for side in sides))


def _struct(df: DataFrame, columns: list[str]) -> str:
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


# --- documents in a ring, each followed by the next

def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, text, and a digest of both that stands for equal rows."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    return rows.withColumn("row", F.unhex(F.sha2(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "body")
        .cast("binary"), 256)))


def ring(rows: DataFrame) -> DataFrame:
    """One narrow row per different row, with the digest of the next and that of the one before.

    Ranges are sorted on their own and written with running numbers; only their ends, one row per
    range, are looked at together.
    """
    keys = stage(rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.char_length("body")).cast("long")
        .alias("n_chars"), F.count("*").alias("copies")), "rows")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at")), "order")
    ends = placed.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("at"))
    ranges = Window.orderBy("part")
    ends = ends.select("at", F.coalesce(
        F.lead("first").over(ranges), F.first("first").over(ranges)).alias("jump"))
    nexts = placed.join(F.broadcast(ends), "at", "left").select(
        "row", "doc_id", "n_chars", "copies", F.coalesce("jump", F.col("at") + 1).alias("at"))
    linked = stage(nexts.join(placed.select("at", F.col("row").alias("next_row")), "at")
                   .drop("at"), "ring")
    before = linked.select(F.col("next_row").alias("row"), F.col("row").alias("row_before"),
                           F.expr("n_chars div 4").alias("asked"))
    return stage(linked.join(before, "row"), "ring")


def edited(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(row, copy, times, doc_id, n_chars, next_row, own, edited) for every different row.

    The text of a row is shuffled once, to its digest; from there the start that the row before
    asks for travels. Of repeated rows all but the last are followed by themselves (``copy`` 1).
    """
    texts = rows.groupBy("row").agg(F.first("body").alias("body")).join(links, "row")
    starts = texts.select(F.col("row_before").alias("row"),
                          F.expr("substring(body, 1, int(asked))").alias("start"))
    both = texts.drop("row_before", "asked").join(starts, "row")
    keep = "substring(body, 1, int(n_chars - n_chars div 4))"
    last = f"struct(0 as copy, 1L as times, next_row, concat({keep}, start) as edited)"
    more = (f"struct(1 as copy, copies - 1 as times, row as next_row, "
            f"concat({keep}, substring(body, 1, int(n_chars div 4))) as edited)")
    return both.select("row", "doc_id", "n_chars", F.col("body").alias("own"), F.explode(F.expr(
        f"if(copies > 1, array({last}, {more}), array({last}))")).alias("x")) \
        .select("row", "x.copy", "x.times", "doc_id", "n_chars", "x.next_row", "own", "x.edited")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likeness to it and to the next
    document's."""
    rows = rows_of(docs, key, text)
    words, size = lexicon(rows)
    marked = fingerprinted(edited(rows, ring(rows)), ["own", "edited"], ["row", "copy"], words,
                           size <= MOST_BROADCAST)
    marked = stage(marked.select(
        "row", "copy", "times", "next_row", "doc_id", "n_chars", "edited_sha256",
        F.col("own_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness("own_print", "edited_print").alias("near_edited")), "fingerprints")
    following = marked.filter("copy = 0").select(
        F.col("row").alias("next_row"), F.col("fingerprint").alias("next_print"))
    out = marked.join(following, "next_row").withColumn(
        "near_next", likeness("fingerprint", "next_print"))
    return out.withColumn("_", F.explode(F.expr("sequence(1L, times)"))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next")


#: The same rows in DuckDB, over ``documents``.
SQL = f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS body,
        sha256(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS row
    FROM documents),
ring AS (
    SELECT *, length(body) AS n,
        coalesce(lead(body) OVER byid, first_value(body) OVER byid) AS next
    FROM docs WINDOW byid AS (ORDER BY doc_id NULLS LAST, row
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
both_texts AS (
    SELECT *, substr(body, 1, n - n // 4) || substr(next, 1, n // 4) AS edited FROM ring),
words AS (
    SELECT w, count(*) AS c FROM (
        SELECT unnest(list_distinct(regexp_extract_all(lower(body), '{TERM}'))) AS w FROM docs)
    GROUP BY w),
lexicon AS (
    SELECT DISTINCT ('0x' || substr(md5(w), 1, 15))::BIGINT AS id FROM words
    WHERE ln((SELECT greatest(count(*), 1) FROM docs) / c) BETWEEN {LEAST_IDF} AND {MOST_IDF}),
texts AS (
    SELECT DISTINCT body AS t FROM docs UNION SELECT edited FROM both_texts),
sized AS (
    SELECT t, list_distinct(regexp_extract_all(lower(t), '{TERM}')) AS terms FROM texts),
leveled AS (
    SELECT t, terms, CASE WHEN len(terms) <= {SUBSETS} THEN 0
        ELSE length(bin((len(terms) - 1) // {SUBSETS})) END AS level FROM sized),
ids AS (
    SELECT t, level, unnest([('0x' || substr(md5(w), 1, 15))::BIGINT FOR w IN terms]) AS id
    FROM leveled),
hit AS (
    SELECT t, level, id, id IN (SELECT id FROM lexicon) AS known FROM ids
    WHERE id % ({SUBSETS} * (1 << level)) < {SUBSETS}),
banded AS (
    SELECT t, level, id FROM hit
    QUALIFY known OR NOT bool_or(known) OVER (PARTITION BY t)),
subsets AS (
    SELECT t, level, step, id % ({SUBSETS} * (1 << (level + step))) AS s,
        substr(md5(string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 4) AS h
    FROM banded, (SELECT unnest([0, 1]) AS step)
    WHERE id % ({SUBSETS} * (1 << (level + step))) < {SUBSETS} GROUP BY ALL),
marks AS (
    SELECT t, any_value(level) AS level,
        coalesce(list(lower(printf('%02x', s)) || h ORDER BY s) FILTER (step = 0), []) AS coarse,
        coalesce(list(lower(printf('%02x', s)) || h ORDER BY s) FILTER (step = 1), []) AS fine
    FROM subsets GROUP BY t),
prints AS (
    SELECT texts.t, level, coarse, fine,
        CASE WHEN level IS NULL THEN '-' || substr(sha256(texts.t), 1, 16)
            ELSE level || ':' || array_to_string(coarse, '') || '/' || array_to_string(fine, '')
        END AS mark
    FROM texts LEFT JOIN marks ON texts.t = marks.t),
compared AS (
    SELECT r.doc_id, r.n, r.edited, o.mark AS own_mark, e.mark AS edited_mark, x.mark AS next_mark,
        o.level AS lo, e.level AS le, x.level AS lx,
        CASE WHEN o.level < e.level THEN o.fine ELSE o.coarse END AS oe,
        CASE WHEN e.level < o.level THEN e.fine ELSE e.coarse END AS eo,
        CASE WHEN o.level < x.level THEN o.fine ELSE o.coarse END AS ox,
        CASE WHEN x.level < o.level THEN x.fine ELSE x.coarse END AS xo
    FROM both_texts r JOIN prints o ON r.body = o.t JOIN prints e ON r.edited = e.t
        JOIN prints x ON r.next = x.t)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, own_mark AS fingerprint,
    edited_mark AS edited_fingerprint,
    (CASE WHEN own_mark = edited_mark THEN 1 WHEN lo IS NULL OR le IS NULL THEN 0
        WHEN abs(lo - le) > 1 THEN 0 ELSE coalesce(len(list_intersect(oe, eo)) / nullif(
            len(list_distinct([left(e, 2) FOR e IN list_concat(oe, eo)])), 0), 0) END)::DOUBLE
        AS near_edited,
    (CASE WHEN own_mark = next_mark THEN 1 WHEN lo IS NULL OR lx IS NULL THEN 0
        WHEN abs(lo - lx) > 1 THEN 0 ELSE coalesce(len(list_intersect(ox, xo)) / nullif(
            len(list_distinct([left(e, 2) FOR e IN list_concat(ox, xo)])), 0), 0) END)::DOUBLE
        AS near_next
FROM compared
"""
