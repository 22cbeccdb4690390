"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker. No piece of the
vocabulary crosses the start of a chunk (checked when a model is loaded), so a text's ids are those
of its chunks in order: each distinct chunk of a slice of texts is segmented once by the library
and its ids are joined back by position. A distinct chunk costs the library one call; the table
lives as long as the slice, so memory is bounded by the slice.

Decoding looks every id's bytes up in a table made from the vocabulary and joins them by position.

A null text is empty and has the begin and end ids alone. Rows are encoded one by one: repeated
rows give repeated results, a null key stays null, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tenderlens.llm.texts import SpanHash, Texts, per_slice, utf8

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkCodec:
    """A model whose pieces never hold a marker after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece crosses a white-space marker")
        if [self.model.encode(x) for x in ("a", " a")] != \
                [self.model.encode(f"{MARK * n}a"[1:]) for n in (1, 2)]:
            raise ValueError("the model does not put one marker before a text")
        surfaces = [
            b"" if self.model.is_control(i) else bytes([int(name[3:5], 16)])
            if self.model.is_byte(i) else name.replace(MARK, " ").encode()
            for i, name in enumerate(names)]
        surfaces[self.model.unk_id()] = " ⁇ ".encode()
        self.size = np.fromiter(map(len, surfaces), np.int64, size)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        # The marker alone is a chunk at the end of a text; the library has no text for it.
        self.marker = [self.model.piece_to_id(MARK)]
        if self.marker == [self.model.unk_id()]:
            raise ValueError("the marker is no piece")
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with begin and end of each text, and their number for each text."""
        marked = [(" " + b.decode()).replace(MARK, " ").encode() if b else b"" for b in bodies]
        t = Texts(marked)
        # A chunk starts at a space that follows something else, or at the start of a text.
        space = t.data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        used = t.end > t.start
        begins[t.start[used]] = True
        starts = np.flatnonzero(begins)
        limits = np.append(starts[1:], 0)
        counts = t.counts(starts)
        last = np.cumsum(counts)[used] - 1
        limits[last] = t.end[used]
        hashes = SpanHash(t.data).of(starts, limits)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        raw, first = t.data.tobytes(), order[new]
        # The library itself puts the first marker of a chunk.
        distinct = [raw[a + 1:b].decode() for a, b in
                    zip(starts[first].tolist(), limits[first].tolist())]
        table = self.model.encode(distinct, num_threads=1) if distinct else []
        table = [ids or self.marker for ids in table]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.fromiter((i for ids in table for i in ids), np.uint32, int(sizes.sum()))
        joined, _ = gather(flat, np.cumsum(sizes) - sizes, sizes, which)
        per_chunk = np.concatenate([[0], np.cumsum(sizes[which])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        inner = per_chunk[bounds[1:]] - per_chunk[bounds[:-1]]
        lengths = inner + 2
        out = np.empty(int(lengths.sum()), np.uint32)
        ends = np.cumsum(lengths)
        body = np.ones(len(out), bool)
        body[ends - lengths] = body[ends - 1] = False
        out[ends - lengths], out[ends - 1] = self.begin, self.end
        out[body] = joined
        return out, lengths

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, as the library's ``decode`` gives it.

        Control ids have no surface, the space that stands for the marker put in front goes, and
        bytes that are no UTF-8 become replacement characters.
        """
        flat, _ = gather(self.bytes, self.at, self.size, ids)
        total = np.concatenate([[0], np.cumsum(self.size[ids])])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        raw = flat.tobytes()
        out = []
        for a, b in zip(total[bounds[:-1]].tolist(), total[bounds[1:]].tolist()):
            text = raw[a + 1:b] if raw[a:a + 1] == b" " and b > a else raw[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode(errors="replace").encode()
            out.append(text)
        return out


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray,
           which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[at[i]:at[i] + size[i]]`` for i in ``which``, one after the other."""
    sizes = size[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(at[which] - (ends - sizes), sizes)
    return flat[np.arange(total) + shift], sizes


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    return ChunkCodec(path)


def _digests(path: str):
    def work(keys, bodies):
        model = codec(path)
        ids, lengths = model.encode(bodies)
        decoded = model.decode(ids, lengths)
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(lengths)
        starts = ends - 4 * lengths
        return {
            "doc_id": pa.array(keys, pa.int64()), "n_tokens": lengths,
            "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in
                           zip(starts.tolist(), ends.tolist())],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
        }
    return work


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and digest of the ids and digest of the decoded text, for every row."""
    return utf8(docs, key, text).mapInArrow(per_slice(_digests(path)), SCHEMA)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (begin and end included) of every row."""
    def work(keys, bodies):
        ids, lengths = codec(path).encode(bodies)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return {"doc_id": pa.array(keys, pa.int64()),
                "ids": pa.ListArray.from_arrays(offsets, ids.astype(np.int32))}
    return utf8(docs, key, text).mapInArrow(per_slice(work), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; a null list is empty."""
    def run(batches):
        for batch in batches:
            lists = pc.fill_null(pc.list_value_length(batch.column(1)), 0)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "text": [x.decode() for x in
                         codec(path).decode(flat, lists.to_numpy(zero_copy_only=False))]})
    return tokens.selectExpr(f"cast(`{key}` as long) doc_id", f"`{ids}` ids") \
        .mapInArrow(run, "doc_id long, text string")
