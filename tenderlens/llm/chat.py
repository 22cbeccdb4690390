"""Chat formatting with loss masks that are aligned by offsets.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is
put after the ``<`` of every ``<\\...\\|`` (any number of backslashes), so no control string can
stand there and one backslash less gives the original back. The control strings are special
tokens, which no other token crosses: encoding block by block of turns gives the ids of the whole
conversation, and a block is all that is in memory. Token spans come from the encoder's offsets;
the tokens under the loss mask are those that lie in an assistant's text, found by binary search
of the sorted turn spans.

Turns are dealt by conversation and read in order of ``turn`` (ties: role, then text) as a stream;
digests are carried from turn to turn, so a conversation of any length takes the memory of one
block. A null text or role is empty, a null turn comes first, rows without conversation form the
conversation null. Repeated rows are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
# Characters of rendered turns that are encoded at a time; a longer turn is encoded alone.
BLOCK_CHARS = 1 << 20

SCHEMA = """conv_id long, n_turns long, turns_sha256 string, loss_chars long,
    loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"""

_control = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<\\(\\*)\|")
_turn = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _control.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


@lru_cache(maxsize=2)
def encoder(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True)
                                  for x in (TURN, TEXT, END)])
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted spans; both have a start and an end per row."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[np.maximum(at, 0), 1]) \
        & (offsets[:, 1] > offsets[:, 0])


def encode_block(path: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and loss mask of rendered turns."""
    encoded = encoder(path).encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    spans = np.array([m.span(2) for m in _turn.finditer(text) if unescape(m[1]) == LOSS_ROLE],
                     np.int64).reshape(-1, 2)
    return np.array(encoded.ids, np.int64), offsets, loss_mask(offsets, spans)


class _Digest:
    """What is carried from block to block of a conversation."""

    def __init__(self, path: str, conversation):
        self.path, self.conversation = path, conversation
        self.turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.block: list[str] = []
        self.size = 0

    def add(self, role: str, text: str) -> None:
        rendered = render(role, text)
        if self.block and self.size + len(rendered) > BLOCK_CHARS:
            self.flush()
        self.block.append(rendered)
        self.size += len(rendered)

    def flush(self) -> None:
        text = "".join(self.block)
        self.block, self.size = [], 0
        ids, offsets, mask = encode_block(self.path, text)
        for match in _turn.finditer(text):
            self.turns += 1
            self.all.update(f"{unescape(match[1])}\n{unescape(match[2])}\n".encode())
        self.chars += len(text)
        self.tokens += len(ids)
        self.loss_tokens += int(mask.sum())
        # Runs of tokens under the mask; several tokens may share the bytes of one character.
        chosen = offsets[mask]
        if not len(chosen):
            return
        cut = np.flatnonzero(chosen[1:, 0] > chosen[:-1, 1]) + 1
        for a, b in zip(chosen[np.append(0, cut), 0].tolist(),
                        chosen[np.append(cut, len(chosen)) - 1, 1].tolist()):
            part = unescape(text[a:b])
            self.loss_chars += len(part)
            self.loss.update(part.encode())

    def row(self) -> tuple:
        self.flush()
        return (self.conversation, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens)


def _stream(path: str):
    def batch_of(rows):
        names = [f.split()[0] for f in SCHEMA.split(",")]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches):
        current, rows = None, []
        for batch in batches:
            for conversation, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if current is None or current.conversation != conversation:
                    if current is not None:
                        rows.append(current.row())
                    current = _Digest(path, conversation)
                current.add(role, text)
            if rows:
                yield batch_of(rows)
                rows = []
        if current is not None:
            yield batch_of([current.row()])
    return run


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conversation"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("position"))


def format_digests(turns: DataFrame, path: str) -> DataFrame:
    """One row per conversation, read back from its rendered and encoded form."""
    return (_turns(turns).repartition("conversation")
            .sortWithinPartitions("conversation", "position", "role", "text")
            .select("conversation", "role", "text").mapInArrow(_stream(path), SCHEMA))


def formatted_turns(turns: DataFrame, path: str) -> DataFrame:
    """Rendered text, ids and loss mask of every turn; a conversation's are its turns' in order."""
    def run(batches):
        for batch in batches:
            conversation, position = batch.column(0), batch.column(3)
            texts = [render(r, t) for r, t in zip(batch.column(1).to_pylist(),
                                                  batch.column(2).to_pylist())]
            encoded = [encode_block(path, t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "conv_id": conversation, "turn": position, "formatted": texts,
                "ids": pa.array([e[0] for e in encoded], pa.list_(pa.int64())),
                "loss": pa.array([e[2] for e in encoded], pa.list_(pa.bool_()))})
    return _turns(turns).mapInArrow(
        run, "conv_id long, turn long, formatted string, ids array<long>, loss array<boolean>")


_ESCAPED = "length(regexp_replace(coalesce({0}, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
              FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum({len(TURN + TEXT + END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})
            AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
