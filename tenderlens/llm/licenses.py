"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a
shunting-yard parser evaluates the and/or/with expression behind a tag.

Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. A
phrase of ``BASE`` or ``NOTICES`` is found where its words stand consecutively, whatever stands
between them. ``SPDX-License-Identifier`` is the phrase "spdx license identifier"; the expression
is parsed from the characters behind it to the end of its line. Operators in falling strength:
WITH, AND, OR (any case). An expression that does not parse gives the identifiers it names.

score: known / (known + unknown) identifiers, over all phrases of the text and the distinct identifiers
of every expression; 0 without any. ``obligations`` lists the alternative sets of licences one may
choose from ("apache-2.0+mit" means both hold). An expression of more than ``MOST_ALTERNATIVES`` sets
is written as it is factored ("(isc|mit)+(apache-2.0|zlib)"); nothing else depends on their number.

A null text is empty: no words, null first and last word, empty labels, score 0. Rows are judged
one by one; null keys stay null; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from tenderlens.llm.texts import per_slice, utf8

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices, with the identifiers of the SPDX licence list in lower case.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "all rights reserved": "proprietary",
}
# Families of identifiers by their first part.
FAMILIES = {
    "gpl", "lgpl", "agpl", "apache", "mit", "bsd", "mpl", "epl", "isc", "bsl", "cc-by", "cc0",
    "unlicense", "zlib", "artistic", "cddl", "python", "postgresql", "wtfpl", "0bsd",
}
TAG = "spdx license identifier"
STRENGTH = {"or": 1, "and": 2, "with": 3}
# Sets of one expression that are written out one by one.
MOST_ALTERNATIVES = 64

SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long,
    base_labels string, labels string, score double, obligations string"""

_table = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_token = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_tag = re.compile(rb"(?i)spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier"
                  rb"(?![0-9a-z\x80-\xff])[ \t:]*([^\r\n]*)")


def postfix(tokens: list[str]) -> list[str] | None:
    """Tokens in postfix order by two stacks; None if parentheses or operands do not match."""
    out, waiting, want_operand = [], [], True
    for token in tokens:
        word = token.lower()
        if token == "(":
            if not want_operand:
                return None
            waiting.append(token)
        elif token == ")":
            if want_operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in STRENGTH:
            if want_operand:
                return None
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want_operand = True
        else:
            if not want_operand:
                return None
            out.append(word)
            want_operand = False
    if want_operand or "(" in waiting:
        return None
    return out + waiting[::-1]


class Choice:
    """What an expression allows: its identifiers, the sets of licences one may choose from (None
    if a product of them is too large to write out), and its factored form."""

    def __init__(self, identifier: str):
        self.kind, self.parts = "", [identifier]
        self.identifiers, self.sets = {identifier}, [frozenset([identifier])]

    def written(self) -> str:
        joint = "+" if self.kind == "and" else "|"
        return joint.join(sorted(set(self.parts)))

    def _factors(self, kind: str) -> list[str]:
        """Its parts as those of a larger expression of a kind."""
        if self.kind in ("", kind):
            return self.parts
        return [self.written() if kind == "or" else f"({self.written()})"]

    def joined(self, kind: str, other: Choice) -> Choice:
        """Both by ``and`` or ``or``; takes the two over."""
        self.parts = self._factors(kind)
        self.parts += other._factors(kind)
        self.kind = kind
        self.identifiers |= other.identifiers
        if self.sets is None or other.sets is None:
            self.sets = None
        elif kind == "or":
            self.sets += other.sets
        else:
            left, right = (list(dict.fromkeys(x)) for x in (self.sets, other.sets))
            self.sets = [a | b for a, b in product(left, right)] \
                if len(left) * len(right) <= MOST_ALTERNATIVES else None
        return self

    def with_exception(self, other: Choice) -> Choice:
        names = "+".join(sorted(other.identifiers))
        if self.kind:
            self.kind, self.parts = "", [f"({self.written()}) with {names}"]
        else:
            self.parts = [f"{self.parts[0]} with {names}"]
        self.identifiers = {f"{x} with {names}" for x in self.identifiers}
        if self.sets is not None:
            self.sets = [frozenset(f"{x} with {names}" for x in a) for a in self.sets]
        return self


def evaluated(expression: list[str]) -> Choice:
    """What an expression in postfix order allows."""
    stack: list[Choice] = []
    for token in expression:
        if token not in STRENGTH:
            stack.append(Choice(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left.with_exception(right) if token == "with" else left.joined(token, right))
    return stack[0]


def family(identifier: str) -> str | None:
    """The label of an identifier ("gpl-2.0-only": "gpl"), None if it is not known."""
    name = identifier.split(" with ")[0].rstrip("+")
    parts = name.split("-")
    return next((f for f in ("-".join(parts[:2]), parts[0]) if f in FAMILIES), None)


def expression_of(line: str) -> list[frozenset[str]]:
    """Alternatives of the expression at the start of a line, if they are written out."""
    choice = choice_of(line)
    return list(dict.fromkeys(choice.sets or [])) if choice else []


def choice_of(line: str) -> Choice | None:
    """What the expression at the start of a line allows; plain text may follow it.

    It ends where an operand stands behind an operand or a character is neither.
    """
    tokens, at, want_operand = [], 0, True
    for match in _token.finditer(line):
        token = match[0].rstrip(".:") or match[0]
        operand = token not in "()" and token.lower() not in STRENGTH
        if line[at:match.start()].strip() or (operand or token == "(") and not want_operand:
            break
        tokens.append(token)
        at, want_operand = match.end(), token != ")" and not operand
    while tokens and tokens[-1].lower() in STRENGTH:
        tokens.pop()
    order = postfix(tokens) if tokens else []
    if order is None:
        # It does not parse: any of the identifiers that it names.
        named = [t.lower() for t in tokens if t not in "()" and t.lower() not in STRENGTH]
        order = named + ["or"] * (len(named) - 1)
    return evaluated(order) if order else None


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: None}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton


def scan(body: bytes) -> tuple:
    words = body.translate(_table).split()
    # Latin-1 keeps one character for each byte; phrases are ASCII.
    text = f" {b' '.join(words).decode('latin-1')} "
    places, base, labels, known, unknown, chosen = [], set(), set(), 0, 0, set()
    tagged = False
    for end, phrase in _automaton().iter(text):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            known += 1
            chosen.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(NOTICES[phrase])
            chosen.add(NOTICES[phrase])
            known += 1
    if tagged:
        for match in _tag.finditer(body):
            choice = choice_of(match[1].decode(errors="replace"))
            for name in choice.identifiers if choice else ():
                label = family(name)
                known, unknown = known + (label is not None), unknown + (label is None)
                labels.add(label or name)
            if choice and choice.sets is None:
                chosen.add(choice.written())
            elif choice:
                chosen.update("+".join(sorted(a)) for a in choice.sets)
    first = last = None
    if places:
        first, last = text.count(" ", 0, places[0] + 1) - 1, \
            text.count(" ", 0, places[-1] + 1) - 1
    return (len(words), len(places), first, last, ",".join(sorted(base)),
            ",".join(sorted(base | labels)), known / (known + unknown) if known else 0.0,
            "|".join(sorted(chosen)))


def _scan_all(keys, bodies):
    columns = list(zip(*map(scan, bodies)))
    names = [f.split()[0] for f in SCHEMA.split(",")][1:]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    return {"doc_id": pa.array(keys, pa.int64())} | {
        n: pa.array(c, t) for n, c, t in zip(names, columns, types)}


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrases, identifiers, labels and choices of every row."""
    return utf8(docs, key, text).mapInArrow(per_slice(_scan_all), SCHEMA)
