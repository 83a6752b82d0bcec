"""The full-text query language: parsed into a tree, compiled into column expressions.

    query  := or;  or := and (OR and)*;  and := not (AND not)*;  not := row (NOT row)*
    row    := item+                         (items side by side are AND-ed)
    item   := [columns :] ( "(" or ")" | NEAR "(" phrase+ [, n] ")" | phrase )
    phrase := [^] string (+ string)* [*]    string := "..." ("" is a quote) or a bare word
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistle.functions.sqlsem import fold_text

_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x80-\U0010ffff]+)|(?P<mark>[():*^+,{}\-]))')
_PIECES = re.compile(r"[^\W_]+")


class FtsSyntaxError(ValueError):
    """The query is not in the language."""


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple = field(default=())


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.columns, self.items, at = columns, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise FtsSyntaxError(f"syntax error near {text[at:].strip()[:1]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else (None, None)

    def take(self, value: str | None = None):
        found = self.peek()
        if found[0] is None or (value is not None and found[1] != value):
            raise FtsSyntaxError(f"syntax error near {found[1] or 'the end'!r}")
        self.at += 1
        return found

    def parse(self):
        tree = self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", self.row)))
        if self.at < len(self.items):
            raise FtsSyntaxError(f"syntax error near {self.peek()[1]!r}")
        return tree

    def chain(self, word, kind, operand):
        out = operand()
        while self.peek() == ("word", word):
            self.at += 1
            out = Op(kind, (out, operand()))
        return out

    def row(self):
        parts = [self.item()]
        while self.peek()[0] is not None and self.peek() not in (("mark", ")"), ("mark", ",")) and self.peek() not in (("word", "OR"), ("word", "AND"), ("word", "NOT")):
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def item(self):
        columns = self.filter()
        if self.peek() == ("mark", "("):
            self.at += 1
            tree = self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", self.row)))
            self.take(")")
        elif self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            phrases, distance = [], 10
            while self.peek()[1] not in (")", ","):
                phrases.append(self.phrase())
            if self.peek()[1] == ",":
                self.at += 1
                kind, n = self.take()
                if kind != "word" or not n.isdigit():
                    raise FtsSyntaxError(f"expected integer, got {n!r}")
                distance = int(n)
            self.take(")")
            tree = Near(tuple(phrases), distance)
        else:
            tree = self.phrase()
        return _limit(tree, columns) if columns is not None else tree

    def filter(self):
        start, negated, names = self.at, False, None
        if self.peek() == ("mark", "-"):
            negated, self.at = True, self.at + 1
        if self.peek() == ("mark", "{"):
            self.at, names = self.at + 1, []
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1].strip('"').lower())
            self.take("}")
            self.take(":")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            names = [self.take()[1].strip('"').lower()]
            self.at += 1
        if names is None:
            if negated:
                raise FtsSyntaxError("syntax error near '-'")
            self.at = start
            return None
        for n in names:
            if n not in self.columns:
                raise FtsSyntaxError(f"no such column: {n}")
        return tuple(c for c in self.columns if (c in names) != negated)

    def phrase(self):
        first = self.peek() == ("mark", "^")
        self.at += first
        tokens, prefix = [], False
        while True:
            kind, value = self.take()
            if kind not in ("word", "string") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise FtsSyntaxError(f"syntax error near {value!r}")
            tokens += _PIECES.findall(fold_text(value[1:-1].replace('""', '"') if kind == "string" else value))
            if self.peek() != ("mark", "+"):
                break
            self.at += 1
        if self.peek() == ("mark", "*"):
            prefix, self.at = True, self.at + 1
        return Phrase(tuple(tokens), prefix, first)


def _limit(tree, columns):
    """The tree under a column filter; filters inside one another intersect."""
    if isinstance(tree, Phrase):
        return Phrase(tree.tokens, tree.prefix, tree.first, columns if tree.columns is None else tuple(c for c in tree.columns if c in columns))
    if isinstance(tree, Near):
        return Near(tuple(_limit(p, columns) for p in tree.phrases), tree.distance)
    return Op(tree.kind, tuple(_limit(p, columns) for p in tree.parts))


def parse(text: str, columns: tuple[str, ...] = ("subject", "body_text")):
    """The tree of a query; FtsSyntaxError where it is none."""
    parser = _Parser(text, columns)
    if not parser.items:
        raise FtsSyntaxError("syntax error near the end")
    return parser.parse()


def phrases(tree) -> list[Phrase]:
    """All phrases of a tree, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    return [p for part in (tree.phrases if isinstance(tree, Near) else tree.parts) for p in phrases(part)]


def places(phrase: Phrase, words: Column) -> Column:
    """Positions (from 0) at which a phrase starts in an array of tokens."""
    if not phrase.tokens:
        return F.array().cast("array<int>")
    head, last = phrase.tokens[0], len(phrase.tokens) - 1

    def here(i):
        out = None
        for k, t in enumerate(phrase.tokens):
            w = F.get(words, i + k)
            same = w.startswith(t) if phrase.prefix and k == last else w == F.lit(t)
            out = same if out is None else out & same
        return F.coalesce(out & (i == 0) if phrase.first else out, F.lit(False))

    # most texts hold no such token at all, which array_contains finds out much faster
    some = F.lit(True) if phrase.prefix and not last else F.array_contains(words, head)
    none = F.array().cast("array<int>")
    return F.when(some & (F.size(words) > 0), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(none)


def nears(tree) -> list[Near]:
    """All NEAR groups of a tree, in order."""
    if isinstance(tree, Near):
        return [tree]
    return [n for part in getattr(tree, "parts", ()) for n in nears(part)]


def found_in(phrase: Phrase, column: str) -> bool:
    return phrase.columns is None or column in phrase.columns


def near(tree: Near, words: Column) -> Column:
    """Whether all phrases of a NEAR group stand in one array of tokens, within the distance."""
    spots = [places(p, words) for p in tree.phrases]
    sizes = [len(p.tokens) for p in tree.phrases]

    # some placement of every phrase lies in a span whose ends are at most the distance apart
    def chain(k, low, high):
        if k == len(spots):
            return F.lit(True)
        return F.exists(spots[k], lambda i: (F.greatest(high, i) - F.least(low, i + sizes[k]) <= tree.distance) & chain(k + 1, F.least(low, i + sizes[k]), F.greatest(high, i)))

    return F.exists(spots[0], lambda i: chain(1, i + sizes[0], i))


def matches(tree, counts: dict[Phrase, Column], groups: dict[Near, Column]) -> Column:
    """Whether a row matches, given each phrase's count and each NEAR group's answer."""
    if isinstance(tree, Phrase):
        return counts[tree] > 0
    if isinstance(tree, Near):
        return groups[tree]
    parts = [matches(p, counts, groups) for p in tree.parts]
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.kind == "and" else out | p
    return out
