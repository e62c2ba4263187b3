"""Boolean trigram queries derived from regular expressions.

An expression is parsed into literals, classes, groups, alternations and repeats. From each
part, bottom up, follow the strings it can match (`exact`, if few), how its matches can begin
and end (`pre` and `suf`, up to two characters), and a query in disjunctive form: sets of
trigrams of which a lower-cased text with a match holds one set whole. Joining two parts adds
the trigrams across their border. What can't be parsed, and what has no mandatory trigram,
gives the query [frozenset()], which every text meets: such rules scan fully.

Trigrams are lower case and ASCII: lower-casing a text turns its ASCII letters into lower
case and leaves its other ASCII characters, so a match of either case keeps its trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass

MANY, CLAUSES = 40, 16
ANY = [frozenset()]
_CLASSES = {"d": None, "w": None, "s": None, "D": None, "W": None, "S": None, "h": None, "v": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}
_WIDTHLESS = "bBAzZG"


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    pre: frozenset[str]
    suf: frozenset[str]
    query: tuple[frozenset[str], ...]


EMPTY = Part(frozenset([""]), frozenset([""]), frozenset([""]), tuple(ANY))
WILD = Part(None, frozenset([""]), frozenset([""]), tuple(ANY))


def grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii())


def _slim(query) -> tuple[frozenset[str], ...]:
    """Without the clauses that another one implies; too many clauses ask nothing."""
    own = sorted(set(query), key=lambda c: (len(c), sorted(c)))
    kept: list[frozenset[str]] = []
    for c in own:
        if not any(k <= c for k in kept):
            kept.append(c)
    return tuple(kept) if len(kept) <= CLAUSES else tuple(ANY)


def _both(a, b) -> tuple[frozenset[str], ...]:
    out = _slim(x | y for x in a for y in b)
    return out if out != tuple(ANY) or tuple(ANY) in (a, b) else min((a, b), key=len)


def _known(p: Part) -> tuple[frozenset[str], ...]:
    """The query with what the exact strings say."""
    return _both(p.query, _slim(map(grams, p.exact))) if p.exact is not None else p.query


def _part(exact) -> Part:
    exact = frozenset(exact)
    return Part(exact, frozenset(s[:2] for s in exact), frozenset(s[-2:] for s in exact), tuple(ANY))


def _join(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MANY:
        p = _part(x + y for x in a.exact for y in b.exact)
        return Part(p.exact, p.pre, p.suf, _both(a.query, b.query))
    query = _both(_both(_known(a), _known(b)), _slim(grams(x + y) for x in a.suf for y in b.pre))
    pre = frozenset((x + y)[:2] for x in a.exact for y in b.pre) if a.exact is not None else a.pre
    suf = frozenset((x + y)[-2:] for y in b.exact for x in a.suf) if b.exact is not None else b.suf
    return Part(None, pre if len(pre) <= MANY else frozenset([""]), suf if len(suf) <= MANY else frozenset([""]), query)


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MANY and a.query == b.query == tuple(ANY):
        return _part(a.exact | b.exact)
    pre, suf = a.pre | b.pre, a.suf | b.suf
    return Part(None, pre if len(pre) <= MANY else frozenset([""]), suf if len(suf) <= MANY else frozenset([""]), _slim([*_known(a), *_known(b)]))


def _repeat(p: Part, least: int, most: int | None) -> Part:
    if (least, most) == (0, 1):
        return _either(p, EMPTY)
    if least == 0:
        return WILD
    out = p
    for _ in range(min(least, 3) - 1):
        out = _join(out, p)
    if most == least <= 3:
        return out
    # more of the same may follow or stand between: beginnings, ends and trigrams hold, whole strings don't
    return Part(None, out.pre, p.suf if least < 2 else out.suf, _known(out))


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        got = self.text[self.at : self.at + n]
        if len(got) < n:
            raise Unsupported("unfinished expression")
        self.at += n
        return got

    def either(self) -> Part:
        out = self.sequence()
        while self.more() == "|":
            self.take()
            out = _either(out, self.sequence())
        return out

    def sequence(self) -> Part:
        out = EMPTY
        while self.more() and self.more() not in "|)":
            out = _join(out, self.repeated())
        return out

    def repeated(self) -> Part:
        p = self.one()
        while (c := self.more()) and c in "*+?{":
            self.take()
            if c == "{":
                stop = self.text.index("}", self.at) if "}" in self.text[self.at :] else -1
                inner = self.text[self.at : stop] if stop >= 0 else ""
                low, comma, high = inner.partition(",")
                if not low.isdigit() or high and not high.isdigit():
                    raise Unsupported("brace")
                self.at = stop + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            if self.more() and self.more() in "?+":
                self.take()
            p = _repeat(p, least, most)
        return p

    def one(self) -> Part:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.several()
        if c == ".":
            return WILD
        if c in "^$":
            return EMPTY
        if c == "\\":
            chars = self.escape()
            return EMPTY if chars == "" else WILD if chars is None else _part([chars.lower()])
        return _part([c.lower()]) if c.isascii() else WILD

    def group(self) -> Part:
        ahead = None
        if self.more() == "?":
            self.take()
            c = self.take()
            if c == "P":
                c = self.take()
            if c == "<" and self.more() not in "=!":
                self.at = self.text.index(">", self.at) + 1
            elif c in "=!" or c == "<":
                ahead = c if c != "<" else self.take()
            elif c not in ":>":
                flags = c
                while (c := self.take()) not in ":)":
                    flags += c
                if "x" in flags or "u" in flags.lower():
                    raise Unsupported("free spacing, or cases beyond ASCII")
                if c == ")":
                    return EMPTY
        out = self.either()
        if self.take() != ")":
            raise Unsupported("group")
        return out if ahead is None else EMPTY

    def escape(self) -> str | None:
        """The character of an escape after its backslash; "" has no width, None is any character."""
        c = self.take()
        if c in _WIDTHLESS:
            return ""
        if c in _CLASSES:
            return None
        if c == "x":
            return self.char(int(self.take(2), 16))
        if c == "u":
            return self.char(int(self.take(4), 16))
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c.isalnum():
            raise Unsupported(f"escape {c}")
        return c

    @staticmethod
    def char(code: int) -> str | None:
        return chr(code) if code < 128 else None

    def several(self) -> Part:
        """A class: its characters, if they are few."""
        negated = self.more() == "^" and bool(self.take())
        chars: set[str] | None = set()
        first = True
        while first or self.more() != "]":
            c, first = self.take(), False
            if c == "[" or c == "&" and self.more() == "&":
                raise Unsupported("nested class")
            if c == "\\":
                c = self.escape()
                if c == "":
                    raise Unsupported("escape in class")
            if self.more() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                d = self.take()
                d = self.escape() if d == "\\" else d
                if c is None or not d:
                    raise Unsupported("range")
                span = ord(d) - ord(c)
                chars = None if chars is None or span > 128 else chars | {chr(k) for k in range(ord(c), ord(d) + 1)}
            else:
                chars = None if c is None or chars is None else chars | {c}
        self.take()
        if negated or chars is None or not all(c.isascii() for c in chars):
            return WILD
        low = {c.lower() for c in chars}
        return _part(low) if 0 < len(low) <= 8 else WILD


def query_of(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams: a lower-cased text with a match holds one of them whole."""
    try:
        p = _Parser(pattern)
        part = p.either()
        if p.at < len(pattern):
            raise Unsupported("unbalanced")
    except (Unsupported, ValueError, IndexError):
        return list(ANY)
    return list(_slim(_known(part)))
