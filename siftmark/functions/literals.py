"""Literals that every match of a pattern holds one of, so that a pattern runs only over texts in which one stands.

A pattern is read with the dialect's own reader. Each part gives the strings that it can be, if they are few, and else a set of
which one stands in each of its matches; parts beside each other are joined as long as they are few strings. What is not
understood counts as any text, so a gate may be missing or weak, but never wrong.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import FLAGS, NAMED, REPEAT, Reader, Refused

FEW = 24  # strings of a set
#: Characters that ignore-case patterns take for s, k, i and i, though lower() does not.
FOLDED = ("ſ\u212aİı", "skii")
ZERO = re.compile(r"\\[bBAzZ]|\^|\$")


@dataclass
class Part:
    """exact: all that it can be; need: one of these is in each match. None: not known."""

    exact: frozenset[str] | None
    need: frozenset[str] | None

    def needed(self) -> frozenset[str] | None:
        return better(self.exact, self.need)


EMPTY, ANY = Part(frozenset([""]), None), Part(None, None)


def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, that with the longer shortest string, then the smaller; a set with the empty string is none."""
    a, b = (x if x and "" not in x else None for x in (a, b))
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def sequence(parts: list[Part]) -> Part:
    now, whole, best = frozenset([""]), True, None
    for p in parts:
        if p.exact is not None and len(now) * len(p.exact) <= FEW:
            now = frozenset(a + b for a in now for b in p.exact)
            continue
        best, whole = better(best, now), False
        if p.exact is not None:
            now = p.exact
        else:
            best, now = better(best, p.need), frozenset([""])
    return Part(now if whole else None, better(best, now))


def either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and len(exact := frozenset().union(*(p.exact for p in parts))) <= FEW:
        return Part(exact, None)
    needs = [p.needed() for p in parts]
    if any(n is None for n in needs) or len(need := frozenset().union(*needs)) > FEW:
        return ANY
    return Part(None, need)


class Literals:
    def __init__(self, pattern: str, dialect: str):
        self.p, self.r = pattern, Reader(pattern, dialect)

    def branches(self, fold: bool) -> Part:
        """Up to the end of the group or pattern."""
        out, now = [], []
        while self.r.i < len(self.p) and self.p[self.r.i] != ")":
            if self.p[self.r.i] == "|":
                self.r.i += 1
                out.append(sequence(now))
                now = []
                continue
            part, fold = self.item(fold)
            now.append(part)
        return either([*out, sequence(now)])

    def item(self, fold: bool) -> tuple[Part, bool]:
        at = self.r.i
        if m := ZERO.match(self.p, at):
            self.r.i = m.end()
            return self.repeated(EMPTY), fold
        if self.p[at] == "(":
            flags = None if NAMED.match(self.p, at) else FLAGS.match(self.p, at)
            around = self.p.startswith(("(?=", "(?!", "(?<=", "(?<!"), at) and not NAMED.match(self.p, at)
            self.r.group()
            if self.p.startswith("(?P=", at):
                return self.repeated(ANY), fold
            inner = fold
            if flags:
                if "x" in flags[1]:
                    raise Refused("free spacing")
                inner = (fold or "i" in flags[1]) and "i" not in (flags[2] or "")
                if flags[3] == ")":
                    return EMPTY, inner
            part = self.branches(inner)
            if not self.p.startswith(")", self.r.i):
                raise Refused("missing )")
            self.r.i += 1
            return self.repeated(EMPTY if around else part), fold
        self.r.atom()
        return self.repeated(self.one(self.p[at : self.r.i], fold)), fold

    def one(self, raw: str, fold: bool) -> Part:
        """A token as the characters it can be."""
        if raw[0] == "[":
            inside = raw[1:-1]
            chars = set(inside)
            if inside[:1] in "^]" or chars & set("\\[]&") or "-" in inside[1:-1] or len(chars) > 6:
                return ANY
        elif raw.startswith(r"\Q"):
            chars = {raw[2:].removesuffix(r"\E")}
        elif raw[0] == "\\":
            if len(raw) != 2 or raw[1].isalnum():
                return ANY
            chars = {raw[1]}
        elif raw == ".":
            return ANY
        else:
            chars = {raw}
        if any(not (c.isascii() or c.lower() == c.upper()) for x in chars for c in x):
            return ANY  # letters whose cases are not one to one
        return Part(frozenset(x.lower() for x in chars), None)

    def repeated(self, part: Part) -> Part:
        at = self.r.i
        _, least = self.r.repeat()
        raw = self.p[at : self.r.i]
        if not raw:
            return part
        if raw[0] == "?":
            return Part(part.exact | {""}, None) if part.exact is not None else ANY
        if (m := REPEAT.match(raw)) and m[1] == "1" and not m[2]:
            return part
        return Part(None, part.needed()) if least else ANY


def required(pattern: str, dialect: str = "re2") -> list[str] | None:
    """Lower-case strings of which one stands in the folded() text of every match; None if there are none that are known."""
    try:
        r = Literals(pattern, dialect)
        part = r.branches(False)
    except (Refused, IndexError):
        return None
    need = part.needed() if r.r.i >= len(pattern) else None
    return sorted(need) if need else None


def folded(text: Column) -> Column:
    """The text in which literals are looked for."""
    return F.lower(F.translate(text, *FOLDED))


def gate(folded_text: Column, pattern: str, dialect: str = "re2") -> Column | None:
    """Whether a text can match; None where every text may."""
    need = required(pattern, dialect)
    if not need:
        return None
    out = F.contains(folded_text, F.lit(need[0]))
    for x in need[1:]:
        out = out | F.contains(folded_text, F.lit(x))
    return out
