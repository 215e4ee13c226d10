"""Regex patterns of RE2 or Python for Spark's Java engine: a pattern is read token by token and written anew."""

import re

SPACES = r"\t\n\f\r\x20"
#: Word characters, digits and spaces of each dialect, as the inside of a Java class.
SETS = {
    "re2": {"w": "0-9A-Za-z_", "d": "0-9", "s": SPACES},
    "python": {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\t-\r\x1c-\x20\x85\p{Z}"},
}
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
NAMED = re.compile(r"\(\?P?<[A-Za-z_]\w*>")
BACK = re.compile(r"\(\?P=(\w+)\)")
ESCAPE = re.compile(r"\\(?:[pP](?:\{\^?\w+\}|\w)|x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|[uU][0-9A-Fa-f]+|.)", re.S)


class Refused(ValueError):
    """A pattern that the dialect does not have, or that cannot be told to Java."""


class Reader:
    def __init__(self, pattern: str, dialect: str):
        self.p, self.i, self.dialect, self.sets = pattern, 0, dialect, SETS[dialect]
        self.word = f"[{self.sets['w']}]"
        self.lines = False  # whether $ ends lines
        self.groups, self.names = 0, {}  # capturing groups so far, and which of them have names

    def java(self) -> str:
        out: list[str] = ["(?d)"]
        inside = False  # whether the last atom is one word character or more
        while self.i < len(self.p):
            if self.p.startswith(r"\b", self.i):
                self.i += 2
                out.append(self.edge(inside))
                inside = False
                continue
            atom, words = self.atom()
            repeat, least = self.repeat()
            out.append(atom + repeat)
            inside = words and least > 0
        return "".join(out)

    def edge(self, inside: bool) -> str:
        """A word edge; one look is enough where the pattern tells what stands on its other side."""
        behind, ahead = f"(?<!{self.word})", f"(?!{self.word})"
        if inside:
            return ahead
        at = self.i
        follows = at < len(self.p) and self.p[at] not in "()|^$" and not self.p.startswith((r"\b", r"\B"), at) and self.atom()[1] and self.repeat()[1] > 0
        self.i = at
        return behind if follows else f"(?:{behind}(?={self.word})|(?<={self.word}){ahead})"

    def repeat(self) -> tuple[str, int]:
        """A quantifier, and the fewest repeats."""
        rest, least = self.p[self.i : self.i + 1], 1
        m = REPEAT.match(self.p, self.i)
        open_ = re.compile(r"\{,(\d+)\}").match(self.p, self.i) if self.dialect == "python" else None
        if open_:
            self.i = open_.end()
            out, least = f"{{0,{open_[1]}}}", 0
        elif rest and rest in "*+?":
            self.i += 1
            out, least = rest, int(rest == "+")
        elif m:
            self.i = m.end()
            out, least = m[0], int(m[1])
            if self.dialect == "re2" and max(least, int(m[3] or 0)) > 1000:
                raise Refused(f"repeat over 1000: {m[0]}")
        else:
            return "", 1
        if self.p.startswith("?", self.i):
            self.i += 1
            out += "?"
        elif self.dialect == "python" and self.p.startswith("+", self.i):
            self.i += 1
            out += "+"
        if self.dialect == "re2" and (self.p[self.i : self.i + 1] in ("*", "+", "?") and self.i < len(self.p)):
            raise Refused("repeat of a repeat")
        return out, least

    def atom(self) -> tuple[str, bool]:
        """The next token but its quantifier, and whether it is one word character."""
        c = self.p[self.i]
        if c == "\\":
            return self.escape()
        if c == "[":
            return self.klass()
        if c == "(":
            return self.group(), False
        self.i += 1
        if c == "$":
            return ("$" if self.lines or self.dialect == "python" else r"\z"), False
        if c == "{" and not REPEAT.match(self.p, self.i - 1):
            return r"\{", False
        if c in "*+?" or c == "{":
            raise Refused(f"nothing to repeat before {c}")
        return c, c.isascii() and (c.isalnum() or c == "_")

    def group(self) -> str:
        m = NAMED.match(self.p, self.i)
        if m:  # only whole matches count here, so names live on as numbers
            self.i, self.groups = m.end(), self.groups + 1
            self.names[m[0].split("<")[1][:-1]] = self.groups
            return "("
        m = BACK.match(self.p, self.i)
        if m and self.dialect == "python":
            if m[1] not in self.names:
                raise Refused(f"unknown group {m[1]}")
            self.i = m.end()
            return rf"(?:\{self.names[m[1]]})"
        m = FLAGS.match(self.p, self.i)
        if m and (m[1] or m[2] or m[3] == ":"):
            on, off = m[1], m[2] or ""
            known = "ims" if self.dialect == "re2" else "aimsux"
            if set(on + off) - set(known):
                raise Refused(f"flags {m[0]}")
            self.i = m.end()
            self.lines = (self.lines or "m" in on) and "m" not in off
            on, off = on.replace("u", "").replace("a", ""), off.replace("u", "").replace("a", "")
            flags = on.replace("i", "iu") + (f"-{off.replace('i', 'iu')}" if off else "")
            return f"(?{flags}{m[3]}" if flags or m[3] == ":" else ""
        if self.p.startswith("(?", self.i):
            if self.dialect == "re2" or not self.p.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), self.i):
                raise Refused(f"group {self.p[self.i : self.i + 4]}")
            n = 4 if self.p[self.i + 2] == "<" else 3
            self.i += n
            return self.p[self.i - n : self.i]
        self.i, self.groups = self.i + 1, self.groups + 1
        return "("

    def escape(self) -> tuple[str, bool]:
        if self.p.startswith(r"\Q", self.i) and self.dialect == "re2":
            end = self.p.find(r"\E", self.i)
            text, self.i = self.p[self.i + 2 : end if end >= 0 else None], end + 2 if end >= 0 else len(self.p)
            return "".join(re.escape(x) for x in text), False
        out, kind = self.one()
        if kind in ("w", "d"):
            return f"[{out}]", True
        if kind == "set":
            return f"[{out}]", False
        return out, kind == "letter"

    def one(self) -> tuple[str, str]:
        """An escape as Java writes it, or the inside of a class for sets."""
        m = ESCAPE.match(self.p, self.i)
        if not m:
            raise Refused("trailing backslash")
        self.i = m.end()
        x = m[0][1]
        if x in "wds":
            return self.sets[x], x if x != "s" else "set"
        if x in "WDS":
            return "^" + self.sets[x.lower()], "set"
        if x in "pP" and len(m[0]) > 2:
            name = m[0][2:].strip("{}")
            x = {"p": "P", "P": "p"}[x] if name.startswith("^") else x
            name = name.lstrip("^")
            return rf"\{x}{{{name if len(name) <= 2 else 'Is' + name}}}", "other"
        if x == "v":
            return r"\x0B", "other"
        if x == "z" and self.dialect == "re2" or x == "Z" and self.dialect == "python":
            return r"\z", "other"
        if x in "xuUanrtf0AB" or not x.isalnum():
            if x == "B":
                return f"(?:(?<!{self.word})(?!{self.word})|(?<={self.word})(?={self.word}))", "other"
            return m[0], "other"
        if x.isdigit() and self.dialect == "python":
            return m[0], "other"
        raise Refused(f"escape {m[0]}")

    def klass(self) -> tuple[str, bool]:
        self.i += 1
        out, words, complements = [], True, []  # complements: of which sets the class has all others
        negated = self.p.startswith("^", self.i)
        self.i += negated
        first, kinds = True, []  # of the items: a character or a set
        while first or not self.p.startswith("]", self.i):
            if self.i >= len(self.p):
                raise Refused("missing ]")
            first = False
            c = self.p[self.i]
            m = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i) if self.dialect == "re2" else None
            ranged = kinds[-1:] == ["-"] and kinds[-2:-1] == ["char"] and kinds[-3:-2] != ["-"]  # a range whose end comes now
            if m:
                if m[2] not in POSIX:
                    raise Refused(f"class {m[0]}")
                self.i = m.end()
                if m[1]:
                    complements.append(POSIX[m[2]])
                else:
                    out.append(POSIX[m[2]])
                words &= m[2] in ("alnum", "alpha", "digit", "lower", "upper", "word", "xdigit") and not m[1]
                kinds.append("set")
            elif c == "\\":
                got, kind = self.one()
                if got.startswith("^"):
                    complements.append(got[1:])
                else:
                    out.append(got)
                words &= kind in ("w", "d")
                kinds.append("set" if kind in ("w", "d", "set") or got[:2] in (r"\p", r"\P") else "char")
            else:
                self.i += 1
                if c == "-" and kinds and kinds[-1] == "set" and not self.p.startswith("]", self.i):
                    if self.dialect == "python":
                        raise Refused("a range that starts with a set")
                    c = r"\-"
                out.append("\\" + c if c in "[]&^~#" or c.isspace() and c == " " else c)
                words &= c.isascii() and (c.isalnum() or c == "_" or c == "-" and 1 < len(out) and not self.p.startswith("]", self.i))
                kinds.append("-" if c == "-" else "char")
            if ranged and kinds[-1] == "set":
                raise Refused("a range that ends with a set")
        self.i += 1
        if not complements:
            return f"[{'^' * negated}{''.join(out)}]", words and not negated
        if not negated:
            return f"[{''.join(out)}{''.join(f'[^{x}]' for x in complements)}]", False
        return "[" + "&&".join([*([f"[^{''.join(out)}]"] if out else []), *(f"[{x}]" for x in complements)]) + "]", False


def to_java(pattern: str, dialect: str = "re2") -> str:
    """re2: ASCII words and digits, only \\n ends a line, no vertical tab among spaces, $ only at the end, Unicode case folding. python: Unicode words, digits and spaces.

    Raises Refused for what the dialect itself refuses, such as look-arounds in RE2, and for the few forms Java cannot say.
    """
    return Reader(pattern, dialect).java()


def check(spark, patterns: list[str], dialect: str = "re2") -> dict[str, str]:
    """pattern -> error, for those that are refused; a rule with one is reported and skipped instead of failing the query."""
    bad = {}
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for p in dict.fromkeys(patterns):
        try:
            compile_(to_java(p, dialect))
        except Exception as e:  # noqa: BLE001  the gateway raises its own kinds
            bad[p] = re.sub(r"\s+", " ", str(e))[:200]
    return bad
