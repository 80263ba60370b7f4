"""Query strings to a tree. Runs on the driver only, never per row.

Clauses carry MUST, SHOULD or MUST_NOT as the classic syntax defines: an AND marks both neighbours MUST, an OR under default AND
marks its left neighbour SHOULD. Bare words side by side are one text, so that analyzers that build word groups see them together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"


@dataclass
class Node:
    boost: float = field(default=1.0, kw_only=True)


@dataclass
class Text(Node):
    field: str | None
    text: str


@dataclass
class Phrase(Node):
    field: str | None
    text: str
    slop: int = 0


@dataclass
class Prefix(Node):
    field: str | None
    text: str


@dataclass
class Wildcard(Node):
    field: str | None
    text: str


@dataclass
class Regex(Node):
    field: str | None
    text: str


@dataclass
class Fuzzy(Node):
    field: str | None
    text: str
    edits: int = 2


@dataclass
class Range(Node):
    field: str | None
    low: str | None
    high: str | None
    include_low: bool
    include_high: bool


@dataclass
class Exists(Node):
    field: str | None


@dataclass
class MatchAll(Node):
    pass


@dataclass
class Bool(Node):
    clauses: list[tuple[str, Node]]
    mm: int = 0


class QueryError(ValueError):
    """The query string can't be read."""


TOKEN = re.compile(
    r"""\s*(?:
      (?P<op>AND\b|OR\b|NOT\b|&&|\|\||[+\-!()])
    | (?P<range>[\[{]\s*(?:"(?:[^"\\]|\\.)*"|[^\s\]}]+)\s+TO\s+(?:"(?:[^"\\]|\\.)*"|[^\s\]}]+)\s*[\]}])
    | (?P<phrase>"(?:[^"\\]|\\.)*")
    | (?P<regex>/(?:[^/\\]|\\.)*/)
    | (?P<field>(?:[^\s:()\[\]{}"/^~+\-!*?\\]|\\.)(?:[^\s:()\[\]{}"/^~\\]|\\.)*:(?=\S))
    | (?P<all>\*:\*)
    | (?P<word>(?:[^\s:()\[\]{}"^~\\]|\\.|:(?!\s|$))+)
    )""",
    re.X,
)
SUFFIX = re.compile(r"~(?P<tilde>[\d.]*)|\^(?P<boost>[\d.]+)")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class Parser:
    def __init__(self, query: str, default_and: bool = False, mm: int = 0):
        self.s, self.at, self.default_and, self.mm = query, 0, default_and, mm

    def parse(self) -> Node:
        if not self.s.strip():
            return MatchAll()
        out = self._clauses(None, False)
        if self.s[self.at :].strip():
            raise QueryError(f"can't read {self.s[self.at :]!r}")
        return out

    def _peek(self) -> re.Match | None:
        return TOKEN.match(self.s, self.at)

    def _clauses(self, field_name: str | None, nested: bool) -> Node:
        clauses: list[tuple[str, Node]] = []
        joined = modifier = None
        bare = False  # whether the last clause is a bare text that a following word may join
        while True:
            if not self.s[self.at :].strip():
                if nested:
                    raise QueryError("a closing parenthesis is missing")
                break
            m = self._peek()
            if not m:
                raise QueryError(f"can't read {self.s[self.at :]!r}")
            op = m["op"]
            if op == ")":
                if not nested:
                    raise QueryError("a closing parenthesis has no opening one")
                self.at = m.end()
                break
            if op in ("AND", "&&", "OR", "||"):
                joined, self.at, bare = ("AND" if op in ("AND", "&&") else "OR"), m.end(), False
                continue
            if op in ("+", "-", "!", "NOT"):
                modifier, self.at, bare = ("+" if op == "+" else "-"), m.end(), False
                continue
            node = self._clause(field_name)
            if bare and joined is None and modifier is None and isinstance(node, Text) and node.boost == 1.0 and node.field == clauses[-1][1].field == field_name and m["field"] is None:
                clauses[-1][1].text += " " + node.text
                continue
            self._add(clauses, node, joined, modifier)
            bare = isinstance(node, Text) and node.boost == 1.0 and modifier is None and m["field"] is None
            joined = modifier = None
        if joined or modifier:
            raise QueryError("the query ends with an operator")
        if len(clauses) == 1 and clauses[0][0] != MUST_NOT:
            return clauses[0][1]
        return Bool(clauses, self.mm)

    def _add(self, clauses: list[tuple[str, Node]], node: Node, joined: str | None, modifier: str | None) -> None:
        if clauses and joined == "AND" and clauses[-1][0] != MUST_NOT:
            clauses[-1] = (MUST, clauses[-1][1])
        if clauses and self.default_and and joined == "OR" and clauses[-1][0] != MUST_NOT:
            clauses[-1] = (SHOULD, clauses[-1][1])
        if modifier == "-":
            occur = MUST_NOT
        elif self.default_and:
            occur = SHOULD if joined == "OR" and modifier != "+" else MUST
        else:
            occur = MUST if modifier == "+" or joined == "AND" else SHOULD
        clauses.append((occur, node))

    def _clause(self, field_name: str | None) -> Node:
        m = self._peek()
        if m and m["field"]:
            field_name, self.at = unescape(m["field"][:-1]), m.end()
            m = self._peek()
        if not m:
            raise QueryError(f"can't read {self.s[self.at :]!r}")
        self.at = m.end()
        if m["op"] == "(":
            node: Node = self._clauses(field_name, True)
        elif m["all"]:
            node = MatchAll()
        elif m["phrase"]:
            node = Phrase(field_name, unescape(m["phrase"][1:-1]))
        elif m["regex"]:
            node = Regex(field_name, m["regex"][1:-1].replace(r"\/", "/"))
        elif m["range"]:
            text = m["range"]
            ends = re.match(r'[\[{]\s*("(?:[^"\\]|\\.)*"|\S+)\s+TO\s+("(?:[^"\\]|\\.)*"|[^\s\]}]+)\s*[\]}]', text)
            low, high = (unescape(x[1:-1] if x[0] == '"' else x) for x in ends.groups())
            node = Range(field_name, None if low == "*" else low, None if high == "*" else high, text[0] == "[", text[-1] == "]")
        elif m["word"]:
            node = self._word(field_name, m["word"])
        else:
            raise QueryError(f"can't read {m[0]!r}")
        while s := SUFFIX.match(self.s, self.at):
            self.at = s.end()
            if s["boost"]:
                try:
                    node.boost *= float(s["boost"])
                except ValueError as e:
                    raise QueryError(f"bad boost {s['boost']!r}") from e
            elif isinstance(node, Phrase):
                node.slop = int(float(s["tilde"] or 0))
            elif isinstance(node, Text):
                node = Fuzzy(node.field, node.text, min(2, int(float(s["tilde"]))) if s["tilde"] else 2)
            else:
                raise QueryError("~ follows a word or a phrase only")
        return node

    @staticmethod
    def _word(field_name: str | None, raw: str) -> Node:
        if raw == "*":
            return Exists(field_name)
        plain = re.sub(r"\\.", "", raw)
        if re.fullmatch(r"[^*?]+\*", plain):
            return Prefix(field_name, unescape(raw[:-1]))
        if "*" in plain or "?" in plain:
            return Wildcard(field_name, raw)
        return Text(field_name, unescape(raw))


def parse(query: str, default_and: bool = False, mm: int = 0) -> Node:
    return Parser(query, default_and, mm).parse()
