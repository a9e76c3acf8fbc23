"""Confidence in model replies: lines that state one, and remarks at the ends of lines.

A line is read as tokens (numbers, words, single signs), and a small grammar over
them tells what is a statement of confidence.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Words of the grammar.
LABELS = ("confidence", "conf")
OWNERS = ("my", "final", "overall", "estimated")
LEVELS = ("high", "medium", "low")
KINDS = ("level", "score")
DASHES = ("-", "–", "—")
#: How far behind its label a colon or equals sign may stand.
REACH = 25


class Token(NamedTuple):
    sort: str  # number, word or sign
    text: str  # in lower case
    start: int
    end: int


_LEXEME = re.compile(r"(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[^\W\d_]+)|(?P<sign>\S)")
NOTHING = Token("", "", -1, -1)


def tokens(line: str) -> list[Token]:
    return [Token(m.lastgroup or "", m.group().lower(), *m.span()) for m in _LEXEME.finditer(line)]


class Reader:
    """A place in a list of tokens, moving forwards or (``step`` -1) backwards."""

    def __init__(self, items: list[Token], at: int = 0, step: int = 1):
        self.items, self.at, self.step = items, at, step

    @property
    def now(self) -> Token:
        return self.items[self.at] if 0 <= self.at < len(self.items) else NOTHING

    def move(self) -> None:
        self.at += self.step

    def one(self, *texts: str) -> bool:
        if self.now.text in texts:
            self.move()
            return True
        return False

    def many(self, *texts: str) -> None:
        while self.one(*texts):
            pass

    def number(self) -> bool:
        if self.now.sort == "number":
            self.move()
            return True
        return False


def is_confidence_line(line: str) -> bool:
    """Does the line report a confidence, and nothing else of use?"""
    r = Reader(tokens(line))
    r.many(*">#*_-`")
    for _ in range(2):
        if r.one("self"):
            r.one("-")
            if not r.one("reported"):
                return False
        else:
            r.one(*OWNERS)
    label = r.now
    if not r.one(*LABELS) or r.now.start == label.end and r.now.sort == "number":
        return False
    if any(t.text in (":", "=") and t.start - label.end <= REACH for t in r.items[r.at :]):
        return True
    r.one(".")
    r.many("*", "_")
    r.one(*KINDS)
    r.many("*", "_")
    if r.one(*DASHES):
        r.many("*", "_")
        return r.now.sort == "number" or r.now.text in LEVELS
    r.one("of")
    return r.now.sort == "number"


def _value(r: Reader) -> bool:
    """Backwards over one value: a level, a number, a percentage or a ratio."""
    if r.one(*LEVELS):
        return True
    percent = r.one("%")
    if not r.number():
        return False
    if not percent and r.now.text == "/":
        r.move()
        r.one("%")
        return r.number()
    return True


def _labelled(r: Reader) -> bool:
    """Backwards over a label with its value."""
    r.many("*", "_")
    if not _value(r):
        return False
    r.many("*", "_")
    r.one(":", "=", *DASHES) or r.one("of")
    r.many("*", "_")
    r.one(*KINDS)
    r.one(".")
    return r.one(*LABELS)


def _counted(r: Reader) -> str:
    """Backwards over ``90% confidence`` or the like: what must stand before it."""
    noun = r.now.text
    if not r.one("confidence", "confident", "certainty"):
        return ""
    percent = r.one("%")
    if not r.number():
        return ""
    at = r.at
    r.one("a")
    if noun != "confident" and r.one("with"):
        return "anything"
    r.at = at
    if not percent or noun == "certainty":
        return ""
    if r.one("m"):
        r.many("'", "’")
        r.one("i")
    elif r.one("am"):
        r.one("i")
    elif r.now.text == "im":
        r.move()
    r.one("and")
    return "separator"


def remark_start(line: str) -> int | None:
    """Where a remark begins that ends the line and holds one confidence; None without one."""
    items = tokens(line)
    last = len(items) - 1
    while last >= 0 and items[last].text == ".":
        last -= 1
    if last >= 0 and items[last].text in (")", "]"):
        last -= 1
    for read in (_labelled, _counted):
        r = Reader(items, last, -1)
        found = read(r)
        if not found:
            continue
        r.many("*", "_")
        first = items[r.at + 1]
        before = r.now
        spaced = first.start == 0 or line[first.start - 1].isspace()
        if before.text in (",", ";", "|", "(", "["):
            return before.start
        if before.text in DASHES and spaced and (before.start == 0 or line[before.start - 1].isspace()):
            return before.start
        if found != "separator" and spaced:
            return first.start
    return None


def without_remark(line: str) -> str:
    start = remark_start(line)
    return line if start is None else line[:start].rstrip()


def remove_confidence(text: str) -> str:
    """Without confidence lines, and without confidence remarks at the ends of the others."""
    return "\n".join(without_remark(x) for x in text.splitlines() if not is_confidence_line(x))
