"""Markdown and LaTeX around answers taken off."""

from __future__ import annotations

import re

# Commands that only wrap their content, and those that mark a result.
WRAPPERS = ("boxed", "fbox", "text", "textbf", "textit", "mathrm", "mathbf", "mbox", "emph")
RESULTS = ("boxed", "fbox")
# What may enclose a whole answer.
ENCLOSING = (("$$", "$$"), ("$", "$"), ("\\(", "\\)"), ("\\[", "\\]"), ("*", "*"), ("_", "_"))
# Escapes and what they stand for.
ESCAPES = {"\\%": "%", "\\$": "$", "\\,": "", "\\!": ""}
MOST_LAYERS = 20

_COMMAND = re.compile(r"\\([A-Za-z]+)\s*\{")


def closings(text: str) -> dict[int, int]:
    """The closing brace of each opening one that has one."""
    out, open_at = {}, []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            out[open_at.pop()] = m.start()
    return out


def boxed(text: str) -> list[str]:
    """Contents of the outermost result groups in order, up to one that isn't closed."""
    close, out, free = closings(text), [], 0
    for m in _COMMAND.finditer(text):
        if m.group(1) in RESULTS and m.start() >= free:
            end = close.get(m.end() - 1)
            if end is None:
                break
            out.append(text[m.end() : end])
            free = end + 1
    return out


def unwrapped(text: str) -> str:
    """Wrapping commands replaced by their contents; one that isn't closed loses its head."""
    if "\\" not in text:
        return text
    close, gone = closings(text), []
    for m in _COMMAND.finditer(text):
        if m.group(1) in WRAPPERS:
            gone.append(m.span())
            if (end := close.get(m.end() - 1)) is not None:
                gone.append((end, end + 1))
    return _without(text, sorted(gone))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = max(at, z)
    return "".join([*out, text[at:]])


def fractions(text: str) -> str:
    r"""``\frac{a}{b}`` as ``a/b`` where neither part has braces."""
    if "frac" not in text:
        return text
    close, out, at = closings(text), [], 0
    for m in _COMMAND.finditer(text):
        first = close.get(m.end() - 1)
        if m.group(1) not in ("frac", "dfrac", "tfrac") or m.start() < at or first is None:
            continue
        second = first + 1 + len(text[first + 1 :]) - len(text[first + 1 :].lstrip())
        if text[second : second + 1] != "{" or second not in close:
            continue
        parts = [text[m.end() : first].strip(), text[second + 1 : close[second]].strip()]
        if all(p and not set(p) & set("{}") for p in parts):
            out += [text[at : m.start()], "/".join(parts)]
            at = close[second] + 1
    return "".join([*out, text[at:]])


def _peeled(s: str) -> str:
    s = fractions(unwrapped(s.strip()))
    for left, right in ENCLOSING:
        inner = s[len(left) : len(s) - len(right)]
        if inner and s.startswith(left) and s.endswith(right) and left not in inner:
            s = inner.strip()
    s = s.replace("`", "")
    if s.count("**") % 2 == 0:
        s = s.replace("**", "")
    s = s.removeprefix("**").removesuffix("**").strip()
    for escape, plain in ESCAPES.items():
        s = s.replace(escape, plain)
    return s[:-1].rstrip() if s.endswith(".") and not s.endswith("..") else s


def strip_markup(s: str) -> str:
    """Layers of decoration and a final period taken off until nothing changes."""
    for _ in range(MOST_LAYERS):
        before, s = s, _peeled(s)
        if s == before:
            break
    return s
