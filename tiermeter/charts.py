"""Small SVG charts of rows that fit on the driver: lines, dots and intervals over two axes."""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

#: Points that one curve draws at most; more are thinned by even rank.
MOST_DRAWN = 2000
COLOURS = ("#0072b2", "#d55e00", "#009e73", "#cc79a7", "#7a5c00")

Point = tuple[float, float]


@dataclass(frozen=True)
class Curve:
    """``spans`` are intervals of y, one for each point or None."""

    name: str
    points: Sequence[Point]
    kind: str = "line"  # or steps, dots
    spans: Sequence[tuple[float, float] | None] = ()


def thin(rows: Sequence, most: int) -> list:
    """At most ``most`` rows, evenly by rank, with the first and the last."""
    n = len(rows)
    if n <= most:
        return list(rows)
    if most < 2:
        return list(rows[:most])
    return [rows[i] for i in sorted({round(k * (n - 1) / (most - 1)) for k in range(most)})]


def ticks(lo: float, hi: float, about: int = 5) -> list[float]:
    """Round numbers that cover [lo, hi]: steps of 1, 2 or 5 times a power of ten."""
    if not hi > lo:
        hi = lo + (abs(lo) or 1.0)
    rough = (hi - lo) / about
    ten = 10.0 ** math.floor(math.log10(rough))
    step = next(m * ten for m in (1, 2, 5, 10) if m * ten >= rough * (1 - 1e-9))
    first, last = math.floor(lo / step + 1e-9), math.ceil(hi / step - 1e-9)
    return [float(f"{k * step:.12g}") for k in range(first, last + 1)]


def _drawable(c: Curve) -> list[tuple[float, float, tuple[float, float] | None]]:
    spans = c.spans or [None] * len(c.points)
    rows = [(float(x), float(y), s) for (x, y), s in zip(c.points, spans, strict=True) if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    return thin(rows, MOST_DRAWN)


def xy_chart(curves: Sequence[Curve], x_label: str, y_label: str, show_x: Callable[[float], str] = "{:g}".format, show_y: Callable[[float], str] = "{:g}".format, diagonal: bool = False, size: tuple[int, int] = (560, 320)) -> str:
    """An SVG with a legend. Points without finite values are left out; no points at all give an empty text."""
    drawn = [(c, rows) for c in curves if (rows := _drawable(c))]
    if not drawn:
        return ""
    every = [r for _, rows in drawn for r in rows]
    xs = ticks(min(r[0] for r in every), max(r[0] for r in every))
    ys = ticks(min(min(r[1], *(r[2] or ())) if r[2] else r[1] for r in every), max(max(r[1], *r[2]) if r[2] else r[1] for r in every))
    width, height = size
    left, right, top, bottom = 64, width - 16, 12 + 16 * len(drawn), height - 44

    def at_x(v: float) -> float:
        return left + (v - xs[0]) / (xs[-1] - xs[0]) * (right - left)

    def at_y(v: float) -> float:
        return bottom - (v - ys[0]) / (ys[-1] - ys[0]) * (bottom - top)

    out = []
    for v in xs:
        out.append(f'<line x1="{at_x(v):.1f}" x2="{at_x(v):.1f}" y1="{top}" y2="{bottom}" stroke="#e4e4e4"/><text x="{at_x(v):.1f}" y="{bottom + 15}" text-anchor="middle">{html.escape(show_x(v))}</text>')
    for v in ys:
        out.append(f'<line x1="{left}" x2="{right}" y1="{at_y(v):.1f}" y2="{at_y(v):.1f}" stroke="#e4e4e4"/><text x="{left - 6}" y="{at_y(v) + 4:.1f}" text-anchor="end">{html.escape(show_y(v))}</text>')
    out.append(f'<text x="{(left + right) / 2:.1f}" y="{height - 8}" text-anchor="middle">{html.escape(x_label)}</text><text x="14" y="{(top + bottom) / 2:.1f}" text-anchor="middle" transform="rotate(-90 14 {(top + bottom) / 2:.1f})">{html.escape(y_label)}</text>')
    if diagonal:
        a, z = max(xs[0], ys[0]), min(xs[-1], ys[-1])
        if z > a:
            out.append(f'<line x1="{at_x(a):.1f}" y1="{at_y(a):.1f}" x2="{at_x(z):.1f}" y2="{at_y(z):.1f}" stroke="#888" stroke-dasharray="4 3"/>')
    for i, (c, rows) in enumerate(drawn):
        colour = COLOURS[i % len(COLOURS)]
        out.append(f'<rect x="{left}" y="{4 + 16 * i}" width="10" height="10" fill="{colour}"/><text x="{left + 16}" y="{13 + 16 * i}">{html.escape(c.name)}</text>')
        for x, _, span in rows:
            if span:
                out.append(f'<line x1="{at_x(x):.1f}" x2="{at_x(x):.1f}" y1="{at_y(span[0]):.1f}" y2="{at_y(span[1]):.1f}" stroke="{colour}"/>')
        if c.kind == "dots" or len(rows) == 1:
            out += [f'<circle cx="{at_x(x):.1f}" cy="{at_y(y):.1f}" r="3" fill="{colour}"/>' for x, y, _ in rows]
            continue
        path = [f"M{at_x(rows[0][0]):.1f} {at_y(rows[0][1]):.1f}"]
        path += [(f"H{at_x(x):.1f}V{at_y(y):.1f}" if c.kind == "steps" else f"L{at_x(x):.1f} {at_y(y):.1f}") for x, y, _ in rows[1:]]
        out.append(f'<path d="{"".join(path)}" fill="none" stroke="{colour}" stroke-width="1.5"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11" role="img">{"".join(out)}</svg>'
