"""A run's summary as text, Markdown or a page of HTML, from sections that all forms share."""

from __future__ import annotations

import html
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.charts import Curve, thin, xy_chart
from tiermeter.functions.stats import Estimate, wilson
from tiermeter.operators import calibrate, sweep
from tiermeter.operators.audit import Summary

Row = tuple[str, ...]
#: Rows of the frontier that a table shows, at most.
MOST_FRONTIER = 15


class Section(NamedTuple):
    title: str
    header: Row
    rows: list[Row]
    chart: str = ""  # SVG, for pages


def percent(e: Estimate | None) -> str:
    if e is None or e.value is None:
        return "unknown"
    span = "" if e.lo is None or e.hi is None else f" ({e.lo:.1%} to {e.hi:.1%})"
    return f"{e.value:.1%}{span}"


def money(v: float | None) -> str:
    return "unknown" if v is None else f"${v:,.2f}" if abs(v) >= 1 else f"${v:.4g}"


def sections(s: Summary) -> list[Section]:
    """The audit's sections."""
    head = [
        ("run", str(s.run_id)), ("mode", s.mode), ("decisions", f"{s.n_decisions:,}"), ("failed", f"{s.n_errors:,}"), ("escalated", percent(s.escalation_rate)), ("skipped cases", f"{s.n_skipped:,}"), ("audited", f"{s.n_audited:,}"),
        ("disagreement", percent(s.disagreement)), ("error of skipped cases", percent(s.skipped_error)), ("accuracy served", percent(s.served_accuracy)), ("status", s.status + ("" if s.tolerance is None else f" at a tolerance of {s.tolerance:.1%}")),
    ]
    if s.audits_to_resolve:
        head.append(("audits until it is settled", f"{s.audits_to_resolve:,}"))
    costs = [("serving", money(s.cost_serving)), ("audits", money(s.cost_audit)), ("a task", money(s.cost_per_task)), (f"a task, always {s.reference_tier}", money(s.est_all_slow_cost_per_task.value if s.est_all_slow_cost_per_task else None)), ("saving", percent(s.est_savings))]
    bins = [(b.label, f"{b.n_cases:,}", f"{b.n_audited:,}", percent(b.disagreement) if b.n_audited else "", percent(b.error) if b.error else "") for b in [*s.bins, *([s.no_score_bin] if s.no_score_bin else [])]]
    chart = bars([(b.label, b.disagreement if b.n_audited else None) for b in s.bins])
    return [
        Section("Audit", ("figure", "value"), head), Section("Tiers", ("tier", "served"), [(t, f"{s.tier_share.get(t, 0):,}") for t in s.tiers]),
        Section("Costs", ("cost", "value"), costs), Section("By confidence", ("confidence", "cases", "audits", "disagreement", "error"), bins, chart), Section("Notes", ("note",), [(n,) for n in s.notes]),
    ]


def figure(v: float | None) -> str:
    return "unknown" if v is None else f"{v:.3f}"


def eval_sections(decisions: DataFrame, tiers: Sequence[str], most: int = sweep.MOST_GRID) -> list[Section]:
    """What an evaluation run adds: the thresholds worth having, and how far each gated tier's scores can be trusted.

    All that reaches the driver has a fixed bound: ``sweep.MOST_POINTS`` points, bins, and 200 points of a curve.
    """
    if len(tiers) < 2:
        return []
    gated = len(tiers) - 1
    rows = sweep.items(decisions, tiers)
    each = min(most, sweep.joint_cap(gated) - 2)
    grids = [sweep.default_grid(rows, f"s{j}", each) for j in range(1, gated + 1)]
    names = [f"t{j}" for j in range(1, gated + 1)]
    table = sweep.points(rows, grids).withColumn("accuracy", F.try_divide("correct", "n"))
    best = sorted(sweep.frontier(table, order=names).collect(), key=lambda r: r.cost_per_task)
    alone = sweep.baselines(rows, tiers).collect()
    shown = [(*(f"{r[t]:.4g}" for t in names), money(r.cost_per_task), f"{r.accuracy:.1%}", f"{r.escalated / r.n:.1%}") for r in thin(best, MOST_FRONTIER)]
    dots = [(r.cost_per_task, r.correct / r.n) for r in alone if r.n and r.cost_per_task is not None]
    chart = xy_chart([Curve("thresholds", [(r.cost_per_task, r.accuracy) for r in best], "steps"), Curve("one tier alone", dots, "dots")], "cost of a task", "accuracy", money, "{:.1%}".format)
    out = [Section("Thresholds", (*names, "cost of a task", "accuracy", "escalated"), shown, chart)]
    found, trust, risk = [], [], []
    for j, tier in enumerate(tiers[:-1], start=1):
        pairs = rows.select(F.col(f"s{j}").alias("score"), F.col(f"ok{j}").alias("label"))
        m = calibrate.measures(pairs)
        found.append((tier, f"{m['n']:,}", f"{m['missing']:,}", *(figure(m[k]) for k in ("ece", "brier", "auroc", "aurc"))))
        full = [b for b in m["reliability"] if b["n"]]
        spans = [(e.lo, e.hi) for e in (wilson(b["k"], b["n"]) for b in full)]
        trust.append(Curve(tier, [(b["mean_score"], b["accuracy"]) for b in full], "dots", spans))
        if m["n"]:
            known = pairs.where("score is not null")
            risk.append(Curve(tier, [(r.coverage, r.risk) for r in calibrate.curve(known).orderBy("coverage").collect()]))
    share = "{:.0%}".format
    out.append(Section("Calibration", ("tier", "scores", "missing", "ECE", "Brier", "AUROC", "AURC"), found, xy_chart(trust, "confidence", "accuracy", show_y=share, diagonal=True)))
    out.append(Section("Risk and coverage", (), [], xy_chart(risk, "share of cases kept, by confidence", "error rate", share, share)))
    return out


def _columns(rows: Sequence[Row]) -> list[int]:
    return [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]


def as_text(s: Summary, more: Sequence[Section] = ()) -> str:
    out = []
    for title, header, rows, _ in [*sections(s), *more]:
        if rows:
            wide = _columns([header, *rows])
            out += [title, "-" * len(title), *("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in ([header, *rows] if len(header) > 2 else rows)), ""]
    return "\n".join(out)


def as_markdown(s: Summary, more: Sequence[Section] = ()) -> str:
    out = []
    for title, header, rows, _ in [*sections(s), *more]:
        if rows:
            line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
            out += [f"## {title}", "", line(header), line(("---",) * len(header)), *map(line, rows), ""]
    return "\n".join(out)


def bars(points: Sequence[tuple[str, Estimate | None]], width: int = 560) -> str:
    """An SVG of proportions with their intervals."""
    known = [(n, e) for n, e in points if e and e.value is not None]
    if not known:
        return ""
    top = max(e.hi if e.hi is not None else e.value for _, e in known) or 1
    scale = (width - 180) / top
    lines = []
    for i, (name, e) in enumerate(known):
        y = 12 + 24 * i
        lines.append(f'<text x="110" y="{y + 10}" text-anchor="end">{html.escape(name)}</text><rect x="120" y="{y}" width="{e.value * scale:.1f}" height="12" fill="#4878a8"/>')
        if e.lo is not None and e.hi is not None:
            lines.append(f'<line x1="{120 + e.lo * scale:.1f}" x2="{120 + e.hi * scale:.1f}" y1="{y + 6}" y2="{y + 6}" stroke="#222"/>')
        lines.append(f'<text x="{126 + (e.hi or e.value) * scale:.1f}" y="{y + 10}">{e.value:.1%}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(known) + 16}" font-family="sans-serif" font-size="11">{"".join(lines)}</svg>'


def as_html(s: Summary, more: Sequence[Section] = ()) -> str:
    cell = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
    parts = []
    for title, header, rows, chart in [*sections(s), *more]:
        if rows or chart:
            table = f"<table>{cell(header, 'th')}{''.join(cell(r, 'td') for r in rows)}</table>" if rows else ""
            parts.append(f"<h2>{html.escape(title)}</h2>{table}{chart}")
    policy = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\">"
    style = "<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}</style>"
    return f"<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\">{policy}<title>{html.escape(str(s.run_id))}</title>{style}</head><body><h1>Cascade audit</h1>{''.join(parts)}</body></html>"


FORMS = {"html": as_html, "htm": as_html, "md": as_markdown, "txt": as_text}


def write_report(s: Summary, path: str, more: Sequence[Section] = ()) -> None:
    """The form follows the file's suffix; ``more`` sections come last."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMS:
        raise ValueError(f"{path}: reports end in .{', .'.join(FORMS)}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(FORMS[kind](s, more))
