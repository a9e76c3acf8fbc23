"""Column builders for predicates, decision fields and confidence scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNUSABLE = ("refusal", "error", "max_tokens")


def finite(score: Column) -> Column:
    """The score, or null for NaN."""
    return F.when(~F.isnan(score), score)


def accepts(score: Column, threshold: Column) -> Column:
    """Is the score at or above the threshold; nulls and NaN never are."""
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


def unusable(stop_reason: Column, answer: Column) -> Column:
    return F.coalesce(stop_reason.isin(*UNUSABLE), F.lit(False)) | (F.coalesce(F.trim(answer), F.lit("")) == "")


def render(template: str, prompt: Column) -> Column:
    """Every ``{prompt}`` in the template replaced."""
    return F.replace(F.lit(template), F.lit("{prompt}"), prompt)


def served_attempt(attempts: Column, final_tier: Column) -> Column:
    """The accepted attempt without error of the serving tier, else that tier's last attempt."""
    of_tier = F.filter(attempts, lambda a: a["tier"] == final_tier)
    good = F.filter(of_tier, lambda a: a["accepted"] & a["error"].isNull())
    return F.coalesce(F.get(good, F.lit(0)), F.get(of_tier, F.size(of_tier) - 1))


def last_good_attempt(attempts: Column) -> Column:
    """What is served when the final tier failed: the last attempt without error."""
    good = F.filter(attempts, lambda a: a["error"].isNull())
    return F.get(good, F.size(good) - 1)


def sum_or_null(values: Column) -> Column:
    """The sum of an array, null if any item is null: an unknown cost stays unknown."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def attempt_cost(attempt: Column) -> Column:
    """The model call plus its confidence calls; null if any is unknown."""
    calls = F.coalesce(F.transform(attempt["confidence"]["calls"], lambda c: c["cost_usd"]), F.array().cast("array<double>"))
    return attempt["completion"]["cost_usd"] + sum_or_null(calls)


# --- confidence ---------------------------------------------------------------

_STRIP = " \t\r\n*_`\"'()[]<>:="
_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}


def confidence_value(raw: Column, words: bool = False) -> Column:
    """A confidence as written: percent, ratio, comma decimal, fraction, or whole percent.

    A bare number up to 1 stands as it is, a whole one up to 100 is a percentage,
    anything else is unknown. One remark in brackets may follow. Results are
    clamped to [0, 1].
    """
    value = F.regexp_replace(raw, r"[,\s]*\([^()]*\)[.\s]*$", "")
    s = F.lower(F.regexp_replace(F.btrim(value, F.lit(_STRIP)), r"[.\s]+$", ""))
    s = F.btrim(s, F.lit(_STRIP))
    number = r"(\d+(?:\.\d*)?|\.\d+)"

    def part(pattern: str, k: int = 1) -> Column:
        return F.regexp_extract(s, pattern, k).try_cast("double")

    percent, ratio = rf"^{number}\s*(?:%|percent)$", rf"^{number}\s*(?:/|out of)\s*{number}$"
    comma, plain = r"^(0),(\d+)$", rf"^{number}$"
    value = (
        F.when(s.rlike(percent), part(percent) / 100)
        .when(s.rlike(ratio), F.try_divide(part(ratio, 1), part(ratio, 2)))
        .when(s.rlike(comma), F.concat(F.lit("0."), F.regexp_extract(s, comma, 2)).try_cast("double"))
        .when(s.rlike(plain), F.when(part(plain) <= 1, part(plain)).when(s.rlike(r"^\d+$") & (part(plain) <= 100), part(plain) / 100))
    )
    if words:
        for word, v in _WORDS.items():
            value = F.when(s == word, F.lit(v)).otherwise(value)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


#: A line's decoration, an owner, the label, and a separator; a dash only before a number.
_SAYS = r"(?imd)^[\s>#*_\-`]*(?:(?:my|final|overall) +)?confidence(?: +(?:level|score))?"
_PROBABLY = r"(?imd)^[\s>#*_\-`]*p *\( *correct *\)"
_THEN = r"[ \t*_]*(?:[:=]|[-–—](?=[ \t*_]*[\d.]))[ \t*_]*([^\n]*)$"


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def verbal_confidence(text: Column, monitor: bool = False, words: bool = False) -> Column:
    """The value of the last line that states a confidence; a monitor may also call it P(correct)."""
    label = rf"(?:{_SAYS}|{_PROBABLY})" if monitor else _SAYS
    return confidence_value(last_match(text, label + _THEN), words)


def logprob_confidence(logprobs: Column, method: str = "mean") -> Column:
    """mean: mean of exp; min: exp of the least; geo_mean: exp of the mean. NaN or nothing is unknown."""
    n = F.size(logprobs)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    if method == "mean":
        value = total(F.transform(logprobs, lambda x: F.exp(x))) / n
    elif method == "min":
        value = F.exp(F.array_min(logprobs))
    elif method == "geo_mean":
        value = F.exp(total(logprobs) / n)
    else:
        raise ValueError(f"unknown method {method!r}; known: mean, min, geo_mean")
    bad = F.exists(logprobs, lambda x: F.isnan(x))
    return F.when((n > 0) & ~F.coalesce(bad, F.lit(True)) & ~F.isnan(value), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def combined(scores: Sequence[Column], method: str = "mean", weights: Sequence[float] | None = None, ignore_missing: bool = False) -> Column:
    """Scores put together; any unknown one makes the result unknown unless ``ignore_missing``."""
    if method == "weighted" and (weights is None or len(weights) != len(scores)):
        raise ValueError("weighted needs one weight for each score")
    if method not in ("mean", "min", "max", "weighted"):
        raise ValueError(f"unknown method {method!r}; known: mean, min, max, weighted")
    known = [finite(s) for s in scores]
    every = known[0].isNotNull()
    for s in known[1:]:
        every = every & s.isNotNull()
    if method in ("min", "max"):
        value = (F.least if method == "min" else F.greatest)(*known) if len(known) > 1 else known[0]
    else:
        w = [1.0] * len(known) if method == "mean" else list(weights or ())
        top = F.lit(0.0)
        mass = F.lit(0.0)
        for s, x in zip(known, w, strict=True):
            top = top + F.coalesce(s * F.lit(float(x)), F.lit(0.0))
            mass = mass + F.when(s.isNotNull(), F.lit(float(x))).otherwise(F.lit(0.0))
        value = F.try_divide(top, mass)
    return value if ignore_missing else F.when(every, value)


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation between points in ascending x, constant beyond the ends."""
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)) or not points:
        raise ValueError("points need strictly rising x")
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull() & ~F.isnan(x), out.otherwise(F.lit(float(points[-1][1]))))


def verdict(text: Column) -> Column:
    """True for the last ``VERDICT: EQUIVALENT``, false for another verdict, null without one."""
    word = F.lower(last_match(text, r"(?i)verdict\s*[*_]*\s*[:=\-]?\s*[*_`\"'\[]*\s*(not[\s_-]+equivalent|non[\s_-]?equivalent|equivalent|different)\b"))
    return word == "equivalent"


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


# --- simulator primitives --------------------------------------------------------


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def noise(*parts: Column) -> Column:
    """A number in (0, 1) from SHA-256 of the parts joined by bars."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / F.lit(float(1 << 64))


def apply_ops(start: Column, ops: Column) -> Column:
    """Left fold of arithmetic steps, an array of (op, value) structs. A division that doesn't come out even is an error, and so is one by zero."""

    def failed(what: str, acc: Column, x: Column) -> Column:
        return F.raise_error(F.format_string(f"%.17g {what} %.17g: not a whole result", acc, x["value"].cast("double"))).cast("double")

    def step(acc: Column, x: Column) -> Column:
        op, value = x["op"], x["value"].cast("double")
        even = (value != 0) & (F.try_mod(acc, value) == 0)
        return (
            F.when(op == "add", acc + value).when(op == "sub", acc - value).when(op == "mul", acc * value)
            .when(op == "div", F.when(F.coalesce(even, acc.isNull() | value.isNull()), F.try_divide(acc, value)).otherwise(failed("div", acc, x)))
            .when(op == "floordiv", F.when(F.coalesce(value != 0, F.lit(True)), F.floor(F.try_divide(acc, value)).cast("double")).otherwise(failed("floordiv", acc, x)))
        )

    return F.aggregate(ops, start.cast("double"), step)
