import xml.dom.minidom

import pytest

from tiermeter import charts, cli, config
from tiermeter.operators import calibrate


def test_ticks_cover_the_range():
    assert charts.ticks(0, 1) == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert charts.ticks(-3, 14) == [-5.0, 0.0, 5.0, 10.0, 15.0]
    for lo, hi in ((0.0, 0.0), (2.0, 2.0), (-1.0, -1.0), (1e-7, 3e-7), (12345.0, 99999.0)):
        got = charts.ticks(lo, hi)
        assert got[0] <= lo and got[-1] >= hi and 2 <= len(got) <= 12


def test_thinning_keeps_the_ends():
    for n, most in ((0, 5), (5, 5), (6, 5), (1000, 15), (3, 1)):
        got = charts.thin(range(n), most)
        assert len(got) <= most and (n < 1 or got[0] == 0) and (n < 1 or most < 2 or got[-1] == n - 1)


def test_charts_are_well_formed():
    curves = [charts.Curve("a<b & c", [(0.1, 0.2), (0.5, float("nan")), (0.9, 0.8)], "steps"), charts.Curve("one", [(0.3, 0.3)]), charts.Curve("d", [(0.2, 0.5), (0.4, 0.6)], "dots", [(0.4, 0.7), None]), charts.Curve("none", [])]
    page = charts.xy_chart(curves, "x & y", "<y>", diagonal=True)
    tree = xml.dom.minidom.parseString(page)
    assert len(tree.getElementsByTagName("circle")) == 3 and len(tree.getElementsByTagName("path")) == 1
    assert "nan" not in page and "a&lt;b &amp; c" in page
    assert charts.xy_chart([charts.Curve("none", [(None, 1.0)])], "x", "y") == ""
    long = charts.xy_chart([charts.Curve("long", [(k, k * k) for k in range(50_000)])], "x", "y")
    assert long.count("L") < charts.MOST_DRAWN + 10


def test_measures_of_a_tier(spark):
    rows = [(k / 100, k % 4 != 0) for k in range(100)] + [(None, True), (float("nan"), False)]
    pairs = spark.createDataFrame(rows, "score double, label boolean")
    m = calibrate.measures(pairs)
    good = [(s, y) for s, y in rows[:100]]
    assert (m["n"], m["missing"]) == (100, 2) and sum(b["n"] for b in m["reliability"]) == 100
    assert m["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in good) / 100)
    right, wrong = [s for s, y in good if y], [s for s, y in good if not y]
    assert m["auroc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in right for b in wrong) / len(right) / len(wrong))
    top = sorted(good, reverse=True)
    assert m["aurc"] == pytest.approx(sum(sum(not y for _, y in top[: i + 1]) / (i + 1) for i in range(100)) / 100)
    wide = calibrate.measures(spark.createDataFrame([(1.5, True), (0.2, False)], "score double, label boolean"))
    assert wide["ece"] is None and wide["brier"] is None and wide["reliability"] == [] and wide["auroc"] == 1.0
    none = calibrate.measures(pairs.limit(0))
    assert none["n"] == 0 and none["auroc"] is None
    got = calibrate.curve(pairs.where("score <= 1"), 10).orderBy("coverage").collect()
    assert len(got) == 10 and got[-1].coverage == 1.0 and got[-1].risk == pytest.approx(0.25)


def test_init_and_reports_of_evaluations(spark, tmp_path, capsys):
    path = str(tmp_path / "start.toml")
    assert cli.main(["init", path]) == cli.OK and cli.main(["init", path]) == cli.USAGE and cli.main(["init", path, "--force"]) == cli.OK
    assert [t.name for t in config.load(path).tiers] == ["fast", "slow"]
    book = f"file://{tmp_path}/book"
    assert cli.main(["demo", "--n", "150", "--ledger", book, "--run", "e", "--mode", "eval"], spark) == cli.OK
    assert cli.main(["report", "--ledger", book, "--run", "no", f"{tmp_path}/r.html"], spark) == cli.USAGE
    assert "the last ones are e" in capsys.readouterr().err
    for kind in ("html", "md", "txt"):
        assert cli.main(["report", "--ledger", book, f"{tmp_path}/r.{kind}"], spark) == cli.OK
    page = (tmp_path / "r.html").read_text()
    assert page.count("<svg") >= 3 and all(f"<h2>{t}</h2>" in page for t in ("Thresholds", "Calibration", "Risk and coverage"))
    for part in page.split("<svg")[1:]:
        xml.dom.minidom.parseString("<svg" + part.split("</svg>")[0] + "</svg>")
    assert "## Calibration" in (tmp_path / "r.md").read_text()
