import json
import xml.dom.minidom

import pytest

from tiermeter import cli, config, report
from tiermeter.operators import audit
from tiermeter.sources.ledger import Ledger


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('cli')}/book"
    assert cli.main(["demo", "--n", "120", "--ledger", path, "--run", "s"], spark) == cli.OK
    assert cli.main(["demo", "--n", "120", "--ledger", path, "--run", "e", "--mode", "eval"], spark) == cli.OK
    return path


def test_commands(spark, book, tmp_path, capsys):
    assert cli.main(["runs", "--ledger", book], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["audit", "--ledger", book, "--run", "s", "--tolerance", "0.0", "--json"], spark) in (cli.OK, cli.BREACH)
    assert json.loads(capsys.readouterr().out)["n_decisions"] == 120
    assert cli.main(["sweep", "--ledger", book, "--run", "e", "--most", "11"], spark) == 0
    assert json.loads(capsys.readouterr().out)["oracle"]["n"] == 120
    assert cli.main(["sweep", "--ledger", book, "--run", "s"], spark) == cli.USAGE
    assert cli.main(["calibrate", "--ledger", book, "--run", "e"], spark) == 0
    assert json.loads(capsys.readouterr().out[0:] or "{}")["points"]
    assert cli.main(["export", "--ledger", book, "--run", "s", f"file://{tmp_path}/out"], spark) == 0
    assert cli.main(["import", "--ledger", f"file://{tmp_path}/other", f"file://{tmp_path}/out"], spark) == 0
    assert cli.main(["audit", "--ledger", f"file://{tmp_path}/none"], spark) == cli.USAGE


def test_budget_stops(spark, tmp_path):
    args = ["demo", "--n", "20", "--ledger", f"file://{tmp_path}/b", "--budget", "1e-9"]
    assert cli.main(args, spark) == cli.OK and cli.main([*args, "--run", "run"], spark) == cli.STOPPED


def test_reports(spark, book, tmp_path):
    s = audit.summarize(Ledger(spark, book).decisions("s"), 0.1)
    page = report.as_html(s)
    xml.dom.minidom.parseString(report.bars([("a<b", s.escalation_rate)]))
    assert "<script" not in page and "Cascade audit" in page
    assert report.as_markdown(s).count("## ") >= 4 and "decisions" in report.as_text(s)
    report.write_report(s, f"{tmp_path}/r.md")
    with pytest.raises(ValueError):
        report.write_report(s, "r.doc")


def test_config(tmp_path):
    good = tmp_path / "a.toml"
    good.write_text('[run]\nid = "x"\n[[tiers]]\nname = "a"\nbackend = "simulated"\nthreshold = 0.5\n[[tiers]]\nname = "b"\nbackend = "simulated"\n[audit]\nrate = 0.2\nbands = [[0.0, 0.5, 1.0]]\n')
    c = config.load(str(good))
    assert c.run_id == "x" and [t.name for t in c.tiers] == ["a", "b"] and c.audit.bands == ((0.0, 0.5, 1.0),)
    for bad, said in (({"teirs": []}, "did you mean tiers"), ({"tiers": [{"name": "a", "backend": "simulated", "threshold": 0.1}]}, "threshold"), ({"tiers": [{"name": "a", "backend": "simulated", "options": {"api_key": "x"}}]}, "secrets")):
        with pytest.raises(config.ConfigError, match=said):
            config.parse(bad)
