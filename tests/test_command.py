"""The command line on a small tree."""

from __future__ import annotations

import factloom
from factloom.__main__ import main


def test_scan_command(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("from flask import Flask, request, redirect\napp = Flask(__name__)\n\n@app.get('/go')\ndef go():\n    return redirect(request.args['to'])\n")
    code = main(["scan", str(tmp_path / "src"), "--include", "input*", "--fail-on", "medium", "--json", str(tmp_path / "j"), "--sarif", str(tmp_path / "s"), "--baseline", str(tmp_path / "b")], spark)
    out = capsys.readouterr().out
    assert code == 1 and "query input beside a redirect sink" in out
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.text(str(tmp_path / "s/results")).count() == 1
    assert factloom.open_repo(spark, str(tmp_path / "src")).routes.count() == 1


def test_rules_command(capsys):
    assert main(["rules"]) == 0 and "unguarded-writes" in capsys.readouterr().out
