"""Source trees, findings documents, ignore files."""

from __future__ import annotations

import json

import pytest

from factloom.operators import findings
from factloom.sources import code, documents


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "my repo"
    (root / "pkg").mkdir(parents=True)
    (root / "venv/lib").mkdir(parents=True)
    (root / "pkg/a.py").write_text("import pkg.b\n\ndef f():\n    return 1\n")
    (root / "pkg/b.py").write_text("x = 1\n")
    (root / "venv/lib/c.py").write_text("no = 1\n")
    (root / "notes.txt").write_text("no")
    return root


def test_sources_and_changes(spark, tree):
    got = code.read_sources(spark, str(tree))
    assert sorted(r["file"] for r in got.collect()) == ["pkg/a.py", "pkg/b.py"]
    before = spark.createDataFrame(code.manifest(got).collect())
    digest = code.content_hash(got)
    (tree / "pkg/b.py").write_text("x = 2\n")
    (tree / "pkg/d.py").write_text("y = 1\n")
    (tree / "pkg/a.py").unlink()
    now = code.read_sources(spark, str(tree))
    assert {(r["file"], r["change"]) for r in code.changes(before, code.manifest(now)).collect()} == {("pkg/a.py", "removed"), ("pkg/b.py", "changed"), ("pkg/d.py", "added")}
    assert code.content_hash(now) != digest


def test_open_repo_and_text(spark, tree):
    repo = code.open_repo(spark, str(tree))
    assert [r["fqn"] for r in repo.functions.collect()] == ["pkg.a.f"]
    shown = code.text_around(repo.functions.select("file", "line"), code.read_sources(spark, str(tree)), 1).first()["text"]
    assert shown == "2: \n3: def f():\n4:     return 1"


def test_affected(spark):
    imports = spark.createDataFrame([("a", "b.name"), ("c", "a"), ("d", "z")], "file string, module string")
    modules = spark.createDataFrame([(x, x) for x in "abcd"], "file string, module string")
    changed = spark.createDataFrame([("b",)], "file string")
    assert sorted(r["file"] for r in code.affected(changed, imports, modules).collect()) == ["a", "b", "c"]


def test_documents(spark, tmp_path):
    capture = {"findings": [{"rule_id": "r", "severity": "high", "fingerprint": "f1", "summary": "s", "file": "a.py", "line": 3}], "other": 1}
    (tmp_path / "c.json").write_text(json.dumps(capture))
    rows = documents.load_findings(spark, str(tmp_path / "c.json"))
    assert [(r["rule_id"], r["line"]) for r in rows.collect()] == [("r", 3)]
    result = findings.to_sarif(rows).first()["result"]
    log = {"version": "2.1.0", "runs": [{"results": [json.loads(result), {"ruleId": "q", "message": {"text": "t"}}]}]}
    (tmp_path / "s.json").write_text(json.dumps(log))
    back = {r["rule_id"]: r for r in documents.load_findings(spark, str(tmp_path / "s.json")).collect()}
    assert (back["r"]["severity"], back["r"]["fingerprint"], back["r"]["file"], back["r"]["line"]) == ("high", "f1", "a.py", 3)
    assert back["q"]["severity"] == "low" and len(back["q"]["fingerprint"]) == 16
    (tmp_path / "x.json").write_text('{"a": 1}')
    (tmp_path / "y.json").write_text('{"findings": [{"rule_id": "r"}]}')
    for bad in ("x.json", "y.json"):
        with pytest.raises(documents.UnknownDocument):
            documents.load_findings(spark, str(tmp_path / bad))
    documents.write_baseline(rows, str(tmp_path / "base"))
    from factloom.sources.facts import read_baseline

    assert [r["key"] for r in read_baseline(spark, str(tmp_path / "base")).collect()] == ["f1"]
    documents.append_telemetry(spark, str(tmp_path / "log"), {"a": 1})
    documents.append_telemetry(spark, str(tmp_path / "log"), {"a": 2})
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_ignore_file(spark):
    rules = documents.ignore_rules(spark, ["# all", "tests", "*.gen.py: my-rule", "!tests/keep.py", ""])
    rows = spark.createDataFrame([("tests/a.py", "x"), ("tests/keep.py", "x"), ("src/tests/b.py", "x"), ("src/m.gen.py", "My_Rule"), ("src/m.gen.py", "x"), ("src/m.py", "my_rule")], "file string, rule_id string")
    got = [r["ignored"] for r in documents.ignored(rows, rules).collect()]
    assert got == [True, False, True, True, False, False]
