"""Control flow from source, branch arms, ordering, scans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.extract.control_flow import control_flow, graphs_of
from factloom.extract.python_facts import extract
from factloom.functions import scalars
from factloom.operators import graph
from factloom.plans import rules, scan
from factloom.plans.catalogue import built_in
from factloom.plans.repo import Repo


def edges(source):
    return {(a, b, label) for _, _, a, b, label, _ in graphs_of("m.py", "def f(x):\n" + "".join(f"    {line}\n" for line in source))}


def reach(found, start=0):
    after = {}
    for a, b, _ in found:
        after.setdefault(str(a), set()).add(str(b))
    return {int(x) for x in graph._reach(str(start), after)}


def test_straight_line():
    assert edges(["a = 1", "b = 2"]) == {(0, 1, None)}


def test_branches_and_early_return():
    found = edges(["if x:", "    return 1", "else:", "    y = 2", "return y"])
    assert (0, 2, "true") in found and (2, 1, "return") in found
    assert sum(label == "false" for *_, label in found) == 1 and 1 in reach(found)


def test_loop_with_break():
    found = edges(["while x:", "    if a:", "        break", "    b()", "c()"])
    assert {label for *_, label in found} == {"true", "false", None}
    assert 1 in reach(found)
    head = next(b for a, b, _ in found if a == 0)
    assert any(b == head and a != 0 for a, b, _ in found)  # a back edge


def test_handlers():
    found = edges(["try:", "    raise V", "except V:", "    return 0", "finally:", "    z()", "return 1"])
    assert {"raise", "except", "return"} <= {label for *_, label in found}
    assert edges(["raise V"]) == {(0, 1, "raise")}


def test_names_and_broken_files(spark):
    files = spark.createDataFrame([("p/m.py", "class A:\n  def f(self):\n    def g(): pass\n    return g\n"), ("bad.py", "def ("), ("none.py", None)], "file string, source string")
    assert {r["graph"] for r in control_flow(files).collect()} == {"p.m.A.f", "p.m.A.f.g"}


def test_branch_arms(spark):
    rows = [("g", "if", "a", "true"), ("g", "if", "b", "false"), ("g", "a", "join", None), ("g", "b", "join", None), ("g", "join", "end", None)]
    got = {tuple(r)[1:] for r in graph.branch_arms(spark.createDataFrame(rows, "graph string, src string, dst string, label string")).collect()}
    assert got == {("if", d, m, m in "ab") for d, arm in (("true", "a"), ("false", "b")) for m in (arm, "join", "end")}


def test_precedes(spark):
    pairs = spark.createDataFrame([(1, "g", 1, 2), (2, "g", 2, 1), (3, "g", 1, 5), (4, "g", 5, 1), (5, "g", 1, 99)], "pair int, graph string, a_line int, b_line int")
    blocks = spark.createDataFrame([("g", "s", 1), ("g", "s", 2), ("g", "t", 5)], "graph string, block string, line int")
    dom = graph.per_graph(spark.createDataFrame([("g", "s", "t")], "graph string, src string, dst string"), "dominators")
    got = {r["pair"]: r["precedes"] for r in graph.precedes(pairs, blocks, dom).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_logical_inputs(spark):
    rows = spark.createDataFrame([("query", "Token"), ("form", "a"), ("path", "a"), ("query", None)], "c string, k string")
    kinds = lambda e: [r[0] for r in rows.select(scalars.logical_input(F.col("c"), F.col("k"), e)).collect()]
    assert kinds("exact") == ["query:Token", "form:a", "path:a", None]
    assert kinds("container") == ["forgeable:Token", "forgeable:a", "path:a", None]
    assert kinds("credential") == ["credential", "forgeable:a", "path:a", None]
    with pytest.raises(ValueError):
        kinds("other")


def test_scan(spark, tmp_path):
    source = "from flask import Flask, request, redirect\napp = Flask(__name__)\n\n@app.get('/go')\ndef go():\n    return redirect(request.args['to'])\n"
    repo = Repo(extract(spark.createDataFrame([("m.py", source)], "file string, source string")), built_in(spark))
    config = scan.Config().merged({"include": ["e*", "input*"]}, {"fail_on": "medium"})
    got = scan.scan(spark, repo, rules.chosen(config.include), str(tmp_path / "a"), config)
    assert got.code(config.fail_on) == 1 and got.code("high") == 0 and set(got.profile) == {"endpoints", "input-near-sink"}
    rows = [(r["section"], r["value"], r["n"]) for r in scan.overview(got.findings).orderBy("section", "place", "value").collect()]
    assert rows == [("rule", "endpoints", 1), ("rule", "input-near-sink", 1), ("severity", "medium", 1), ("severity", "info", 1), ("total", "", 2)]
    late = scan.scan(spark, repo, rules.chosen(["e*"]), str(tmp_path / "b"), scan.Config(overall_seconds=0))
    assert late.incomplete == ["endpoints"] and late.code("info") == 124
    with pytest.raises(ValueError):
        scan.Config().merged({"odd": 1})
