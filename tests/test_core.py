"""Library core: plain semantics on hand-made rows, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import itertools
import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions import scalars
from factloom.operators import findings, flow, graph, joins
from factloom.operators.collection import FactSet
from factloom.operators.selectors import Effect, Fn, When
from factloom.sources import facts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.sql(f"CREATE VIEW {name.split('.')[0]} AS FROM '{DATA}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    expected = duck.sql(registry.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(rows)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_closure_on_a_cycle(spark):
    edges = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("d", None))
    roots = frame(spark, "r string", ("a",), ("d",))
    got = {tuple(r) for r in graph.closure(edges, roots, 9).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}
    assert {tuple(r) for r in graph.closure(edges, roots, 1, include_root=True).collect()} == {("a", "a", 0), ("a", "b", 1), ("d", "d", 0)}


def test_dominators_of_all_small_graphs():
    names = "sxyz"
    for bits in range(0, 1 << 9, 7):
        pairs = [p for k, p in enumerate(itertools.product("xyz", repeat=2)) if bits >> k & 1]
        after = {"s": {"x", "y"}}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)
        dom = graph.dominator_sets("s", after)
        reach = graph._reach("s", after)
        for b in reach:
            assert dom[b] == {x for x in names if x in reach and (x == b or x == "s" or b not in graph._reach("s", after, without=x))}
        idom = graph.immediate_dominators("s", dom)
        assert all(idom[b] in dom[b] for b in reach)


def test_class_order():
    bases = {"A": [], "B": ["A"], "C": ["A"], "D": ["B", "C"], "X": ["unknown"], "P": ["Q"], "Q": ["P"], "Bad": ["A", "B"]}
    assert graph.linear_mro(bases, "D") == (["D", "B", "C", "A", "object"], True)
    assert graph.linear_mro(bases, "X") == (["X"], False)
    assert graph.linear_mro(bases, "Bad") == (["Bad"], False)
    assert graph.linear_mro(bases, "P")[1] is False or graph.linear_mro(bases, "P")[0][0] == "P"


def test_fact_set(spark):
    made = FactSet(frame(spark, "ord int, file string", (2, "a/x.py"), (1, "b/x.py"), (3, "b/y.py")), ("ord",))
    assert made.first().collect()[0]["ord"] == 1
    assert [r["ord"] for r in made.slice(1, 3).collect()] == [2, 3]
    assert made.in_file("x.py").df.count() == 2 and made.in_dir("b/").df.count() == 2
    with pytest.raises(LookupError):
        made.one()
    assert made.where("ord = 3").one()["file"] == "b/y.py"
    with pytest.raises(TypeError):
        made.union(FactSet(made.df, ("ord",), "other"))
    assert made.union(made).df.count() == 3
    assert made.tabulate(["ord", "file"]).splitlines() == ["ord  file", "1    b/x.py", "2    a/x.py", "3    b/y.py"]


def test_selectors(spark):
    rows = frame(spark, "category string, key string, scope int, name string, fqn string", ("w", "k", 6, "f", "m.f"), ("w", "k", None, "g", "m.g"), ("r", None, 1, None, None))
    assert rows.where(Effect(frozenset("w"), scope=2).matches()).count() == 1
    either = Effect(frozenset("w"), frozenset("k"), 1) | Effect(frozenset("r"), frozenset("z"))
    assert either == Effect(frozenset("wr"), frozenset("kz"))
    assert rows.where(Fn(name="f", pattern="g").matches()).count() == 1
    assert rows.where((Fn(name="f") | Fn(pattern="[g")).matches()).count() == 1
    assert rows.where(Fn().matches()).count() == 0
    known = When(F.col("scope") > 3)
    assert [r[0] for r in rows.select(known.outcome()).collect()] == ["passed", "unknown", "failed"]
    assert rows.where((~known).keeps()).count() == 2


def test_canonical_names(spark):
    names = frame(spark, "fqn string", ("a.b.c",), ("a.bc",), ("x",), (None,))
    aliases = frame(spark, "alias string, target string", ("a", "one"), ("a.b", "two"), ("a.b", "three"))
    assert {tuple(r) for r in joins.longest_prefix(names, aliases).collect()} == {("a.b.c", "three.c"), ("a.bc", "one.bc"), ("x", "x"), (None, None)}
    known = frame(spark, "fqn string", ("p.f",), ("q.g",), ("r.g",), ("x",))
    asked = frame(spark, "fqn string", ("f",), ("g",), ("x",), ("none",))
    assert {tuple(r) for r in joins.unique_suffix(asked, known).collect()} == {("f", "p.f"), ("g", "g"), ("x", "x"), ("none", "none")}


def test_flow_bridges(spark):
    arguments = frame(spark, "call_id int, callee string, position int, keyword string, expression string", (1, "m", 0, None, "x"), (2, "m", None, "b", "y"), (3, "m", 5, None, "z"), (4, "f", 0, None, "u"))
    parameters = frame(spark, "callee string, name string, position int", ("m", "self", 0), ("m", "a", 1), ("m", "b", 2), ("f", "p", 0))
    got = {(r["call_id"], r["parameter"], r["gap"]) for r in flow.argument_bridge(arguments, parameters).collect()}
    assert got == {(1, "a", False), (2, "b", False), (3, None, True), (4, "p", False)}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scalars.short_name(F.lit("a.b.c"))) == "c"
    assert value(scalars.owner_of(F.lit("a.b.c"))) == "a.b" and value(scalars.owner_of(F.lit("a"))) is None
    assert value(scalars.dotted_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert value(scalars.json_leaf(F.lit("$.user.id"))) == "id"
    assert len(value(scalars.short_expression(F.lit("x  y" * 40)))) == 48
    assert value(scalars.severity_rank(F.lit("HIGH"))) == 3 and value(scalars.severity_rank(F.lit("odd"))) == -1
    assert value(scalars.types_agree(F.lit("pkg.User"), F.lit("User"))) and not value(scalars.types_agree(F.lit("pkg.User"), F.lit("ser")))


def test_findings(spark):
    rows = frame(spark, "ord int, rule_id string, severity string, file string, line int, endpoint string, summary string, evidence string", (2, "r-1", "low", "a.py", 1, "e", "s", "v"), (1, "r-1", "low", "a.py", 1, "e", "s", "v"), (3, "r_2", "critical", "b.py", 9, None, "s", "v"))
    found = findings.identified(rows)
    assert sorted(r["ord"] for r in findings.first_of_each(found).collect()) == [1, 3]
    inline = frame(spark, "file string, line int, rule string", ("b.py", 9, "R-2"), ("b.py", 9, "R-2"), ("a.py", 7, None))
    ignored = frame(spark, "file string, rule string", ("a.py", None))
    base = found.select(F.col("fingerprint").alias("key"))
    got = sorted((r["ord"], r["suppressed_by"]) for r in findings.suppressed(found, inline, ignored, base).collect())
    assert got == [(1, "ignore-file"), (2, "ignore-file"), (3, "inline")]
    assert findings.at_least(found, "medium").count() == 1


def test_fact_families(spark, tmp_path):
    at = str(tmp_path)
    edge = {"caller_fqn": "a", "callee_fqn": None, "arguments": [], "resolution": "unresolved", "source": "ast"}
    with open(f"{at}/call_edges.jsonl", "w") as f:
        f.write(json.dumps(edge) + "\n")
    index = facts.read_index(spark, at)
    assert list(index) == ["call_edges"] and index["call_edges"].first()["caller_fqn"] == "a"
    assert [tuple(r) for r in facts.manifest(index).collect()] == [("call_edges", 1)]
    with open(f"{at}/functions.jsonl", "w") as f:
        f.write(json.dumps({"fqn": "a", "name": "a"}) + "\n")
    with pytest.raises(facts.CorruptFacts):
        facts.read_index(spark, at)
    facts.write_family(index["call_edges"], f"{at}/again", "call_edges")
    assert facts.read_family(spark, f"{at}/again", "call_edges").collect() == index["call_edges"].collect()
    assert len(facts.schema_fingerprint()) == 16
