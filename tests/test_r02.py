"""Queries against their SQL on tables that the driver's small ones do not hold: long orders, many copies, crowded keys."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from factloom.operators import derive, graph, resolution, scopes, sinks


def same(spark, folder, name):
    """The query's rows, which must be those of its SQL."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    made = con.execute(__spark_entry__.oracle_sql()[name])
    columns, rows = [c[0] for c in made.description], made.fetchall()
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    return rows


@pytest.fixture(scope="module")
def long_orders(tmp_path_factory):
    """Three orders of fourteen lines each, from one supplier to the next; all hand on whole values."""
    folder = tmp_path_factory.mktemp("long")
    duckdb.sql("""SELECT o * 20 AS l_orderkey, o * 100 + i AS l_partkey, o * 100 + 6 + i * 7 AS l_suppkey, CAST(i AS INT) AS l_linenumber, CASE WHEN i % 4 = 3 AND o = 2 THEN 'R' ELSE 'A' END AS l_returnflag
    FROM range(1, 4) a(o), range(14) b(i)""").write_parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["value_traces", "reads_flowing_to", "value_derived_from", "value_logical_inputs", "whole_value_handles"])
def test_ten_levels(spark, long_orders, name):
    assert same(spark, long_orders, name)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_by_arithmetic(spark):
    """owners of a group share the list of its hooks; the sizes are those of the expanded members."""
    owners = spark.createDataFrame([("r1", "a", "g"), ("r1", "a", "k"), ("r2", "b", None), ("r3", "h", "g"), ("r4", "x", "k"), ("r5", "c", "none"), ("r6", None, "g")], "owner string, handler string, group string")
    edges = spark.createDataFrame([("a", "x"), ("x", "y"), ("h", "z"), ("h", "x"), ("j", "y"), ("c", "all"), ("every", "all")], "src string, dst string")
    hooks = spark.createDataFrame([("h", "g"), ("j", "k"), ("y", "k"), ("every", None)], "hook string, group string")
    rows = lambda df: sorted(tuple(r) for r in df.select("owner", "scope", "n_functions").collect())
    got = rows(scopes.sizes(owners, edges, hooks))
    assert got == rows(scopes.counted(scopes.members(owners, edges, hooks)))
    assert ("r1", "full_stack", 8) in got and ("r5", "full_stack", 3) in got and ("r6", "full_stack", 6) in got


def test_shadowed_by_latest(spark):
    """a range is found by order, not dealt to bins that it spans."""
    refs = spark.createDataFrame([("f", "a", 1, "own"), ("f", "a", 5, "own"), ("f", "a", 9_000_000, "own"), ("f", "b", 7, "own"), (None, "a", 6, "own"), ("g", "a", 4, None)], "file string, name string, line long, fqn string")
    bound = spark.createDataFrame([("f", "a", 5, "x"), ("f", "a", 5, "y"), ("f", "a", 8_000_000, "z"), ("f", "b", 8, "w"), (None, "a", 1, "n"), ("g", "a", 4, "v")], "file string, name string, line long, target string")
    got = resolution.shadowed(refs, resolution.binding_ranges(bound))
    assert {(r["file"], r["name"], r["line"], r["fqn"]) for r in got.collect()} == {("f", "a", 1, "own"), ("f", "a", 5, "y"), ("f", "a", 9_000_000, "z"), ("f", "b", 7, "own"), (None, "a", 6, "own"), ("g", "a", 4, "v")}
    assert got.columns == refs.columns and "Generate" not in plan_of(got)


def test_sinks_meet_reads_by_scope(spark):
    """what a read reaches is asked for by the scope's sinks, not listed for every scope."""
    given = spark.createDataFrame([(1, "s", "v", False), (2, "s", "w", False), (3, "t", "v", False), (4, "t", "u", True), (5, "s", "u", True), (6, "t", "w", False), (7, "q", "v", False), (8, "s", "v", False), (8, "t", "u", False)], "sink long, scope string, value string, proved boolean")
    reads = spark.createDataFrame([("s", "one", True), ("t", "one", False), ("t", "two", False), ("t", None, None)], "scope string, value string, is_text boolean")
    reach = spark.createDataFrame([("one", "v"), ("one", "v"), ("two", "v"), ("two", "w"), ("three", "u")], "root string, node string")
    got = sinks.reached_sinks(given, reads, reach, spark.createDataFrame([(8,)], "sink long"))
    assert sorted(r["sink"] for r in got.collect()) == [1, 3, 5, 6]
    assert not [line for line in plan_of(got).splitlines() if "Join Inner" in line and "root" in line]


def above_joins(df):
    return plan_of(df).partition("Join")[0]


def test_table_edges_once(spark):
    """pairs of callers with one lookup are not compared with one another; those of other callers come once."""
    tables = spark.createDataFrame([("t", "a", "h"), ("t", "b", "h"), ("t", "b", "i"), ("t", "b", "i"), ("u", None, "j")], "table string, key string, handler string")
    single = [("c", "t", "b"), ("c", "t", "b"), ("d", "t", None), ("e", "u", "x"), ("f", "u", None)]
    make = lambda rows: derive.table_edges(tables, spark.createDataFrame(rows, "caller string, table string, key string"))
    pairs = [("c", "h"), ("c", "i"), ("d", "h"), ("d", "i"), ("f", "j")]
    assert sorted(tuple(r) for r in make(single).collect()) == pairs and "Aggregate" not in above_joins(make(single))
    assert sorted(tuple(r) for r in make([*single, ("g", "t", "a"), ("g", "t", None), ("g", "u", None)]).collect()) == [*pairs, ("g", "h"), ("g", "i"), ("g", "j")]


def test_signal_edges_once(spark):
    """pairs of handlers of one signal are not compared with one another; those of other handlers come once."""
    sent = spark.createDataFrame([("a", "f"), ("b", "f"), ("b", "f"), ("b", "g")], "signal string, sender string")
    make = lambda rows: derive.signal_edges(spark.createDataFrame(rows, "signal string, handler string"), sent)
    single = make([("a", "h"), ("b", "i"), ("b", "i"), ("z", "k")])
    assert sorted(tuple(r) for r in single.collect()) == [("f", "h"), ("f", "i"), ("g", "i")] and "Aggregate" not in above_joins(single)
    assert sorted(tuple(r) for r in make([("a", "h"), ("b", "h"), ("b", "i")]).collect()) == [("f", "h"), ("f", "i"), ("g", "h"), ("g", "i")]


def test_closure_of_dense_graph(spark):
    """edges beyond the limit between few nodes are walked in the tasks too; both ways and the levels agree."""
    rows = [(f"n{i}", f"n{(i * i * 7 + j * 11) % 150}") for i in range(150) for j in range(6)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [(None, "n1")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(0, 150, 7)] + [("c0",), ("c30",), ("q",), ("q",)], "r string")
    rows_of = lambda *limits: sorted(tuple(r) for r in graph.closure(edges, roots, 20, True, *limits).collect())
    assert rows_of(0) == rows_of(0, 0) == rows_of() and ("c0", "c20", 20) in rows_of(0)
    assert "MapInArrow" in plan_of(graph.closure(edges, roots, 20, True, 0))


def test_closure_asks_unknown_nodes(spark, monkeypatch):
    """where few edges lead into unknown nodes, those are asked; hubs, islands and depth limits give what a plain search gives."""
    rows = [(f"n{i}", f"n{(i * 37 + j * j * 13 + 5) % 400}") for i in range(400) for j in range(8)]
    rows += [(f"n{i}", "hub") for i in range(300, 400)] + [(f"i{i}", "hub") for i in range(60)] + [("hub", "end"), ("end", "i0"), ("i7", "n0"), ("lone", "lone")]
    after = {}
    for src, dst in rows:
        after.setdefault(src, set()).add(dst)

    def plain(root, most):
        found, frontier = {root: 0}, {root}
        for depth in range(1, most + 1):
            frontier = {y for x in frontier for y in after.get(x, ())} - found.keys()
            found |= dict.fromkeys(frontier, depth)
        return {(root, x, depth) for x, depth in found.items()}

    plans = []
    monkeypatch.setattr(graph.Levels, "keep", lambda self, df, f=graph.Levels.keep: plans.append(plan_of(df)) or f(self, df))
    edges, names = spark.createDataFrame(rows + rows[:50], "src string, dst string"), [*sorted(after), "none"]
    roots = spark.createDataFrame([(x,) for x in names], "r string")
    for most, *limits in ((1,), (2,), (3,), (50,), (50, 0)):
        got = [tuple(r) for r in graph.closure(edges, roots, most, True, *limits).collect()]
        assert len(got) == len(set(got)) and set(got) == set().union(*(plain(r, most) for r in names))
    assert len(plans) == 5 and not any("Aggregate" in p for p in plans)


def test_large_graph_is_kept_once(spark, monkeypatch):
    """edges kept as they come are deleted where the distinct ones follow them."""
    made = []
    monkeypatch.setattr(graph, "_shared", lambda *a, f=graph._shared: made.append(f(*a)) or made[-1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = graph.closure(edges, edges.select("src"), 5, False, 2, 2)
    assert sorted(map(tuple, got.collect())) == [(x, y, (ord(y) - ord(x)) % 3) for x in "abc" for y in "abc" if x != y]
    assert sorted(x for x in os.listdir(made[0].removeprefix("file:")) if x.startswith("kept")) == ["kept2"]


def test_asked_nodes():
    """a node is found by any known node before it, the first as well as the last of many."""
    lists = [[], [0], [1, 2], list(range(40)), [1] * 39 + [0], list(range(1, 30)), [0, 1]]
    known = np.array([True] + [False] * 5 + [True] + [False] * 33)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists] + [0] * 33)])
    before = np.concatenate(lists).astype(np.uint16)
    assert graph._asked(known, first, before).tolist() == [1, 3, 4, 5]
    assert graph._asked(known & (np.arange(40) == 6), first, before).tolist() == [3, 5]


def test_closure_of_many_nodes_keeps_the_loop(spark, monkeypatch):
    """only a graph of few nodes travels as numbers; with more nodes the levels are tables, with the same result."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 3 % 40}") for i in range(40)] + [("n1", "n39")], "src string, dst string")
    roots = edges.select("src")
    walked = graph.closure(edges, roots, 9, False, 0)
    monkeypatch.setattr(graph, "DENSE_NODES", 39)
    looped = graph.closure(edges, roots, 9, False, 0)
    assert "MapInArrow" in plan_of(walked) and "MapInArrow" not in plan_of(looped)
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, looped.collect()))


@pytest.mark.parametrize("back", [False, True])
def test_places_of_one_ord(spark, back):
    """F8: lists whose places share an ord have one result, whatever the order of rows."""
    rows = [(1, 5, 10), (1, 5, 20), (2, 5, 20), (2, 5, 10), (3, 5, 10), (3, 5, 10), (4, 5, 10), (4, 6, 20), (4, 6, 15)]
    places = spark.createDataFrame(rows[::-1] if back else rows, "list long, ord long, place long").coalesce(1)
    ordered = spark.createDataFrame([(10, 15), (15, 20), (10, 20)], "a long, b long")
    assert sorted(map(tuple, derive.in_order(places, ordered).collect())) == [(1, True), (2, True), (3, False), (4, True)]
