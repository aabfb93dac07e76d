"""Findings of the third round: dense graphs beyond the old limit, values of all functions."""

from __future__ import annotations

import duckdb
import numpy as np

from factloom.operators import graph
from tests.test_r02 import same


def test_dense_edges_in_parts(spark, monkeypatch):
    """the driver gets a dense graph's edges in parts, as numbers of their targets; both ways give the lists of the plain graph."""
    assert graph.DENSE_EDGES > 36_000_000 * 3 // 4 and graph.DENSE_BYTES >= 2 * graph.DENSE_EDGES
    rows = [(f"n{i}", f"n{(i * 37 + j * j * 13 + 5) % 90}") for i in range(90) for j in range(8)] + [("n1", "last")]
    links = spark.createDataFrame(rows + rows[:50], "src string, dst string").repartition(3)
    monkeypatch.setattr(graph, "PART", 64)
    names, first, after = graph._numbered(links, graph._neighbours(links)[0])
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
    names = names.to_pylist()
    lists = lambda at, of: {x: {names[y] for y in of[at[i] : at[i + 1]]} for i, x in enumerate(names) if at[i] < at[i + 1]}
    assert lists(first, after) == near and after.dtype == np.uint16
    into = graph._into(after, len(names))
    start, before = graph._reversed(first, after, into)
    assert lists(start, before) == {b: {a for a in near if b in near[a]} for b in set().union(*near.values())}
    assert len(before) == len(after) and before.dtype == np.uint16


def test_reads_of_all_functions(spark, tmp_path):
    """source values of every function are reads, not only of each twentieth; loops, long orders and null keys are as in the SQL."""
    duckdb.sql("""SELECT CASE WHEN o < 40 THEN o END AS l_orderkey, o * 100 + i AS l_partkey, CASE WHEN o % 9 > 0 OR i <> 2 THEN (i * i + o) % 5 + i // 8 * 7 END AS l_suppkey, CAST(i AS INT) AS l_linenumber,
    CASE WHEN (i + o) % 4 = 3 THEN 'R' WHEN i % 3 = 1 THEN 'A' END AS l_returnflag FROM range(1, 42) a(o), range(24) b(i) WHERE i < 4 + o""").write_parquet(f"{tmp_path}/lineitem.parquet")
    rows = same(spark, tmp_path, "reads_flowing_to")
    assert len({value.split("|")[0] for value, _ in rows}) == 39


def test_goals_within_parts(spark, monkeypatch):
    """marks of any number give the pairs of a plain search; a graph's roots go one by one where it is larger than the marks."""
    rows = [(f"g{g}", f"x{i}", f"x{(i * 5 + g) % 17 + i // 9}", i % 3 > 0, (i + g) % 4 == 0) for g in range(30) for i in range(1 + g)] + [("g4", None, "x1", True, True), ("g5", "x1", "x1", None, None)]
    edges = spark.createDataFrame(rows, "graph string, src string, dst string, asked boolean, goal boolean").repartition(2)
    want = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        goals = {d for _, _, d, _, goal in own if goal}
        for root in {s for _, s, _, asked, _ in own if asked and s}:
            found = {root}
            for _ in range(3):
                found |= {d for _, s, d, _, _ in own if s in found}
            want |= {(g, root, x) for x in found & goals}
    table = edges.na.fill(False).sort("graph").coalesce(1).toArrow()
    whole = [tuple(r) for r in graph.goals_within(edges, 3).collect()]
    monkeypatch.setattr(graph, "MARKS", 5)
    for got in (whole, [tuple(r.values()) for b in graph._goals(table, 3) for r in b.to_pylist()]):
        assert len(got) == len(set(got)) and set(got) == want
