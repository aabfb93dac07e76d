"""Extraction, patterns, scopes, streaming."""

from __future__ import annotations

from factloom.extract.python_facts import extract
from factloom.operators import patterns, scopes
from factloom.sources.facts import FAMILIES
from factloom.streaming import incremental

SOURCE = '''
import os.path as p
from .m import f as g

class A(B.C):
    @app.route("/x", methods=["POST"])
    def go(self, a, *, b=p.sep):
        x = y = g(a)
        self.seen = x
        return helper(x)

async def top():
    pass
'''


def test_extract(spark):
    files = spark.createDataFrame([("pkg/mod.py", SOURCE), ("empty.py", None), ("bad.py", "def (")], "file string, source string")
    rows = extract(files).collect()
    by = lambda family, *names: sorted(tuple(r[n] for n in names) for r in rows if r["family"] == family)
    assert by("functions", "fqn", "detail", "flag") == [("pkg.mod.A.go", "self,a,b", True), ("pkg.mod.top", "", False)]
    assert by("classes", "fqn", "detail") == [("pkg.mod.A", "B.C")]
    assert by("decorators", "fqn", "name", "target", "detail") == [("app.route", "route", "pkg.mod.A.go", "'/x', methods=['POST']")]
    assert by("imports", "fqn", "name", "flag") == [("os.path", "p", False), ("pkg.m.f", "g", True)]
    assert by("call_edges", "fqn", "owner") == [("app.route", "<module>"), ("g", "pkg.mod.A.go"), ("helper", "pkg.mod.A.go")]
    assert by("value_flow_edges", "name", "target", "detail") == [("g(a)", "x", "chain"), ("g(a)", "y", "chain"), ("helper(x)", "return", "return"), ("x", "self.seen", "attribute_write")]
    assert ("seen", True) in by("attributes", "name", "flag")
    assert by("errors", "file", "flag") == [("bad.py", True)]


def test_patterns(spark):
    imports = spark.createDataFrame([("flask.views",), ("django",)], "module string")
    providers = spark.createDataFrame([("f", "flask"), ("d", "django.db"), ("n", "flas")], "provider string, library string")
    assert [r["provider"] for r in patterns.active(providers, imports).collect()] == ["f"]
    access = spark.createDataFrame([("r", "args", False), ("r", "args", True)], "receiver string, attribute string, is_write boolean")
    known = spark.createDataFrame([("r", "args", "read", 1), ("r", "args", None, 2)], "fqn string, name string, access string, pattern int")
    assert sorted((r["is_write"], r["pattern"]) for r in patterns.match_attributes(access, known).collect()) == [(False, 1), (False, 2), (True, 2)]
    marks = spark.createDataFrame([("t", "a.route", "route"), ("u", "b.login", "login")], "target string, fqn string, name string")
    shapes = spark.createDataFrame([("a.route", None, 1), (None, "login", 2)], "fqn string, name string, pattern int")
    assert sorted(tuple(r) for r in patterns.match_decorators(marks, shapes).collect()) == [("t", 1), ("u", 2)]


def test_scopes(spark):
    owners = spark.createDataFrame([("r1", "a", "g"), ("r2", "b", None)], "owner string, handler string, group string")
    edges = spark.createDataFrame([("a", "x"), ("x", "y"), ("h", "z")], "src string, dst string")
    hooks = spark.createDataFrame([("h", "g"), ("k", None)], "hook string, group string")
    got = scopes.members(owners, edges, hooks)
    full = {(r["owner"], r["function"]) for r in got.where("scope = 'full_stack'").collect()}
    assert full == {("r1", f) for f in "ahxyz"} | {("r2", "b"), (None, "k")}  # k belongs to all owners and is told once
    assert {r["owner"]: r["n_functions"] for r in scopes.counted(got).where("scope = 'full_stack'").collect()} == {"r1": 6, "r2": 2}
    some, every, none = (spark.createDataFrame([(f,)], "function string") for f in "zkq")
    names = lambda df: sorted(r["owner"] for r in df.select("owner").collect())
    assert names(scopes.without(owners, got, some)) == ["r2"] and names(scopes.with_any(owners, got, some, "full_stack")) == ["r1"]
    assert names(scopes.without(owners, got, every)) == [] and names(scopes.with_any(owners, got, every, "full_stack")) == ["r1", "r2"]
    assert names(scopes.without(owners, got, none)) == ["r1", "r2"]


def test_stream_replaces_files(spark, tmp_path):
    at = str(tmp_path)
    one = spark.createDataFrame([("a.py", 1), ("b.py", 2)], "file string, line int")
    two = spark.createDataFrame([("a.py", 9)], "file string, line int")
    for part in (one, two):
        part.write.mode("append").json(f"{at}/in")
        stream = spark.readStream.schema("file string, line int").json(f"{at}/in")
        incremental.maintain(stream, f"{at}/table", f"{at}/marks").awaitTermination()
    assert sorted(tuple(r) for r in incremental.latest(spark, f"{at}/table").collect()) == [("a.py", 9), ("b.py", 2)]
    assert incremental.latest(spark, f"{at}/none") is None
    assert incremental.fact_stream(spark, f"{at}/in", "errors").isStreaming and "errors" in FAMILIES


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counted = incremental.windowed_counts(stream, "ts", "event_type", "1 day", "0 seconds")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == events.count()
