"""Facts from source: families, the flat view, a round trip through artifacts, caches, control flow, expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.extract.control_flow import graphs_of
from factloom.extract.index_facts import records_of
from factloom.functions import expressions
from factloom.operators import descriptors, graph, hierarchy, values
from factloom.operators.descriptors import ArgRef, Descriptor, Provider
from factloom.plans.catalogue import built_in
from factloom.plans.index import Index, InvalidIndex
from factloom.plans.repo import Repo
from factloom.sources import code
from factloom.sources.cache import Budget, ResultCache

SOURCE = '''
from flask import Flask, request as req
from .models import Base as B
from .models import *
app = Flask(__name__)

class Shop(B):
    limit: int = 3
    def __init__(self, store: "Store" = None):
        self.store = store
        self.items = []
    @property
    def size(self): return len(self.items)
    def add(self, item, *rest, key=None, **more):
        a, b = item, key
        self.items.append(a)
        total = n = 0
        total += 1
        for x, y in rest:
            yield x
        if (z := self.find(b, deep=True)) is not None:
            return z
    async def find(self, what, deep=False):
        with open(what) as f:
            return [row for row in f if row]

@app.post("/add", strict=False)
def add():
    shop = Shop()
    shop.add(req.form["item"], key=req.args.get("k"))
    f = lambda q: q + 1
    super().gone()
    return "ok"
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("shop/app.py", SOURCE), ("shop/models.py", "class Base:\n    def save(self):\n        raise NotImplementedError\n"), ("shop/bad.py", "def ("), ("shop/none.py", None)]
    return spark.createDataFrame(rows, "file string, source string")


@pytest.fixture(scope="module")
def index(files):
    return Index.of_sources(files)


def test_families(index):
    found = {r["fqn"]: r for r in index.family("functions").collect()}
    assert set(found) >= {"shop.app.Shop.__init__", "shop.app.Shop.size", "shop.app.Shop.add", "shop.app.Shop.find", "shop.app.add", "shop.models.Base.save"}
    assert [f["kind"] for f in found.values() if f["name"] == "<lambda>"] == ["LAMBDA"]
    params = found["shop.app.Shop.add"]["params"]
    assert [(p["name"], p["kind"], p["position"], p["default"]) for p in params] == [
        ("self", "POSITIONAL_OR_KEYWORD", 0, None), ("item", "POSITIONAL_OR_KEYWORD", 1, None), ("rest", "VAR_POSITIONAL", None, None), ("key", "KEYWORD_ONLY", None, "None"), ("more", "VAR_KEYWORD", None, None)]
    assert found["shop.app.Shop.find"]["is_async"] and found["shop.app.Shop.add"]["parent_class"] == "shop.app.Shop"
    calls = {r["call_expression"]: r for r in index.family("call_edges").collect()}
    added = calls["shop.add(req.form['item'], key=req.args.get('k'))"]
    assert [(a["position"], a["keyword"], a["expression"]) for a in added["arguments"]] == [(0, None, "req.form['item']"), (None, "key", "req.args.get('k')")]
    assert calls["self.find(b, deep=True)"]["callee_fqn"] == "shop.app.Shop.find" and calls["super().gone()"]["callee_fqn"] is None
    assert calls["Shop()"]["callee_fqn"] == "shop.app.Shop"
    flows = {(r["source_expr"], r["target_expr"], r["kind"]) for r in index.family("value_flow_edges").collect()}
    assert {("item", "a", "UNPACK"), ("key", "b", "UNPACK"), ("1", "total", "AUGMENTED_ASSIGN"), ("0", "total", "CHAIN"), ("0", "n", "CHAIN"), ("rest", "x", "UNPACK"), ("x", "yield", "YIELD"), ("self.find(b, deep=True)", "z", "ASSIGN"), ("3", "limit", "ANNOTATED_ASSIGN"), ("store", "self.store", "ATTRIBUTE_WRITE"), ("open(what)", "f", "ASSIGN"), ("f", "row", "COMPREHENSION_BINDING"), ("z", "return", "RETURN")} <= flows
    kinds = {(r["target_expr"], r["attr_name"], r["access_kind"], r["is_write"]) for r in index.family("attributes").collect()}
    assert {("self.items", "append", "CALL_MUTATOR", True), ("req.form", "'item'", "SUBSCRIPT", False), ("self", "store", "ATTR", True)} <= kinds
    types = {(r["expression"], r["declared_type"], r["source_tool"]) for r in index.family("type_enrichment").collect()}
    assert {("limit", "int", "annotation"), ("shop", "shop.app.Shop", "constructor")} <= types
    assert [(r["error_kind"], r["is_fatal"]) for r in index.errors.fatal().df.collect()] == [("PARSE", True)]
    imports = {(r["module"], tuple(r["names"]), r["is_relative"]) for r in index.family("imports").collect()}
    assert {("shop.models", ("Base",), True), ("shop.models", ("*",), True)} <= imports
    graphs = {r["fqn"] for r in index.family("cfgs").collect()}
    assert graphs == {f for f in found if "<lambda" not in f}


def test_typed_relations(index):
    assert {r["name"] for r in index.functions.in_class("shop.app.Shop").methods().df.collect()} == {"__init__", "size", "add", "find"}
    assert index.functions.by_fqn("shop.app.add").count() == 1 and index.functions.decorated_with("post").df.count() == 1
    assert index.functions.parameter_named("deep").first()["fqn"] == "shop.app.Shop.find"
    assert index.attributes.in_function("shop.app.Shop.__init__").writes().df.count() == 2
    assert index.decorators.on_function_named("size").df.first()["name"] == "property"
    assert index.symbols.in_file("shop/app.py").df.where("name = 'req'").first()["fqn"] == "flask.request"
    assert index.flow.assignments_to("z", "shop.app.Shop.add").df.count() == 1


def test_round_trip_through_artifacts(spark, index, tmp_path):
    at = f"file://{tmp_path}/facts"
    whole = index.completed()
    whole.write(at)
    back = Index.of_artifacts(spark, at)
    for family in ("functions", "classes", "call_edges", "cfgs", "errors"):
        assert sorted(map(str, back.family(family).collect())) == sorted(map(str, whole.family(family).collect()))
    assert sorted(map(str, back.flat().collect())) == sorted(map(str, index.flat().collect()))
    repo = code.open_artifacts(spark, at)
    assert [(r["path"], r["methods"], r["handler"]) for r in repo.routes.collect()] == [("/add", ["POST"], "shop.app.add")]
    shop = {r["fqn"]: r for r in back.family("classes").collect()}["shop.app.Shop"]
    assert shop["mro_chain"] == ["shop.app.Shop", "shop.models.Base", "object"] and shop["mro_complete"]
    assert [m["name"] for m in shop["inherited_methods"]] == ["save"]
    assert Index.empty(spark).functions.exists() is False and Index.empty(spark).flat().collect() == []


def test_invariants(spark, index):
    assert index.checked().blocking_violations().isEmpty()
    bad = index.family("functions").withColumn("file", F.concat(F.lit("/abs/"), "file"))
    with pytest.raises(InvalidIndex):
        Index(spark, {"functions": bad}).checked()


def test_caches(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("def f(x):\n    return x\n")
    root, cache = f"file://{tmp_path}/src", f"file://{tmp_path}/cache"
    assert [r["fqn"] for r in code.open_cached(spark, root, cache).functions.collect()] == ["m.f"]
    again = code.open_cached(spark, root, cache)
    assert [r["fqn"] for r in again.functions.collect()] == ["m.f"] and ResultCache(spark, cache).status().count() > 0
    (tmp_path / "src" / "m.py").write_text("def g(x):\n    return x\n")
    assert [r["fqn"] for r in code.open_cached(spark, root, cache).functions.collect()] == ["m.g"]
    store = ResultCache(spark, f"file://{tmp_path}/results")
    assert store.get("k") is None and store.status().isEmpty()
    assert store.put("k", spark.range(3)).count() == 3 and store.get("k").count() == 3
    budget = Budget({"flow": 10})
    assert budget.spend("flow", 6) and not budget.spend("flow", 6) and budget.spend("other", 99) and budget.exceeded() == ["flow"]


def lowered(source):
    found = [(a, b, label) for _, _, a, b, label, _ in graphs_of("m.py", "def f(x):\n" + "".join(f"    {line}\n" for line in source))]
    lines = {a: n for _, _, a, _, _, n in graphs_of("m.py", "def f(x):\n" + "".join(f"    {line}\n" for line in source))}
    return found, lines


def after_of(found):
    after = {}
    for a, b, _ in found:
        after.setdefault(str(a), set()).add(str(b))
    return after


def test_loop_else():
    found, lines = lowered(["for a in x:", "    b()", "else:", "    return 1", "c()"])
    head = next(a for a, _, label in found if label == "true")
    other = next(b for a, b, label in found if label == "false")
    assert a_line(lines, other) == 5 and (other, 1, "return") in found  # the loop's end runs the else body
    assert not any(a == head and label == "false" and b != other for a, b, label in found)


def a_line(lines, block):
    return lines.get(block)


def test_return_goes_through_finally():
    found, lines = lowered(["try:", "    return 1", "finally:", "    c()", "d()"])
    (inside,) = {a for a, _, label in found if label == "return" and a_line(lines, a) == 3}
    last = next(b for a, b, label in found if a == inside and label == "return")
    assert a_line(lines, last) == 5 and (last, 1, "return") in found and (inside, 1, "return") not in found


def test_break_goes_through_finally():
    found, lines = lowered(["while x:", "    try:", "        break", "    finally:", "        c()", "d()"])
    (inside,) = {a for a, n in lines.items() if n == 4}
    (last,) = {b for a, b, label in found if a == inside and label is None}
    assert a_line(lines, last) == 6 and "1" in graph._reach(str(last), after_of(found))


def test_every_block_of_a_try_body_may_raise():
    found, lines = lowered(["try:", "    if x:", "        a()", "    b()", "except E:", "    c()"])
    handler = {b for _, b, label in found if label == "except"}
    assert len(handler) == 1 and len({a for a, _, label in found if label == "except"}) >= 3


def test_match_with_and_without_wildcard():
    found, _ = lowered(["match x:", "    case 1:", "        a()", "    case _:", "        b()"])
    assert not any(label == "false" for *_, label in found)
    found, _ = lowered(["match x:", "    case 1:", "        a()"])
    assert any(label == "false" for *_, label in found)


def test_records_of_regions_and_conditions():
    rows = dict(r for r in records_of("m.py", "def f(x):\n    try:\n        g(x)\n    except (A, B) as e:\n        if x == 1:\n            raise\n    return x in y\n") if r[0] == "cfgs")
    (region,) = rows["cfgs"]["try_regions"]
    assert region["handlers"][0]["exception_types"] == ["A", "B"] and region["handlers"][0]["name"] == "e"
    assert [b["condition_expr"] for b in rows["cfgs"]["blocks"] if b["condition_expr"]] == ["x == 1"]
    assert [(p["expression"], p["position"]) for b in rows["cfgs"]["blocks"] for p in b["value_predicates"]] == [("x in y", "return")]


def test_expression_details():
    got = expressions.parsed
    assert got("not a.b == 'x'")[:5] == ("comparison", "Not", "a.b", "'x'", None)
    assert got("f(a, *b, k=c)")[7:10] == ("f", [], ["a", "b", "c"]) and got("f'{a}-{b}' + c")[8] == ["a", "b", "c"]
    assert got("x y")[0] is None and got("'s'")[4:6] == ("s", True) and got("a or b")[0] == "compound"


def test_unpacking(spark):
    rows = spark.createDataFrame([("a, b", "f(1, 2), x"), ("a, b", "x")], "t string, v string")
    got = [[tuple(p) for p in r[0]] for r in rows.select(expressions.unpacked(F.col("t"), F.col("v"))).collect()]
    assert got == [[("a", "f(1, 2)"), ("b", "x")], []]


@pytest.mark.parametrize("local_edges", [0, 100])
def test_closure_of_either_kind(spark, local_edges):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "z"), (None, "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("z",), ("q",)], "r string")
    got = {tuple(r) for r in graph.closure(edges, roots, 9, True, local_edges).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("z", "z", 0), ("q", "q", 0)}
    assert {tuple(r) for r in graph.closure(edges, roots, 1, False, local_edges).collect()} == {("a", "b", 1)}
    assert graph.closure(edges.limit(0), roots, 3, False, local_edges).collect() == []


def test_traces_take_the_hop_limit_into_account(spark):
    hop = lambda a, b, n: (values_key(a), values_key(b), n, (a, b, "argument" if n else "assign", 1))
    rows = [hop(f"f{i}", f"f{i + 1}", 1) for i in range(7)] + [hop("f0", "g", 0), hop("g", "f4", 0)]
    edges = spark.createDataFrame(rows, f"src string, dst string, hop int, step {values.STEP}")
    root = spark.createDataFrame([(values_key("f0"),)], "root string")
    got = {r["node"][:-2]: (r["depth"], r["hops"]) for r in values.traces(edges, root).collect()}
    assert got["f4"] == (2, 0) and got["f5"][1] in (1, 5) and "f7" in got  # the way by g saves four calls


def values_key(name):
    return f"{name}\0x"


def test_trace_gaps(spark):
    edges = values.value_edges(spark.createDataFrame([("f", "a", "b", "ASSIGN", 1)], "fn string, source_expr string, target_expr string, kind string, line int"))
    pairs = spark.createDataFrame([("f\0a", "f\0b"), ("f\0b", "f\0a"), ("f\0q", "f\0a"), ("f\0a", "f\0a")], "source string, sink string")
    calls = spark.createDataFrame([("f", "g(x)")], "function string, expression string")
    got = {(r["source"][-1], r["sink"][-1]): (r["reachable"], len(r["steps"]), r["gaps"]) for r in values.trace(pairs, edges, calls).collect()}
    assert got[("a", "b")] == (True, 1, []) and got[("a", "a")] == (True, 0, [])
    assert got[("b", "a")] == (False, 0, ["calls without a known callee"])
    assert got[("q", "a")] == (False, 0, ["source is in no edge", "calls without a known callee"])


def test_predicates_on_arguments(spark):
    rows = spark.createDataFrame(
        [(1, [(0, None, "x")], {"x": ["str"]}), (2, [(0, None, "x")], {}), (3, [(0, None, "x")], {"x": ["str", "int"]}), (4, [], {}), (5, [(0, None, "'lit'")], {"'lit'": ["app.Text"]})],
        "id int, arguments array<struct<position:int,keyword:string,expression:string>>, types map<string,array<string>>",
    )
    test, literal = ArgRef(0).type_is("Text"), ArgRef(0).is_literal()
    got = {r[0]: (r[1], r[2]) for r in rows.select("id", test.outcome(), literal.outcome()).collect()}
    assert got == {1: ("failed", "failed"), 2: ("unknown", "failed"), 3: ("unknown", "failed"), 4: ("failed", "failed"), 5: ("passed", "passed")}
    assert {r[0] for r in rows.where((test & ~literal).keeps()).select("id").collect()} == {2, 3}


def test_descriptor_dimension(spark):
    own = Provider("a", "liba", (Descriptor("check", "call", "check", fqn="liba.check", detail="x"),))
    rows = descriptors.dimension(spark, [Provider("b", "libb", ()), own, Provider("a", "liba", (Descriptor("sink", "call", "sink", fqn="liba.sink", position=1),))])
    assert [(r["provider"], r["fqn"], r["position"]) for r in rows.collect()] == [("a", "liba.sink", 1)]
    with pytest.raises(ValueError):
        Descriptor("nowhere", "call", "check", fqn="x")
    with pytest.raises(ValueError):
        Descriptor("check", "call", "check")


def test_inconsistent_and_cyclic_hierarchies(spark):
    rows = [("A", []), ("B", ["A"]), ("C", ["A", "B"]), ("D", ["D"]), ("E", ["lib.X"]), ("F", ["B"])]
    classes = spark.createDataFrame(rows, "fqn string, bases array<string>")
    got = {r["fqn"]: (r["mro"], r["mro_complete"]) for r in hierarchy.linear_orders(classes).collect()}
    assert got["F"] == (["F", "B", "A", "object"], True) and got["C"] == (["C"], False) and got["E"] == (["E"], False) and got["D"][1] is False
    assert {tuple(r) for r in hierarchy.gaps(classes).collect()} == {("D", "D", "cycle"), ("E", "lib.X", "external")}


def test_repo_from_index(spark, index):
    repo = Repo(index.flat(), built_in(spark))
    assert {(r["function"], r["detail"]) for r in repo.reads.collect()} == {("shop.app.add", "form"), ("shop.app.add", "query")}
    assert ("shop.app.add", "shop.app.Shop") not in {(r["src"], r["dst"]) for r in repo.call_edges.collect()}
