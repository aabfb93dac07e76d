"""Queries over the driver's tables for pattern descriptors and for the relations that facts imply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, descriptors, hierarchy, scopes, vocabulary
from ..operators.descriptors import Descriptor, Provider
from ..operators.selectors import Source
from .queries import query
from .queries_facts import _LINES, _classes, _methods, _plain, _sql
from .views import table


def _text(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _patterns(spark: SparkSession, *given: Descriptor) -> DataFrame:
    return descriptors.dimension(spark, [Provider("lib", "lib", given)])


def _arguments(*given: tuple[int | None, str | None, Column]) -> Column:
    return F.array(*(F.struct(F.lit(p).cast("int").alias("position"), F.lit(k).cast("string").alias("keyword"), e.alias("expression")) for p, k, e in given))


# --- descriptors --------------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES} SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, CASE WHEN list_contains(mro, 'ASIA') THEN 'ASIA.save' ELSE 'EUROPE.save' END AS fqn
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN l ON l.fqn = s_name WHERE l_returnflag = 'R' AND (list_contains(mro, 'ASIA') OR list_contains(mro, 'EUROPE'))""")
def pattern_receiver_matches(spark: SparkSession, d: str) -> DataFrame:
    """Calls ``v.save()`` on a value whose type is a supplier's class; patterns name methods of two regions' classes."""
    lines = table(spark, d, "lineitem")
    site = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site")
    calls = lines.select(site, _text("o", "l_orderkey").alias("function"), _text("v", "l_suppkey").alias("receiver"), F.when(F.col("l_returnflag") == "R", "save").otherwise("load").alias("method"))
    named = lines.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    types = named.select(_text("o", "l_orderkey").alias("function"), _text("v", "l_suppkey").alias("expression"), F.col("s_name").alias("declared_type"))
    orders = hierarchy.linear_orders(_classes(spark, d))
    ancestors = orders.select(F.col("fqn").alias("root"), F.explode("mro").alias("node"))
    known = _patterns(spark, Descriptor("effect", "method", "effect", fqn="ASIA.save"), Descriptor("effect", "method", "effect", fqn="EUROPE.save"))
    return descriptors.receiver_matches(calls, types, ancestors, known).join(known.select("pattern", "fqn"), "pattern").select("site", "fqn")


_SHAPES = "SELECT event_id AS site, CASE WHEN user_id % 3 = 0 THEN 'web.session' WHEN user_id % 3 = 1 THEN 'web.g' ELSE 'other' END AS receiver, CASE event_id % 3 WHEN 0 THEN 'subscript' WHEN 1 THEN 'method' ELSE 'attribute' END AS shape, CASE event_id % 3 WHEN 0 THEN '''' || event_type || '''' WHEN 1 THEN CASE WHEN value > 50 THEN 'get' ELSE 'keys' END ELSE event_type END AS name, '''k' || CAST(user_id AS STRING) || '''' AS first_argument FROM {events}"


@query(f"""SELECT site, CASE shape WHEN 'method' THEN replace(first_argument, '''', '') ELSE replace(name, '''', '') END AS key FROM {_plain(_SHAPES, "events")} s
WHERE (receiver = 'web.session' AND shape IN ('subscript', 'method') OR receiver = 'web.g' AND shape = 'attribute') AND (shape <> 'method' OR name IN ('get', 'pop'))""")
def pattern_containers(spark: SparkSession, d: str) -> DataFrame:
    known = _patterns(spark, Descriptor("input", "container", "input", fqn="web.session", access=("subscript", "method")), Descriptor("input", "container", "input", fqn="web.g", access=("attribute",)))
    return descriptors.container_matches(_sql(spark, d, _SHAPES, "events"), known).select("site", "key")


@query("SELECT 'f' || o_orderkey AS function, 'p' || o_custkey AS parameter, CASE o_orderstatus WHEN 'F' THEN 'query' ELSE 'json' END AS source FROM orders WHERE o_orderstatus IN ('F', 'O')")
def pattern_parameters(spark: SparkSession, d: str) -> DataFrame:
    default = F.when(F.col("o_orderstatus") == "F", "api.Query").when(F.col("o_orderstatus") == "O", "api.Body")
    given = table(spark, d, "orders").select(_text("f", "o_orderkey").alias("function"), _text("p", "o_custkey").alias("name"), F.concat(default, F.lit("(None)")).alias("default"), default.alias("default_fqn"))
    known = _patterns(spark, Descriptor("input", "parameter", "input", fqn="api.Query", detail="query"), Descriptor("input", "parameter", "input", fqn="api.Body", detail="json"))
    return descriptors.parameter_matches(given, known).join(known.select("pattern", F.col("detail").alias("source")), "pattern").select("function", "parameter", "source")


@query(f"""WITH {_LINES} SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, 'field' || l_partkey AS key FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN l ON l.fqn = s_name WHERE l_linestatus = 'O' AND list_contains(mro, 'AFRICA')""")
def pattern_form_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    site = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site")
    accesses = lines.select(site, _text("o", "l_orderkey").alias("function"), F.concat(_text("form", "l_suppkey"), _text(".field", "l_partkey")).alias("target"), F.when(F.col("l_linestatus") == "O", "data").otherwise("errors").alias("attribute"))
    made = lines.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    instances = made.select(_text("o", "l_orderkey").alias("function"), _text("form", "l_suppkey").alias("expression"), F.col("s_name").alias("class")).distinct()
    ancestors = hierarchy.linear_orders(_classes(spark, d)).select(F.col("fqn").alias("root"), F.explode("mro").alias("node"))
    known = _patterns(spark, Descriptor("input", "field", "input", fqn="AFRICA", name="data"))
    return descriptors.field_matches(accesses, instances, ancestors, known).select("site", "key")


@query("SELECT event_id AS site, 'web.' || event_type AS fqn FROM events WHERE event_type IN ('click', 'view')")
def pattern_symbols(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "events").select(F.col("event_id").alias("site"), F.concat(F.lit("web."), "event_type").alias("fqn"))
    known = _patterns(spark, *(Descriptor("propagation", "symbol", "proxy", fqn=f"web.{n}") for n in ("click", "view", "nothing")))
    return descriptors.symbol_matches(refs, known).join(known.select("pattern", "fqn"), "pattern").select("site", "fqn")


_M = "m AS (SELECT r_name AS owner, 'get' AS name FROM region UNION SELECT n_name, 'post' FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT s_name, 'get' FROM supplier WHERE s_acctbal > 8000)"


@query(f"""WITH {_LINES}, {_M}, t AS (SELECT fqn, name AS method, arg_min(owner, list_position(mro, owner)) AS defined_in, any_value(mro) AS mro FROM l JOIN m ON list_contains(mro, owner) GROUP BY 1, 2)
SELECT fqn, defined_in || '.' || method AS handler, upper(method) AS http_method FROM t WHERE list_contains(mro[2:], 'AMERICA')""")
def pattern_class_views(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    methods = table(spark, d, "region").select(F.col("r_name").alias("owner"), F.lit("get").alias("name"))
    methods = methods.union(nation.where("n_nationkey % 2 = 0").select("n_name", F.lit("post"))).union(supplier.where("s_acctbal > 8000").select("s_name", F.lit("get")))
    classes = _classes(spark, d)
    orders = hierarchy.linear_orders(classes)
    ancestors = orders.select(F.col("fqn").alias("root"), F.explode(F.expr("slice(mro, 2, size(mro))")).alias("node"))
    known = _patterns(spark, Descriptor("routing", "view", "route", fqn="AMERICA", methods=dict(descriptors.VIEW_METHODS)))
    hits = descriptors.class_matches(classes, ancestors, known)
    return descriptors.class_view_routes(hits, hierarchy.method_table(orders, methods), known).select("fqn", "handler", "http_method")


@query("""SELECT s_name AS class, 'Guard' || s_nationkey % 3 AS guard FROM supplier WHERE s_nationkey % 2 = 0 UNION SELECT s_name, 'auth.Extra' FROM supplier WHERE s_nationkey % 2 = 0
UNION SELECT s_name, 'Limit' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND s_nationkey % 2 = 1""")
def pattern_guard_lists(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("s_nationkey") % 2 == 0
    value = F.when(even, F.concat(F.lit("[Guard"), (F.col("s_nationkey") % 3).cast("string"), F.lit(", auth.Extra]"))).otherwise("(Limit,)")
    lists = table(spark, d, "supplier").select(F.col("s_name").alias("class"), F.when(even, "permission_classes").otherwise("throttles").alias("name"), value.alias("value"))
    ancestors = hierarchy.linear_orders(_classes(spark, d)).select(F.col("fqn").alias("root"), F.explode("mro").alias("node"))
    known = _patterns(spark, Descriptor("check", "guard_list", "check", name="permission_classes"), Descriptor("check", "guard_list", "check", fqn="ASIA", name="throttles"))
    return descriptors.guard_lists(lists, ancestors, known).select("class", "guard")


@query("SELECT 'urls' || c_custkey AS list, '/c/' || c_custkey AS path, 'view' || c_nationkey AS view FROM customer UNION ALL SELECT 'urls' || c_custkey, '/k', 'named' || c_nationkey FROM customer")
def pattern_imperative_routes(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("c_custkey").cast("string")
    value = F.concat(F.lit("[path('/c/"), number, F.lit("', view"), F.col("c_nationkey").cast("string"), F.lit("), path('/k', view=named"), F.col("c_nationkey").cast("string"), F.lit("), other('/x', y), 3]"))
    entries = descriptors.route_entries(table(spark, d, "customer").select(_text("urls", "c_custkey").alias("list"), value.alias("value"))).withColumn("fqn", F.concat(F.lit("web."), "callee"))
    known = _patterns(spark, Descriptor("routing", "route_entry", "route", fqn="web.path", position=1, keyword="view"))
    return descriptors.imperative_routes(entries, known).select("list", "path", "view")


@query("""SELECT 'g' || n_regionkey AS parent, 'bp_' || n_nationkey AS child FROM nation WHERE n_nationkey % 2 = 0""")
def pattern_group_mounts(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    file = F.lit("app.py").alias("file")
    made = nation.select(_text("v", "n_nationkey").alias("variable"), file, F.lit("web.Group").alias("fqn"), _arguments((0, None, F.concat(F.lit("'bp_"), F.col("n_nationkey").cast("string"), F.lit("'"))), (None, "prefix", F.lit("'/x'"))).alias("arguments"))
    made = made.union(region.select(_text("r", "r_regionkey"), file, F.lit("web.Group"), _arguments((0, None, F.concat(F.lit("'g"), F.col("r_regionkey").cast("string"), F.lit("'"))), (None, "other", F.lit("1")))))
    known = _patterns(spark, Descriptor("routing", "call", "group", fqn="web.Group", position=0, keyword="prefix"))
    mount = _patterns(spark, Descriptor("routing", "call", "mount", fqn="web.Group.include", position=0))
    calls = nation.where("n_nationkey % 2 = 0").select(file, _text("r", "n_regionkey").alias("receiver"), F.lit("web.Group.include").alias("fqn"), _arguments((0, None, _text("v", "n_nationkey"))).alias("arguments"))
    return descriptors.group_mounts(calls, descriptors.router_groups(made, known), mount)


@query("SELECT DISTINCT 'o' || l_orderkey AS src, 'h' || s_suppkey AS dst FROM lineitem JOIN supplier ON s_nationkey = l_suppkey % 25 WHERE l_returnflag = 'R' AND s_acctbal > 5000")
def pattern_signal_dispatch(spark: SparkSession, d: str) -> DataFrame:
    none = _arguments((0, None, F.lit("x")))
    connects = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.lit("m").alias("function"), _text("sig", "s_nationkey").alias("receiver"), F.lit("web.Signal.connect").alias("fqn"), _arguments((0, None, _text("h", "s_suppkey"))).alias("arguments"))
    sends = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(_text("o", "l_orderkey").alias("function"), _text("sig", F.col("l_suppkey") % 25).alias("receiver"), F.lit("web.Signal.send").alias("fqn"), none.alias("arguments"))
    known = _patterns(spark, Descriptor("dependency", "register", "dispatch", fqn="web.Signal.connect", position=0), Descriptor("dependency", "send", "dispatch", fqn="web.Signal.send"))
    registered, sent = descriptors.dispatches(connects.union(sends), known)
    return derive.signal_edges(registered, sent)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Library calls with two positional arguments and a keyword."""
    lines = table(spark, d, "lineitem")
    given = _arguments((0, None, _text("a", "l_suppkey")), (1, None, F.when(F.col("l_linestatus") == "O", F.lit("'lit'")).otherwise(_text("b", "l_partkey"))), (None, "_external", F.when(F.col("l_tax") > 0.04, "True").otherwise("False")))
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), _text("o", "l_orderkey").alias("function"), F.concat(F.lit("lib."), F.col("l_returnflag")).alias("fqn"),
        F.concat(F.lit("lib."), F.col("l_returnflag"), F.lit("("), _text("a", "l_suppkey"), F.lit(")")).alias("expression"), F.col("l_linenumber").alias("line"), given.alias("arguments"),
    )


_SECOND = "CASE WHEN l_linestatus = 'O' THEN '''lit''' ELSE 'b' || l_partkey END"


@query(f"""SELECT 'o' || l_orderkey AS function, source_expr, 'lib.R(a' || l_suppkey || ')' AS target_expr, l_linenumber AS line FROM lineitem, LATERAL (SELECT unnest(['a' || l_suppkey, CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'False' END]) AS source_expr) WHERE l_returnflag = 'R'""")
def pattern_flow_propagators(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.propagations(_calls(spark, d), _patterns(spark, Descriptor("propagation", "call", "flow", fqn="lib.R", position=1)))


@query("SELECT 'o' || l_orderkey AS function, 'lib.A(a' || l_suppkey || ')' AS expression, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'A' AND NOT l_tax > 0.04")
def pattern_generated_urls(spark: SparkSession, d: str) -> DataFrame:
    found = descriptors.generated_urls(_calls(spark, d), _patterns(spark, Descriptor("url", "call", "url", fqn="lib.A", safe_kinds=("redirect",))))
    return found.select("function", "expression", "line")


@query("SELECT DISTINCT 'o' || l_orderkey AS function, 'lib.' || l_returnflag || '(a' || l_suppkey || ')' AS guard, 'a' || l_suppkey AS expression, l_linenumber AS line, l_returnflag = 'N' AS validated_when FROM lineitem WHERE l_returnflag IN ('N', 'R')")
def pattern_validations(spark: SparkSession, d: str) -> DataFrame:
    known = _patterns(spark, Descriptor("validation", "call", "valid", fqn="lib.N", position=0, safe_kinds=("sql",)), Descriptor("validation", "call", "valid", name="R", position=0, safe_kinds=("sql",), detail="false"))
    return descriptors.validations(_calls(spark, d), known).select("function", "guard", "expression", "line", "validated_when")


@query(f"SELECT 'o' || l_orderkey AS function, l_linenumber AS line, 'sql' AS kind, {_SECOND} AS argument FROM lineitem WHERE l_returnflag = 'A'")
def pattern_sink_arguments(spark: SparkSession, d: str) -> DataFrame:
    known = _patterns(spark, Descriptor("sink", "call", "sink", fqn="lib.A", detail="sql", position=1), Descriptor("sink", "call", "sink", fqn="lib.R", detail="never", position=7))
    return descriptors.sink_arguments(_calls(spark, d), known).select("function", "line", "kind", "argument")


@query("""WITH t AS (SELECT 'o' || o_orderkey AS function, 'a' || k AS expression, CASE WHEN k % 2 = 0 THEN 'str' ELSE 'app.Text' END AS t FROM orders, (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 < 4) WHERE o_orderstatus = 'O')
SELECT l_orderkey * 10 + l_linenumber AS site, CASE WHEN t.t IS NULL THEN 'unknown' ELSE 'passed' END AS outcome FROM lineitem LEFT JOIN t ON t.function = 'o' || l_orderkey AND t.expression = 'a' || l_suppkey
WHERE l_returnflag = 'R' AND (t.t IS NULL OR t.t = 'app.Text') UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'passed' FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'""")
def pattern_when_predicates(spark: SparkSession, d: str) -> DataFrame:
    known = _patterns(spark, Descriptor("effect", "call", "effect", fqn="lib.R", position=0, when_types=("Text",)), Descriptor("effect", "call", "effect", fqn="lib.A", position=1, when_literal=True))
    calls = _calls(spark, d)
    used = table(spark, d, "lineitem").where("l_suppkey % 10 < 4").join(table(spark, d, "orders").where("o_orderstatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"))
    facts = used.select(_text("o", "l_orderkey").alias("function"), _text("a", "l_suppkey").alias("expression"), F.when(F.col("l_suppkey") % 2 == 0, "str").otherwise("app.Text").alias("declared_type"), F.lit(True).alias("is_concrete"))
    hits = calls.join(known.select("fqn", "position", "keyword", "when_types", "when_literal"), "fqn")
    return descriptors.restricted(hits, descriptors.function_types(facts)).select("site", "outcome")


@query("SELECT DISTINCT 'o' || l_orderkey AS function, 'k' || l_partkey % 9 AS key, l_linenumber AS line FROM lineitem WHERE l_suppkey % 5 IN (0, 1)")
def pattern_claims(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(_text("o", "l_orderkey").alias("function"), _text("t", F.col("l_suppkey") % 5).alias("target"), _text("k", F.col("l_partkey") % 9).alias("key"), F.col("l_linenumber").alias("line"))
    number = F.col("target").substr(2, 1)
    flow = lines.select("function", "target", F.when(number == "0", "parse_id_token").alias("call_name"), F.when(number == "1", "auth.exchange").alias("call_fqn"))
    known = _patterns(spark, Descriptor("input", "call", "claims", name="parse_id_token"), Descriptor("input", "call", "claims", fqn="auth.exchange"))
    return descriptors.claim_reads(flow, lines, known)


@query("""SELECT DISTINCT 'o' || l_orderkey AS function, CASE l_returnflag WHEN 'A' THEN 'authentication' ELSE 'rate' END AS category, CASE l_returnflag WHEN 'A' THEN 'call' ELSE 'decorator' END AS how FROM lineitem WHERE l_returnflag IN ('A', 'R')
UNION SELECT DISTINCT 'o' || l_orderkey, 'token', 'method' FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'""")
def pattern_security_checks(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d)
    known = _patterns(spark, Descriptor("check", "call", "check", fqn="lib.A", detail="authentication"), Descriptor("check", "decorator", "check", fqn="lib.R", detail="rate"), Descriptor("check", "method", "check", fqn="Token.verify", detail="token"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'N' AND l_linestatus = 'O'")
    methods = lines.select(_text("o", "l_orderkey").alias("function")).withColumn("pattern", F.lit(2))
    return descriptors.check_matches(calls, calls, methods, known)


# --- what facts imply ---------------------------------------------------------------------------------------------

_VERBS = "SELECT 'o' || CAST(l_orderkey AS STRING) AS function, CASE l_linenumber % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'logger' WHEN 2 THEN 'cache' END AS receiver, CASE l_returnflag WHEN 'A' THEN 'save' WHEN 'R' THEN 'delete_item' ELSE 'fetch' END AS method, 'f' || CAST(l_suppkey % 10 AS STRING) || '.py' AS file, CAST(l_orderkey AS INT) AS line, l_linenumber * 1000 + l_partkey * 10000000 + l_suppkey * 100000000000 AS column FROM {lineitem}"


@query(f"""SELECT DISTINCT function, file, line, "column", CASE WHEN receiver = 'store' AND file IN ('f1.py', 'f2.py', 'f3.py') THEN 4 ELSE 1 END AS scope FROM {_plain(_VERBS, "lineitem").replace("AS column", 'AS "column"')} v WHERE receiver IN ('store', 'cache') AND method IN ('save', 'delete_item') AND NOT (line % 5 = 0)""")
def inferred_state_writes(spark: SparkSession, d: str) -> DataFrame:
    calls = _sql(spark, d, _VERBS, "lineitem")
    modelled = calls.where("line % 5 = 0").select("file", "line", "column")
    shared = spark.sql("SELECT file, name FROM VALUES ('f1.py'), ('f2.py'), ('f3.py') AS f(file) LATERAL VIEW explode(array('store', 'cache')) AS name")
    return derive.inferred_writes(calls, modelled, shared)


_WRITES = "SELECT CASE WHEN l_linenumber > 1 THEN 'o' || CAST(l_orderkey AS STRING) END AS function, 'f' || CAST(l_suppkey % 10 AS STRING) || '.py' AS file, CAST(l_linenumber AS INT) AS line, CASE l_returnflag WHEN 'A' THEN 'STATE' WHEN 'R' THEN 'g.user' ELSE 'local' END AS target, CASE WHEN l_tax > 0.05 THEN '_x' ELSE 'role' || CAST(l_partkey % 5 AS STRING) END AS attribute, CASE WHEN l_discount > 0.04 THEN 'ATTR' ELSE 'SUBSCRIPT' END AS kind, l_linestatus = 'O' AS is_write FROM {lineitem}"


@query(f"SELECT function, file, line, attribute AS key FROM {_plain(_WRITES, 'lineitem')} w WHERE is_write AND function IS NOT NULL AND target = 'STATE' AND file IN ('f1.py', 'f4.py') AND NOT (kind = 'ATTR' AND attribute = '_x')")
def server_state_writes(spark: SparkSession, d: str) -> DataFrame:
    shared = spark.sql("SELECT file, 'STATE' AS name FROM VALUES ('f1.py'), ('f4.py') AS f(file)")
    return derive.server_writes(_sql(spark, d, _WRITES, "lineitem"), shared)


@query(f"SELECT function, file, line, attribute AS key FROM {_plain(_WRITES, 'lineitem')} w WHERE is_write AND function IS NOT NULL AND target = 'g.user' AND kind = 'ATTR' AND attribute <> '_x'")
def principal_attribute_writes(spark: SparkSession, d: str) -> DataFrame:
    return derive.principal_writes(_sql(spark, d, _WRITES, "lineitem"))


@query("""SELECT DISTINCT 'p' || l_partkey AS function, 'form' AS container, 'k' || s.s_nationkey AS key, 7 AS line FROM lineitem JOIN supplier s ON s.s_suppkey = l_partkey WHERE l_returnflag = 'R'""")
def container_argument_reads(spark: SparkSession, d: str) -> DataFrame:
    expression = F.when(F.col("l_returnflag") == "R", "request.form").otherwise("x")
    arguments = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), _text("p", "l_partkey").alias("callee"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("keyword"), expression.alias("expression"))
    parameters = table(spark, d, "part").select(_text("p", "p_partkey").alias("callee"), F.lit("data").alias("name"), F.lit(0).alias("position"))
    containers = spark.sql("SELECT 'request.form' AS expression, 'form' AS container")
    accesses = table(spark, d, "supplier").select(_text("p", "s_suppkey").alias("function"), F.lit("data").alias("target"), _text("k", "s_nationkey").alias("key"), F.lit(7).alias("line"))
    return derive.container_reads(arguments, parameters, containers, accesses)


@query("SELECT DISTINCT 'u' || user_id AS function, 'session' AS container, event_type AS key, CAST(event_id % 100 AS INT) AS line FROM events WHERE value > 30 AND user_id % 2 = 0")
def membership_reads(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "events").select(_text("u", "user_id").alias("function"), (F.col("event_id") % 100).cast("int").alias("line"), F.when(F.col("value") > 30, "membership").otherwise("comparison").alias("kind"), F.col("event_type").alias("literal"), F.when(F.col("user_id") % 2 == 0, "web.session").otherwise("names").alias("right"))
    return derive.membership_reads(tests, spark.sql("SELECT 'web.session' AS expression, 'session' AS container"))


@query("SELECT 'r' || c_custkey AS route, 'h' || c_nationkey AS function, 'id' AS key, 'int' AS type FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT 'r' || c_custkey, 'h' || c_nationkey, 'slug', 'string' FROM customer")
def path_parameter_reads(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "customer").select(_text("r", "c_custkey").alias("route"), F.lit("/x/<int:id>/<slug>/<gone>").alias("path"), _text("h", "c_nationkey").alias("handler"))
    nation = table(spark, d, "nation")
    parameters = nation.select(_text("h", "n_nationkey").alias("callee"), F.lit("slug").alias("name")).union(nation.where("n_nationkey % 2 = 0").select(_text("h", "n_nationkey"), F.lit("id")))
    return derive.path_reads(routes, parameters)


@query("""WITH t AS (SELECT 't' || s_nationkey AS tab, 'k' || s_suppkey % 3 AS key, 'h' || s_suppkey AS handler FROM supplier), u AS (SELECT 'c' || c_custkey AS caller, 't' || c_nationkey AS tab, CASE WHEN c_custkey % 4 > 0 THEN 'k' || c_custkey % 3 END AS key FROM customer)
SELECT DISTINCT caller AS src, handler AS dst FROM u JOIN t ON t.tab = u.tab AND (u.key IS NULL OR u.key = t.key)""")
def table_dispatch_edges(spark: SparkSession, d: str) -> DataFrame:
    tables = table(spark, d, "supplier").select(_text("t", "s_nationkey").alias("table"), _text("k", F.col("s_suppkey") % 3).alias("key"), _text("h", "s_suppkey").alias("handler"))
    lookups = table(spark, d, "customer").select(_text("c", "c_custkey").alias("caller"), _text("t", "c_nationkey").alias("table"), F.when(F.col("c_custkey") % 4 > 0, _text("k", F.col("c_custkey") % 3)).alias("key"))
    return derive.table_edges(tables, lookups)


_NESTED = "n AS (SELECT s_name AS grp, n_name AS ancestor FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT s_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"


def _nesting(spark: SparkSession, d: str) -> DataFrame:
    from .views import view

    return derive.group_nesting(view(spark, d, "hierarchy").toDF("parent", "child"))


@query(f"WITH {_NESTED} SELECT grp, ancestor FROM n")
def group_nesting(spark: SparkSession, d: str) -> DataFrame:
    return _nesting(spark, d).withColumnRenamed("group", "grp")


@query("""WITH r AS (SELECT n_name AS grp, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 GROUP BY 1), k AS (SELECT n_name AS grp, CASE WHEN n_nationkey % 2 = 0 THEN '/p' || n_nationkey END AS prefix FROM nation WHERE n_regionkey < 3)
SELECT coalesce(r.grp, k.grp) AS grp, prefix, coalesce(n, 0) AS n_routes FROM r FULL JOIN k ON k.grp = r.grp""")
def route_groups(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    routes = table(spark, d, "customer").where("c_custkey % 3 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("group"))
    declared = nation.where("n_regionkey < 3").select(F.col("n_name").alias("group"), F.when(F.col("n_nationkey") % 2 == 0, _text("/p", "n_nationkey")).alias("prefix"))
    return derive.groups(routes, declared.union(declared.select("group", F.lit(None).cast("string")))).withColumnRenamed("group", "grp")


@query(f"""WITH {_NESTED}, h AS (SELECT 'before_' || r_name AS hook, r_name AS grp FROM region WHERE r_regionkey < 3 UNION SELECT 'own_' || s_name, s_name FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT 'all', NULL),
o AS (SELECT 'r' || s_suppkey AS route, s_name AS grp FROM supplier) SELECT DISTINCT route, hook FROM (SELECT route, grp FROM o UNION SELECT route, ancestor FROM o JOIN n ON n.grp = o.grp) x JOIN h ON h.grp = x.grp""")
def lifecycle_hooks_of_routes(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "supplier").select(_text("r", "s_suppkey").alias("route"), F.col("s_name").alias("group"))
    hooks = table(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("before_"), "r_name").alias("hook"), F.col("r_name").alias("group"))
    hooks = hooks.union(table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("own_"), "s_name"), "s_name")).union(spark.sql("SELECT 'all', CAST(NULL AS STRING)"))
    return derive.hooks_of_routes(routes, hooks, _nesting(spark, d))


@query("SELECT 'r' || c_custkey AS route, 'csrf' AS \"check\" FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'r' || c_custkey, 'rate' FROM customer WHERE c_nationkey = 3")
def control_plane_exemptions(spark: SparkSession, d: str) -> DataFrame:
    handler = F.concat(F.lit("app.views."), F.when(F.col("c_custkey") % 7 == 0, "Open").otherwise("Shut"), _text(".h", "c_custkey"))
    routes = table(spark, d, "customer").select(_text("r", "c_custkey").alias("route"), handler.alias("handler"), _text("g", "c_nationkey").alias("group"))
    sevens = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("Open"), _text(".h", "c_custkey")).alias("target"), F.lit("csrf").alias("check"))
    return derive.exempted(routes, sevens.union(spark.sql("SELECT 'g3', 'rate'")))


@query(f"WITH {_NESTED} SELECT DISTINCT grp AS function, 'guard_' || ancestor AS category FROM n JOIN region ON r_name = ancestor WHERE r_regionkey % 2 = 0")
def inherited_dependency_guards(spark: SparkSession, d: str) -> DataFrame:
    from .views import view

    dependencies = view(spark, d, "hierarchy").select(F.col("dst").alias("function"), F.col("src").alias("dependency"))
    guards = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("function"), F.concat(F.lit("guard_"), "r_name").alias("category"))
    return derive.inherited_guards(dependencies, guards)


@query(f"""WITH {_NESTED}, k AS (SELECT 'f' || c_custkey AS target, CASE c_custkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'x.require_' || c_nationkey ELSE 'x.cached' END AS fqn FROM customer JOIN supplier ON s_suppkey = c_custkey % 50 + 1)
SELECT target, fqn, CASE WHEN fqn IN (SELECT grp FROM n WHERE ancestor = 'ASIA') THEN 'check' ELSE 'suspect' END AS verdict FROM k WHERE (fqn IN (SELECT grp FROM n WHERE ancestor = 'ASIA') OR fqn LIKE 'x.require%') AND fqn <> 'x.require_4'""")
def inferred_custom_auth(spark: SparkSession, d: str) -> DataFrame:
    from .views import view

    third = F.col("c_custkey") % 3
    joined = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey") % 50 + 1)
    marks = joined.select(_text("f", "c_custkey").alias("target"), F.when(third == 0, F.col("s_name")).when(third == 1, _text("x.require_", "c_nationkey")).otherwise("x.cached").alias("fqn"))
    edges = view(spark, d, "hierarchy").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return derive.inferred_auth(marks, spark.sql("SELECT 'x.require_4' AS fqn"), edges, spark.sql("SELECT 'ASIA' AS fqn"))


@query("""SELECT 'f' || l_suppkey AS fqn, max(l_linenumber * 1000000 + l_orderkey) FILTER (WHERE l_returnflag <> 'R') AS line, count(*) FILTER (WHERE l_returnflag = 'R') AS n_overloads FROM lineitem GROUP BY 1""")
def overloads_grouped(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber") * 1000000 + F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(_text("f", "l_suppkey").alias("fqn"), line.alias("line"), F.array(F.col("l_partkey").cast("string")).alias("params"), (F.col("l_returnflag") == "R").alias("is_overload"))
    found = derive.with_overloads(rows)
    return found.select("fqn", "line", F.size("overloads").cast("long").alias("n_overloads"))


@query("SELECT 'o' || l_orderkey AS function, 's' || l_suppkey AS name, CAST(min(l_linenumber) AS INT) AS line FROM lineitem GROUP BY 1, 2")
def first_definitions(spark: SparkSession, d: str) -> DataFrame:
    return derive.first_definitions(table(spark, d, "lineitem").select(_text("o", "l_orderkey").alias("function"), _text("s", "l_suppkey").alias("name"), F.col("l_linenumber").cast("int").alias("line")))


@query("SELECT statement, source, target FROM (SELECT l_orderkey AS statement, l_suppkey AS source, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000 + l_partkey * 10000000 + l_suppkey * 100000000000) AS target FROM lineitem) WHERE target IS NOT NULL")
def chained_assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("statement"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100000000000).alias("place"), F.col("l_suppkey").alias("target"))
    return derive.chain_links(rows)


@query("""WITH p AS (SELECT l_orderkey AS list, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey) AS b FROM lineitem)
SELECT list, bool_and(a < b) AS holds FROM p WHERE b IS NOT NULL GROUP BY 1""")
def places_in_order(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    places = lines.select(F.col("l_orderkey").alias("list"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("place"))
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("a")).join(lines.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b")
    return derive.in_order(places, pairs)


@query("SELECT event_type AS kind, 'm' || user_id % 7 AS message, CASE WHEN user_id % 2 = 0 THEN 'f' || user_id % 5 END AS file, min(event_id) AS ord FROM events GROUP BY ALL")
def gaps_once(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "events").select(F.col("event_type").alias("kind"), _text("m", F.col("user_id") % 7).alias("message"), F.when(F.col("user_id") % 2 == 0, _text("f", F.col("user_id") % 5)).alias("file"), F.col("event_id").alias("ord"))
    return derive.distinct_gaps(gaps, ["ord"])


_LATE = "CASE WHEN {0}l_linenumber > 2 THEN {0}l_linenumber END"


@query(f"""SELECT l_suppkey, coalesce(line, -1) AS line, side FROM (SELECT DISTINCT l_suppkey, {_LATE.format("")} AS line, 1 AS side FROM lineitem WHERE l_returnflag = 'R' UNION ALL
SELECT DISTINCT l_suppkey, {_LATE.format("")}, 2 FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_suppkey = a.l_suppkey AND ({_LATE.format("b.")}) IS NOT DISTINCT FROM ({_LATE.format("a.")})))""")
def reads_added_once(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda flag, side: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_suppkey", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("line"), F.lit(side).alias("side"))
    return derive.added_once(rows("R", 1).distinct(), rows("A", 2), ["l_suppkey", "line"]).na.fill(-1, ["line"])


# --- scopes and named selectors -----------------------------------------------------------------------------------

_AREAS = ("db_read", "db_write", "db_delete", "file_write", "cache_read", "state_write", "response_write")
_EFFECTS = "SELECT l_orderkey * 10 + l_linenumber AS id, 'o' || CAST(l_orderkey AS STRING) AS function, CASE l_suppkey % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AREAS)) + " END AS category, l_returnflag AS key, CAST(l_linenumber AS INT) AS scope FROM {lineitem}"


@query(" UNION ALL ".join(f"SELECT '{n}' AS selector, id FROM {_plain(_EFFECTS, 'lineitem')} e WHERE {test}" for n, test in {
    "mutation.persistent": "category IN ('db_write', 'db_delete', 'file_write', 'state_write')", "data.read": "category IN ('db_read', 'cache_read')", "db.any": "category IN ('db_read', 'db_write', 'db_delete')",
    "response.write": "category = 'response_write' AND key = 'R'", "state.write": "category = 'state_write' AND (scope & 4) <> 0"}.items()))
def named_effect_selectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _EFFECTS, "lineitem")
    chosen = {"mutation.persistent": {}, "data.read": {}, "db.any": {}, "response.write": {"key": "R"}, "state.write": {"scope": 4}}
    parts = [rows.where(vocabulary.effect(n, **more).matches()).select(F.lit(n).alias("selector"), "id") for n, more in chosen.items()]
    return reduce(DataFrame.union, parts)


_NAMED = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_suppkey % 5 WHEN 0 THEN 'jwt.decode' WHEN 1 THEN 'app.check_password' WHEN 2 THEN 'unicodedata.normalize' WHEN 3 THEN 'str.lower' ELSE 'app.other' END AS fqn FROM {lineitem}"


@query(f"""SELECT id, CASE fqn WHEN 'jwt.decode' THEN 'token' WHEN 'app.check_password' THEN 'compare' ELSE 'normalise' END AS what FROM {_plain(_NAMED, "lineitem")} n WHERE fqn <> 'app.other'""")
def named_function_selectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _NAMED, "lineitem").withColumn("name", F.substring_index("fqn", ".", -1))
    what = F.when(vocabulary.function("token.verify").matches(), "token").when(vocabulary.function("crypto.compare").matches(), "compare").when(vocabulary.normalising().matches(), "normalise")
    return rows.select("id", what.alias("what")).where("what IS NOT NULL")


_SCOPE = "SELECT 'c' || CAST(o_custkey AS STRING) AS owner, 'reachable' AS scope, 'o' || CAST(o_orderkey AS STRING) AS function FROM {orders}"
_INSIDE = "SELECT 'o' || CAST(l_orderkey AS STRING) AS function, CASE l_suppkey % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'form' WHEN 2 THEN 'session' ELSE 'header' END AS container, 'k' || CAST(l_partkey % 5 AS STRING) AS key, l_returnflag || '|' || l_linestatus AS category, 's' || CAST(l_suppkey AS STRING) || ' > 3' AS expression, 's' || CAST(l_suppkey AS STRING) AS left_side, CAST(l_linenumber % 3 AS STRING) AS block FROM {lineitem}"
_TESTS = {
    "reads": "container <> 'session'", "session": "container = 'session'", "query": "container = 'query'", "checks": "list_contains(string_split(category, '|'), 'O')", "using": "left_side = 's7' OR contains(expression, 's7')", "branch": "block = '1'",
}


@query(f"WITH s AS {_plain(_SCOPE, 'orders')}, f AS {_plain(_INSIDE, 'lineitem')} " + " UNION ALL ".join(f"SELECT '{n}' AS question, owner, count(*) AS n FROM s JOIN f ON f.function = s.function WHERE {test} GROUP BY owner" for n, test in _TESTS.items()))
def scope_questions(spark: SparkSession, d: str) -> DataFrame:
    facts = _sql(spark, d, _INSIDE, "lineitem").withColumnRenamed("left_side", "left").withColumn("right", F.lit("3"))
    seen = scopes.ScopeView(_sql(spark, d, _SCOPE, "orders"), "reachable", {"reads": facts, "checks": facts, "conditions": facts})
    chosen = facts.where("block = '1'").select("function", "block")
    parts = {"reads": seen.reads(), "session": seen.reads(Source("session")), "query": seen.reads(Source("query", (("key", None),))), "checks": seen.checks("O"), "using": seen.conditions("s7"), "branch": seen.restricted(chosen, "checks")}
    counted = [df.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("question"), "owner", "n") for n, df in parts.items()]
    return reduce(DataFrame.union, counted)
