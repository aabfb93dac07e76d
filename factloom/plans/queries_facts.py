"""Queries over the driver's tables for facts and names: relations' filters, symbols, resolution, hierarchies, scalars, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions, scalars
from ..operators import hierarchy, resolution, summaries
from ..operators.relations import AttributeFacts, CallSites, Checks, ClassFacts, Classes, Conditions, DecoratorFacts, Decorators, ErrorFacts, FlowFacts, FunctionFacts, Functions, Groups, ImportFacts, Routes, SafeValues, Sinks, SymbolFacts
from ..operators.selectors import Fn
from .queries import query
from .views import sql_of, table, view


def _sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, d, t) for t in tables})


def _plain(text: str, *tables: str) -> str:
    return "(" + text.format(**{t: t for t in tables}) + ")"


def _each(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    """The rows of several filters, each under its name."""
    return reduce(DataFrame.union, (df.select(F.lit(name).alias("filter"), *columns) for name, df in parts.items()))


def _each_sql(rows: str, columns: str, filters: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS filter, {columns} FROM {rows} r WHERE {test}" for name, test in filters.items())


# --- relations' filters -------------------------------------------------------------------------------------------

_FUNCTIONS = """SELECT 'm' || CAST(c_nationkey AS STRING) || '.C' || CAST(c_custkey % 50 AS STRING) || '.f' || CAST(c_custkey AS STRING) AS fqn, 'f' || CAST(c_custkey AS STRING) AS name,
 'app/m' || CAST(c_nationkey AS STRING) || '.py' AS file, CAST(c_custkey AS INT) AS line, c_mktsegment = 'BUILDING' AS is_method, c_mktsegment = 'MACHINERY' AS is_nested,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'METHOD' WHEN 'MACHINERY' THEN 'NESTED' ELSE 'TOP_LEVEL' END AS kind,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'm' || CAST(c_nationkey AS STRING) || '.C' || CAST(c_custkey % 50 AS STRING) END AS parent_class, c_mktsegment AS deco FROM {customer}"""


@query(_each_sql(_plain(_FUNCTIONS, "customer"), "fqn", {
    "in_file": "file = 'app/m3.py'", "in_dir": "starts_with(file, 'app/m1')", "in_class": "parent_class = 'm7.C7'", "methods": "is_method", "top_level": "kind = 'TOP_LEVEL'",
    "nested": "is_nested", "decorated_with": "deco IN ('HOUSEHOLD') OR 'web.' || deco = 'HOUSEHOLD'", "named": "name = 'f77'", "with_fqn": "name = 'f78'", "any_decorator": "deco = 'FURNITURE'"}))
def function_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _FUNCTIONS, "customer").withColumns({"decorator_names": F.array("deco"), "decorator_fqns": F.array(F.concat(F.lit("web."), "deco"))})
    facts, domain = FunctionFacts(rows, ("file", "line", "fqn")), Functions(rows, ("fqn",))
    marks = rows.select(F.col("fqn").alias("target_fqn"), F.col("deco").alias("name"), F.concat(F.lit("web."), "deco").alias("fqn"))
    wanted = rows.where("name = 'f78'").select("fqn").collect()  # one name
    return _each({
        "in_file": facts.in_file("app/m3.py").df, "in_dir": facts.in_dir("app/m1").df, "in_class": facts.in_class("m7.C7").df, "methods": facts.methods().df, "top_level": facts.top_level().df,
        "nested": facts.nested().df, "decorated_with": facts.decorated_with("HOUSEHOLD").df, "named": domain.named("f77").df,
        "with_fqn": domain.with_fqn(wanted[0]["fqn"] if wanted else "").df, "any_decorator": domain.decorated_with(marks, "web.FURNITURE").df,
    }, "fqn")


_ACCESSES = """SELECT l_orderkey * 10 + l_linenumber AS id, 's' || CAST(l_suppkey AS STRING) AS target_expr, 'a' || CAST(l_linenumber AS STRING) AS attr_name, l_linestatus = 'O' AS is_write,
 CASE l_returnflag WHEN 'A' THEN 'ATTR' WHEN 'R' THEN 'SUBSCRIPT' ELSE 'CALL_MUTATOR' END AS access_kind, 'o' || CAST(l_orderkey AS STRING) AS containing_function_fqn FROM {lineitem}"""


@query(_each_sql(_plain(_ACCESSES, "lineitem"), "id", {
    "reads": "NOT is_write", "writes": "is_write", "reads_on": "NOT is_write AND target_expr = 's7'", "writes_on": "is_write AND target_expr = 's7'", "named": "attr_name = 'a5'",
    "in_function": "containing_function_fqn = 'o8'", "of_kind": "access_kind = 'SUBSCRIPT'"}))
def attribute_filters(spark: SparkSession, d: str) -> DataFrame:
    facts = AttributeFacts(_sql(spark, d, _ACCESSES, "lineitem"), ("id",))
    return _each({
        "reads": facts.reads().df, "writes": facts.writes().df, "reads_on": facts.reads_on("s7").df, "writes_on": facts.writes_on("s7").df, "named": facts.named("a5").df,
        "in_function": facts.in_function("o8").df, "of_kind": facts.of_kind("SUBSCRIPT").df,
    }, "id")


_IMPORTS = "SELECT o_orderkey AS id, 'lib.' || o_orderstatus AS module, o_orderpriority AS one, 'f' || CAST(o_custkey % 20 AS STRING) AS name, 'web.f' || CAST(o_custkey % 20 AS STRING) AS fqn, 'm.C.h' || CAST(o_custkey % 30 AS STRING) AS target_fqn FROM {orders}"


@query(_each_sql(_plain(_IMPORTS, "orders"), "id", {
    "importing": "module = 'lib.P'", "importing_name": "one = '1-URGENT'", "on_function": "target_fqn = 'm.C.h3'", "on_function_named": "target_fqn LIKE '%.h4'", "named": "name = 'f5'", "with_fqn": "fqn = 'web.f6'", "decorator": "name = 'f7' OR fqn = 'web.f8'"}))
def import_and_decorator_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _IMPORTS, "orders").withColumn("names", F.array("one"))
    imports, facts, domain = ImportFacts(rows, ("id",)), DecoratorFacts(rows, ("id",)), Decorators(rows, ("id",))
    return _each({
        "importing": imports.importing("lib.P").df, "importing_name": imports.importing_name("1-URGENT").df, "on_function": facts.on_function("m.C.h3").df, "on_function_named": facts.on_function_named("h4").df,
        "named": facts.named("f5").df, "with_fqn": facts.with_fqn("web.f6").df, "decorator": domain.named("f7").union(domain.with_fqn("web.f8")).df,
    }, "id")


_ERRORS = "SELECT event_id AS id, event_type AS pass_name, value < 10 AS is_fatal, 's' || CAST(user_id AS STRING) AS source_expr, 't' || CAST(event_id % 9 AS STRING) AS target_expr, 'fn' || CAST(user_id % 5 AS STRING) AS containing_function_fqn, 'f' || CAST(user_id AS STRING) || '.py' AS file, CAST(event_id % 50 AS INT) AS line FROM {events}"


@query(_each_sql(_plain(_ERRORS, "events"), "id", {
    "for_pass": "pass_name = 'click'", "fatal": "is_fatal", "in_function": "containing_function_fqn = 'fn2'", "flows_from": "file = 'f3.py' AND line = 7", "flows_to": "file = 'f4.py' AND line = 9",
    "assignments_to": "containing_function_fqn = 'fn1' AND target_expr = 't4'"}))
def error_and_flow_filters(spark: SparkSession, d: str) -> DataFrame:
    place = F.struct("file", "line")
    rows = _sql(spark, d, _ERRORS, "events").withColumns({"source_location": place, "target_location": place})
    errors, flow = ErrorFacts(rows, ("id",)), FlowFacts(rows, ("id",))
    return _each({
        "for_pass": errors.for_pass("click").df, "fatal": errors.fatal().df, "in_function": flow.in_function("fn2").df, "flows_from": flow.flows_from("f3.py", 7).df, "flows_to": flow.flows_to("f4.py", 9).df,
        "assignments_to": flow.assignments_to("t4", "fn1").df,
    }, "id")


_CONDITIONS = "SELECT l_orderkey * 10 + l_linenumber AS id, 's' || CAST(l_suppkey AS STRING) || ' == p' || CAST(l_partkey AS STRING) AS expression, CASE WHEN l_tax > 0.02 THEN 's' || CAST(l_suppkey AS STRING) END AS left_side, 'p' || CAST(l_partkey AS STRING) AS right_side, l_returnflag || '|' || l_linestatus AS category FROM {lineitem}"


@query(_each_sql(_plain(_CONDITIONS, "lineitem"), "id", {
    "using": "coalesce(left_side = 's7', false) OR right_side = 's7' OR contains(expression, 's7')", "comparing": "left_side LIKE 's1%' AND right_side LIKE 'p_'", "in_category": "category = 'A' OR list_contains(string_split(category, '|'), 'A')"}))
def condition_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _CONDITIONS, "lineitem").withColumnsRenamed({"left_side": "left", "right_side": "right"})
    conditions = Conditions(rows, ("id",))
    return _each({"using": conditions.using("s7").df, "comparing": conditions.comparing("s1*", "p?").df, "in_category": Checks(rows, ("id",)).in_category("A").df}, "id")


_CALLS = "SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || CAST(l_suppkey % 9 AS STRING) AS name, 'lib.f' || CAST(l_suppkey % 9 AS STRING) AS fqn, 'v.check_' || l_returnflag || '(x)' AS expression, CAST(l_partkey AS STRING) AS one, l_shipmode AS key FROM {lineitem}"
_CALLS = _CALLS.replace("l_shipmode", "l_linestatus")


@query(f"""SELECT id, one AS positional, CASE WHEN key = 'O' THEN one END AS keyword FROM {_plain(_CALLS, "lineitem")} c WHERE name = 'f3' OR one = '17'""")
def call_arguments(spark: SparkSession, d: str) -> DataFrame:
    arg = lambda index, name: F.struct(F.lit(index).cast("int").alias("index"), name.alias("name"), F.col("one").alias("expression"))
    rows = _sql(spark, d, _CALLS, "lineitem").withColumn("arguments", F.array(arg(0, F.lit(None).cast("string")), arg(None, F.col("key"))))
    sites = CallSites(rows, ("id",))
    chosen = CallSites(sites.to(Fn(name="f3")).df.union(sites.where("name != 'f3'").with_argument_from("17").df), ("id",))
    both = CallSites(chosen.argument(0).withColumnRenamed("argument", "positional"), ("id",)).keyword_argument("O")
    return both.select("id", F.col("positional.expression").alias("positional"), F.col("argument.expression").alias("keyword"))


@query(_each_sql(_plain(_CALLS, "lineitem"), "id", {"named": "expression = 'v.check_R(x)'", "safe_for": "key = 'O'", "of_kind": "key = 'F'"}))
def safe_value_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _CALLS, "lineitem").withColumns({"safe_for_sink_kinds": F.array("key"), "kind": F.col("key")})
    values = SafeValues(rows, ("id",))
    return _each({"named": values.named("check_R").df, "safe_for": values.safe_for("O").df, "of_kind": Sinks(rows, ("id",)).of_kind("F").df}, "id")


_ROUTES = "SELECT o_orderkey AS id, '/' || o_orderstatus AS path, o_orderpriority AS method, 'g' || CAST(o_custkey % 12 AS STRING) AS grp FROM {orders}"


@query(_each_sql(_plain(_ROUTES, "orders"), "id", {"with_path": "path = '/F'", "in_group": "grp = 'g4'", "accepting": "method IN ('2-HIGH', '5-LOW')", "of_group": "grp = 'g5'"}))
def route_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, _ROUTES, "orders").withColumn("methods", F.array("method")).withColumnRenamed("grp", "group")
    routes = Routes(rows, ("id",))
    groups = Groups(rows.select("group").distinct(), ("group",))
    return _each({"with_path": routes.with_path("/F").df, "in_group": routes.in_group("g4").df, "accepting": routes.accepting("2-HIGH", "5-LOW").df, "of_group": groups.named("g5").routes(rows)}, "id")


# --- symbols and resolution ---------------------------------------------------------------------------------------

_REFS = "SELECT event_id AS line, event_type AS name, 'f' || CAST(user_id AS STRING) || '.py' AS file, CASE WHEN value > 20 THEN 'lib.' || event_type || '.' || CAST(user_id % 4 AS STRING) || CAST(event_id % 3 AS STRING) END AS fqn FROM {events}"


@query(f"SELECT file, name, arg_min(fqn, line) FILTER (WHERE fqn IS NOT NULL) AS fqn FROM {_plain(_REFS, 'events')} r GROUP BY 1, 2")
def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    refs = _sql(spark, d, _REFS, "events").withColumn("location", F.struct("file", "line"))
    asked = refs.select("name", "file").distinct()
    return SymbolFacts(refs, ("line",)).resolve(asked).select("file", "name", "fqn")


@query(f"SELECT fqn, file, line FROM {_plain(_REFS, 'events')} r WHERE fqn IN ('lib.click.10', 'lib.view.21') UNION ALL SELECT NULL, file, line FROM {_plain(_REFS, 'events')} r WHERE fqn IS NULL AND file = 'f7.py'")
def symbol_usages(spark: SparkSession, d: str) -> DataFrame:
    refs = SymbolFacts(_sql(spark, d, _REFS, "events").withColumn("location", F.struct("file", "line")), ("line",))
    asked = spark.sql("SELECT * FROM VALUES ('lib.click.10'), ('lib.view.21'), ('lib.nowhere') AS t(fqn)")
    known = refs.usages(refs.existing(asked)).select("fqn", "location.file", "location.line")
    return known.union(refs.in_file("f7.py").unresolved().df.select("fqn", "location.file", "location.line"))


_BIND = "SELECT 'f' || CAST(user_id AS STRING) || '.py' AS file, event_type AS name, event_id AS line, 'v' || CAST(event_id AS STRING) AS target FROM {events} WHERE value > 30"
_USES = "SELECT 'f' || CAST(user_id AS STRING) || '.py' AS file, event_type AS name, event_id AS line, 'own' AS fqn FROM {events} WHERE value <= 30"


@query(f"SELECT u.file, u.name, u.line, (SELECT arg_max(target, b.line) FROM {_plain(_BIND, 'events')} b WHERE b.file = u.file AND b.name = u.name AND b.line < u.line) AS target FROM {_plain(_USES, 'events')} u")
def import_meant_at(spark: SparkSession, d: str) -> DataFrame:
    return resolution.meant_at(_sql(spark, d, _USES, "events").drop("fqn"), _sql(spark, d, _BIND, "events")).select("file", "name", "line", "target")


@query(f"SELECT *, coalesce(lead(line) OVER (PARTITION BY file, name ORDER BY line), -1) AS until FROM {_plain(_BIND, 'events')} b")
def binding_until(spark: SparkSession, d: str) -> DataFrame:
    return resolution.binding_ranges(_sql(spark, d, _BIND, "events")).select("file", "name", "line", "target", F.coalesce("until", F.lit(-1).cast("long")).alias("until"))


@query(f"""WITH b AS (SELECT *, lead(line) OVER (PARTITION BY file, name ORDER BY line) AS until FROM {_plain(_BIND, 'events')} x)
SELECT u.file, u.name, u.line, coalesce(b.target, u.fqn) AS fqn FROM {_plain(_USES, 'events')} u LEFT JOIN b ON b.file = u.file AND b.name = u.name AND u.line >= b.line AND (b.until IS NULL OR u.line < b.until)""")
def import_shadowing(spark: SparkSession, d: str) -> DataFrame:
    return resolution.shadowed(_sql(spark, d, _USES, "events"), resolution.binding_ranges(_sql(spark, d, _BIND, "events"))).select("file", "name", "line", "fqn")


_EXPORTS = "SELECT 'app.' || n_name AS alias, CASE WHEN n_nationkey % 5 = 0 THEN 'core.' || n_name ELSE 'app.' || 'N' || CAST(n_regionkey AS STRING) END AS target FROM {nation} UNION ALL SELECT 'app.N' || CAST(r_regionkey AS STRING), 'core.' || r_name FROM {region}"


@query(f"""WITH e AS (SELECT * FROM {_plain(_EXPORTS, 'nation', 'region')} x), c AS (SELECT e.alias, coalesce(f.target, e.target) AS target FROM e LEFT JOIN e f ON f.alias = e.target)
SELECT c_custkey, coalesce(c.target || '.x', 'app.' || n_name || '.x') AS canonical FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON c.alias = 'app.' || n_name""")
def reexport_resolution(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("app."), "n_name", F.lit(".x")).alias("fqn"))
    return resolution.through_exports(names, _sql(spark, d, _EXPORTS, "nation", "region")).select("c_custkey", "canonical")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'made.' || s_nationkey ELSE 'n' || s_nationkey END AS fqn FROM supplier")
def assignment_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("fqn"))
    aliases = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("made."), F.col("n_nationkey").cast("string")).alias("target"))
    return resolution.through_assignments(refs, aliases).select("s_suppkey", "fqn")


@query("""WITH m AS (SELECT 'm' || s_nationkey AS module, CASE WHEN s_acctbal < 0 THEN '_' ELSE '' END || s_name AS name FROM supplier), a AS (SELECT module, name FROM m WHERE CAST(substring(module, 2) AS INT) % 4 = 0 AND name LIKE '%1'),
l AS (SELECT * FROM a UNION SELECT module, name FROM m WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND module NOT IN (SELECT module FROM a))
SELECT DISTINCT 'f' || c_custkey || '.py' AS file, name, module || '.' || name AS fqn FROM customer JOIN l ON module = 'm' || c_nationkey WHERE c_custkey % 10 = 0""")
def star_import_expansion(spark: SparkSession, d: str) -> DataFrame:
    nation = lambda c: F.concat(F.lit("m"), F.col(c).cast("string")).alias("module")
    members = table(spark, d, "supplier").select(nation("s_nationkey"), F.concat(F.when(F.col("s_acctbal") < 0, "_").otherwise(""), "s_name").alias("name"), "s_nationkey")
    exported = members.where("s_nationkey % 4 = 0 AND name LIKE '%1'").select("module", "name")
    stars = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file"), nation("c_nationkey"))
    return resolution.star_names(stars, members.select("module", "name"), exported)


@query("""WITH mods AS (SELECT 'app.m' || n_nationkey AS module FROM nation), mem AS (SELECT DISTINCT 'app.m' || s_nationkey AS module, 'x' || s_suppkey % 7 AS name FROM supplier)
SELECT file, module, name FROM (SELECT 'f' || c_custkey AS file, CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE 'app' END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.m' || c_nationkey END AS module,
  CASE WHEN c_custkey % 4 = 0 THEN 'm' || c_custkey % 40 ELSE 'x' || c_custkey % 11 END AS name FROM customer) i
WHERE split_part(module, '.', 1) = 'app' AND NOT EXISTS (SELECT 1 FROM mem WHERE mem.module = i.module AND mem.name = i.name) AND NOT EXISTS (SELECT 1 FROM mods WHERE mods.module = i.module || '.' || i.name)""")
def project_import_validation(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    modules = table(spark, d, "nation").select(F.concat(F.lit("app.m"), text("n_nationkey")).alias("module"))
    members = table(spark, d, "supplier").select(F.concat(F.lit("app.m"), text("s_nationkey")).alias("module"), F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string")).alias("name"))
    top = F.when(F.col("c_custkey") % 9 == 0, "other").otherwise("app")
    package = F.col("c_custkey") % 4 == 0
    imports = table(spark, d, "customer").select(
        F.concat(F.lit("f"), text("c_custkey")).alias("file"),
        F.concat(top, F.when(package, "").otherwise(F.concat(F.lit(".m"), text("c_nationkey")))).alias("module"),
        F.when(package, F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string"))).otherwise(F.concat(F.lit("x"), (F.col("c_custkey") % 11).cast("string"))).alias("name"),
    )
    return resolution.missing_imports(imports, modules, members)


_CHAINS = "SELECT l_orderkey * 10 + l_linenumber AS site, CASE l_returnflag WHEN 'A' THEN 'M' || CAST(l_suppkey % 9 AS STRING) || '.query.filter_by(id=' || CAST(l_partkey AS STRING) || ').first()' WHEN 'R' THEN 's' || CAST(l_suppkey % 9 AS STRING) || '.query(M).filter(x).delete()' ELSE 'f(x)' END AS call_expression FROM {lineitem}"


@query(f"SELECT DISTINCT site, CASE WHEN call_expression LIKE 'M%' THEN 'orm.Query.first' ELSE 'orm.Query.delete' END AS callee FROM {_plain(_CHAINS, 'lineitem')} c WHERE regexp_matches(call_expression, '^M[0-4][.]') OR regexp_matches(call_expression, '^s[2-6][.]')")
def orm_query_chain(spark: SparkSession, d: str) -> DataFrame:
    names = lambda p, a, b: spark.range(a, b).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("name"))
    return resolution.query_chain(_sql(spark, d, _CHAINS, "lineitem"), names("M", 0, 5), names("s", 2, 7))


# --- hierarchies --------------------------------------------------------------------------------------------------


def _classes(spark: SparkSession, d: str) -> DataFrame:
    edges = view(spark, d, "hierarchy")
    based = edges.groupBy(F.col("dst").alias("fqn")).agg(F.collect_set("src").alias("bases"))
    return based.union(table(spark, d, "region").select("r_name", F.array().cast("array<string>")))


_LINES = "l AS (SELECT s_name AS fqn, [s_name, n_name, r_name, 'object'] AS mro FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT n_name, [n_name, r_name, 'object'] FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, [r_name, 'object'] FROM region)"


@query(f"WITH {_LINES} SELECT fqn, array_to_string(mro, ',') AS mro, true AS mro_complete FROM l")
def class_linear_orders(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.linear_orders(_classes(spark, d)).select("fqn", F.array_join("mro", ",").alias("mro"), "mro_complete")


_METHODS = "m AS (SELECT r_name AS owner, 'run' AS name FROM region UNION SELECT n_name, 'run' FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT n_name, '__init__' FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT s_name, 'run' FROM supplier WHERE s_acctbal > 8000)"
_TABLE = "t AS (SELECT fqn, name AS method, CAST(min(list_position(mro, owner)) - 1 AS INT) AS place, arg_min(owner, list_position(mro, owner)) AS defined_in FROM l JOIN m ON list_contains(mro, owner) GROUP BY 1, 2)"


def _methods(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    parts = [table(spark, d, "region").select("r_name", F.lit("run")), nation.where("n_nationkey % 2 = 0").select("n_name", F.lit("run")), nation.where("n_nationkey % 3 = 0").select("n_name", F.lit("__init__")), supplier.where("s_acctbal > 8000").select("s_name", F.lit("run"))]
    return reduce(DataFrame.union, parts).toDF("owner", "name")


@query(f"WITH {_LINES}, {_METHODS}, {_TABLE} SELECT s_suppkey AS site, s_name AS caller_class, 'run' AS method, defined_in || '.run' AS resolved FROM supplier LEFT JOIN t ON fqn = s_name AND method = 'run'")
def receiver_method_resolution(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("caller_class"), F.lit("run").alias("method"))
    out = hierarchy.self_calls(calls, hierarchy.method_table(hierarchy.linear_orders(_classes(spark, d)), _methods(spark, d)))
    return out.select("site", "caller_class", "method", "resolved")


@query(f"WITH {_LINES}, {_METHODS}, u AS (SELECT fqn, mro[2:] AS mro FROM l), {_TABLE.replace('FROM l', 'FROM u')} SELECT s_suppkey AS site, s_name AS caller_class, 'run' AS method, defined_in || '.run' AS resolved FROM supplier LEFT JOIN t ON fqn = s_name AND method = 'run'")
def super_call_resolution(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("caller_class"), F.lit("run").alias("method"))
    return hierarchy.super_calls(calls, hierarchy.linear_orders(_classes(spark, d)), _methods(spark, d)).select("site", "caller_class", "method", "resolved")


@query(f"WITH {_LINES}, {_METHODS}, {_TABLE} SELECT s_suppkey AS site, s_name AS class, defined_in || '.__init__' AS resolved FROM supplier LEFT JOIN t ON fqn = s_name AND method = '__init__'")
def constructor_call_resolution(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("class"))
    return hierarchy.constructor_calls(calls, hierarchy.method_table(hierarchy.linear_orders(_classes(spark, d)), _methods(spark, d))).select("site", "class", "resolved")


@query(f"WITH {_LINES}, {_METHODS}, {_TABLE} SELECT s_suppkey AS site, defined_in || '.run' AS resolved FROM supplier JOIN t ON fqn = s_name AND method = 'run' WHERE s_suppkey % 2 = 0")
def property_setter_dispatch(spark: SparkSession, d: str) -> DataFrame:
    writes = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("class"), F.lit("run").alias("attribute"))
    return hierarchy.setter_calls(writes, _methods(spark, d), hierarchy.linear_orders(_classes(spark, d)))


@query("""SELECT n_name AS fqn, 'lib.B' || n_regionkey AS base, 'external' AS reason FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'B' || n_regionkey, 'unresolved' FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT r_name, r_name, 'cycle' FROM region""")
def hierarchy_gaps(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("n_regionkey").cast("string")
    classes = table(spark, d, "nation").select(F.col("n_name").alias("fqn"), F.array(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("lib.B"), text)).otherwise(F.concat(F.lit("B"), text))).alias("bases"))
    ring = table(spark, d, "region").select(F.col("r_name").alias("fqn"), F.array("r_name").alias("bases"))
    return hierarchy.gaps(classes.union(ring))


@query("""SELECT n_name AS fqn, n_name AS listed_under, string_agg(s_name, ',' ORDER BY s_name) AS all_subclasses FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT r_name, r_name, string_agg(x, ',' ORDER BY x) FROM (SELECT r_name, n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT r_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1""")
def class_subclasses(spark: SparkSession, d: str) -> DataFrame:
    below = hierarchy.subclasses(_classes(spark, d))
    facts = ClassFacts(below, ("fqn",))
    listed = facts.df.select("fqn", F.col("fqn").alias("listed_under"), F.array_join("all_subclasses", ",").alias("all_subclasses"))
    return listed


@query("SELECT 'direct' AS filter, n_name AS fqn FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'all', s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'all', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def subclass_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _classes(spark, d).join(hierarchy.linear_orders(_classes(spark, d)), "fqn")
    classes = Classes(rows, ("fqn",))
    return _each({"direct": classes.direct_subclasses_of("ASIA").df, "all": classes.subclasses_of("ASIA").df}, "fqn")


# --- scalars ------------------------------------------------------------------------------------------------------

_TEXTS = "SELECT p_partkey, lower(replace(p_name, ' ', '.')) AS dotted, CASE p_partkey % 4 WHEN 0 THEN 'Optional[int]' WHEN 1 THEN 'NoneLike' WHEN 2 THEN 'int | None' ELSE 'str' END AS declared, '/' || p_brand || '/<int:id>/{{slug}}/<name>' AS rule, '  x = ' || p_name || '  ' AS line FROM {part}"


@query(f"""SELECT p_partkey, split_part(dotted, '.', -1) AS method, CASE WHEN contains(dotted, '.') THEN regexp_replace(dotted, '[.][^.]*$', '') END AS receiver, CASE WHEN contains(dotted, '.') THEN NULL ELSE dotted END AS simple,
p_partkey % 4 IN (0, 2) AS allows_none, 'id:int,name:string,slug:string' AS parameters, substring(sha256('my_rule' || chr(0) || trim(line)), 1, 16) AS stable FROM {_plain(_TEXTS, 'part')} t""")
def name_scalars(spark: SparkSession, d: str) -> DataFrame:
    split = scalars.receiver_and_method(F.col("dotted"))
    listed = F.array_join(F.transform(scalars.path_parameters(F.col("rule")), lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    rows = _sql(spark, d, _TEXTS, "part")
    return rows.select(
        "p_partkey", split["method"].alias("method"), split["receiver"].alias("receiver"), F.when(F.instr("dotted", ".") == 0, scalars.simple_name(F.col("dotted"))).alias("simple"),
        scalars.type_allows_none(F.col("declared")).alias("allows_none"), listed.alias("parameters"), scalars.stable_key(F.lit("My-Rule"), F.col("line")).alias("stable"),
    )


@query("""SELECT DISTINCT CASE WHEN l_tax > 0.06 THEN 'high' WHEN l_tax > 0.03 THEN 'medium' ELSE 'low' END AS label, CASE WHEN l_tax > 0.06 THEN 3 WHEN l_tax > 0.03 THEN 2 ELSE 1 END AS place,
CASE WHEN l_tax > 0.06 THEN 'a call may reach another target' WHEN l_tax > 0.03 THEN 'another object may stand in for the checked one' END AS relevance FROM lineitem""")
def severity_scalars(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_tax") > 0.06, "HIGH").when(F.col("l_tax") > 0.03, "Medium").otherwise("low")
    place = scalars.parsed_severity(label)
    kind = F.when(F.col("l_tax") > 0.06, "callable").when(F.col("l_tax") > 0.03, "identity").otherwise("unknown")
    return table(spark, d, "lineitem").select(scalars.severity_label(place).alias("label"), place.alias("place"), scalars.security_relevance(kind).alias("relevance")).distinct()


_EXPRESSIONS = "SELECT l_orderkey * 10 + l_linenumber AS id, 'a' || CAST(l_suppkey % 50 AS STRING) AS a, 'b.c' || CAST(l_partkey % 50 AS STRING) AS b, l_linenumber % 7 AS k FROM {lineitem}"


@query(f"""SELECT id, CASE k WHEN 0 THEN 'comparison' WHEN 1 THEN 'membership' WHEN 2 THEN 'identity' WHEN 3 THEN 'truthiness' WHEN 4 THEN 'call_result' WHEN 5 THEN 'compound' ELSE 'unknown' END AS kind,
CASE k WHEN 0 THEN 'Eq' WHEN 1 THEN 'NotIn' WHEN 2 THEN 'IsNot' WHEN 5 THEN 'Or' END AS operator, CASE WHEN k IN (0, 1, 2, 3) THEN a WHEN k = 4 THEN a || '(' || b || ')' END AS left_side, CASE WHEN k IN (0, 1, 2) THEN b END AS right_side,
CASE WHEN k = 3 THEN a WHEN k = 6 THEN NULL ELSE a || ',b' END AS names FROM {_plain(_EXPRESSIONS, 'lineitem')} e""")
def condition_classification(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda sign: F.concat("a", F.lit(sign), "b")
    text = F.when(F.col("k") == 0, joined(" == ")).when(F.col("k") == 1, joined(" not in ")).when(F.col("k") == 2, joined(" is not ")).when(F.col("k") == 3, F.col("a")).when(F.col("k") == 4, F.concat("a", F.lit("("), "b", F.lit(")"))).when(F.col("k") == 5, joined(" or ")).otherwise(F.lit("1"))
    found = _sql(spark, d, _EXPRESSIONS, "lineitem").withColumn("d", expressions.details(text))
    return found.select("id", "d.kind", "d.operator", F.col("d.left").alias("left_side"), F.col("d.right").alias("right_side"), F.nullif(F.array_join("d.names", ","), F.lit("")).alias("names"))


@query("""SELECT c_custkey, string_agg(m, ',' ORDER BY m) AS taken FROM customer, (SELECT unnest(['GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS', 'HEAD']) AS m)
WHERE CASE WHEN c_custkey % 3 = 0 THEN m = 'POST' WHEN c_custkey % 3 = 1 THEN m NOT IN ('GET', 'HEAD') ELSE false END GROUP BY 1""")
def method_branch_directions(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("c_custkey") % 3
    text = F.when(third == 0, "request.method == 'POST'").when(third == 1, "request.method not in ('GET', 'HEAD')").otherwise("request.path == '/x'")
    rows = table(spark, d, "customer").select("c_custkey", expressions.details(text).alias("d"))
    taken = F.transform(F.filter(expressions.method_directions(F.col("d")), lambda m: m["arm"]), lambda m: m["method"])
    return rows.select("c_custkey", F.array_join(F.array_sort(taken), ",").alias("taken")).where("taken != ''")


# --- summaries ----------------------------------------------------------------------------------------------------

_EDGE_FACTS = "SELECT l_linestatus AS source, CASE WHEN l_tax > 0.01 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, CASE WHEN l_tax <= 0.01 THEN 'unknown name' END AS unresolved_reason, l_returnflag AS dynamic_dispatch_kind FROM {lineitem}"
_SUMMED = " UNION ALL ".join(f"SELECT '{c}' AS section, coalesce({c}, '') AS value, count(*) AS n FROM {_plain(_EDGE_FACTS, 'lineitem')} e GROUP BY 2" for c in ("source", "resolution", "unresolved_reason", "dynamic_dispatch_kind"))


@query(_SUMMED)
def summarize_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summary(_sql(spark, d, _EDGE_FACTS, "lineitem"), "call_edges")


_ERROR_FACTS = "SELECT event_type AS error_kind, 'p' || CAST(user_id % 6 AS STRING) AS pass_name, CAST(value < 10 AS STRING) AS is_fatal, 'm' || CAST(event_id % 40 AS STRING) AS message FROM {events}"


@query(f"""WITH s AS ({" UNION ALL ".join(f"SELECT '{c}' AS section, {c} AS value, count(*) AS n FROM {_plain(_ERROR_FACTS, 'events')} e GROUP BY 2" for c in ("error_kind", "pass_name", "is_fatal", "message"))})
SELECT section, value, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, value) AS k FROM s) WHERE k <= 5""")
def summarize_errors_top(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top(_sql(spark, d, _ERROR_FACTS, "events"), "errors", 5)


@query("""WITH b AS (SELECT l_suppkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), a AS (SELECT l_suppkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_tax > 0.03 GROUP BY 1, 2)
SELECT coalesce(b.k, a.k) AS key, coalesce(b.f, a.f) AS flag, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.k = b.k AND a.f = b.f""")
def diff_error_summaries(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c: table(spark, d, "lineitem").where(c).groupBy(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return summaries.difference(side("l_linestatus = 'O'"), side("l_tax > 0.03"), ["key", "flag"])


@query(f"SELECT file, ['info', 'low', 'medium', 'high', 'critical'][CAST(max(r) AS INT) + 1] AS worst, count(*) AS n, CAST(-max(r) AS INT) AS place FROM (SELECT file, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 AS r FROM {sql_of('hits')} h) GROUP BY 1")
def findings_by_file(spark: SparkSession, d: str) -> DataFrame:
    return summaries.findings_by_file(view(spark, d, "hits"))


@query("SELECT split_part('m' || c_nationkey || '.C.f', '.', 1) AS package, count(*) AS n FROM customer GROUP BY 1")
def routes_by_package(spark: SparkSession, d: str) -> DataFrame:
    return summaries.by_package(table(spark, d, "customer").select(F.concat(F.lit("m"), F.col("c_nationkey").cast("string"), F.lit(".C.f")).alias("handler")))


@query("SELECT event_type AS phase, count(*) AS n_calls, sum(event_id % 1000) AS total_ms, max(event_id % 1000) AS longest_ms FROM events GROUP BY 1")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.profile(table(spark, d, "events").select(F.col("event_type").alias("phase"), (F.col("event_id") % 1000).alias("ms")))


@query("SELECT source AS folder, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def artifact_sizes(spark: SparkSession, d: str) -> DataFrame:
    return summaries.sizes(table(spark, d, "documents").select(F.col("source").alias("folder"), F.col("n_chars").alias("length")))


@query("SELECT CASE WHEN l_tax > 0.06 THEN 'baseline' WHEN l_tax > 0.03 THEN 'inline' ELSE 'active' END AS source, count(*) AS n FROM lineitem GROUP BY 1")
def suppression_counts(spark: SparkSession, d: str) -> DataFrame:
    by: Column = F.when(F.col("l_tax") > 0.06, "baseline").when(F.col("l_tax") > 0.03, "inline")
    return summaries.suppression_counts(table(spark, d, "lineitem").select(by.alias("suppressed_by")))
