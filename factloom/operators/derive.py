"""Domain relations that facts imply without a pattern of their own: writes by verb, reads by argument, dispatch, hooks, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import REQUEST, SERVER, dotted_suffixes, path_parameters
from .flow import argument_bridge
from .graph import closure

#: Rows up to which the registered side of a dispatch goes to every task.
SMALL = 300_000
#: Method names, and beginnings of such, that write; receivers whose methods of that name keep nothing.
WRITE_VERBS = ("delete", "remove", "destroy", "save", "update", "create", "insert", "add", "write", "store", "put", "commit", "flush", "persist")
WRITE_PREFIXES = ("delete_", "remove_", "destroy_", "save_", "update_", "create_", "insert_", "add_", "write_", "store_", "put_", "set_")
TRANSIENT = ("logger", "log", "logging")
#: Module-level objects that stand for one request's state all the same.
PER_REQUEST = ("session", "db_session", "cache")
#: The object that stands for who is logged in.
PRINCIPAL = r"(^|\.)(current_user|user|principal)$"


def writes_by_verb(method: Column) -> Column:
    """Whether a method's name says that it writes."""
    starts = reduce(Column.__or__, (method.startswith(p) for p in WRITE_PREFIXES))
    return method.isin(*WRITE_VERBS) | starts


def inferred_writes(calls: DataFrame, modelled: DataFrame, shared: DataFrame) -> DataFrame:
    """``function``, ``file``, ``line``, ``column``, ``scope``: writes that method names suggest and no pattern says.

    calls: ``function``, ``receiver``, ``method``, ``file``, ``line``, ``column``; modelled: ``file``, ``line``, ``column`` of effects that
    patterns gave; shared: ``file``, ``name`` of module-level objects, whose writes concern the whole server.
    """
    base = F.substring_index("receiver", ".", 1)
    last = F.substring_index("receiver", ".", -1)
    verbs = calls.where(F.col("receiver").isNotNull() & writes_by_verb(F.col("method")) & ~last.isin(*TRANSIENT)).withColumn("name", base)
    new = verbs.join(modelled.select("file", "line", "column"), ["file", "line", "column"], "left_anti").dropDuplicates(["file", "line", "column"])
    scoped = new.join(shared.select("file", "name").distinct().withColumn("_shared", F.lit(True)), ["file", "name"], "left")
    server = F.col("_shared").isNotNull() & ~last.isin(*PER_REQUEST)
    return scoped.select("function", "file", "line", "column", F.when(server, SERVER).otherwise(REQUEST).alias("scope"))


def server_writes(accesses: DataFrame, shared: DataFrame) -> DataFrame:
    """Writes of functions to module-level containers: ``function``, ``file``, ``line``, ``key``. accesses: ``function``, ``file``, ``line``, ``target``,
    ``attribute``, ``kind``, ``is_write``."""
    private = (F.col("kind") == "ATTR") & F.col("attribute").startswith("_")
    writes = accesses.where(F.col("is_write") & F.col("function").isNotNull() & ~private).withColumn("name", F.substring_index("target", ".", 1))
    return writes.join(shared.select("file", "name").distinct(), ["file", "name"], "left_semi").select("function", "file", "line", F.col("attribute").alias("key"))


def principal_writes(accesses: DataFrame) -> DataFrame:
    """Writes to attributes of the logged-in user: ``function``, ``file``, ``line``, ``key``; private attributes don't count."""
    hit = F.col("is_write") & F.col("function").isNotNull() & F.col("target").rlike(PRINCIPAL) & ~F.col("attribute").startswith("_")
    return accesses.where(hit & F.col("kind").isin("ATTR", "AUGMENTED")).select("function", "file", "line", F.col("attribute").alias("key"))


def container_reads(arguments: DataFrame, parameters: DataFrame, containers: DataFrame, accesses: DataFrame) -> DataFrame:
    """Reads inside a helper of a container that a caller hands it: ``function``, ``container``, ``key``, ``line``.

    arguments and parameters as for ``argument_bridge``; containers: ``expression``, ``container``; accesses: ``function``, ``target``,
    ``key``, ``line``.
    """
    handed = argument_bridge(arguments, parameters).where("NOT gap").join(containers, "expression").select(F.col("callee").alias("function"), F.col("parameter").alias("target"), "container").distinct()
    return accesses.join(handed, ["function", "target"]).select("function", "container", "key", "line").distinct()


def membership_reads(conditions: DataFrame, containers: DataFrame) -> DataFrame:
    """``'key' in container`` tests as reads: ``function``, ``container``, ``key``, ``line``. conditions: ``function``, ``line``, ``kind``, ``literal`` (of
    the left side), ``right``; containers: ``expression``, ``container``."""
    tests = conditions.where("kind = 'membership' AND literal IS NOT NULL").withColumnRenamed("right", "expression")
    return tests.join(containers, "expression").select("function", "container", F.col("literal").alias("key"), "line").distinct()


def path_reads(routes: DataFrame, parameters: DataFrame) -> DataFrame:
    """``route``, ``function``, ``key``, ``type``: a route's path parameters that its handler takes. routes: ``route``, ``path``, ``handler``; parameters:
    ``callee``, ``name``."""
    named = routes.select("route", F.col("handler").alias("callee"), F.inline(path_parameters(F.col("path")))).withColumnRenamed("name", "key")
    return named.join(parameters.select("callee", F.col("name").alias("key")).distinct(), ["callee", "key"], "left_semi").select("route", F.col("callee").alias("function"), "key", "type")


def _sent(rows: DataFrame) -> DataFrame:
    """The rows, for every task where they are few."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _several(rows: DataFrame, of: str) -> DataFrame:
    """Distinct rows with ``_several``: whether their ``of`` has more than one."""
    return rows.repartition(of).distinct().withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy(of)) > 1)


def signal_edges(registered: DataFrame, sent: DataFrame) -> DataFrame:
    """Dispatch edges ``src``, ``dst``: who sends a signal reaches everyone that is registered for it. registered: ``signal``, ``handler``; sent:
    ``signal``, ``sender``. A handler of one signal meets a sender once; only the pairs of other handlers are compared."""
    known, sent = _several(registered.select("signal", "handler"), "handler"), sent.select("signal", "sender").distinct()
    pairs = lambda kept: sent.join(_sent(kept.drop("_several")), "signal").select(F.col("sender").alias("src"), F.col("handler").alias("dst"))
    several = known.where("_several")
    once = pairs(known.where("NOT _several"))
    return once if several.isEmpty() else once.union(pairs(several).distinct())


def table_edges(tables: DataFrame, lookups: DataFrame) -> DataFrame:
    """Dispatch edges through literal tables: ``src``, ``dst``. tables: ``table``, ``key``, ``handler``; lookups: ``caller``, ``table``, ``key`` (null: any).
    A caller of one lookup meets each handler once; only the pairs of other callers are compared."""
    entries, any_key = _sent(tables.select("table", "key", "handler").distinct()), _sent(tables.select("table", "handler").distinct())
    looked = _several(lookups.select("caller", "table", "key"), "caller")

    def pairs(kept: DataFrame) -> DataFrame:
        known = kept.where("key IS NOT NULL").join(entries, ["table", "key"])
        anyone = kept.where("key IS NULL").drop("key").join(any_key, "table")
        return known.select("caller", "handler").union(anyone.select("caller", "handler")).toDF("src", "dst")

    several = looked.where("_several")
    once = pairs(looked.where("NOT _several"))
    return once if several.isEmpty() else once.union(pairs(several).distinct())


def group_nesting(mounts: DataFrame, depth: int = 20) -> DataFrame:
    """``group``, ``ancestor``: the groups that a group is mounted in, at any distance. mounts: ``parent``, ``child``."""
    up = mounts.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return closure(up, mounts.select("child").distinct(), depth).select(F.col("root").alias("group"), F.col("node").alias("ancestor"))


def groups(routes: DataFrame, declared: DataFrame) -> DataFrame:
    """``group``, ``prefix``, ``n_routes``: declared groups and those that routes name; a group without routes stays, a known prefix wins."""
    counted = routes.where("group IS NOT NULL").groupBy("group").agg(F.count(F.lit(1)).alias("n_routes"))
    known = declared.groupBy("group").agg(F.max("prefix").alias("prefix"))  # null only where all are
    return known.join(counted, "group", "full").select("group", "prefix", F.coalesce("n_routes", F.lit(0).cast("bigint")).alias("n_routes"))


def hooks_of_routes(routes: DataFrame, hooks: DataFrame, nesting: DataFrame) -> DataFrame:
    """``route``, ``hook``: hooks of the route's group and of the groups around it. Hooks of the application (null group) concern
    every route and stay a list of their own. routes: ``route``, ``group``; hooks: ``hook``, ``group``."""
    own = routes.where("group IS NOT NULL").select("route", "group")
    around = own.join(nesting, "group").select("route", F.col("ancestor").alias("group"))
    return own.union(around).join(hooks.where("group IS NOT NULL"), "group").select("route", "hook").distinct()


def exempted(routes: DataFrame, exemptions: DataFrame) -> DataFrame:
    """``route``, ``check``: exemptions of a handler (by a dotted suffix of its name) or of a group. exemptions: ``target``, ``check``."""
    names = routes.select("route", F.explode(dotted_suffixes(F.col("handler"))).alias("target"))
    by_group = routes.where("group IS NOT NULL").select("route", F.col("group").alias("target"))
    return names.union(by_group).join(exemptions, "target").select("route", "check").distinct()


def inherited_guards(dependencies: DataFrame, guards: DataFrame, depth: int = 20) -> DataFrame:
    """``function``, ``category``: guard categories that a function's dependencies bring, at any distance. dependencies: ``function``,
    ``dependency``; guards: ``function``, ``category``."""
    edges = dependencies.select(F.col("function").alias("src"), F.col("dependency").alias("dst"))
    reach = closure(edges, dependencies.select("function").distinct(), depth)
    return reach.join(guards.withColumnRenamed("function", "node"), "node").select(F.col("root").alias("function"), "category").distinct()


def inferred_auth(decorators: DataFrame, matched: DataFrame, edges: DataFrame, known: DataFrame, depth: int = 5) -> DataFrame:
    """Decorators (``target``, ``fqn``) that no pattern knows: ``verdict`` is ``check`` where the decorator's code reaches known
    authentication, ``suspect`` where its name alone suggests one; others go. matched: ``fqn``; edges: ``src``, ``dst``; known: ``fqn``."""
    unknown = decorators.join(matched.select("fqn"), "fqn", "left_anti")
    reach = closure(edges, unknown.select("fqn").distinct(), depth, include_root=True)
    proven = reach.join(known.select(F.col("fqn").alias("node")), "node", "left_semi").select(F.col("root").alias("fqn")).distinct().withColumn("_proven", F.lit(True))
    suggests = F.lower(F.substring_index("fqn", ".", -1)).rlike(r"auth|login|permission|require|protect|admin")
    verdict = F.when(F.col("_proven"), "check").when(suggests, "suspect")
    return unknown.join(proven, "fqn", "left").select("target", "fqn", verdict.alias("verdict")).where("verdict IS NOT NULL")


def merged_routes(routes: DataFrame, key: list[str], order: list[str], methods: str = "methods") -> DataFrame:
    """One route per key: all methods, sorted, and the other columns of the first row in ``order``."""
    rest = [c for c in routes.columns if c not in (*key, methods)]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_f")
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_set(methods)))).alias(methods)
    return routes.groupBy(*key).agg(first, each).select(*key, methods, *(F.col(f"_f.{c}").alias(c) for c in rest))


def with_overloads(functions: DataFrame, is_stub: str = "is_overload") -> DataFrame:
    """One function per ``fqn``: the last definition that is no overload stub, with the stubs' parameter lists in order.

    functions: ``fqn``, ``line``, ``params``, ``is_overload``.
    """
    real = F.max(F.struct((~F.col(is_stub)).alias("real"), "line", "params")).alias("_r")
    stubs = F.transform(F.sort_array(F.collect_list(F.when(F.col(is_stub), F.struct("line", "params")))), lambda s: s["params"])
    return functions.groupBy("fqn").agg(real, stubs.alias("overloads")).select("fqn", F.col("_r.line").alias("line"), F.col("_r.params").alias("params"), "overloads")


def first_definitions(assignments: DataFrame) -> DataFrame:
    """``function``, ``name``, ``line``: the first place that defines each name of a function."""
    return assignments.groupBy("function", "name").agg(F.min("line").alias("line"))


def chain_links(assignments: DataFrame) -> DataFrame:
    """Adjacent targets of chained assignments (``x = y = v``): ``statement``, ``source``, ``target``. assignments: ``statement``, ``place``, ``target``."""
    order = Window.partitionBy("statement").orderBy("place")
    return assignments.select("statement", F.col("target").alias("source"), F.lead("target").over(order).alias("target")).where("target IS NOT NULL")


def in_order(places: DataFrame, ordered: DataFrame) -> DataFrame:
    """``list``, ``holds``: whether each place of a list precedes the next. places: ``list``, ``ord``, ``place``; ordered: ``a``, ``b`` pairs known
    to be in order. Places of one ``ord`` follow each other by ``place``, so that the result does not hang on the order of rows."""
    window = Window.partitionBy("list").orderBy("ord", "place")
    pairs = places.select("list", F.col("place").alias("a"), F.lead("place").over(window).alias("b")).where("b IS NOT NULL")
    known = ordered.select("a", "b").distinct().withColumn("_known", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").groupBy("list").agg(F.every(F.col("_known").isNotNull()).alias("holds"))


def distinct_gaps(gaps: DataFrame, order: list[str]) -> DataFrame:
    """Gaps once each, by kind, message, file, function and error; of equal ones the first in order."""
    key = [c for c in ("kind", "message", "file", "function", "source_error") if c in gaps.columns]
    rest = [c for c in gaps.columns if c not in key]
    best = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_b")
    return gaps.groupBy(*key).agg(best).select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def added_once(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """The rows, and of the others those whose key is not among them; null keys equal one another."""
    names = [f"_k{i}" for i in range(len(key))]
    have = rows.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).distinct()
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)))
    return rows.unionByName(more.dropDuplicates(key).join(have, same, "left_anti"))
