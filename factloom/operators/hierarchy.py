"""Class hierarchies: linear orders, subclasses, inherited methods, and calls that they resolve.

A linear order needs a class's ancestors only. Connected hierarchies are found by a closure over base edges; each class's
own ancestors meet in one group, bounded by the depth of a hierarchy, never all classes of a code base in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure, linear_mro

#: Levels of bases that are followed.
DEPTH = 50


def base_edges(classes: DataFrame) -> DataFrame:
    """``src`` (class), ``dst`` (base) of each class (``fqn``, ``bases``); bases that are no class of the code base included."""
    return classes.select(F.col("fqn").alias("src"), F.explode("bases").alias("dst")).distinct()


def linear_orders(classes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``fqn``, ``mro array<string>``, ``mro_complete``: C3 orders from ``fqn``, ``bases``; see ``linear_mro`` for the odd cases."""
    edges = base_edges(classes)
    reach = closure(edges, classes.select("fqn"), depth, include_root=True)
    own = classes.groupBy("fqn").agg(F.min("bases").alias("bases"))  # a redefined class: the least list of bases
    lines = reach.join(own.withColumnRenamed("fqn", "node"), "node").select("root", F.struct("node", "bases").alias("_c"))
    groups = lines.groupBy("root").agg(F.collect_list("_c").alias("_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, complete = [], []
            for root, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order, whole = linear_mro({k["node"]: k["bases"] for k in known}, root)
                orders.append(order)
                complete.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(orders, pa.list_(pa.string())), pa.array(complete, pa.bool_())], names=["fqn", "mro", "mro_complete"])

    return groups.select("root", "_known").mapInArrow(run, "fqn string, mro array<string>, mro_complete boolean")


def gaps(classes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``fqn``, ``base``, ``reason``: bases that are no class of the code base (``external`` where dotted, else ``unresolved``), and
    classes that are their own ancestors (``cycle``)."""
    edges = base_edges(classes).where("dst != 'object'")
    unknown = edges.join(classes.select(F.col("fqn").alias("dst")).distinct(), "dst", "left_anti")
    reason = F.when(F.instr("dst", ".") > 0, "external").otherwise("unresolved")
    # A class on a cycle reaches a base that has the class itself as a base, at some distance.
    reach = closure(edges, classes.select("fqn"), depth, include_root=True)
    cyclic = reach.join(edges, (F.col("node") == F.col("src")) & (F.col("root") == F.col("dst"))).select("root").distinct()
    return unknown.select(F.col("src").alias("fqn"), F.col("dst").alias("base"), reason.alias("reason")).union(cyclic.select("root", F.col("root"), F.lit("cycle")))


def subclasses(classes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``fqn``, ``subclasses`` (direct), ``all_subclasses``, each sorted; classes without any have no row."""
    edges = base_edges(classes)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = closure(back, classes.select("fqn"), depth)
    direct = F.array_sort(F.collect_set(F.when(F.col("depth") == 1, F.col("node"))))
    return below.groupBy(F.col("root").alias("fqn")).agg(direct.alias("subclasses"), F.array_sort(F.collect_set("node")).alias("all_subclasses"))


def method_table(orders: DataFrame, methods: DataFrame) -> DataFrame:
    """``fqn``, ``method``, ``place``, ``defined_in``: the class of a linear order that each method comes from.

    orders: ``fqn``, ``mro``; methods: ``owner``, ``name``.
    """
    lines = orders.select("fqn", F.posexplode("mro").alias("place", "owner"))
    hits = lines.join(methods.select("owner", F.col("name").alias("method")).distinct(), "owner")
    first = hits.groupBy("fqn", "method").agg(F.min(F.struct("place", "owner")).alias("_f"))
    return first.select("fqn", "method", F.col("_f.place").alias("place"), F.col("_f.owner").alias("defined_in"))


def self_calls(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Calls of a method on ``self`` or ``cls`` with ``resolved``: the first definition along the class's order.

    calls: ``site``, ``caller_class``, ``method``; table: rows of ``method_table``.
    """
    known = table.select(F.col("fqn").alias("caller_class"), "method", F.concat("defined_in", F.lit("."), "method").alias("resolved"))
    return calls.join(known, ["caller_class", "method"], "left")


def super_calls(calls: DataFrame, orders: DataFrame, methods: DataFrame) -> DataFrame:
    """``super().m()`` calls with ``resolved``: the first definition behind the class itself in its order."""
    behind = orders.select("fqn", F.expr("slice(mro, 2, greatest(size(mro) - 1, 0))").alias("mro"))
    return self_calls(calls, method_table(behind, methods))


def constructor_calls(calls: DataFrame, table: DataFrame) -> DataFrame:
    """``C()`` calls (``site``, ``class``) with ``resolved``: the ``__init__`` that runs; null where no class of the code base has one."""
    known = table.where("method = '__init__'").select(F.col("fqn").alias("class"), F.concat("defined_in", F.lit(".__init__")).alias("resolved"))
    return calls.join(known, "class", "left")


def setter_calls(writes: DataFrame, setters: DataFrame, orders: DataFrame) -> DataFrame:
    """Attribute writes on objects of a known class that run a property setter: ``site``, ``resolved``.

    writes: ``site``, ``class``, ``attribute``; setters: ``owner``, ``name``; orders: ``fqn``, ``mro``.
    """
    table = method_table(orders, setters)
    hit = writes.join(table, (F.col("class") == F.col("fqn")) & (F.col("attribute") == F.col("method")))
    return hit.select("site", F.concat("defined_in", F.lit("."), "method").alias("resolved")).distinct()


def completed(classes: DataFrame, columns: list[str]) -> DataFrame:
    """Class records with ``mro_chain``, ``mro_complete``, ``subclasses``, ``all_subclasses``, ``inherited_methods`` and ``hierarchy_gaps``."""
    rows = classes.drop("mro_chain", "mro_complete", "subclasses", "all_subclasses", "inherited_methods", "hierarchy_gaps")
    orders = linear_orders(classes)
    methods = classes.select(F.col("fqn").alias("owner"), F.explode("method_names").alias("name"))
    table = method_table(orders, methods).where("place > 0")
    inherited = table.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct(F.col("method").alias("name"), F.col("defined_in").alias("defining_class_fqn"), F.lit("RESOLVED").alias("resolution")))).alias("inherited_methods"))
    missing = gaps(classes).groupBy("fqn").agg(F.array_sort(F.collect_set(F.struct(F.col("base").alias("base_expression"), "reason"))).alias("hierarchy_gaps"))
    out = rows.join(orders.withColumnRenamed("mro", "mro_chain"), "fqn", "left").join(subclasses(classes), "fqn", "left").join(inherited, "fqn", "left").join(missing, "fqn", "left")
    empty = {c: F.coalesce(c, F.array().cast(classes.schema[c].dataType)) for c in ("mro_chain", "subclasses", "all_subclasses", "inherited_methods", "hierarchy_gaps")}
    return out.withColumns(empty).withColumn("mro_complete", F.coalesce("mro_complete", F.lit(False))).select(*columns)
