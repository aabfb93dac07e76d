"""Values and where they come from: traces over value flow with calls in between, and questions about handles.

A value is a function and an expression in it. Edges link by the expression's text within a function; a call links an
argument to its parameter and a returned value to the call's expression, and counts as a hop. A trace is kept level by
level in the shared folder, so it survives lost executors, and each value is reached once for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import logical_input
from .flow import argument_bridge, preserves_whole, return_bridge
from .graph import Levels, goals_within

#: Levels of edges, and calls in between, that a trace follows.
DEPTH, HOPS = 50, 5
STEP = "struct<function:string,expression:string,kind:string,line:int>"


def node(function: str | Column, expression: str | Column) -> Column:
    """Key of a value."""
    return F.concat_ws("\0", function, expression)


def value_edges(flow: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``hop`` (0), ``step`` of flow edges (``fn``, ``source_expr``, ``target_expr``, ``kind``, ``line``); ``fn`` null: the module."""
    fn = F.coalesce("fn", F.lit("<module>"))
    step = F.struct(fn.alias("function"), F.col("target_expr").alias("expression"), F.lower("kind").alias("kind"), F.col("line").cast("int").alias("line"))
    return flow.where("source_expr IS NOT NULL AND target_expr IS NOT NULL").select(node(fn, "source_expr").alias("src"), node(fn, "target_expr").alias("dst"), F.lit(0).alias("hop"), step.alias("step"))


def call_edges(arguments: DataFrame, parameters: DataFrame, returns: DataFrame, uses: DataFrame) -> DataFrame:
    """Edges across calls, each a hop: arguments to parameters, returned values to call expressions.

    arguments: as for ``argument_bridge``, with ``caller`` and ``line``; returns and uses: as for ``return_bridge``.
    """
    bound = argument_bridge(arguments, parameters).where("NOT gap")
    step = lambda fn, e, kind: F.struct(F.col(fn).alias("function"), F.col(e).alias("expression"), F.lit(kind).alias("kind"), F.col("line").cast("int").alias("line")).alias("step")
    into = bound.select(node("caller", "expression").alias("src"), node("callee", "parameter").alias("dst"), F.lit(1).alias("hop"), step("callee", "parameter", "argument"))
    back = return_bridge(returns, uses)
    out = back.select(node("callee", "source_expr").alias("src"), node("caller", "target_expr").alias("dst"), F.lit(1).alias("hop"), step("caller", "target_expr", "return"))
    return into.union(out)


def with_propagators(edges: DataFrame, propagators: DataFrame) -> DataFrame:
    """The edges with those that a library call's patterns add (``value_edges`` shape)."""
    return edges.unionByName(propagators)


def traces(edges: DataFrame, sources: DataFrame, depth: int = DEPTH, hops: int = HOPS) -> DataFrame:
    """``root``, ``node``, ``depth``, ``hops``, ``steps``: what each source value (``root``) reaches, with one shortest way.

    Of ways of one length the one with fewest hops, then the least steps counts. A way takes ``hops`` calls at most; with
    fewest edges first, a longer way with fewer hops is followed as well where it reaches further.
    """
    links = edges.groupBy("src", "dst", "hop").agg(F.min("step").alias("step"))
    levels = Levels(edges.sparkSession, "trace")
    start = sources.select(F.col(sources.columns[0]).alias("root")).distinct()
    none = F.array().cast(f"array<{STEP}>")
    frontier = levels.add(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("hops"), none.alias("steps")))
    links = levels.keep(links)
    for level in range(1, depth + 1):
        further = frontier.join(links, F.col("node") == F.col("src")).where(F.col("hops") + F.col("hop") <= hops)
        new = further.select("root", F.col("dst").alias("node"), (F.col("hops") + F.col("hop")).alias("hops"), F.concat("steps", F.array("step")).alias("steps"))
        new = new.groupBy("root", "node").agg(F.min(F.struct("hops", "steps")).alias("_b")).select("root", "node", F.lit(level).alias("depth"), "_b.hops", "_b.steps")
        best = levels.all().groupBy("root", "node").agg(F.min("hops").alias("_known"))
        new = new.join(best, ["root", "node"], "left").where("_known IS NULL OR hops < _known").drop("_known")
        frontier = levels.add(new)
        if not levels.last_count:
            break
    found = levels.all()
    first = found.groupBy("root", "node").agg(F.min(F.struct("depth", "hops", "steps")).alias("_f"))
    return first.select("root", "node", "_f.*").where("depth > 0")


def flow_reach(edges: DataFrame, sources: DataFrame, depth: int = DEPTH, hops: int = HOPS) -> DataFrame:
    """``root``, ``node`` of ``traces``, and each source itself: a value flows to itself."""
    start = sources.select(F.col(sources.columns[0]).alias("root")).distinct()
    return traces(edges, sources, depth, hops).select("root", "node").union(start.select("root", F.col("root").alias("node")))


def whole_edges(edges: DataFrame) -> DataFrame:
    """The edges that hand the whole value on."""
    return edges.where(preserves_whole("step.kind"))


def trace(pairs: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None, depth: int = DEPTH, hops: int = HOPS) -> DataFrame:
    """Pairs (``source``, ``sink``: value keys) with ``reachable``, ``steps`` and ``gaps``.

    Gaps say why "no" is not proven: a source or sink that no edge knows, and calls without a known callee (``function``,
    ``expression`` in ``unresolved``) in the source's function. A reachable pair has none.
    """
    found = traces(edges, pairs.select("source"), depth, hops)
    joined = pairs.join(found.select(F.col("root").alias("source"), F.col("node").alias("sink"), "steps"), ["source", "sink"], "left")
    known = edges.select(F.explode(F.array("src", "dst")).alias("_node")).distinct().withColumn("_seen", F.lit(True))
    for side in ("source", "sink"):
        joined = joined.join(known.select(F.col("_node").alias(side), F.col("_seen").alias(f"_{side}")), side, "left")
    function = F.substring_index("source", "\0", 1)
    if unresolved is None:
        joined = joined.withColumn("_calls", F.lit(0).cast("bigint"))
    else:
        calls = unresolved.groupBy(F.col("function").alias("_fn")).agg(F.count(F.lit(1)).alias("_calls"))
        joined = joined.withColumn("_fn", function).join(calls, "_fn", "left").drop("_fn")
    reachable = F.col("steps").isNotNull() | (F.col("source") == F.col("sink"))
    reasons = F.array(
        F.when(F.col("_source").isNull(), F.lit("source is in no edge")),
        F.when(F.col("_sink").isNull(), F.lit("sink is in no edge")),
        F.when(F.coalesce("_calls", F.lit(0)) > 0, F.lit("calls without a known callee")),
    )
    gaps = F.when(reachable, F.array().cast("array<string>")).otherwise(F.filter(reasons, lambda g: g.isNotNull()))
    none = F.array().cast(f"array<{STEP}>")
    return joined.select(*pairs.columns, reachable.alias("reachable"), F.coalesce("steps", none).alias("steps"), gaps.alias("gaps"))


def reads_flowing_to(reads: DataFrame, targets: DataFrame, reach: DataFrame) -> DataFrame:
    """Reads (``value``: a key, and more) with the ``target`` keys that they reach; identity sources are included."""
    hit = reads.join(reach.withColumnRenamed("root", "value"), "value")
    return hit.join(targets.select(F.col(targets.columns[0]).alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "target")


def reads_flowing_within(flow: DataFrame, read: Column, target: Column, depth: int = DEPTH) -> DataFrame:
    """``value``, ``target``: ``reads_flowing_to`` where no call lies between, for reads and targets of any number.

    flow: as for ``value_edges``; read and target say whether a row's source and target expressions are reads and targets. Each
    function is walked by itself, since only calls lead from one to another.
    """
    rows = flow.select(F.coalesce("fn", F.lit("<module>")).alias("graph"), F.col("source_expr").alias("src"), F.col("target_expr").alias("dst"), read.alias("asked"), target.alias("goal"))
    return goals_within(rows, depth).select(node("graph", "root").alias("value"), node("graph", "node").alias("target"))


def derived_from(handles: DataFrame, reads: DataFrame, source: Column, reach: DataFrame) -> DataFrame:
    """Handles (``value``) that some read matching the source flows to."""
    chosen = reads.where(source).select(F.col("value").alias("root")).distinct()
    return handles.join(reach.join(chosen, "root", "left_semi").select(F.col("node").alias("value")), "value", "left_semi")


def value_inputs(handles: DataFrame, reads: DataFrame, reach: DataFrame, equivalence: str = "exact") -> DataFrame:
    """``value``, ``input``: the logical inputs (``container``, ``key`` of reads) that flow into each handle."""
    named = reads.select(F.col("value").alias("root"), logical_input(F.col("container"), F.col("key"), equivalence).alias("input")).where("input IS NOT NULL")
    hit = reach.join(named.distinct(), "root").select(F.col("node").alias("value"), "input")
    return hit.join(handles.select("value").distinct(), "value", "left_semi").distinct()


def shares_origin(pairs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Pairs (``left``, ``right``) with ``shared``: the number of logical inputs that flow into both. inputs: ``value``, ``input``."""
    left = inputs.withColumnRenamed("value", "left")
    right = inputs.withColumnRenamed("value", "right")
    both = pairs.select("left", "right").distinct().join(left, "left").join(right, ["right", "input"]).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(both, ["left", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint")))


def expressions_at(flow: DataFrame, places: DataFrame, side: str = "source") -> DataFrame:
    """Places (``file``, ``line``) with the ``expression`` of each edge's side there: the values that a location stands for."""
    at = flow.select(F.col(f"{side}_location.file").alias("file"), F.col(f"{side}_location.line").alias("line"), F.coalesce("containing_function_fqn", F.lit("<module>")).alias("function"), F.col(f"{side}_expr").alias("expression"))
    return places.join(at.distinct(), ["file", "line"])
