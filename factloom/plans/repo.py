"""A repository's facts as derived relations: from extracted facts and a pattern dimension to routes, reads, effects,
checks, sinks, scopes and gaps. Nothing is collected; relations that many others read are written to the shared folder once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dotted_prefixes, owner_of
from ..operators import patterns, scopes
from ..operators.graph import Levels, closure
from ..operators.joins import unique_suffix

#: Levels of calls that a reachable scope follows.
DEPTH = 5


class Repo:
    """facts: rows of ``extract.python_facts``; dimension: rows of ``plans.catalogue`` and the user's own."""

    def __init__(self, facts: DataFrame, dimension: DataFrame):
        self.facts, self.dimension = facts, dimension

    def _kept(self, df: DataFrame) -> DataFrame:
        return Levels(self.facts.sparkSession, "repo").keep(df)

    def family(self, name: str) -> DataFrame:
        return self.facts.where(F.col("family") == name)

    @cached_property
    def functions(self) -> DataFrame:
        return self.family("functions").select("fqn", "name", "file", "line", F.split("detail", ",").alias("params"), F.col("flag").alias("is_method"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.family("classes").select("fqn", "name", "file", "line", F.split("detail", ",").alias("bases"))

    @cached_property
    def gaps(self) -> DataFrame:
        """What is not known: files that do not parse."""
        return self.family("errors").select(F.lit("parse").alias("kind"), F.col("detail").alias("message"), "file", "line")

    @cached_property
    def aliases(self) -> DataFrame:
        """``file``, ``alias``, ``target``: imported names, and module names assigned from a constructor call of one."""
        imported = self.family("imports").select("file", F.col("name").alias("alias"), F.col("fqn").alias("target"))
        made = self.family("value_flow_edges").where(F.col("owner") == "<module>").select("file", F.col("target").alias("alias"), F.regexp_extract("name", r"^([A-Za-z_][\w.]*)\(", 1).alias("_call"))
        made = made.where("_call != '' AND alias RLIKE '^[A-Za-z_][A-Za-z0-9_]*$'").withColumn("_head", F.substring_index("_call", ".", 1))
        known = imported.select("file", F.col("alias").alias("_head"), F.col("target").alias("_target"))
        resolved = made.join(known, ["file", "_head"]).select("file", "alias", F.concat("_target", F.expr("substring(_call, length(_head) + 1)")).alias("target"))
        return self._kept(imported.union(resolved).groupBy("file", "alias").agg(F.min("target").alias("target")))

    def canonical(self, rows: DataFrame, name: str = "fqn") -> DataFrame:
        """With ``canonical``: the name with its longest alias of the file rewritten, once per distinct name of a file."""
        asked = rows.select("file", F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
        asked = asked.withColumn("alias", F.explode(dotted_prefixes(F.col("_name"))))
        best = asked.join(self.aliases, ["file", "alias"]).groupBy("file", "_name").agg(F.max(F.struct(F.length("alias").alias("n"), "target")).alias("_b"))
        out = rows.join(best, (rows["file"] == best["file"]) & (rows[name] == best["_name"]), "left").drop(best["file"])
        return out.withColumn("canonical", F.coalesce(F.concat("_b.target", F.expr(f"substring({name}, _b.n + 1)")), F.col(name))).drop("_b", "_name")

    @cached_property
    def providers(self) -> DataFrame:
        """The patterns of providers whose library some file imports."""
        imports = self.family("imports").select(F.col("fqn").alias("module"))
        known = patterns.active(self.dimension.select("provider", "library").distinct(), imports)
        return self.dimension.join(known.select("provider").distinct(), "provider", "left_semi")

    @cached_property
    def matches(self) -> DataFrame:
        """``kind``, ``gives``, ``detail``, ``function``, ``file``, ``line``, ``given``: patterns against calls, decorators, attributes."""
        module = F.regexp_replace(F.regexp_replace("file", r"(/__init__)?\.py$", ""), "/", ".")
        site = lambda family, kind, function, given: self.family(family).select(F.lit(kind).alias("kind"), "fqn", function.alias("function"), "file", "line", given.alias("given"))
        inside = F.when(F.col("owner") == "<module>", module).otherwise(F.col("owner"))
        observed = site("call_edges", "call", inside, F.col("detail")).union(site("decorators", "decorator", F.col("target"), F.col("detail"))).union(site("attributes", "attribute", inside, F.lit(None).cast("string")))
        dimension = self.providers.select("kind", F.col("fqn").alias("canonical"), "pattern", "provider", "gives", F.col("detail").alias("detail"))
        return self._kept(self.canonical(observed).join(dimension, ["kind", "canonical"]))

    @cached_property
    def routes(self) -> DataFrame:
        """``route`` (file:line), ``path``, ``methods``, ``handler``; methods come from the decorator's list, else from its name."""
        listed = F.regexp_extract_all(F.regexp_extract("given", r"methods=[\[(]([^\])]*)", 1), F.lit(r"'([A-Z]+)'"), F.lit(1))
        methods = F.when(F.size(listed) > 0, F.array_sort(F.array_distinct(listed))).otherwise(F.array("detail"))
        path = F.regexp_extract("given", r"^'([^']*)'", 1)
        found = self.matches.where("gives = 'route'").select(path.alias("path"), methods.alias("methods"), F.col("function").alias("handler"), "file", "line")
        return found.withColumn("route", F.concat("file", F.lit(":"), F.col("line").cast("string")))

    def _given(self, what: str) -> DataFrame:
        return self.matches.where(F.col("gives") == what).select("function", "detail", "file", "line", F.coalesce("given", F.lit("")).alias("given")).distinct()

    reads = cached_property(lambda self: self._given("input"))
    effects = cached_property(lambda self: self._given("effect"))
    checks = cached_property(lambda self: self._given("check"))
    sinks = cached_property(lambda self: self._given("sink"))
    hooks = cached_property(lambda self: self._given("hook").select(F.col("function").alias("hook"), F.lit(None).cast("string").alias("group")))

    @cached_property
    def call_edges(self) -> DataFrame:
        """``src``, ``dst`` between functions: canonical callees, local names, and unique suffixes of either."""
        calls = self.canonical(self.family("call_edges").where("fqn IS NOT NULL")).select(F.col("owner").alias("src"), "canonical", "file")
        selfless = F.regexp_replace("canonical", r"^\.+", "")
        own = F.when(F.col("canonical").startswith("self."), F.concat(owner_of(F.col("src")), F.expr("substring(canonical, 5)"))).otherwise(selfless)
        named = calls.select("src", own.alias("fqn")).where("src != '<module>' AND fqn IS NOT NULL").distinct()
        resolved = unique_suffix(named, self.functions).select("src", F.col("canonical").alias("dst"))
        return self._kept(resolved.join(self.functions.select(F.col("fqn").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))

    @cached_property
    def scope(self) -> DataFrame:
        """``owner`` (route), ``scope``, ``function``."""
        owners = self.routes.select(F.col("route").alias("owner"), "handler", F.lit(None).cast("string").alias("group"))
        return self._kept(scopes.members(owners, self.call_edges, self.hooks, DEPTH))

    def in_scope(self, facts: DataFrame, kind: str = "reachable") -> DataFrame:
        return scopes.facts_in(self.scope.where(F.col("scope") == kind), facts)

    def reachable(self, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
        return closure(self.call_edges, roots, depth, include_root=True)

    def routes_where(self, has: DataFrame, kind: str = "reachable") -> DataFrame:
        found = scopes.with_any(self.routes.select(F.col("route").alias("owner")), self.scope, has, kind)
        return self.routes.join(found.withColumnRenamed("owner", "route"), "route", "left_semi")

    def routes_without(self, has: DataFrame, kind: str = "full_stack") -> DataFrame:
        found = scopes.without(self.routes.select(F.col("route").alias("owner")), self.scope, has, kind)
        return self.routes.join(found.withColumnRenamed("owner", "route"), "route", "left_semi")


def accepting(*methods: str) -> Column:
    return F.arrays_overlap("methods", F.array(*map(F.lit, methods)))
