"""Scopes: which functions belong to a route, and what happens in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .relations import uses
from .selectors import Effect, Fn, Source


def members(owners: DataFrame, edges: DataFrame, hooks: DataFrame, max_depth: int = 5) -> DataFrame:
    """``owner``, ``scope``, ``function`` for the scopes body, reachable and full_stack.

    owners: ``owner``, ``handler``, ``group``; edges: ``src``, ``dst``; hooks: ``hook``, ``group`` (null: all owners). The full
    stack is what the handler and the hooks of the owner's group reach, and what ``everywhere`` says of all owners: a
    hook that concerns everyone has one row with a null ``owner``, which stands for each of them, instead of one for
    each. Handlers are resolved once each, however many owners share them.
    """
    starts = owners.select(F.col("handler").alias("root")).union(hooks.select("hook")).distinct()
    reach = closure(edges, starts, max_depth, include_root=True).select("root", F.col("node").alias("function"))
    body = owners.select("owner", F.lit("body").alias("scope"), F.col("handler").alias("function"))
    own = owners.join(reach, F.col("handler") == F.col("root"))
    reachable = own.select("owner", F.lit("reachable").alias("scope"), "function")
    grouped = owners.join(hooks.where("group IS NOT NULL"), "group").select("owner", "hook")
    stack = own.select("owner", "function").union(grouped.join(reach, F.col("hook") == F.col("root")).select("owner", "function"))
    common = hooks.where("group IS NULL").join(reach, F.col("hook") == F.col("root")).select(F.lit(None).cast(owners.schema["owner"].dataType).alias("owner"), "function")
    return body.union(reachable).union(stack.union(common).distinct().select("owner", F.lit("full_stack").alias("scope"), "function"))


def everywhere(scope: DataFrame) -> DataFrame:
    """``scope``, ``function``: the members that belong to every owner."""
    return scope.where("owner IS NULL").select("scope", "function")


def of_owners(scope: DataFrame, facts: DataFrame) -> DataFrame:
    """``owner``, ``scope`` with the facts of the owners' own functions; what belongs to all is not repeated for each."""
    return scope.where("owner IS NOT NULL").join(facts, "function")


def counted(scope: DataFrame) -> DataFrame:
    """``owner``, ``scope``, ``n_functions``: each owner's members, with those of all owners counted in once each."""
    own = scope.where("owner IS NOT NULL").distinct()
    common = everywhere(scope).distinct()
    shared = own.join(common, ["scope", "function"], "left_semi").groupBy("owner", "scope").agg(F.count(F.lit(1)).alias("_both"))
    sizes = own.groupBy("owner", "scope").agg(F.count(F.lit(1)).alias("_own"))
    of_all = common.groupBy("scope").agg(F.count(F.lit(1)).alias("_all"))  # a row a scope at most
    joined = sizes.join(shared, ["owner", "scope"], "left").join(F.broadcast(of_all), "scope", "left")
    n = F.col("_own") + F.coalesce("_all", F.lit(0)) - F.coalesce("_both", F.lit(0))
    return joined.select("owner", "scope", n.alias("n_functions"))


def sizes(owners: DataFrame, edges: DataFrame, hooks: DataFrame, max_depth: int = 5) -> DataFrame:
    """``counted`` of ``members``, by arithmetic: owners of the same groups share one list of what their hooks reach, which is not
    repeated for each of them, and of an owner's own functions only those outside that list are added to its length."""
    owners = owners.where("owner IS NOT NULL")
    starts = owners.select(F.col("handler").alias("root")).union(hooks.select("hook")).distinct()
    reach = closure(edges, starts, max_depth, include_root=True).select("root", F.col("node").alias("function"))
    own = owners.join(reach, F.col("handler") == F.col("root")).select("owner", "function").distinct()
    hooked = hooks.join(reach, F.col("hook") == F.col("root")).select("group", "function").distinct()
    common = hooked.where("group IS NULL").select("function")
    of_group = hooked.where("group IS NOT NULL").join(common, "function", "left_anti")
    groups = owners.join(hooks.select("group").distinct(), "group").groupBy("owner").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    listed = groups.select("groups").distinct().select("groups", F.explode("groups").alias("group")).join(of_group, "group").select("groups", "function").distinct()
    marked = own.join(groups, "owner", "left").join(common.withColumn("_common", F.lit(True)), "function", "left").join(listed.withColumn("_listed", F.lit(True)), ["groups", "function"], "left")
    added = F.count(F.when(F.col("_common").isNull() & F.col("_listed").isNull(), 1))
    per_owner = marked.groupBy("owner").agg(F.count(F.lit(1)).alias("_own"), added.alias("_added"))
    lengths = listed.groupBy("groups").agg(F.count(F.lit(1)).alias("_listed"))
    whole = per_owner.join(groups, "owner", "full").join(lengths, "groups", "left").crossJoin(F.broadcast(common.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    n = F.col("_all") + F.coalesce("_listed", F.lit(0)) + F.coalesce("_added", F.lit(0))
    body = owners.select("owner", "handler").distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("n_functions"))
    each = {"body": body, "reachable": per_owner.select("owner", F.col("_own").alias("n_functions")), "full_stack": whole.select("owner", n.alias("n_functions"))}
    parts = [df.select("owner", F.lit(scope).alias("scope"), "n_functions") for scope, df in each.items()]
    return parts[0].union(parts[1]).union(parts[2])


def facts_in(scope: DataFrame, facts: DataFrame) -> DataFrame:
    """``owner``, ``scope`` with the facts (``function``, ...) of their functions; a null owner stands for all of them."""
    return scope.join(facts, "function")


def _hits(scope: DataFrame, facts: DataFrame, kind: str) -> DataFrame:
    return scope.where(F.col("scope") == kind).join(facts.select("function"), "function", "left_semi").select("owner")


def with_any(owners: DataFrame, scope: DataFrame, facts: DataFrame, kind: str, common: bool = True) -> DataFrame:
    """Owners with some fact (``function``) in the scope; all of them where a function that belongs to all has one. Without
    ``common`` members, one semi-join does."""
    if not common:
        return owners.join(_hits(scope, facts, kind), "owner", "left_semi")
    return owners.join(without(owners, scope, facts, kind).select("owner"), "owner", "left_anti")


def without(owners: DataFrame, scope: DataFrame, checks: DataFrame, kind: str = "full_stack", common: bool = True) -> DataFrame:
    """Owners with no check (``function``) anywhere in the scope; a check that all share leaves nobody."""
    hits = _hits(scope, checks, kind)
    some = owners.join(hits.where("owner IS NOT NULL"), "owner", "left_anti")
    if not common:
        return some
    shared = hits.where("owner IS NULL").agg(F.count(F.lit(1)).alias("_shared"))  # one row
    return some.withColumn("_shared", F.lit(0).cast("bigint")).join(F.broadcast(shared), "_shared", "left_semi").drop("_shared")


#: Containers whose reads say who asks, not what; a plain question for reads leaves them out.
IDENTITY = ("session", "framework_global")


class ScopeView:
    """What happens in one kind of scope: members joined with facts by function, filtered by selectors.

    ``scope``: rows of ``members``; facts by relation name (conditions, predicates, checks, reads, effects, calls, sinks, ...), each with
    ``function``. A null ``owner`` in an answer stands for all owners.
    """

    def __init__(self, scope: DataFrame, kind: str, facts: dict[str, DataFrame]):
        self.members = scope.where(F.col("scope") == kind)
        self.facts = facts

    def of(self, relation: str, where: Column | None = None) -> DataFrame:
        """The relation's facts in the scope: decorators, generated URLs, validated values, guards, disagreements, gaps and the like."""
        rows = self.facts[relation]
        return facts_in(self.members, rows if where is None else rows.where(where))

    def functions(self) -> DataFrame:
        return self.members.select("owner", "function").distinct()

    def conditions(self, using: str | None = None) -> DataFrame:
        return self.of("conditions", None if using is None else uses("expression", using))

    def predicates(self) -> DataFrame:
        return self.of("predicates")

    def checks(self, category: str | None = None) -> DataFrame:
        """All checks, or those of a category; ``a|b`` belongs to both of its parts."""
        return self.of("checks", None if category is None else F.array_contains(F.split("category", r"\|"), category))

    def reads(self, source: Source | None = None) -> DataFrame:
        """Reads of a source; without one, all that don't say who asks."""
        return self.of("reads", ~F.col("container").isin(*IDENTITY) if source is None else source.matches())

    def effects(self, selector: Effect | None = None) -> DataFrame:
        return self.of("effects", None if selector is None else selector.matches())

    def calls(self, selector: Fn | None = None) -> DataFrame:
        return self.of("calls", None if selector is None else selector.matches("name", "fqn"))

    def sinks(self, kind: str | None = None) -> DataFrame:
        return self.of("sinks", None if kind is None else F.col("kind") == kind)

    def restricted(self, blocks: DataFrame, relation: str) -> DataFrame:
        """The relation's facts in the scope whose block (``function``, ``block``) is among those given: a branch of it."""
        return self.of(relation).join(blocks.select("function", "block").distinct(), ["function", "block"], "left_semi")
