"""Detectors: named functions from a repository to finding rows, their registry, and the outcome of a scan."""

from __future__ import annotations

import importlib.util
import inspect
import pathlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITIES, glob_regex
from ..operators import findings
from .repo import Repo, accepting

#: Columns that a detector returns.
COLUMNS = ("endpoint", "summary", "file", "line", "evidence")


@dataclass(frozen=True)
class Detector:
    rule_id: str
    severity: str
    description: str
    find: Callable[[Repo], DataFrame]


REGISTRY: dict[str, Detector] = {}


def detector(rule_id: str, severity: str, description: str) -> Callable[[Callable[[Repo], DataFrame]], Detector]:
    """Registers a function; an unknown severity or a second rule of one id is refused."""
    if severity not in SEVERITIES:
        raise ValueError(f"{severity} is no severity")

    def add(fn: Callable[[Repo], DataFrame]) -> Detector:
        if rule_id in REGISTRY:
            raise ValueError(f"{rule_id} is registered already")
        REGISTRY[rule_id] = Detector(rule_id, severity, description, fn)
        return REGISTRY[rule_id]

    return add


def chosen(include: Iterable[str] = ("*",), exclude: Iterable[str] = ()) -> list[Detector]:
    """Registered rules by shell patterns, in the order of their ids."""
    hit = lambda rule, globs: any(re.search(glob_regex(g), rule) for g in globs)
    return [REGISTRY[r] for r in sorted(REGISTRY) if hit(r, include) and not hit(r, exclude)]


def run(repo: Repo, detectors: Iterable[Detector]) -> DataFrame:
    """All findings with rule, severity, fingerprint and a stable order; duplicates are gone."""
    parts = []
    for d in detectors:
        rows = d.find(repo)
        if missing := set(COLUMNS) - set(rows.columns):
            raise TypeError(f"{d.rule_id} lacks {sorted(missing)}")
        parts.append(rows.select(F.lit(d.rule_id).alias("rule_id"), F.lit(d.severity).alias("severity"), *COLUMNS))
    found = findings.identified(reduce(DataFrame.union, parts))
    order = F.concat_ws("\0", "file", F.format_string("%09d", "line"), "rule_id", "summary")
    return findings.first_of_each(found.withColumn("ord", order))


def described(detectors: Iterable[Detector]) -> list[dict[str, str]]:
    """Id, severity, description and origin of rules, in the order of their ids: what a listing shows of each."""
    rows = [{"rule_id": d.rule_id, "severity": d.severity, "description": d.description, "origin": d.find.__module__} for d in detectors]
    return sorted(rows, key=lambda r: r["rule_id"])


def explained(rule_id: str) -> str:
    """A rule's description, severity, and what its function says of itself; an unknown id is refused."""
    if rule_id not in REGISTRY:
        raise KeyError(f"{rule_id} is no rule")
    d = REGISTRY[rule_id]
    return "\n".join([f"{d.rule_id} ({d.severity}): {d.description}", *filter(None, [inspect.getdoc(d.find)])])


def rule_files(folders: Iterable[str]) -> list[str]:
    """Python files with rules in folders of the driver, sorted; names that begin with an underscore are none."""
    return sorted(str(f) for folder in folders for f in pathlib.Path(folder).rglob("*.py") if not f.name.startswith("_"))


def load_rules(files: Iterable[str]) -> list[str]:
    """Runs rule files, whose ``detector`` calls register their rules; the ids that are new. A file that fails stops the scan."""
    before = set(REGISTRY)
    for n, file in enumerate(files):
        spec = importlib.util.spec_from_file_location(f"factloom_rules_{n}_{pathlib.Path(file).stem}", file)
        spec.loader.exec_module(importlib.util.module_from_spec(spec))  # type: ignore[union-attr]
    return sorted(set(REGISTRY) - before)


def with_severity(found: DataFrame, rule_id: str, severity: str) -> DataFrame:
    """The findings, those of one rule with another severity."""
    if severity not in SEVERITIES:
        raise ValueError(f"{severity} is no severity")
    return found.withColumn("severity", F.when(F.col("rule_id") == rule_id, severity).otherwise(F.col("severity")))


def exit_code(found: DataFrame, fail_on: str, complete: bool = True) -> int:
    """124 for an incomplete scan, 1 for a finding as severe as ``fail_on``, else 0."""
    if not complete:
        return 124
    return int(not findings.at_least(found, fail_on).isEmpty())


def _place() -> tuple:
    return F.col("route").alias("endpoint"), "file", "line", F.col("route").alias("evidence")


@detector("endpoints", "info", "Lists the routes")
def endpoints(repo: Repo) -> DataFrame:
    return repo.routes.select(*_place(), F.concat_ws(" ", F.array_join("methods", ","), "path", "handler").alias("summary"))


@detector("request-inputs", "info", "What each route's reachable code reads from the request")
def request_inputs(repo: Repo) -> DataFrame:
    counts = repo.in_scope(repo.reads).groupBy("owner", "detail").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("n").cast("string"), F.lit("x "), "detail"))), ", ").alias("summary"))
    return repo.routes.join(listed.withColumnRenamed("owner", "route"), "route").select(*_place(), "summary")


@detector("route-guards", "info", "The kinds of checks in each route's full stack")
def route_guards(repo: Repo) -> DataFrame:
    found = repo.in_scope(repo.checks, "full_stack")
    own = found.groupBy("owner").agg(F.collect_set("detail").alias("_own")).where("owner IS NOT NULL")
    common = found.where("owner IS NULL").agg(F.collect_set("detail").alias("_common"), F.lit(0).alias("_k"))  # one row: kinds of checks are few
    none = F.array().cast("array<string>")
    rows = repo.routes.join(own.withColumnRenamed("owner", "route"), "route", "left").withColumn("_k", F.lit(0)).join(F.broadcast(common), "_k")
    kinds = F.array_sort(F.array_union(F.coalesce("_own", none), F.coalesce("_common", none)))
    return rows.where(F.size(kinds) > 0).select(*_place(), F.array_join(kinds, ", ").alias("summary"))


@detector("unguarded-writes", "high", "Routes that write state with no check in their full stack")
def unguarded_writes(repo: Repo) -> DataFrame:
    writes = repo.effects.where("detail RLIKE '(write|delete)$'")
    open_ = repo.routes_without(repo.checks).select("route")
    hit = repo.routes_where(writes).where(accepting("POST", "PUT", "PATCH", "DELETE")).join(open_, "route", "left_semi")
    return hit.select(*_place(), F.concat(F.lit("no check before a write in "), "handler").alias("summary"))


@detector("input-near-sink", "medium", "Functions that read the request and call a sink")
def input_near_sink(repo: Repo) -> DataFrame:
    reads = repo.reads.groupBy("function").agg(F.min(F.struct("line", "detail")).alias("r"))
    hit = repo.sinks.join(reads, "function")
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    return hit.select(F.col("function").alias("endpoint"), "file", "line", place.alias("evidence"), F.concat(F.col("r.detail"), F.lit(" input beside a "), "detail", F.lit(" sink")).alias("summary"))
