"""A scan: detectors under deadlines, with a profile, an overview and an exit code."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank
from .repo import Repo
from .rules import Detector, exit_code, run


@dataclass(frozen=True)
class Config:
    """What a scan runs and when it fails; layers of settings merge left to right."""

    include: tuple[str, ...] = ("*",)
    exclude: tuple[str, ...] = ()
    fail_on: str = "high"
    rule_seconds: float = 60.0
    overall_seconds: float = 600.0

    def merged(self, *layers: dict) -> Config:
        """Unknown settings are refused; a later layer wins."""
        out = self
        for layer in layers:
            if unknown := set(layer) - set(self.__dataclass_fields__):
                raise ValueError(f"unknown settings {sorted(unknown)}")
            out = replace(out, **{k: tuple(v) if isinstance(v, list) else v for k, v in layer.items()})
        return out


@dataclass
class Outcome:
    """Findings written per rule, what did not finish, and milliseconds by rule."""

    findings: DataFrame | None
    incomplete: list[str] = field(default_factory=list)
    profile: dict[str, int] = field(default_factory=dict)

    def code(self, fail_on: str) -> int:
        if self.findings is None or self.incomplete:
            return 124 if self.incomplete else 0
        return exit_code(self.findings, fail_on)


def scan(spark: SparkSession, repo: Repo, detectors: Iterable[Detector], folder: str, config: Config) -> Outcome:
    """Runs each detector as a job group of its own and writes its findings to ``folder/rule=ID``.

    A rule beyond its deadline has its jobs cancelled and counts as incomplete, as do those after the overall
    deadline; what was written before stays.
    """
    began, out, paths = time.monotonic(), Outcome(None), []
    for d in detectors:
        left = config.overall_seconds - (time.monotonic() - began)
        if left <= 0:
            out.incomplete.append(d.rule_id)
            continue
        group, path, started = uuid.uuid4().hex, f"{folder}/rule={d.rule_id}", time.monotonic()
        spark.sparkContext.setJobGroup(group, d.rule_id, interruptOnCancel=True)
        alarm = threading.Timer(min(left, config.rule_seconds), spark.sparkContext.cancelJobGroup, [group])
        alarm.daemon = True
        alarm.start()
        try:
            run(repo, [d]).write.mode("overwrite").parquet(path)
            paths.append(path)
        except Exception:
            if time.monotonic() - started < min(left, config.rule_seconds):
                raise
            out.incomplete.append(d.rule_id)
        finally:
            alarm.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        out.profile[d.rule_id] = round(1000 * (time.monotonic() - started))
    if paths:
        out.findings = spark.read.parquet(*paths)
    return out


def overview(found: DataFrame, top: int = 10) -> DataFrame:
    """``section`` (total, severity, rule), ``value``, ``n``: severities by rank, the most frequent rules."""
    total = found.agg(F.lit("total").alias("section"), F.lit("").alias("value"), F.count(F.lit(1)).alias("n"), F.lit(0).alias("place"))
    severity = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit("severity"), "severity", "n", -severity_rank(F.col("severity")))
    rules = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(top).select(F.lit("rule"), "rule_id", "n", (-F.col("n")).cast("int"))
    return total.union(severity).union(rules)
