"""Findings as documents: JSON captures, SARIF logs, baselines, ignore files and telemetry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from ..operators.findings import SARIF, from_sarif, to_sarif

FINDING = "rule_id STRING, severity STRING, fingerprint STRING, endpoint STRING, summary STRING, file STRING, line BIGINT, suppressed_by STRING"
#: Severities for SARIF levels.
OF_LEVEL = {"error": "high", "warning": "medium", "note": "low"}


class UnknownDocument(ValueError):
    """Neither a JSON capture nor a SARIF log, or one without what a finding must have."""


def load_findings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON capture (``findings``) or a SARIF log (``runs``), told apart by their shape.

    Rule, severity and fingerprint must be there in a capture; a SARIF result without a fingerprint gets the digest of
    its rule and text, and its severity follows from its level (else low).
    """
    shape = set(spark.read.json(path, multiLine=True).columns)
    if "runs" in shape:
        rows = spark.read.schema(f"runs ARRAY<STRUCT<results:ARRAY<STRUCT<{_struct(SARIF)}>>>>").json(path, multiLine=True)
        flat = from_sarif(rows.select(F.explode("runs").alias("r")).select(F.explode("r.results").alias("x")).select(F.to_json("x").alias("result")))
        levels = F.create_map(*(F.lit(v) for kv in OF_LEVEL.items() for v in kv))
        made = F.substring(F.sha2(F.concat_ws("\0", "rule_id", "summary"), 256), 1, 16)
        return flat.withColumn("severity", F.coalesce(F.try_element_at(levels, F.col("level")), F.lit("low"))).withColumn("fingerprint", F.coalesce("fingerprint", made)).drop("level")
    if "findings" in shape:
        rows = spark.read.schema(f"findings ARRAY<STRUCT<{_struct(FINDING)}>>").json(path, multiLine=True).select(F.inline("findings"))
        if not rows.where("coalesce(rule_id, '') = '' OR coalesce(severity, '') = '' OR coalesce(fingerprint, '') = ''").isEmpty():
            raise UnknownDocument(f"{path} has findings without rule, severity or fingerprint")
        return rows
    raise UnknownDocument(f"{path} is neither a capture nor a SARIF log")


def _struct(ddl: str) -> str:
    """A column list as the fields of a struct type: only names and types that hold no top-level blank need care."""
    out, depth = [], 0
    for part in re.split(r"([<>,])", ddl):
        depth += (part == "<") - (part == ">")
        out.append(re.sub(r"^(\s*\w+) ", r"\1:", part) if not depth or out[-1:] == [","] or not out else part)
    return "".join(out)


def write_capture(df: DataFrame, path: str) -> None:
    """Findings as JSON lines in parts, a finding a line."""
    df.write.json(path)


def write_sarif_log(df: DataFrame, path: str, tool: str = "factloom") -> None:
    """SARIF results in parts, with a log's head and rules in a document of their own (``path/log``)."""
    to_sarif(df).select("result").write.text(f"{path}/results")
    rules = df.select("rule_id").distinct().orderBy("rule_id").agg(F.collect_list(F.struct(F.col("rule_id").alias("id"))).alias("rules"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"))).alias("runs"))
    rules.select(F.to_json(log).alias("value")).write.text(f"{path}/log")


def write_baseline(df: DataFrame, path: str) -> None:
    """One document with the distinct fingerprints, sorted. A baseline is a file for people: it is small by purpose."""
    df.select(F.col("fingerprint")).distinct().agg(F.array_sort(F.collect_list("fingerprint")).alias("suppressions")).coalesce(1).write.mode("overwrite").json(path)


def ignore_rules(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Ignore-file lines (``glob``, ``!glob``, ``glob: rule, rule``; ``#`` comments) as ``ord``, ``pattern``, ``negated``, ``rules``."""
    out = []
    for n, line in enumerate(lines):
        text = line.split("#", 1)[0].strip()
        if not text:
            continue
        glob, _, rules = text.partition(":")
        negated = glob.startswith("!")
        glob = glob.removeprefix("!").strip()
        inner = glob_regex(glob.strip("/"))[len("(?s)^") : -1]
        pattern = f"(?s)^{'' if '/' in glob.rstrip('/') else '(.*/)?'}{inner}(/.*)?$"
        out.append((n, pattern, negated, [r.strip().replace("-", "_").lower() for r in rules.split(",")] if rules.strip() else None))
    return spark.createDataFrame(out, "ord int, pattern string, negated boolean, rules array<string>")


def ignored(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with ``ignored``: whether the last matching line ignores their file (and rule).

    The lines are few and come from one file; they become one chain of conditions, evaluated in order.
    """
    from ..functions.scalars import rule_key

    found = F.lit(False)
    for r in sorted(rules.collect(), key=lambda r: r["ord"]):  # the lines of an ignore file
        hit = F.col("file").rlike(r["pattern"])
        if r["rules"] is not None:
            hit &= rule_key(F.col("rule_id")).isin(*r["rules"])
        found = F.when(hit, not r["negated"]).otherwise(found)
    return df.withColumn("ignored", found)


def append_telemetry(spark: SparkSession, path: str, record: dict) -> None:
    """One more JSON line, as a part of its own: writers at the same time don't meet."""
    spark.createDataFrame([(k, str(v)) for k, v in sorted(record.items())], "k string, v string").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("record")).write.mode("append").json(path)
