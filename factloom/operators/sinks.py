"""Which sinks input really reaches: by flow, and not through what was generated or validated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safely_generated(sinks: DataFrame, urls: DataFrame, whole_reach: DataFrame) -> DataFrame:
    """``sink``: those whose value is, as a whole, a generated one that is safe for their kind.

    sinks: ``sink``, ``kind``, ``value``; urls: ``value``, ``safe_kinds array``; whole_reach: ``root``, ``node`` of whole-value flow.
    """
    told = urls.select(F.col("value").alias("root"), F.explode("safe_kinds").alias("kind")).join(whole_reach, "root").select(F.col("node").alias("value"), "kind").distinct()
    return sinks.join(told, ["value", "kind"], "left_semi").select("sink")


def validated(sinks: DataFrame, values: DataFrame, guarded: DataFrame) -> DataFrame:
    """``sink``: those whose expression a guard validated for their kind, in its guarded blocks, with no other definition between.

    sinks: ``sink``, ``kind``, ``function``, ``expression``, ``definition`` (null: unknown), ``block``; values: ``guard``, ``function``,
    ``expression``, ``definition``, ``safe_kinds``, ``validated_when``; guarded: ``guard``, ``direction``, ``block`` of each guard's arms and
    of what only its arm reaches.
    """
    told = values.select("guard", "function", "expression", F.col("definition").alias("_defined"), F.col("validated_when").alias("direction"), F.explode("safe_kinds").alias("kind"))
    hit = sinks.join(told, ["function", "expression", "kind"]).where("definition IS NULL OR _defined IS NULL OR definition = _defined")
    return hit.join(guarded, ["guard", "direction", "block"], "left_semi").select("sink").distinct()


def helper_validated(sinks: DataFrame, helpers: DataFrame) -> DataFrame:
    """``sink``: those whose argument is a call of a helper that returns validated data only. helpers: ``name``, ``safe_kinds``."""
    told = helpers.select("name", F.explode("safe_kinds").alias("kind")).distinct()
    called = sinks.withColumn("name", F.regexp_extract("expression", r"([A-Za-z_]\w*)\(", 1))
    return called.join(told, ["name", "kind"], "left_semi").select("sink")


def reached_sinks(sinks: DataFrame, reads: DataFrame, reach: DataFrame, safe: DataFrame) -> DataFrame:
    """Sinks that some read of their scope flows to, and that are not safe (``sink``).

    Those that a predicate proved (``proved``) need no flow, only a read of text in the same scope. sinks: ``sink``, ``scope``,
    ``value``, ``proved``; reads: ``scope``, ``value``, ``is_text``; reach: ``root``, ``node``.
    """
    pairs = reach.select("root", F.col("node").alias("value"))
    scopes = reads.groupBy("scope").agg(F.min("value").alias("root"), F.max("value").alias("_last"), F.max(F.coalesce("is_text", F.lit(False))).alias("_text"))
    met = sinks.join(scopes, "scope")
    by_place = met.where("proved AND _text")
    by_flow = met.where("NOT proved AND root = _last").join(pairs, ["root", "value"], "left_semi")  # one value is read there
    crowded = met.where("NOT proved AND root != _last").drop("root")
    roots = reads.join(scopes.where("root != _last").select("scope"), "scope", "left_semi").select("scope", F.col("value").alias("root")).distinct()
    asked = crowded.select("scope", "value").distinct().join(roots, "scope").join(pairs, ["root", "value"], "left_semi").select("scope", "value")
    by_one = crowded.join(asked, ["scope", "value"], "left_semi")
    found = by_flow.select(*sinks.columns).union(by_one.select(*sinks.columns)).union(by_place.select(*sinks.columns))
    return found.join(safe.select("sink"), "sink", "left_anti")
