"""Findings: identity, duplicates, differences, suppression, gates and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, rule_key, sarif_level, severity_rank


def identified(df: DataFrame) -> DataFrame:
    """With ``fingerprint``: of the rule and the finding's own (endpoint, summary, evidence), 16 hex digits."""
    inner = fingerprint(F.col("endpoint"), F.col("summary"), F.col("evidence"))
    return df.withColumn("fingerprint", fingerprint(F.col("rule_id"), inner))


def first_of_each(df: DataFrame, order: str = "ord", key: str = "fingerprint") -> DataFrame:
    """The first row of each fingerprint, by a minimum that is combined before the shuffle."""
    others = [c for c in df.columns if c not in (order, key)]
    best = df.groupBy(key).agg(F.min(F.struct(order, *others)).alias("_b"))
    return best.select(key, "_b.*").select(*df.columns)


def difference(before: DataFrame, after: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``key``, ``status``: added, removed or common."""
    both = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(key, F.lit(0), F.lit(1)))
    sides = both.groupBy(key).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return sides.select(key, F.when(F.col("b") + F.col("a") == 2, "common").when(F.col("a") == 1, "added").otherwise("removed").alias("status"))


def suppressed(df: DataFrame, inline: DataFrame, ignored: DataFrame, baseline: DataFrame) -> DataFrame:
    """With ``suppressed_by``: the inline directive on the line, else the ignore file, else the baseline key; else null.

    inline: ``file``, ``line``, ``rule`` (null: all rules); ignored: ``file``, ``rule`` (null: all); baseline: ``key``.
    Two joins for each of the first two, one with the rule and one without, each on distinct keys: no row multiplies.
    """

    def marked(rows: DataFrame, marks: DataFrame, on: list[str], name: str) -> DataFrame:
        own = marks.where("rule IS NOT NULL").select(*on, rule_key(F.col("rule")).alias("_rule"), F.lit(True).alias("_m1")).distinct()
        every = marks.where("rule IS NULL").select(*on, F.lit(True).alias("_m2")).distinct()
        rows = rows.join(own, [*on, "_rule"], "left").join(every, on, "left")
        return rows.withColumn(name, F.coalesce("_m1", "_m2", F.lit(False))).drop("_m1", "_m2")

    rows = df.withColumn("_rule", rule_key(F.col("rule_id")))
    rows = marked(marked(rows, inline, ["file", "line"], "_inline"), ignored, ["file"], "_ignored")
    rows = rows.join(baseline.select(F.col("key").alias("fingerprint"), F.lit(True).alias("_base")).distinct(), "fingerprint", "left")
    by = F.when(F.col("_inline"), "inline").when(F.col("_ignored"), "ignore-file").when(F.col("_base"), "baseline")
    return rows.select(*df.columns, by.alias("suppressed_by"))


def without_keys(df: DataFrame, keys: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The rows whose key is not among those given."""
    return df.join(keys.select(key), key, "left_anti")


def at_least(df: DataFrame, label: str, column: str = "severity") -> DataFrame:
    """Findings as severe as the label or more; an unknown severity does not pass."""
    return df.where(severity_rank(F.col(column)) >= severity_rank(F.lit(label)))


def inline_directives(lines: DataFrame, text: str = "text") -> DataFrame:
    """``rules`` (null: all) and ``reason`` of ``# ignore[rule, ...]: reason`` comments; other lines go."""
    pattern = r"#\s*ignore(?:\[([A-Za-z0-9_, -]+)\])?(?::\s*(.*))?$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(text, pattern, i)), F.lit(""))
    found = lines.where(F.col(text).rlike(pattern))
    rules = F.transform(F.split(part(1), ","), lambda r: rule_key(F.trim(r)))
    return found.withColumn("rules", rules).withColumn("reason", part(2))


def to_sarif(df: DataFrame) -> DataFrame:
    """One SARIF result per row, as JSON: rule, level, message, location, partial fingerprint, suppression."""
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    state = F.when(F.col("suppressed_by").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.col("suppressed_by").alias("justification"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("summary").alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"),
        state.alias("suppressions"),
    )
    return df.select("fingerprint", F.to_json(result).alias("result"))


SARIF = (
    "ruleId string, level string, message struct<text:string>, "
    "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>, "
    "partialFingerprints struct<primary:string>, suppressions array<struct<kind:string,justification:string>>"
)


def from_sarif(df: DataFrame, result: str = "result") -> DataFrame:
    """The flat rows of SARIF results; severity comes back as its level."""
    r = F.from_json(F.col(result), SARIF)
    place = r["locations"][0]["physicalLocation"]
    return df.select(
        r["ruleId"].alias("rule_id"),
        r["level"].alias("level"),
        r["message"]["text"].alias("summary"),
        place["artifactLocation"]["uri"].alias("file"),
        place["region"]["startLine"].alias("line"),
        r["partialFingerprints"]["primary"].alias("fingerprint"),
        F.get(r["suppressions"], F.lit(0))["justification"].alias("suppressed_by"),
    )


def disagreements(types: DataFrame) -> DataFrame:
    """Groups of ``file``, ``line``, ``expression`` with two concrete types or more: ``kind``, ``types``, ``n_facts``."""
    groups = types.groupBy("file", "line", "expression").agg(F.array_sort(F.collect_set("declared_type")).alias("_t"), F.count(F.lit(1)).alias("n_facts"))
    has = lambda *names: F.arrays_overlap("_t", F.array(*(F.lit(n) for n in names)))
    kind = F.when(has("None"), "optionality").when(has("list", "dict", "tuple"), "container").when(has("int", "str", "float"), "scalar").otherwise("identity")
    return groups.where((F.size("_t") >= 2) & (F.col("n_facts") >= 2)).select("file", "line", "expression", kind.alias("kind"), F.array_join("_t", ",").alias("types"), "n_facts")


def as_ordinal(column: str, by: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(column)
