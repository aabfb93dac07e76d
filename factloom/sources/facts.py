"""Sources and sinks: the eleven JSONL fact families, their manifest, findings as JSON and SARIF, baselines."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Nested types that the families share.
SPAN = "STRUCT<file:STRING,line:INT,column:INT,end_line:INT,end_column:INT>"
PROVENANCE = "STRUCT<producer:STRING,producer_version:STRING,artifact:STRING>"
PARAMETER = f"STRUCT<name:STRING,annotation:STRING,default:STRING,kind:STRING,position:INT,location:{SPAN}>"
ARGUMENT = f"STRUCT<position:INT,keyword:STRING,expression:STRING,location:{SPAN}>"
#: The families' schemas.
FAMILIES = {
    "functions": f"fqn STRING, name STRING, file STRING, line INT, params ARRAY<{PARAMETER}>, decorator_names ARRAY<STRING>, decorator_fqns ARRAY<STRING>, kind STRING, is_method BOOLEAN, is_nested BOOLEAN, is_async BOOLEAN, parent_class STRING, location {SPAN}, provenance {PROVENANCE}, parent_function STRING",
    "classes": f"fqn STRING, name STRING, file STRING, bases ARRAY<STRING>, mro_chain ARRAY<STRING>, mro_complete BOOLEAN, method_names ARRAY<STRING>, class_var_names ARRAY<STRING>, is_abstract BOOLEAN, metaclass STRING, subclasses ARRAY<STRING>, all_subclasses ARRAY<STRING>, inherited_methods ARRAY<STRUCT<name:STRING,defining_class_fqn:STRING,resolution:STRING>>, hierarchy_gaps ARRAY<STRUCT<base_expression:STRING,reason:STRING>>, location {SPAN}, provenance {PROVENANCE}",
    "decorators": f"name STRING, fqn STRING, args ARRAY<STRING>, kwargs ARRAY<ARRAY<STRING>>, target_fqn STRING, application_order INT, location {SPAN}, provenance {PROVENANCE}",
    "imports": f"module STRING, names ARRAY<STRING>, aliases ARRAY<ARRAY<STRING>>, is_from_import BOOLEAN, location {SPAN}, provenance {PROVENANCE}, is_conditional BOOLEAN, is_relative BOOLEAN",
    "attributes": f"target_expr STRING, attr_name STRING, is_write BOOLEAN, access_kind STRING, value_expr STRING, containing_function_fqn STRING, location {SPAN}, provenance {PROVENANCE}",
    "call_edges": f"caller_fqn STRING, callee_fqn STRING, arguments ARRAY<{ARGUMENT}>, resolution STRING, source STRING, unresolved_reason STRING, location {SPAN}, provenance {PROVENANCE}, call_expression STRING, dynamic_dispatch_kind STRING, receiver_expression STRING, receiver_location {SPAN}",
    "value_flow_edges": f"source_expr STRING, source_location {SPAN}, target_expr STRING, target_location {SPAN}, kind STRING, containing_function_fqn STRING, provenance {PROVENANCE}, callsite_callee_fqn STRING, callsite_expr STRING, argument_position INT, argument_keyword STRING",
    "symbol_refs": f"name STRING, fqn STRING, resolution STRING, location {SPAN}, provenance {PROVENANCE}",
    "errors": f"file STRING, pass_name STRING, error_kind STRING, message STRING, is_fatal BOOLEAN, location {SPAN}, aborts_pipeline BOOLEAN",
    "type_enrichment": f"expression STRING, declared_type STRING, location {SPAN}, source_tool STRING, is_concrete BOOLEAN, provenance {PROVENANCE}, containing_function_fqn STRING",
    "cfgs": f"fqn STRING, file STRING, blocks ARRAY<STRUCT<id:INT,statements:ARRAY<{SPAN}>,successors:ARRAY<INT>,predecessors:ARRAY<INT>,condition_expr:STRING,condition_location:{SPAN},value_predicates:ARRAY<STRUCT<expression:STRING,location:{SPAN},position:STRING>>>>, edges ARRAY<STRUCT<source_id:INT,target_id:INT,label:STRING,is_exceptional:BOOLEAN>>, try_regions ARRAY<STRUCT<try_body_block_ids:ARRAY<INT>,handlers:ARRAY<STRUCT<exception_types:ARRAY<STRING>,entry_block_id:INT,name:STRING>>,finally_block_id:INT,else_block_id:INT,location:{SPAN}>>",
}


class CorruptFacts(RuntimeError):
    """The fact folder lacks a family that a non-empty index must have."""


def schema_of(family: str) -> StructType:
    return StructType.fromDDL(FAMILIES[family])


def schema_fingerprint() -> str:
    """Changes when any family's schema does."""
    text = "\n".join(f"{k}:{schema_of(k).json()}" for k in sorted(FAMILIES))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def read_family(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """One JSONL family under its schema; a row that does not parse fails the read."""
    return spark.read.schema(schema_of(family)).json(f"{folder}/{family}.jsonl", mode="FAILFAST")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All families that the folder has; fails closed where functions come without their control flow."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {f: read_family(spark, folder, f) for f in FAMILIES if files.exists(path(f"{folder}/{f}.jsonl"))}
    if "cfgs" not in found and "functions" in found and not found["functions"].isEmpty():
        raise CorruptFacts(f"{folder} has functions but no cfgs.jsonl")
    return found


def write_family(df: DataFrame, folder: str, family: str) -> None:
    """The family as JSONL parts under its schema's columns."""
    df.select(*schema_of(family).names).write.json(f"{folder}/{family}.jsonl", ignoreNullFields=False)


def cfg_edges(cfgs: DataFrame) -> DataFrame:
    """``graph``, ``src``, ``dst`` as strings, for the control-flow operators."""
    e = cfgs.select("fqn", F.explode("edges").alias("e"))
    return e.select(F.col("fqn").alias("graph"), F.col("e.source_id").cast("string").alias("src"), F.col("e.target_id").cast("string").alias("dst"))


def manifest(index: dict[str, DataFrame]) -> DataFrame:
    """``family``, ``record_count`` in one job."""
    parts = [df.select(F.lit(f).alias("family")) for f, df in sorted(index.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("family").agg(F.count(F.lit(1)).alias("record_count"))


def write_sarif(results: DataFrame, path: str) -> None:
    """SARIF results (a JSON string each) as text parts, a result a line."""
    results.select("result").write.text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``key`` of each suppression of a baseline document."""
    return spark.read.schema("suppressions ARRAY<STRING>").json(path, multiLine=True).select(F.explode("suppressions").alias("key"))
