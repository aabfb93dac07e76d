"""Fact relations that the driver's star schema stands for, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Relation -> SQL over {table} names.
VIEWS = {
    # Call graph: containment down to parts.
    "dag": """
      SELECT 'R:' || CAST(n_regionkey AS STRING) AS src, 'N:' || CAST(n_nationkey AS STRING) AS dst FROM {nation}
      UNION ALL SELECT 'N:' || CAST(c_nationkey AS STRING), 'C:' || CAST(c_custkey AS STRING) FROM {customer}
      UNION ALL SELECT 'C:' || CAST(o_custkey AS STRING), 'O:' || CAST(o_orderkey AS STRING) FROM {orders}
      UNION ALL SELECT 'O:' || CAST(l_orderkey AS STRING), 'P:' || CAST(l_partkey AS STRING) FROM {lineitem}""",
    # A cyclic graph over nations.
    "ring": """
      SELECT CAST(n_nationkey AS STRING) AS src, CAST((n_nationkey * 7 + 3) % 25 AS STRING) AS dst FROM {nation}
      UNION ALL SELECT CAST(n_nationkey AS STRING), CAST(n_regionkey AS STRING) FROM {nation}""",
    # Class hierarchy: base -> subclass.
    "hierarchy": """
      SELECT r_name AS src, n_name AS dst FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
      UNION ALL SELECT n_name, s_name FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    # Call edges from two contributors.
    "site_edges": """
      SELECT 'o' || CAST(l_orderkey AS STRING) AS caller, 'p' || CAST(l_partkey AS STRING) AS callee,
             'f' || CAST(l_orderkey % 10 AS STRING) || '.py' AS file, CAST(floor(l_linenumber / 3) AS BIGINT) AS line,
             CASE WHEN l_linestatus = 'O' THEN 'AST' ELSE 'HIERARCHY' END AS source, CAST(l_quantity AS BIGINT) AS n_arguments
      FROM {lineitem}""",
    # Value flow: consecutive lines of an order hand on from supplier to supplier.
    "flow_edges": """
      SELECT * FROM (
        SELECT 's' || CAST(l_suppkey AS STRING) AS source_expr,
               's' || CAST(lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS STRING) AS target_expr,
               CASE l_returnflag WHEN 'A' THEN 'assign' WHEN 'R' THEN 'argument' END AS kind,
               'o' || CAST(l_orderkey AS STRING) AS fn
        FROM {lineitem}) t
      WHERE target_expr IS NOT NULL""",
    # Control flow: a user's event types of a day, from a start to an exit.
    "control": """
      SELECT graph, coalesce(lag(event_type) OVER (PARTITION BY graph ORDER BY ts, event_id), 'start') AS src, event_type AS dst
      FROM (SELECT *, CAST(user_id AS STRING) || ':' || CAST(CAST(ts AS DATE) AS STRING) AS graph FROM {events}) a
      UNION ALL
      SELECT graph, event_type, 'exit' FROM (
        SELECT graph, event_type, row_number() OVER (PARTITION BY graph ORDER BY ts DESC, event_id DESC) AS k
        FROM (SELECT *, CAST(user_id AS STRING) || ':' || CAST(CAST(ts AS DATE) AS STRING) AS graph FROM {events}) b) c
      WHERE k = 1""",
    # Detector output.
    "hits": """
      SELECT l_orderkey * 100 + l_linenumber AS ord, 'big-discount' AS rule_id, CASE WHEN l_tax > 0.06 THEN 'high' WHEN l_tax > 0.03 THEN 'medium' ELSE 'low' END AS severity,
             'f' || CAST(l_suppkey AS STRING) || '.py' AS file, CAST(l_linenumber AS BIGINT) AS line, 'o' || CAST(l_orderkey AS STRING) AS endpoint,
             l_returnflag AS summary, 'f' || CAST(l_suppkey AS STRING) || '.py:' || CAST(l_linenumber AS STRING) AS evidence
      FROM {lineitem} WHERE l_discount >= 0.08
      UNION ALL
      SELECT o_orderkey, 'Open-Urgent', 'critical', 'c' || CAST(o_custkey AS STRING) || '.py', CAST(1 AS BIGINT), 'c' || CAST(o_custkey AS STRING),
             o_orderstatus, 'c' || CAST(o_custkey AS STRING) || '.py:1'
      FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'""",
}


def sql_of(view: str) -> str:
    """The view for DuckDB, where the driver's tables have their own names."""
    return "(" + VIEWS[view].format(**{t: t for t in TABLES}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder; only the tables it names are read."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
