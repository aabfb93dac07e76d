"""A corpus pipeline over ``documents``: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All stages but the last
return the columns of ``documents``. Edge cases are those of the operators: null texts count as empty, empty
tables pass through. SQL cannot state the stages; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, langid, near_dedup, packing, pii
from factloom.llm.common import Scratch, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pieces of at most so many rows' decisions are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own, saved with them: ids may be null or repeat."""
    return scratch.save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_number")))


def _without(rows: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose number is not among those dropped; the list's size decides how it is sent."""
    dropped = scratch.save(dropped.select("_number"))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "_number", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, or without any letter. ``lang`` becomes the predicted one.

    The model learns from the labelled rows of the stage's own input. Doubtful documents stay: a low score alone
    is no reason to lose clean text.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.predict(docs, model, carry=("lang", "source", "n_chars"))
    found = found.where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest original of each group of texts equal without white space, then the smallest id."""
    scratch = Scratch(spark, "exact-copies")
    rows = _numbered(docs, scratch)
    return _without(rows, exact_dedup.exact_dedup(rows, carry=("_number",)).where("NOT kept"), scratch)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of five-word shingle sets linked at a similarity of 0.8.

    Each row is a document, whatever its id; a null id comes last.
    """
    scratch = Scratch(spark, "near-copies")
    rows = _numbered(docs, scratch)
    linked = near_dedup.near_dedup(rows, key="_number", words=5, percent=80).where("NOT kept").select("_number", "component_id")
    linked = scratch.save(linked)
    members = linked.union(linked.select(F.col("component_id").alias("_number"), "component_id").distinct())
    members = scratch.save(members.join(rows.select("_number", "doc_id"), "_number"))
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_number"))["_number"].alias("_best"))
    return _without(rows, members.join(best, "component_id").where("_number != _best"), scratch)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind in angle brackets; ``n_chars`` follows the new text."""
    found = pii.find_pii(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [
    ("language", language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written to the shared folder before the next reads them."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
