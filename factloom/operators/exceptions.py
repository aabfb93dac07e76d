"""Exception regions: what happens in a try body and in its handlers, and which of them guard or swallow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the name of what a handler calls, in the order in which they decide, and the denial they make.
CALL_WORDS = (("abort", "abort"), ("redirect", "redirect"), ("raise", "raise"), ("exception", "raise"), ("return", "return_error"))
#: Words that show a raise where no call has one of the above.
RAISE_WORDS = ("raise", "HTTPException", "Forbidden", "Unauthorized")


def region_blocks(regions: DataFrame) -> DataFrame:
    """``graph``, ``region``, ``handler`` (null in the try body), ``block``.

    regions: ``graph``, ``region``, ``try_blocks array``, ``handlers array`` of entry blocks.
    """
    body = regions.select("graph", "region", F.lit(None).cast(regions.schema["handlers"].dataType.elementType).alias("handler"), F.explode("try_blocks").alias("block"))
    return body.union(regions.select("graph", "region", F.explode("handlers").alias("handler"), F.col("handler").alias("block")))


def call_denial(target: Column) -> Column:
    """Denial that a called name shows; null without one."""
    text = F.lower(target)
    return reduce(lambda c, w: c.when(text.contains(w[0]), w[1]), CALL_WORDS[1:], F.when(text.contains(CALL_WORDS[0][0]), CALL_WORDS[0][1]))


def denials(blocks: DataFrame, calls: DataFrame, effects: DataFrame) -> DataFrame:
    """``graph``, ``region``, ``handler``, ``denial`` of handlers that deny: a response written, else the first call that shows one.

    blocks: rows of ``region_blocks``; calls: ``graph``, ``block``, ``ord``, ``target``; effects: ``graph``, ``block``, ``category``.
    """
    handlers = blocks.where("handler IS NOT NULL")
    answered = handlers.join(effects.where("category = 'response_write'"), ["graph", "block"], "left_semi").select("graph", "region", "handler", F.lit("return_error").alias("denial"), F.lit(0).alias("_rank"), F.lit(0).cast("bigint").alias("_ord"))
    placed = handlers.join(calls, ["graph", "block"])
    spoken = placed.select("graph", "region", "handler", call_denial(F.col("target")).alias("denial"), F.lit(1).alias("_rank"), F.col("ord").cast("bigint").alias("_ord")).where("denial IS NOT NULL")
    raised = reduce(Column.__or__, (F.col("target").contains(w) for w in RAISE_WORDS))
    late = placed.where(raised).select("graph", "region", "handler", F.lit("raise").alias("denial"), F.lit(2).alias("_rank"), F.col("ord").cast("bigint").alias("_ord"))
    best = answered.union(spoken).union(late).groupBy("graph", "region", "handler").agg(F.min(F.struct("_rank", "_ord", "denial")).getField("denial").alias("denial"))
    return best


def last_of(rows: DataFrame, key: list[str], order: str, what: str) -> DataFrame:
    """``key``, ``what``: the last row's value of each key."""
    return rows.groupBy(*key).agg(F.max(F.struct(order, what)).getField(what).alias(what))


def first_of(rows: DataFrame, key: list[str], order: str, what: str) -> DataFrame:
    """``key``, ``what``: the first row's value of each key."""
    return rows.groupBy(*key).agg(F.min(F.struct(order, what)).getField(what).alias(what))


def exception_guards(blocks: DataFrame, calls: DataFrame, denied: DataFrame) -> DataFrame:
    """``graph``, ``region``, ``handler``, ``guarded_call``, ``denial``: handlers that deny, with the last call of their try body.

    A try body without a call guards nothing. denied: rows of ``denials``.
    """
    body = blocks.where("handler IS NULL").drop("handler").join(calls, ["graph", "block"])
    last = last_of(body, ["graph", "region"], "ord", "target").withColumnRenamed("target", "guarded_call")
    return denied.join(last, ["graph", "region"]).select("graph", "region", "handler", "guarded_call", "denial")


def swallowed_rejections(blocks: DataFrame, raises: DataFrame, denied: DataFrame) -> DataFrame:
    """``graph``, ``region``, ``handler``, ``rejection``: handlers that neither deny nor raise again though their try body raises; the
    rejection is the first raise there.

    raises: ``graph``, ``block``, ``ord``, ``what``; denied: rows of ``denials``.
    """
    inside = blocks.where("handler IS NULL").drop("handler").join(raises, ["graph", "block"])
    first = first_of(inside, ["graph", "region"], "ord", "what").withColumnRenamed("what", "rejection")
    handlers = blocks.where("handler IS NOT NULL").select("graph", "region", "handler", "block").distinct()
    silent = handlers.join(denied, ["graph", "region", "handler"], "left_anti").join(raises.select("graph", "block"), ["graph", "block"], "left_anti")
    return silent.join(first, ["graph", "region"]).select("graph", "region", "handler", "rejection")
