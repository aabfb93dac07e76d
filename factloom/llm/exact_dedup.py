"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text, without its white space, is cut into chunks where its own content says so: after at least
``MIN_CHUNK`` code points, at the next boundary character, or at ``MAX_CHUNK``. Each chunk is named by a
64-bit hash; a name is verified by holding all distinct chunks that bear it against each other, and chunks
that only share the hash get an ordinal as well. A document becomes its recipe: the ordered list of verified
identifiers. Equal recipes are equal texts, so documents are compared and moved as a few numbers; of the
texts themselves each distinct chunk moves once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, no_clash, spread_join

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Characters after which a chunk may end.
BOUNDARY = r"[.!?,;:\)]"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks, in order; their concatenation is the text. An empty text has none."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{least - 1},{most - 2}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, then the columns of ``carry``.

    Texts are equal when equal without white space (null: empty). The row with most code points in its
    original text stays, then the smallest key (null keys last). Of rows that
    repeat a key and a text, one is kept. Empty tables give empty results; other columns are not read. A carried column
    must not bear the name of another column of the result.
    ``hash_bits`` below 64 shortens the chunk hashes, so that tests can reach the verification of names.
    """
    short = 64 - hash_bits

    def name(chunk: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(chunk), short) if short else F.xxhash64(chunk)

    no_clash((key, "keep_id", "group_size", "kept", "text_sha256"), carry)
    scratch = Scratch(df.sparkSession, "exact-dedup")
    base = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *(F.col(c).alias(f"_carry_{c}") for c in carry)).withColumn("_norm", normalised(F.col("_text")))
    cut = chunks(F.col("_norm"))
    # Verification: of each name the distinct chunks (combined before the shuffle); more than one is a collision.
    distinct = base.select(F.explode(cut).alias("_chunk")).select(name("_chunk").alias("_name"), "_chunk").groupBy("_name", "_chunk").agg(F.lit(1).alias("_one"))
    collided = scratch.save(distinct.groupBy("_name").agg(F.sum("_one").alias("_n")).where("_n > 1").select("_name"))
    collisions = not collided.isEmpty()
    # One evaluation numbers the rows; where names collide it keeps the chunks as well.
    recipes = scratch.save(
        base.select(
            F.monotonically_increasing_id().alias("_row"),
            "_id",
            F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_points"),
            F.sha2("_norm", 256).alias("text_sha256"),
            F.transform(cut, name).alias("_recipe"),
            *(f"_carry_{c}" for c in carry),
            *([cut.alias("_cut")] if collisions else []),
        )
    )
    if collisions:
        recipes = scratch.save(_disambiguated(recipes, collided, name))
    else:
        recipes = recipes.withColumn("_ordinals", F.array().cast("array<struct<_at:int,_ordinal:int>>"))
    # Lists are compared as lists, once; a row then finds its group by the digest of its list.
    recipes = recipes.withColumn("_list", F.unhex(F.sha2(F.to_json(F.struct("_recipe", "_ordinals")), 256)))
    best = F.min(F.struct(-F.col("_points"), F.col("_id").isNull().alias("_null"), F.col("_id"), F.col("_row")))
    groups = recipes.groupBy("_list", "_recipe", "_ordinals").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
    several = groups.where("group_size > 1").select("_list", F.col("_best._id").alias("_best_id"), F.col("_best._row").alias("_best_row"), "group_size", F.col("group_size").alias("_copies"))
    rows = recipes.drop("_recipe", "_ordinals", "_points")
    out = spread_join(rows, scratch.save(several), "_list", recipes.count(), "left")
    alone = F.col("_best_row").isNull()
    return out.select(
        F.col("_id").alias(key),
        F.when(alone, F.col("_id")).otherwise(F.col("_best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_best_row"))).alias("kept"),
        "text_sha256",
        *(F.col(f"_carry_{c}").alias(c) for c in carry),
    )


def _disambiguated(recipes: DataFrame, collided: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """Recipes with the ordinals of those chunks whose name other chunks bear too; rare, as names have 64 bits."""
    pieces = recipes.select("_row", F.posexplode("_cut").alias("_at", "_chunk"))
    pieces = pieces.withColumn("_name", name(F.col("_chunk"))).join(collided, "_name", "left_semi")
    ordinal = F.row_number().over(Window.partitionBy("_name").orderBy("_chunk"))
    verified = pieces.select("_name", "_chunk").distinct().withColumn("_ordinal", ordinal)
    found = pieces.join(verified, ["_name", "_chunk"]).groupBy("_row")
    found = found.agg(F.sort_array(F.collect_list(F.struct("_at", "_ordinal"))).alias("_ordinals"))
    none = F.array().cast("array<struct<_at:int,_ordinal:int>>")
    return recipes.drop("_cut").join(found, "_row", "left").withColumn("_ordinals", F.coalesce("_ordinals", none))
