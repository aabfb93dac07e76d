"""The thin queries on the synthetic tables, one per operator, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat_format, exact_dedup, langid, media, near_dedup, packing, pii, repeats, ring
from .common import Scratch, documents


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings; every column is read back from the formatted string and its mask."""
    own = "SELECT -1L AS conv_id, n AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(n, role)"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    out = chat_format.format_chats(rows)
    turns, loss = chat_format.read_back(F.col("formatted")), chat_format.text_under_mask(F.col("formatted"), F.col("segments"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(role, '<|', '<||') AS er, replace(text, '<|', '<||') AS et,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(length(et) + 8 + CASE WHEN before = role THEN 0 ELSE length(er) + 15 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
# 8: a text is preceded by <|next|> or followed by its block's <|body|>, of 8 code points each; 15: <|turn|> and <|end|>.


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts each text by profiles of the documents that are not held out; a null language teaches nothing."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out), "lang", "text")
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85; null ids are one document that comes last."""
    return near_dedup.near_dedup(documents(spark, sf_dir), words=5, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""


def op4_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text; ``spans`` lists those that the method adds as well, by kind, then start."""
    found = pii.find_pii(documents(spark, sf_dir))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to; a null text has none."""
    coded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts differ by one at most; null ids go by size and text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = ring.shard_by_ring(documents(spark, sf_dir), "doc_id", {"size": size, "text_crc32": crc}, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents, each task its own rows in the order of its input split, so another split packs otherwise."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


def op8_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts equal without white space; a null text is empty, and of equal rows one is kept."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the strings of 100 bytes that start earlier; repeated ids are documents of their own."""
    found = repeats.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as an image, refers to it from a page, and computes features from the image as stored."""
    docs = documents(spark, sf_dir).select("doc_id", media.padded(F.col("text")).alias("payload"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    # Each document is a page with one figure; its caption carries the unpadded length.
    figure = '<article><p>document</p><figure><img src="%s%s"><figcaption>%s bytes</figcaption></figure></article>'
    pages = docs.select("doc_id", F.format_string(figure, F.lit(media.SCHEME), F.sha2("payload", 256), F.col("n")).alias("html"))
    stored = Scratch(spark, "media").save(media.store(docs, unique=False))
    found = media.features(media.sequences(pages, "doc_id"), stored, "doc_id")
    n = F.split("caption", " ")[0].cast("long").alias("n_bytes")
    return found.select("doc_id", n, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op3_chosen_path_near_dedup": OP3_SQL, "op8_chunk_recipe_dedup": OP8_SQL}
