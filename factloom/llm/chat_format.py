"""Chat formatting in Spark expressions: turns are collected as structs, sorted, adjacent turns of one role
merged with array functions, and concatenated.

Template: ``<|turn|>role<|body|>text<|end|>``; further texts of a merged turn follow ``<|next|>``. All control
strings begin with ``<|``; within roles and texts ``<|`` is written ``<||``, which no control string contains,
so that reading back is exact. The loss mask is a run-length list of segments over the formatted string, in
code points; a segment with ``loss`` is the (escaped) text of one assistant turn and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
TURN, BODY, NEXT, END = "<|turn|>", "<|body|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``segments array<struct<length int, loss boolean>>``.

    Null texts and null roles count as empty, null turns come first; equal turn numbers go by role, then text,
    and repeated rows stay. Rows with a null conversation id form one conversation. A conversation becomes one
    string, so its rows meet in one task by nature; only the four columns are read and shuffled.
    """
    t = F.struct(F.col(turn).alias("n"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    turns = df.select(F.col(conv).alias("_conv"), t.alias("_t")).groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    at = lambda i: F.col("_turns")[i]
    starts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (at(i)["role"] != F.get("_turns", i - 1)["role"]))
    merged = turns.withColumn("_starts", starts)

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_turns"))
        return F.struct(at(start)["role"].alias("role"), F.transform(F.slice("_turns", start + 1, end - start), lambda x: x["text"]).alias("texts"))

    merged = merged.select("_conv", F.transform("_starts", block).alias("_blocks"))
    whole = F.transform("_blocks", lambda b: F.concat(F.lit(TURN), b["role"], F.lit(BODY), F.array_join(b["texts"], NEXT), F.lit(END)))

    def segment(length: Column | int, loss: Column | bool) -> Column:
        length = length if isinstance(length, Column) else F.lit(length)
        return F.struct(length.cast("int").alias("length"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    def segments(b: Column) -> Column:
        head = segment(F.char_length(b["role"]) + len(TURN) + len(BODY), False)
        texts = F.transform(b["texts"], lambda x: F.array(segment(F.char_length(x), b["role"] == train_on), segment(len(NEXT), False)))
        flat = F.flatten(texts)
        return F.concat(F.array(head), F.slice(flat, 1, F.size(flat) - 1), F.array(segment(len(END), False)))

    return merged.select(F.col("_conv").alias(conv), F.array_join(whole, "").alias("formatted"), F.flatten(F.transform("_blocks", segments)).alias("segments"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: ``array<struct<role string, text string>>``."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def turns(b: Column) -> Column:
        parts = F.split(b, r"<\|body\|>")
        body = F.split(F.regexp_replace(parts[1], r"<\|end\|>$", ""), r"<\|next\|>")
        return F.transform(body, lambda x: F.struct(unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: Segments whose lengths are added up one by one; the sums of so many are added up in turn.
RUN = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def text_under_mask(formatted: Column, segments: Column) -> Column:
    """The unescaped texts that count for the loss, one after another.

    Four bytes a code point make any place of the string known without a walk from its start, and segments' starts
    are sums of runs' sums, so time grows with the text, and with the number of segments times ``RUN``. A string of more
    than 2**29 code points is too long.
    """
    total = lambda of, length: F.aggregate(of, F.lit(0), lambda n, x: n + length(x))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(segments) / RUN), F.lit(1)).cast("int") - 1), lambda r: F.slice(segments, r * RUN + 1, F.lit(RUN)))
    mark = F.unhex(F.lit("0000FEFF"))  # read as the byte order, so that a text may begin with this code point itself

    def piece(units: Column, at: Column, n: Column) -> Column:
        return unescape(F.decode(F.concat(mark, F.substring(units, 4 * at + 1, 4 * n)), "UTF-32"))

    def texts(units: Column, run: Column, start: Column) -> Column:
        def text(s: Column, i: Column) -> Column:
            own = start + total(F.slice(run, F.lit(1), i), lambda x: x["length"])
            return F.when(s["loss"], piece(units, own, s["length"])).otherwise(F.lit(""))

        return F.array_join(F.transform(run, text), "")

    def all_texts(units: Column, runs: Column, sums: Column) -> Column:
        of_run = lambda run, r: _bound(total(F.slice(sums, F.lit(1), r), lambda n: n), lambda start: texts(units, run, start))
        return F.array_join(F.transform(runs, of_run), "")

    def of_runs(units: Column, runs: Column) -> Column:
        return _bound(F.transform(runs, lambda run: total(run, lambda x: x["length"])), lambda sums: all_texts(units, runs, sums))

    return _bound(F.encode(formatted, "UTF-32"), lambda units: _bound(runs, lambda rs: of_runs(units, rs)))
