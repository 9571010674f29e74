"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns up to it as text, and only that reply under the loss mask. Turns after the
last reply form one more example without a mask, so that the output holds every turn. A turn is written as

    <|role|>NEWLINE text <|end|>NEWLINE

Control strings inside roles and texts are broken by a backslash after their first character, and backslashes are doubled, so
the marks are unambiguous and the texts come back exactly.

An example repeats its context, so the output of one conversation grows with the square of its number of turns: this is what
the expansion means. One conversation is one row while it is built.

Defined cases: null role or text is empty; null ``turn`` sorts first, ties by role then text; repeated rows are turns of their own;
rows with null ``conv_id`` form one conversation; an empty table gives no rows; columns besides the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder

TRAINED_ROLE = "assistant"
END = "<|end|>\n"
# Strings that must not stand in a text as they are: this template's marks and those of other common ones.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_examples(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_length, is_last``; the mask counts code points from 0."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    built = grouped.select(
        "conv_id",
        F.size("turns").alias("n"),
        F.transform("turns", lambda t: t["role"] == F.lit(trained_role)).alias("trained"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("text_chars"),
        F.transform("turns", lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>\n"), escaped(t["text"]), F.lit(END))).alias("pieces"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trained", i) | (i == F.col("n")))
    examples = built.select("*", F.posexplode(ends).alias("example", "end")).select(
        "conv_id",
        "example",
        F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "").alias("formatted"),
        F.element_at("trained", F.col("end")).alias("masked"),
        F.element_at("text_chars", F.col("end")).alias("chars"),
        (F.col("end") == F.col("n")).alias("is_last"),
    )
    return examples.select(
        "conv_id",
        "example",
        "formatted",
        (F.length("formatted") - len(END) - F.when(F.col("masked"), F.col("chars")).otherwise(-len(END))).alias("loss_start"),
        F.when(F.col("masked"), F.col("chars")).otherwise(0).alias("loss_length"),
        "is_last",
    )


def write_examples(examples: DataFrame, folder: str) -> None:
    examples.write.mode("overwrite").parquet(folder)


def turns_in(formatted: Column) -> Column:
    """The turns of a formatted text, as ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"),
            unescaped(F.regexp_replace(p, r"(?s)^<\|.*?\|>\n", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescaped(F.substring(formatted, start + 1, length))


def read_back(spark, folder: str) -> DataFrame:
    """What the written examples say of each conversation."""
    written = spark.read.parquet(folder)
    per_conversation = written.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("formatted"))).alias("whole"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("said")))),
                lambda e: e["said"],
            ),
            "",
        ).alias("said"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = per_conversation.withColumn("turns", turns_in(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def round_trip(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    folder = new_folder(spark, "chat-examples")
    write_examples(prefix_examples(conversations), folder)
    return read_back(spark, folder)
