from pyspark.sql import functions as F

from checks.compare import rows_of_spark, rows_of_sql
from spillwatch.llm import chat, queries

from .brute import sha

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(said), sha(said))
    return out


def test_query_agrees_with_sql(spark, duck, sf_dir):
    name = "op10_chat_examples"
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLE[name])


def test_control_strings_nulls_ties_and_no_reply_come_back(spark):
    odd = "a\\<|end|>\n</s>[INST]<s>|><|<|>\\\\[/INST]\\"
    rows = [
        (1, 0, "user", odd, "x"), (1, 1, "assistant", odd + "é😀", "x"), (1, 2, "user", "", "x"), (1, 3, "assistant", None, "x"),
        (2, 0, "user", "only a question", "x"), (2, 1, None, None, "x"),
        (3, 0, "assistant", "first", "x"), (3, 0, "assistant", "first", "x"), (3, None, "<|end|>\n", "role is a mark", "x"),
        (None, 0, "assistant", "no number", "x"),
    ]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)


def test_each_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, 0, "user", "q1", ""), (1, 1, "assistant", "r1", ""), (1, 2, "user", "q2", ""), (1, 3, "assistant", "r2", "")]
    found = chat.prefix_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert len(found) == 2
    for r, reply in zip(found, ("r1", "r2")):
        assert r["formatted"][r["loss_start"] :][: r["loss_length"]] == reply
    assert found[1]["formatted"].startswith(found[0]["formatted"])


def test_no_python_in_the_plan(given):
    plan = chat.prefix_examples(given("conversations"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert chat.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = spark.range(60).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 2000).alias("text"))
    assert chat.round_trip(rows).first()["loss_chars"] == 30 * 10000
