"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. A stage
works on all that the one before it kept. ``run`` writes what a stage returns and reads it again, so every stage is computed once and
survives lost executors.

1. ``quality``: documents that the classifier rejects go; it learns from the labels of ``sf_dir`` that are not held out.
2. ``line_dedup``: repeated long lines go, but for the last document that holds them; ``n_chars`` follows the text.
3. ``near_duplicates``: of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the smallest
   ``doc_id`` stays, once. Texts that share a ``doc_id`` are judged apart. Documents without words stay.
4. ``decontamination``: documents that hold a benchmark item go, by number and text.
5. ``packing``: token sequences, one row per piece.

Null texts are empty texts, rows with null ``doc_id`` stay in stage 3 and are judged like others elsewhere, other columns pass through, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillwatch.llm import decontam, line_dedup, packing, shingle_join
from spillwatch.llm import quality as quality_model
from spillwatch.llm.common import stored, table, text_key

NO_ID = -(2**63)


def _by_key(docs: DataFrame) -> DataFrame:
    """``doc`` and the whole row, so that no column can clash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.struct("*").alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.when(changed, F.col("kept")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars")))
    return kept.select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(shingle_join.linked_texts(docs), "near-duplicates")
    # Of linked texts the one with the least number stays, by its key among texts of that number. Rows without a number stay, and come first.
    first = found.filter("n > 0").groupBy("component").agg(F.min(F.struct("doc", "text_key")).alias("first"))
    first = first.select("first.doc", "first.text_key", F.lit(True).alias("first"))
    each = found.filter(F.col("doc") != NO_ID).groupBy("doc", "text_key").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    judged = each.join(first, ["doc", "text_key"], "left").withColumn("stays", (F.col("n") == 0) | F.col("first").isNotNull())
    judged = stored(judged.select("doc", "text_key", "rows", "n", "stays"), "judged")
    by_doc = judged.groupBy("doc").agg(F.max("stays").alias("some"), F.min("stays").alias("all"))
    gone = stored(by_doc.filter(~F.col("some")).select("doc"), "gone")
    partly = by_doc.filter(F.col("some") & ~F.col("all")).select("doc")
    parts = stored(judged.filter(~F.col("stays")).join(partly, "doc", "left_semi").select("doc", "text_key"), "gone-texts")
    keyed = _by_key(docs).withColumn("text_key", text_key(F.col("row.text")))
    stay = shingle_join.chosen(shingle_join.chosen(keyed, gone, "left_anti"), parts, "left_anti", ["doc", "text_key"])
    # Of rows with the same number and text one stays.
    again = stored(judged.filter("stays and n > 0 and rows > 1").select("doc", "text_key"), "repeated-texts")
    if again.isEmpty():
        return stay.select("row.*")
    single = shingle_join.chosen(stay, again, "left_anti", ["doc", "text_key"])
    several = shingle_join.chosen(stay, again, "inner", ["doc", "text_key"]).groupBy("doc", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.select("row").unionByName(several.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(decontam.contaminated_texts(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    # By number and text: other texts of the number, or without one, are clean.
    gone = stored(found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key").distinct(), "contaminated-texts")
    keyed = _by_key(docs).withColumn("text_key", text_key(F.col("row.text")))
    return shingle_join.chosen(keyed, gone, "left_anti", ["doc", "text_key"]).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

# The classifier, the near-duplicate join, edit distances and the tokenizer have no SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
