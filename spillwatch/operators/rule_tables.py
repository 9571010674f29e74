"""Operators over a table of rules of any size (the fields of ``rules.ruleset.RULE_FIELDS``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keywords import is_valid_keyword
from ..rules.dialect import rule_keyword
from ..rules.ruleset import DEFAULT_CONFIDENCE, DEFAULT_SEVERITY


@F.arrow_udf(T.StringType())
def rule_keywords(regex: pa.Array) -> pa.Array:
    """The keyword of each rule's regex; null for none."""
    return pa.array([None if r is None else rule_keyword(r) or None for r in regex.to_pylist()], pa.string())


def rule_defaults(rules: DataFrame) -> DataFrame:
    """Empty severity becomes medium, confidence 0 becomes 75."""
    return rules.withColumns(
        {
            "severity": F.coalesce(F.nullif("severity", F.lit("")), F.lit(DEFAULT_SEVERITY)),
            "confidence": F.coalesce(F.nullif("confidence", F.lit(0)), F.lit(DEFAULT_CONFIDENCE)),
        }
    )


def keyword_rules(rules: DataFrame) -> DataFrame:
    """``(keyword, ord)``: the index. One row per pair and not a list per keyword, which one task would have to hold."""
    return rules.where(is_valid_keyword(F.col("keyword"))).select("keyword", "ord")


def keyword_counts(rules: DataFrame) -> DataFrame:
    """``(keyword, rules, first_ord)``: each usable keyword with the number of its rules and the first of them."""
    return keyword_rules(rules).groupBy("keyword").agg(F.count("*").alias("rules"), F.min("ord").alias("first_ord"))


def fallback_rules(rules: DataFrame) -> DataFrame:
    """Rules without a usable keyword."""
    return rules.where(~is_valid_keyword(F.col("keyword")))


def rule_index_stats(rules: DataFrame) -> DataFrame:
    """One row: indexed rules, unique keywords, fallbacks."""
    usable = is_valid_keyword(F.col("keyword"))
    # Two plain aggregations: a distinct count next to others would expand every row.
    per_keyword = rules.groupBy(F.when(usable, F.col("keyword")).alias("keyword")).agg(F.count("*").alias("n"))
    return per_keyword.agg(
        F.coalesce(F.sum(F.when(F.col("keyword").isNotNull(), F.col("n"))), F.lit(0)).alias("indexed"),
        F.count("keyword").alias("unique_keywords"),
        F.coalesce(F.sum(F.when(F.col("keyword").isNull(), F.col("n"))), F.lit(0)).alias("fallbacks"),
    )


def rules_by_tag(rules: DataFrame, tag: str) -> DataFrame:
    return rules.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def rules_by_severity(rules: DataFrame, severity: str) -> DataFrame:
    return rules.where(F.lower("severity") == severity.lower())


def rule_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("rules"))


def pack_profile(rules: DataFrame) -> DataFrame:
    """Rules per category, provider and severity."""
    return rules.groupBy("category", "provider", "severity").agg(
        F.count("*").alias("rules"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")
    )


def tag_profile(rules: DataFrame) -> DataFrame:
    """Rules per tag."""
    return rules.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("rules"))


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Regexes that several rules share: only the first of those rules can ever report."""
    shared = rules.groupBy("regex").agg(F.count("*").alias("rules"), F.min("ord").alias("first_ord"))
    return shared.where("rules > 1")
