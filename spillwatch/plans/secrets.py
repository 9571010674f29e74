"""Secret scans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import detector_label, is_false_positive
from ..operators import endpoints as e
from ..operators import matching as m
from ..rules import RuleSet, built_in
from ..rules.ruleset import MAX_BROADCAST_BYTES, rule_labels
from .endpoints import METHOD, REGEX_SOURCE

MODES = ("fast", "deep")
# Copies of the findings of one text, so that a text with very many copies is joined by many tasks.
SALTS = 16
SECRETS_IN_ROW = "array<struct<kind:string,rank:bigint,value:string,line:int,entropy_check:boolean,min_entropy:double>>"


def select_rules(rules=None, mode: str = "fast", tag: str | None = None, severity: str | None = None) -> RuleSet:
    """The rules a scan runs: ``fast`` only those with a usable keyword, ``deep`` all of them."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    chosen = built_in() if rules is None else RuleSet.of(rules)
    if tag is not None:
        chosen = chosen.by_tag(tag)
    if severity is not None:
        chosen = chosen.by_severity(severity)
    return chosen.indexed() if mode == "fast" else chosen


def surviving_matches(
    files: DataFrame,
    rules: RuleSet,
    deny: Iterable[str] | None = None,
    enforce_bounds: bool = False,
    strict_keyword_case: bool = False,
) -> DataFrame:
    """Matches that pass the filters, before one rule is chosen per value. No shuffle."""
    found = m.candidates(files.select("file", "content"), rules, strict_keyword_case=strict_keyword_case)
    matches = m.entropy_filter(m.false_positive_filter(m.distinct_matches(found), deny))
    return m.enforce_rule_bounds(matches) if enforce_bounds else matches


def scan_secrets(
    files: DataFrame,
    rules=None,
    mode: str = "fast",
    *,
    tag: str | None = None,
    severity: str | None = None,
    deny: Iterable[str] | None = None,
    enforce_bounds: bool = False,
    strict_keyword_case: bool = False,
    mask_values: bool = False,
    distinct_content: bool = False,
) -> DataFrame:
    """Findings ``(rule_id, type, value, file, line, detector, severity, confidence, tags)``.

    ``files`` has ``file`` and ``content``; ``rules`` is a RuleSet or a DataFrame of rule fields (default: the
    built-in pack). Each value is reported once per file, by the first rule in order that accepts
    it. ``distinct_content`` scans equal texts once, at the price of one shuffle of the text.
    """
    chosen = select_rules(rules, mode, tag, severity)
    if distinct_content:
        firsts = _firsts_of_distinct_content(files, chosen, deny, enforce_bounds, strict_keyword_case)
    else:
        matches = surviving_matches(files, chosen, deny, enforce_bounds, strict_keyword_case)
        firsts = m.dedupe_matches(matches)
    return m.label_findings(firsts, chosen, mask_values)


def _firsts_of_distinct_content(files, rules, deny, enforce_bounds, strict_keyword_case) -> DataFrame:
    keyed = files.select(F.sha2("content", 256).alias("key"), "file", "content")
    texts = keyed.select(F.col("key").alias("file"), "content").dropDuplicates(["file"])
    firsts = m.dedupe_matches(surviving_matches(texts, rules, deny, enforce_bounds, strict_keyword_case))
    salted = firsts.withColumnRenamed("file", "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = keyed.select("key", "file", F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int").alias("salt"))
    return copies.join(salted, ["key", "salt"]).select("file", "value", "rank", "line")


def scan_both(files: DataFrame, rules=None, mode: str = "fast") -> DataFrame:
    """Secrets and endpoints of one input, which is read once: a finding's ``kind`` is ``secret`` or ``endpoint``.

    Columns are those of both scans; a secret's ``value`` is its text and an endpoint's its path, and what the other kind has is null.
    """
    chosen = select_rules(rules, mode)
    content = F.col("content")
    screened = m.candidates(files.select("file", "content"), chosen)
    secrets = F.transform(
        m.matches_of_row(content, F.col("rules")),
        lambda s: F.struct(F.lit("secret").alias("kind"), s["rank"].alias("rank"), s["value"].alias("value"), s["line"].alias("line"),
                           s["entropy_check"].alias("entropy_check"), s["min_entropy"].alias("min_entropy")),
    )
    paths = F.transform(
        F.filter(e.distinct_paths(content), e.is_endpoint),
        lambda p: F.struct(F.lit("endpoint").alias("kind"), F.lit(None).cast("long").alias("rank"), p.alias("value"), F.lit(None).cast("int").alias("line"),
                           F.lit(False).alias("entropy_check"), F.lit(0.0).alias("min_entropy")),
    )
    none = F.array().cast(SECRETS_IN_ROW)
    found = screened.select("file", F.inline(F.concat(F.coalesce(secrets, none), F.coalesce(paths, none))))
    found = m.entropy_filter(found.where((F.col("kind") == "endpoint") | ~is_false_positive(F.col("value"))))
    firsts = found.groupBy("kind", "file", "value").agg(F.min("rank").alias("rank"), F.min("line").alias("line"))
    labels = rule_labels(chosen, files.sparkSession)
    labelled = firsts.join(F.broadcast(labels) if chosen.nbytes <= MAX_BROADCAST_BYTES else labels, "rank", "left")
    endpoint = F.col("kind") == "endpoint"
    return labelled.select(
        "kind", "rule_id", "type", "value", "file", "line",
        F.when(~endpoint, detector_label(F.col("severity"))).alias("detector"), "severity", "confidence", "tags",
        F.when(endpoint, METHOD).alias("method"), F.when(endpoint, REGEX_SOURCE).alias("source"),
    )
