"""Secret matching: screen, match, filter, dedupe.

``files`` always has ``file`` and ``content``; one row is one file, and stays one until values exist: the rules that can
match it are an array next to the text, and the matching is one expression over both. What leaves the scan stage is one small row
per match, so every shuffle is as big as the matches and not as big as the text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.screen import text_screen
from ..functions.text import detector_label, distinct_values, first_line, is_false_positive, mask_value, shannon_entropy
from ..rules import RuleSet
from ..rules.ruleset import MAX_BROADCAST_BYTES, rule_array, rule_labels
from ..shipping import ship_package


def candidates(
    files: DataFrame, rules: RuleSet, keyword_only: bool = False, strict_keyword_case: bool = False
) -> DataFrame:
    """Files, still one row each, with the rules that can match them in ``rules``."""
    ship_package(files.sparkSession)
    content, parts = F.col("content"), []
    for part in rules.slices():
        place = {row["ord"]: k for k, row in enumerate(part.rows, 1)}

        def places(chosen: RuleSet, fold: bool, strict: bool = False) -> Column:
            spec = chosen.screen_spec(keyword_only, strict)
            return text_screen(content, tuple((place[number], sets, run) for number, sets, run in spec), fold)

        if strict_keyword_case:
            # Keywords are compared as written, what other rules need in any case.
            other = part.where(lambda rule: not rule["indexed"])
            found = places(part.indexed(), False, True)
            found = F.concat(found, places(other, True)) if len(other) else found
        else:
            found = places(part, True)
        own = rule_array(part)
        parts.append(F.transform(found, lambda k: F.element_at(own, k)))
    # No filter on the rules here: it would move below and run the screen twice. A file without rules leaves no rows later.
    return files.withColumn("rules", F.concat(*parts))


def prefilter(files: DataFrame, rules: RuleSet, strict_keyword_case: bool = False) -> DataFrame:
    """``(file, ord)``: the indexed rules whose keyword occurs in a file."""
    found = candidates(files, rules.indexed(), keyword_only=True, strict_keyword_case=strict_keyword_case)
    return found.select("file", F.explode("rules.ord").alias("ord"))


def _values_of(content: Column, rule: Column) -> Column:
    values = F.regexp_extract_all(content, rule["java_regex"], F.lit(0))
    return F.when(rule["java_guard"].isNull(), values).when(F.rlike(content, rule["java_guard"]), values)


def match_rules(found: DataFrame) -> DataFrame:
    """``(file, ord, pos, value)``: all non-overlapping whole matches of each candidate rule."""
    content = F.col("content")
    each = F.transform("rules", lambda r: F.struct(r["ord"].alias("ord"), _values_of(content, r).alias("found")))
    matched = found.select("file", F.explode(F.filter(each, lambda m: F.size(m["found"]) > 0)).alias("m"))
    return matched.select("file", "m.ord", F.posexplode("m.found").alias("pos", "value"))


RULE_COLUMNS = ["rank", "entropy_check", "min_entropy", "min_length", "max_length", "context_keywords"]


def matches_of_row(content: Column, rules: Column) -> Column:
    """An array of the distinct values of each rule with their lines, and what the filters need of the rule."""

    def of_rule(r):
        named = [r[name].alias(name) for name in RULE_COLUMNS]
        return F.transform(distinct_values(_values_of(content, r)), lambda v: F.struct(*named, v.alias("value"), first_line(content, v).alias("line")))

    # A rule whose guard fails has no list at all.
    return F.flatten(F.filter(F.transform(rules, of_rule), lambda found: found.isNotNull()))


def distinct_matches(found: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """One row per candidate rule and distinct value, with its line; the text is gone from here on."""
    return found.select("file", *keep, F.inline(matches_of_row(F.col("content"), F.col("rules"))))


def min_entropy_active(entropy_check: Column, min_entropy: Column) -> Column:
    """The entropy test counts only with a positive floor."""
    return F.coalesce(entropy_check, F.lit(False)) & (F.coalesce(min_entropy, F.lit(0.0)) > 0)


def entropy_filter(matches: DataFrame) -> DataFrame:
    """Drop matches less random than their rule demands."""
    active = min_entropy_active(F.col("entropy_check"), F.col("min_entropy"))
    return matches.where(F.when(active, shannon_entropy(F.col("value")) >= F.col("min_entropy")).otherwise(True))


def false_positive_filter(matches: DataFrame, deny: Iterable[str] | None = None) -> DataFrame:
    return matches.where(~is_false_positive(F.col("value"), deny))


def enforce_rule_bounds(matches: DataFrame) -> DataFrame:
    """Apply the declared lengths and context words of the rules (not part of the default scan)."""
    value = F.col("value")
    longest = F.when(F.col("max_length") > 0, F.col("max_length")).otherwise(F.lit(2**31 - 1))
    context = (F.size("context_keywords") == 0) | F.exists(
        "context_keywords", lambda word: F.contains(F.lower(value), F.lower(word))
    )
    return matches.where(F.length(value).between(F.col("min_length"), longest) & context)


def dedupe_matches(matches: DataFrame) -> DataFrame:
    """One row per (file, value): the rule with the lowest rank names it.

    Repeats are folded before the shuffle, so a value found very often moves once per task.
    """
    return matches.groupBy("file", "value").agg(F.min("rank").alias("rank"), F.min("line").alias("line"))


def label_findings(firsts: DataFrame, rules: RuleSet, mask_values: bool = False) -> DataFrame:
    """Findings in their published form."""
    labels = rule_labels(rules, firsts.sparkSession)
    joined = firsts.join(F.broadcast(labels) if rules.nbytes <= MAX_BROADCAST_BYTES else labels, "rank")
    value = F.col("value")
    return joined.select(
        "rule_id",
        "type",
        (mask_value(value) if mask_values else value).alias("value"),
        "file",
        "line",
        detector_label(F.col("severity")).alias("detector"),
        "severity",
        "confidence",
        "tags",
    )
