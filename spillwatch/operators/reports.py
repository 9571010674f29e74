"""Summaries of findings, endpoints and fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fetch import fetch_outcome, is_fetched
from .settle import settle

# The sections of the reports, in order.
REFERENCE_DETECTORS = (
    "Template (critical)",
    "Template (high)",
    "Template (medium)",
    "Regex (Vendor)",
    "Regex (Entropy)",
    "Entropy (Pure)",
    "gitleaks",
    "jsluice",
    "trufflehog",
)
ENDPOINT_SOURCES = ("Regex", "LinkFinder")
# Low findings are counted in every total, so the default report shows them too.
DETECTORS = (*REFERENCE_DETECTORS[:3], "Template (low)", *REFERENCE_DETECTORS[3:])


def _ordered(spark, names, column: str) -> DataFrame:
    """A handful of section names with their positions."""
    return F.broadcast(spark.createDataFrame([(name, i) for i, name in enumerate(names, 1)], f"{column} string, pos int"))


def detector_order(report_order: str = "full") -> tuple[str, ...]:
    """``full``, or ``reference`` without the low-severity section."""
    return {"full": DETECTORS, "reference": REFERENCE_DETECTORS}[report_order]


def findings_by_detector(secrets: DataFrame, report_order: str = "full") -> DataFrame:
    """``(detector, pos, findings)`` for every section, also those with none.

    In ``full`` order detectors outside the fixed list follow it, by name, so the sections add up to the total.
    """
    sections = _ordered(secrets.sparkSession, detector_order(report_order), "detector")
    counts = secrets.groupBy("detector").agg(F.count("*").alias("n"))
    joined = sections.join(counts, "detector", "left").select("detector", "pos", F.coalesce("n", F.lit(0)).alias("findings"))
    return joined if report_order == "reference" else joined.unionByName(_others(counts.withColumnRenamed("n", "findings"), sections, "detector"))


def _others(counts: DataFrame, sections: DataFrame, column: str) -> DataFrame:
    """Counts outside the fixed sections, placed behind them by name: a row per detector or source."""
    other = counts.join(sections, column, "left_anti")
    last = sections.agg(F.max("pos")).scalar()
    return other.select(column, (last + F.row_number().over(Window.orderBy(column))).alias("pos"), *(c for c in counts.columns if c != column))


def number_findings(secrets: DataFrame) -> DataFrame:
    """Number the findings 1..n within each detector, by file, line, value and rule.

    There are few detectors and one may hold most rows, so the numbering goes over range
    partitions of the whole table and each detector's first position is taken off.
    """
    from .url_lists import with_position

    placed = with_position(secrets, "detector", "file", "line", "value", "rule_id", name="_position")
    first = placed.groupBy("detector").agg(F.min("_position").alias("_first"))
    joined = placed.join(F.broadcast(first), "detector")  # a row per detector
    return joined.select(*secrets.columns, (F.col("_position") - F.col("_first") + 1).alias("number"))


def endpoints_by_source(endpoints: DataFrame) -> DataFrame:
    """``(source, pos, endpoints)`` for the sources that found something, the known ones first."""
    sections = _ordered(endpoints.sparkSession, ENDPOINT_SOURCES, "source")
    counts = endpoints.groupBy("source").agg(F.count("*").alias("endpoints"))
    return counts.join(sections, "source").select("source", "pos", "endpoints").unionByName(_others(counts, sections, "source"))


def distinct_paths_by_source(endpoints: DataFrame) -> DataFrame:
    """``(source, path, file)``: each path once per source, with the first file that has it."""
    return endpoints.groupBy("source", "path").agg(F.min("file").alias("file"))


def findings_total(secrets: DataFrame) -> DataFrame:
    return secrets.agg(F.count("*").alias("total"))


def fetch_stats(log: DataFrame) -> DataFrame:
    """One row over a fetch log ``(url_id, status, bytes, attempt)``; a retry is neither success nor failure yet."""
    outcome = fetch_outcome(F.col("status"), F.col("bytes"), F.col("attempt"))
    judged = log.select("bytes", outcome.alias("outcome")).where(F.col("outcome") != "retry")
    fetched = is_fetched(F.col("outcome"))
    # A response that says "not modified" brought no bytes.
    size = F.when(F.col("outcome") == "success", F.col("bytes")).otherwise(F.lit(0))
    return judged.agg(
        F.count("*").alias("total"),
        F.count_if(fetched).alias("success"),
        F.count_if(~fetched).alias("failed"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
    )


# ------------------------------------------------------------------- text reports

RULE_LINE, SECTION_LINE = "=" * 80, "-" * 80


def _lines(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys, F.posexplode("lines").alias("at", "line"))


def render_secret_report(secrets: DataFrame, report_order: str = "full") -> DataFrame:
    """``(section, item, at, line)``: the text report, to be read in that order.

    Only ``write_report`` sorts it, and it does so by range, so no task holds the whole report.
    """
    secrets = settle(secrets)  # read three times below; without this the texts would be scanned three times
    counts = findings_by_detector(secrets, report_order)
    total = findings_total(secrets).select(
        F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("item"),
        F.array(
            F.lit(RULE_LINE),
            F.lit("SECRET DETECTION REPORT"),
            F.lit(RULE_LINE),
            F.lit(""),
            F.format_string("Total Secrets Found: %d", "total"),
            F.lit(""),
        ).alias("lines"),
    )
    nothing = F.when(F.col("findings") == 0, F.array(F.lit("  No findings from this detector."), F.lit("")))
    headers = counts.select(
        F.col("pos").alias("section"),
        F.lit(0).cast("bigint").alias("item"),
        F.concat(
            F.array(
                F.lit(SECTION_LINE),
                F.format_string("DETECTOR: %s (%d findings)", F.upper("detector"), "findings"),
                F.lit(SECTION_LINE),
                F.lit(""),
            ),
            F.coalesce(nothing, F.array().cast("array<string>")),
        ).alias("lines"),
    )
    sections = F.broadcast(counts.select("detector", "pos"))
    items = number_findings(secrets).join(sections, "detector").select(
        F.col("pos").alias("section"),
        F.col("number").alias("item"),
        F.array(
            F.format_string("[Finding #%d]", "number"),
            F.concat(F.lit("  File: "), "file"),
            F.concat(F.lit("  Type: "), "type"),
            F.concat(F.lit("  Line: "), F.col("line").cast("string")),
            F.concat(F.lit("  Secret: "), "value"),
            F.lit(""),
        ).alias("lines"),
    )
    return _lines(total.unionByName(headers).unionByName(items), "section", "item")


def render_endpoint_report(endpoints: DataFrame) -> DataFrame:
    """``(section, item, at, line)``; within a section the paths are in order of path."""
    endpoints = settle(endpoints)
    total = endpoints.agg(F.count("*").alias("total")).select(
        F.lit(0).alias("section"),
        F.lit("").alias("item"),
        F.array(
            F.lit(RULE_LINE),
            F.lit("API ENDPOINTS REPORT"),
            F.lit(RULE_LINE),
            F.lit(""),
            F.format_string("Total endpoints found: %d", "total"),
            F.lit(""),
        ).alias("lines"),
    )
    headers = endpoints_by_source(endpoints).select(
        F.col("pos").alias("section"),
        F.lit("").alias("item"),
        F.array(
            F.lit(SECTION_LINE),
            F.format_string("SOURCE: %s (%d endpoints)", F.upper("source"), "endpoints"),
            F.lit(SECTION_LINE),
            F.lit(""),
        ).alias("lines"),
    )
    sections = F.broadcast(endpoints_by_source(endpoints).select("source", "pos"))
    items = distinct_paths_by_source(endpoints).join(sections, "source").select(
        F.col("pos").alias("section"), F.col("path").alias("item"), F.array("path").alias("lines")
    )
    return _lines(total.unionByName(headers).unionByName(items), "section", "item")


def scan_metrics(results: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """``(scanner, files, findings)``: one row per scanner."""
    file_count = files.agg(F.count("*")).scalar().alias("files")
    rows = None
    for scanner, found in results.items():
        one = found.agg(F.count("*").alias("findings")).select(F.lit(scanner).alias("scanner"), "findings")
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("scanner", file_count, "findings")
