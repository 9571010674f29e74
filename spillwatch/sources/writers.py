"""Sinks. All of them append; none overwrites an earlier run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.reports import scan_metrics

REPORT_ORDER = ("section", "item", "at")


def write_findings(findings: DataFrame, path: str) -> None:
    """Parquet, one folder per detector."""
    findings.write.mode("append").partitionBy("detector").parquet(path)


def write_endpoints(endpoints: DataFrame, path: str) -> None:
    endpoints.write.mode("append").partitionBy("source").parquet(path)


def write_urls_by_tool(urls: DataFrame, path: str) -> None:
    """Raw feeds as text, one folder per tool."""
    urls.select("tool", F.col("url").alias("value")).write.mode("append").partitionBy("tool").text(path)


def append_manifest(fetched: DataFrame, path: str) -> None:
    """``URL|filename`` lines of the successful fetches of ``(url, filename, success)``."""
    lines = fetched.where("success").select(F.concat_ws("|", "url", "filename").alias("value"))
    lines.write.mode("append").text(path)


def write_report(rendered: DataFrame, path: str) -> None:
    """A rendered report as text files whose names sort in report order."""
    ordered = rendered.orderBy(*REPORT_ORDER)
    ordered.select(F.col("line").alias("value")).write.mode("append").text(path)


def write_scan_log(results: dict[str, DataFrame], files: DataFrame, seconds: dict[str, float], path: str) -> None:
    """One JSON row per scanner: when, files, findings, how long it took."""
    durations = F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair]) if seconds else None
    taken = F.lit(None).cast("double") if durations is None else F.try_element_at(durations, F.col("scanner"))
    log = scan_metrics(results, files).select(
        F.current_timestamp().alias("logged_at"), "scanner", "files", "findings", taken.alias("seconds")
    )
    log.write.mode("append").json(path)


SCAN_LOG = "scanner string, files bigint, findings bigint, seconds double, error string"


def write_scans(scans: dict[str, DataFrame], files: DataFrame, folder: str, log: str) -> None:
    """Run each scan once: append its rows below ``folder`` and a row on it to ``log``, then a row with the totals.

    Findings are counted while they are written. A scan that fails leaves its error in the log, and the others go on.
    """
    spark = files.sparkSession
    rows, file_count = [], files.count()
    for scanner, found in scans.items():
        begun, seen, error, count = time.time(), Observation(), None, None
        try:
            found.observe(seen, F.count(F.lit(1)).alias("findings")).write.mode("append").parquet(f"{folder}/scanner={scanner}")
            count = seen.get["findings"]
        except Exception as problem:  # goes to the log
            error = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
        rows.append((scanner, file_count, count, round(time.time() - begun, 3), error))
    failed = sum(r[4] is not None for r in rows)
    rows.append(("total", file_count, sum(r[2] or 0 for r in rows), round(sum(r[3] for r in rows), 3), f"{failed} failed" if failed else None))
    table = spark.createDataFrame(rows, SCAN_LOG).select(F.current_timestamp().alias("logged_at"), "*")
    table.write.mode("append").json(log)
