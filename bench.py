"""Headline queries over the tables of ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs over its whole tables into a sink that discards the rows, three times; the best time counts.
Session start is not in the times, reading the tables is.
"""

from __future__ import annotations

import glob
import json
import os
import re
import tempfile
import time

from checks import catalog
from checks.session import local_session
from pyspark.sql import functions as F
from spillwatch.operators import detectors, reports, url_lists
from spillwatch.plans.endpoints import scan_endpoints
from spillwatch.plans.secrets import scan_secrets
from spillwatch.sources.readers import files_from_table

GIVEN_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
# The same tables with the texts in as many files as a scan has tasks; written before the clock starts. A table of
# many gigabytes has that many splits by itself.
SF_DIR = tempfile.mkdtemp(prefix="bench-tables-")
FILES = 16
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3


def documents(spark):
    return files_from_table(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text")


def stored_pages(spark):
    return files_from_table(spark.read.parquet(f"{SF_DIR}/pages.parquet"), "page_id", "html", "url")


# name -> (query, its input of files or None)
HEADLINES = {
    "secrets_fast": (lambda s: scan_secrets(documents(s), mode="fast"), documents),
    "secrets_deep": (lambda s: scan_secrets(documents(s), mode="deep"), documents),
    "secrets_fast_planted": (lambda s: scan_secrets(catalog.files(s, SF_DIR), mode="fast"), None),
    "secrets_deep_planted": (lambda s: scan_secrets(catalog.files(s, SF_DIR), mode="deep"), None),
    "secrets_deep_pages": (lambda s: scan_secrets(stored_pages(s), mode="deep"), stored_pages),
    "endpoints_documents": (lambda s: scan_endpoints(documents(s)), documents),
    "endpoints_pages": (lambda s: scan_endpoints(stored_pages(s)), stored_pages),
    "entropy_tokens": (lambda s: detectors.entropy_tokens(documents(s)), documents),
    "findings_by_detector": (lambda s: reports.findings_by_detector(catalog.deep_findings(s, SF_DIR)), None),
    "dedupe_urls": (lambda s: url_lists.dedupe_urls(url_lists.drop_third_party(catalog.cleaned(s, SF_DIR))), None),
    "tool_stats": (lambda s: url_lists.tool_stats(catalog.cleaned(s, SF_DIR)), None),
    "fetch_stats": (lambda s: catalog.QUERIES["g05_fetch_stats"](s, SF_DIR), None),
}


def split_tables(spark) -> None:
    for table in ("documents", "pages", "events", "conversations"):
        spark.read.parquet(f"{GIVEN_DIR}/{table}.parquet").repartition(FILES).write.parquet(f"{SF_DIR}/{table}.parquet")


def shuffle_bytes(folder: str) -> dict[str, int]:
    """Bytes written to shuffles per job group, from the event log."""
    stages, written = {}, {}
    for path in glob.glob(f"{folder}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path, encoding="utf-8"):
            if '"SparkListenerJobStart"' in line:
                event = json.loads(line)
                group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                stages.update({stage: group for stage in event["Stage IDs"]})
            elif '"SparkListenerTaskEnd"' in line:
                event = json.loads(line)
                size = ((event.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                group = stages.get(event["Stage ID"])
                if group:
                    written[group] = written.get(group, 0) + size
    return written


def main() -> None:
    log = tempfile.mkdtemp(prefix="bench-events-")
    spark = local_session(
        CPUS, **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file:{log}", "spark.eventLog.compress": "false"}
    )
    spark.sparkContext.setJobGroup("split", "split")
    split_tables(spark)
    seconds, inputs = {}, {}
    for name, (query, source) in HEADLINES.items():
        best = None
        for run in range(REPEATS):
            spark.sparkContext.setJobGroup(f"{name}-{run}", name)
            begun = time.time()
            query(spark).write.format("noop").mode("overwrite").save()
            taken = time.time() - begun
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
        spark.sparkContext.setJobGroup("sizes", "sizes")
        if source is not None:
            row = source(spark).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")).first()
            inputs[name] = (row["n"], row["b"])
    version, cores = spark.version, spark.sparkContext.defaultParallelism
    spark.stop()
    moved = shuffle_bytes(log)
    sf = re.search(r"sf([0-9.]+)", GIVEN_DIR)
    print(
        json.dumps(
            {
                "metric": "seconds of the headline queries, best of three, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else GIVEN_DIR,
                "files_per_sec": {n: round(f / seconds[n]) for n, (f, _) in inputs.items()},
                "mb_per_sec": {n: round(b / 1e6 / seconds[n], 2) for n, (_, b) in inputs.items()},
                "shuffle_bytes": {n: moved.get(f"{n}-{REPEATS - 1}", 0) for n in seconds},
                "rules": len(catalog.built_in()),
                "cores": cores,
                "spark": version,
            }
        )
    )


if __name__ == "__main__":
    main()
