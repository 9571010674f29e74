"""The same scans over streams. Checkpoints of the queries take the place of a resume manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import is_js_url
from ..operators.url_lists import clean_urls, only_js
from ..plans.endpoints import endpoints_of
from ..plans.secrets import scan_secrets
from ..rules import RuleSet


def stream_scan_secrets(
    files: DataFrame, path: str, checkpoint: str, rules: RuleSet | None = None, mode: str = "fast", trigger: dict | None = None, **options
) -> StreamingQuery:
    """Scan each new file once and append its findings to ``path``.

    ``trigger`` is what Spark's ``trigger`` takes, such as ``{"processingTime": "1 minute"}`` to run on; by default what is there is scanned.

    A batch replayed after a failure replaces its own folder, so findings are there exactly once.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        found = scan_secrets(batch, rules, mode, **options)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return files.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_scan_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints of new files; stateless, so it can be appended to any sink."""
    return endpoints_of(files)


def stream_dedupe_urls(urls: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Script URLs, each once.

    Without ``event_time`` every URL ever seen stays in the state store, as exact dedupe demands. With
    it, a URL is forgotten ``delay`` after its time and may come again.
    """
    cleaned = only_js(clean_urls(urls))
    if event_time is None:
        return cleaned.dropDuplicates(["url"])
    return cleaned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


def stream_tool_stats(urls: DataFrame) -> DataFrame:
    """Running totals per tool, for the ``update`` or ``complete`` output mode."""
    return urls.groupBy("tool").agg(F.count("*").alias("total"), F.count_if(is_js_url(F.col("url"))).alias("js"))


# Settings for a session that runs these queries with large state.
STATE_STORE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
