"""URL feeds ``(tool, url, ord)``: merging, cleaning, classifying, counting, slicing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from .settle import settle

PREVIEW_ROWS = 20
MAX_SORTED_IN_MEMORY = 10_000


def union_tools(*feeds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, feeds)


def clean_urls(urls: DataFrame) -> DataFrame:
    """Trim; drop what is empty then."""
    return urls.withColumn("url", u.trimmed(F.col("url"))).where(F.col("url") != "")


def only_js(urls: DataFrame) -> DataFrame:
    return urls.where(u.is_js_url(F.col("url")))


def drop_third_party(urls: DataFrame) -> DataFrame:
    return urls.where(~u.is_third_party(F.col("url")))


def dedupe_urls(urls: DataFrame) -> DataFrame:
    """``(url, ord)``: each URL once, at its first position. Folded before the shuffle."""
    return urls.groupBy("url").agg(F.min("ord").alias("ord"))


def tool_stats(urls: DataFrame) -> DataFrame:
    """URLs and ``.js`` URLs per tool, counted before any dedupe."""
    return urls.groupBy("tool").agg(
        F.count("*").alias("total"), F.count_if(u.is_js_url(F.col("url"))).alias("js")
    )


def third_party_stats(urls: DataFrame) -> DataFrame:
    """One row: URLs kept and skipped by :func:`drop_third_party`."""
    skipped = u.is_third_party(F.col("url"))
    return urls.agg(F.count_if(~skipped).alias("kept"), F.count_if(skipped).alias("skipped"))


def third_party_reasons(urls: DataFrame) -> DataFrame:
    reason = F.coalesce(u.third_party_reason(F.col("url")), F.lit("first party"))
    return urls.groupBy(reason.alias("reason")).agg(F.count("*").alias("urls"))


def filename_collisions(named: DataFrame) -> DataFrame:
    """``(filename, urls)``: names that several different URLs would be stored under.

    Distinct pairs are folded first, so one very common name is spread over many tasks.
    """
    pairs = named.select("filename", "url").distinct()
    return pairs.groupBy("filename").agg(F.count("*").alias("urls")).where("urls > 1")


# ------------------------------------------------------------------- positions


def with_position(df: DataFrame, *order: str | Column, name: str = "position", start: int = 0) -> DataFrame:
    """Number all rows 1..n in ``order`` (plus ``start``), with no window over the whole table.

    Rows are range-partitioned, sorted and settled; each partition's size gives the later ones their
    start, and only those sizes are brought together.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # Settled before it is read twice: sampled range bounds differ from run to run.
    marked = settle(ranged.withColumn("_id", F.monotonically_increasing_id()))
    # The partition number and the row's place in it, as Spark packs them into the id.
    marked = marked.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = marked.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_at") + F.col("_offset") + F.lit(1 + start)).alias(name))


def _slice(df: DataFrame, first: int, last: int, order: str) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based) in ``order``."""
    if last < first:
        return df.limit(0)
    if last <= MAX_SORTED_IN_MEMORY:
        return df.orderBy(order).offset(first - 1).limit(last - first + 1)
    # A sorted limit is brought together in one task, so a long one is cut by position instead.
    placed = with_position(df, order, name="_position")
    return placed.where(F.col("_position").between(first, last)).drop("_position")


def take_first(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` rows; all of them when there are fewer, none below 1."""
    return _slice(df, 1, n, order)


def parse_range(text: str) -> tuple[int | None, int | None]:
    """``"X-Y"`` as a 1-based inclusive range; ``(None, None)``, meaning everything, when it has not two parts.

    A part that is no number counts as 0.
    """
    parts = text.split("-")
    if len(parts) != 2:
        return None, None
    first, last = (int(p) if re.fullmatch(r"[+-]?[0-9]+", p) else 0 for p in parts)
    return max(first, 1), last


def take_range(df: DataFrame, text: str, order: str = "ord") -> DataFrame:
    """Rows X to Y of ``"X-Y"`` in ``order``."""
    first, last = parse_range(text)
    if first is None:
        return df
    return _slice(df, first, last, order)


def preview(urls: DataFrame, rows: int = PREVIEW_ROWS, order: str = "ord") -> DataFrame:
    """``(position, url, more)``: the first rows, long URLs shortened, and how many are not shown."""
    total = urls.agg(F.count("*")).scalar()
    top = urls.orderBy(order).limit(rows)
    # At most ``rows`` rows are left, so numbering them in one task is fine.
    position = F.row_number().over(Window.orderBy(order))
    return top.select(
        position.alias("position"),
        u.display_url(F.col("url")).alias("url"),
        F.greatest(total - rows, F.lit(0)).alias("more"),
    )


def assign_index(pending: DataFrame, done: int = 0, order: str = "ord") -> DataFrame:
    """Number new items after the ``done`` ones already finished."""
    return with_position(pending, order, name="index", start=done)
