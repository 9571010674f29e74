"""HTTP endpoints quoted in text: extraction and the filters on what was extracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an endpoint looks like. Opening and closing quotes need not agree.
QUOTE = "[\"'`]"
API_WORDS = ("api", "graphql", "rest", "endpoint", "service", "query", "mutation", "webhook", "callback")
SERVER_SUFFIXES = ("php", "asp", "aspx", "jsp", "do", "action", "cgi", "pl", "py")
MIN_BYTES, MAX_BYTES, MAX_SLASHES = 4, 200, 10
SKIPPED_PREFIXES = ("//", "/static-", "/fonts/", "/assets/")
SKIPPED_FRAGMENTS = ("static-", "node_modules")
ASSET_SUFFIXES = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "woff", "woff2", "ttf", "eot", "webp", "ico")
EVENT_NAMES = ("click", "hover", "focus", "blur", "change", "submit", "keydown", "keyup", "mouseenter", "mouseleave", "tap")
FRAMEWORKS = ("react", "redux", "moment")
# Paths that are noise, by reason. ``\z`` is the end of the text.
EXCLUDED = {
    "relative module": r"^\./[a-z-]+\z",
    "parent module": r"^\.\./[a-z-]+\z",
    "selector": r"^[a-z]+\.[a-z]+\z",
    "event": rf"(?i)^(?:{'|'.join(EVENT_NAMES)})\.",
    "static version": r"/static-[0-9]+\.[0-9]+",
    "static folder": r"^/[a-z-]+/static-",
    "short word": r"^/(?:a|store|draft)\z",
    "asset": rf"\.(?:{'|'.join(ASSET_SUFFIXES)})\z",
    "framework": rf"(?i)^(?:{'|'.join(FRAMEWORKS)})\.",
    "content prefix": r"^/(?:content|browserslist|head|hub)-",
}

# In the order in which they claim a path.
PATTERNS = {
    "absolute": rf"{QUOTE}(/[a-zA-Z0-9_/-]{{3,}}[a-zA-Z0-9_/]){QUOTE}",
    "api": rf"{QUOTE}(/(?:{'|'.join(API_WORDS)}|v[0-9]+)[a-zA-Z0-9_/-]*[a-zA-Z0-9_/]){QUOTE}",
    "server file": rf"{QUOTE}([a-zA-Z0-9_/-]+\.(?:{'|'.join(SERVER_SUFFIXES)})){QUOTE}",
}


def _extract(files: DataFrame, kind: str) -> DataFrame:
    paths = F.regexp_extract_all("content", F.lit(PATTERNS[kind]), F.lit(1))
    return files.select("file", F.posexplode(paths).alias("pos", "path"))


def abs_paths(files: DataFrame) -> DataFrame:
    """``(file, pos, path)``: quoted paths that start with a slash."""
    return _extract(files, "absolute")


def api_paths(files: DataFrame) -> DataFrame:
    """Quoted paths that start with an API word or a version."""
    return _extract(files, "api")


def file_endpoints(files: DataFrame) -> DataFrame:
    """Quoted names of server-side files."""
    return _extract(files, "server file")


def has_endpoint_length(path: Column) -> Column:
    return F.octet_length(path).between(MIN_BYTES, MAX_BYTES)


def has_endpoint_prefix(path: Column) -> Column:
    return ~reduce(Column.__or__, [path.startswith(p) for p in SKIPPED_PREFIXES])


def is_excluded(path: Column) -> Column:
    return reduce(Column.__or__, [path.rlike(regex) for regex in EXCLUDED.values()])


def exclusion_reason(path: Column) -> Column:
    """First reason in :data:`EXCLUDED` that applies, or null."""
    return F.coalesce(*[F.when(path.rlike(regex), F.lit(name)) for name, regex in EXCLUDED.items()])


def has_endpoint_shape(path: Column) -> Column:
    lowered = F.lower(path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return ~reduce(Column.__or__, [F.contains(lowered, F.lit(s)) for s in SKIPPED_FRAGMENTS]) & (slashes <= MAX_SLASHES)


def is_endpoint(path: Column) -> Column:
    return has_endpoint_length(path) & has_endpoint_prefix(path) & ~is_excluded(path) & has_endpoint_shape(path)


def dedupe_endpoints(found: DataFrame) -> DataFrame:
    """First of each (file, path) among rows with ``pattern`` and ``pos``, for inputs of several rows per file."""
    # Both orders in one fixed-width number, so repeats fold in hash tables before the shuffle.
    order = F.shiftleft(F.col("pattern").cast("long"), 40) + F.col("pos")
    firsts = found.groupBy("file", "path").agg(F.min(order).alias("first"))
    return firsts.select(
        "file",
        "path",
        F.shiftright("first", 40).cast("int").alias("pattern"),
        (F.col("first") % F.lit(1 << 40)).cast("int").alias("pos"),
    )


def distinct_paths(content: Column) -> Column:
    """All paths of one text, each once, in pattern order and then text order."""
    return F.array_distinct(
        F.concat(*[F.regexp_extract_all(content, F.lit(regex), F.lit(1)) for regex in PATTERNS.values()])
    )


def merge_endpoint_sources(*sources: DataFrame) -> DataFrame:
    """Findings of several extractors; the same path from two of them stays twice."""
    return reduce(DataFrame.unionByName, sources)
