"""Sources: URL lists, text files, tables, rule packs, manifests, other scanners' output."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_js_url, trimmed
from ..rules.ruleset import RuleSet, normalise, reject_reason

try:
    import yaml
except ImportError:
    yaml = None

# A pack is a text of a few hundred kilobytes; anything larger is no rule pack.
MAX_PACK_BYTES = 16 << 20
# Fixed values of the output of an external endpoint scanner.
LINK_SOURCE = "LinkFinder"
HEADER_PREFIX = "Running"
MANIFEST_LINE = r"(?s)^([^|]*)\|(.*)$"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_url_lists(spark: SparkSession, paths: str | list[str], js_only: bool = False) -> DataFrame:
    """``(tool, url, ord)`` from line lists, one file per tool (``<tool>_urls.txt``); empty lines are skipped.

    A list given by the user is taken as it is; ``js_only`` is for lists of an earlier run.
    ``ord`` grows with the line number within a file.
    """
    lines = spark.read.text(paths).select(
        F.regexp_replace(_file_name(F.col("_metadata.file_path")), r"(_urls)?\.[^.]*$", "").alias("tool"),
        F.col("value").alias("url"),
        F.monotonically_increasing_id().alias("ord"),
    )
    lines = lines.where(F.col("url") != "")
    return lines.where(is_js_url(F.col("url"))) if js_only else lines


def read_files(spark: SparkSession, folder: str | list[str], suffix: str | None = None) -> DataFrame:
    """``(url, file, content, fetched)`` from a folder, not its subfolders; ``file`` is the base name.

    A file that is no valid UTF-8 is read byte by byte, each byte as the character of its number, so nothing is replaced: ASCII
    values, lines and lengths stay what they are.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    content = F.col("content")
    return reader.load(folder).select(
        F.lit(None).cast("string").alias("url"),
        F.url_decode(F.replace(_file_name(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")).alias("content"),
        F.lit(True).alias("fetched"),
    )


def files_from_table(df: DataFrame, file: str | Column, text: str | Column, url: str | Column | None = None) -> DataFrame:
    """``(url, file, content, fetched)`` from a table that holds the texts."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        (F.lit(None).cast("string") if url is None else column(url)).alias("url"),
        column(file).cast("string").alias("file"),
        column(text).alias("content"),
        F.lit(True).alias("fetched"),
    )


def parse_manifest(lines: DataFrame, order: str = "ord", line: str = "value") -> DataFrame:
    """``(url, filename)`` from ``URL|filename`` lines, split at the first bar; the last line of a URL wins."""
    parsed = lines.where(F.contains(F.col(line), F.lit("|"))).select(
        F.regexp_extract(line, MANIFEST_LINE, 1).alias("url"),
        F.regexp_extract(line, MANIFEST_LINE, 2).alias("filename"),
        F.col(order).alias("ord"),
    )
    return parsed.groupBy("url").agg(F.max_by("filename", "ord").alias("filename"))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A manifest from text files, in the order of their names and lines."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("id"),
        ).alias("ord"),
    )
    return parse_manifest(lines)


def external_lines(lines: DataFrame, source: str, line: str = "value") -> DataFrame:
    """Output lines of another endpoint scanner as endpoints; blank lines and its headers are skipped."""
    text = trimmed(F.col(line))
    return lines.where((text != "") & ~text.startswith(HEADER_PREFIX)).select(
        text.alias("path"), F.lit("GET").alias("method"), "file", F.lit(source).alias("source")
    )


def ingest_external_endpoints(spark: SparkSession, path: str | list[str], source: str = LINK_SOURCE) -> DataFrame:
    """Endpoints from text output, one output file per scanned file."""
    lines = spark.read.text(path).select("value", _file_name(F.col("_metadata.file_path")).alias("file"))
    return external_lines(lines, source)


def ingest_external_findings(spark: SparkSession, path: str | list[str], detector: str) -> DataFrame:
    """Findings ``(type, value, file, line, detector)`` from another scanner's JSON lines."""
    schema = "type string, value string, file string, line int"
    return spark.read.schema(schema).json(path).withColumn("detector", F.lit(detector))


def _field(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def _finding(kind: Column, value: Column, file: Column, line: Column, severity: Column) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), file.alias("file"), line.alias("line"), severity.alias("severity"))


def _gitleaks(record: Column) -> Column:
    line = _field(record, "$.StartLine", "int")
    return F.array(_finding(_field(record, "$.RuleID"), _field(record, "$.Secret"), _field(record, "$.File"), line, F.lit(None).cast("string")))


def _trufflehog(record: Column) -> Column:
    # The place stands under the name of the kind of source, whichever it is.
    place = F.get(F.map_values(_field(record, "$.SourceMetadata.Data", "map<string,variant>")), F.lit(0))
    severity = F.when(_field(record, "$.Verified", "boolean"), "critical").otherwise("high")
    return F.array(_finding(_field(record, "$.DetectorName"), _field(record, "$.Raw"), _field(place, "$.file"), _field(place, "$.line", "int"), severity))


def _jsluice(record: Column) -> Column:
    # A secret has several named parts, a URL is one value.
    file, nothing = _field(record, "$.filename"), F.lit(None).cast("int")
    parts = F.filter(F.map_entries(_field(record, "$.data", "map<string,variant>")), lambda e: _field(e["value"], "$").isNotNull())
    kind, severity = _field(record, "$.kind"), _field(record, "$.severity")
    secrets = F.transform(parts, lambda e: _finding(F.concat_ws(".", kind, e["key"]), _field(e["value"], "$"), file, nothing, severity))
    url = F.array(_finding(F.concat_ws(".", F.lit("url"), _field(record, "$.type")), _field(record, "$.url"), file, nothing, F.lit(None).cast("string")))
    return F.when(F.size(parts) > 0, secrets).otherwise(url)


# How each scanner writes: whole files that hold an array, or a record per line.
SCANNERS = {"gitleaks": (True, _gitleaks), "trufflehog": (False, _trufflehog), "jsluice": (False, _jsluice)}


def read_scanner_output(spark: SparkSession, path: str | list[str], scanner: str) -> DataFrame:
    """``(type, value, file, line, detector, severity, reject, record)`` from the JSON that a scanner writes.

    Records are read without a fixed schema, so fields of other versions do no harm. What can't be used stays as a row with the reason in ``reject``:
    text that is no JSON (``record`` has it) and records without a value.
    """
    whole, findings = SCANNERS[scanner]
    lines = spark.read.text(path, wholetext=whole).where(trimmed(F.col("value")) != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("json"))
    records = parsed.select(
        "value", F.col("json").isNull().alias("broken"), F.explode(F.coalesce(F.try_variant_get("json", "$", "array<variant>"), F.array("json"))).alias("record")
    )
    found = records.select("value", "broken", "record", F.explode_outer(findings(F.col("record"))).alias("f"))
    usable = F.coalesce(F.col("f.value"), F.lit("")) != ""
    return found.select(
        "f.type",
        F.when(usable, F.col("f.value")).alias("value"),
        "f.file",
        "f.line",
        F.lit(scanner).alias("detector"),
        "f.severity",
        F.when(F.col("broken"), "no JSON").when(~usable, "no value").alias("reject"),
        F.when(F.col("broken"), F.col("value")).when(~usable, F.to_json("record")).alias("record"),
    )


def ingest_scanner_findings(spark: SparkSession, path: str | list[str], scanner: str) -> DataFrame:
    """The findings among :func:`read_scanner_output`."""
    return read_scanner_output(spark, path, scanner).where(F.col("reject").isNull()).drop("reject", "record")


# ------------------------------------------------------------------- rule packs


def _parse_pack(path: str, text: str) -> dict:
    if path.endswith(".json"):
        return json.loads(text)
    if yaml is None:
        raise ValueError("a YAML parser is not installed")
    return yaml.safe_load(text)


def rules_from_packs(packs: Iterable[tuple[str, str]]) -> tuple[RuleSet, list[dict]]:
    """Rules and rejects of ``(path, text)`` packs; a bad pack or a bad rule rejects only itself."""
    rules, rejects = [], []

    def reject(path, rule_id, reason):
        rejects.append({"path": path, "rule_id": rule_id, "reason": reason})

    for path, text in sorted(packs):
        try:
            pack = _parse_pack(path, text)
            patterns = pack.get("patterns") or []
        except Exception as problem:
            reject(path, None, f"unreadable pack: {problem}".splitlines()[0])
            continue
        shared = {k: pack.get(k) for k in ("category", "provider")}
        for pattern in patterns:
            try:
                rule = normalise({**shared, "family": pack.get("family") or pack.get("category"), **pattern})
                problem = reject_reason(rule)
            except (AttributeError, TypeError, ValueError) as error:
                rule, problem = {"rule_id": str(pattern)[:80]}, f"malformed rule: {error}"
            if problem:
                reject(path, rule.get("rule_id"), problem)
            else:
                rules.append(rule)
    return RuleSet.of(rules), rejects


def load_rules(spark: SparkSession, path: str | list[str]) -> tuple[RuleSet, DataFrame]:
    """All packs (``.yaml``, ``.yml``, ``.json``) under ``path``: the rules, and what was rejected, as rows."""
    packs = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{yaml,yml,json}")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    total = packs.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if total > MAX_PACK_BYTES:
        raise ValueError(f"{total} bytes of rule packs: more than {MAX_PACK_BYTES}")
    rules, rejects = rules_from_packs((r["path"], r["value"]) for r in packs.toLocalIterator())
    schema = pa.schema([("path", pa.string()), ("rule_id", pa.string()), ("reason", pa.string())])
    return rules, spark.createDataFrame(pa.Table.from_pylist(rejects, schema=schema))

