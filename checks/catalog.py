"""Every query by name, with the SQL that must give the same rows.

Names start with the inventory's identifiers. All run over whole tables.
"""

from __future__ import annotations

import os
import re

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillwatch.functions import fetch, keywords, text, urls
from spillwatch.operators import detectors, endpoints, matching, pages, reports, resume, rule_tables, url_lists
from spillwatch.operators.settle import shared_folder
from spillwatch.plans.endpoints import scan_endpoints
from spillwatch.plans.secrets import scan_both, scan_secrets, surviving_matches
from spillwatch.rules import RuleSet, built_in
from spillwatch.rules.families import FAMILIES
from spillwatch.sources import readers, writers
from spillwatch.streaming import streams

from . import inputs as i
from . import oracle as o
from . import plants

FAMILY_CODES = {
    "ai_services": "d01",
    "auth_providers": "d02",
    "aws": "d03",
    "azure": "d04",
    "digitalocean": "d05",
    "google_cloud": "d06",
    "discord": "d07",
    "slack": "d08",
    "twilio": "d09",
    "keys_and_crypto": "d10",
    "mongodb": "d11",
    "mysql_postgresql": "d12",
    "docker_kubernetes": "d13",
    "paypal": "d14",
    "stripe": "d15",
    "github": "d16",
    "gitlab": "d17",
}

# User rules in the same fields as the built-in ones.
USER_RULES = [
    {"rule_id": "custom-hex", "regex": r"custom_[0-9a-f]{8,}|\bSK[0-9a-f]{32}\b", "severity": "high", "confidence": 90},
    {"rule_id": "custom-pair", "regex": r"(?i)client_secret\s*=\s*'[0-9a-f]{32}'", "entropy_check": True, "min_entropy": 4.0},
    {"rule_id": "custom-late", "regex": r"AKIA[0-9A-F]{16}", "severity": "low"},
]

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below the checkpoint folder where the cluster names one."""
    shared = shared_folder(spark)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{tempfile.mkdtemp(prefix='scratch-')}/{name}"


def files(spark, sf) -> DataFrame:
    return i.derive(spark, sf, i.FILES_SQL)


def feed(spark, sf) -> DataFrame:
    return i.derive(spark, sf, i.URLS_SQL)


def cleaned(spark, sf) -> DataFrame:
    return url_lists.clean_urls(feed(spark, sf))


def page_texts(spark, sf) -> DataFrame:
    return i.derive(spark, sf, i.ENDPOINT_TEXTS_SQL)


def rule_table(spark, sf) -> DataFrame:
    return i.derive(spark, sf, i.RULES_SQL)


def published(findings: DataFrame) -> DataFrame:
    """Findings with the tags as one text, for comparing values."""
    return findings.withColumn("tags", F.array_join("tags", "|"))


# ------------------------------------------------------------------- sources and sinks


def _url_round_trip(spark, sf, js_only=False):
    folder = scratch(spark, "urls")
    url_lists.clean_urls(feed(spark, sf)).select(F.col("url").alias("value")).write.text(folder)
    return readers.read_url_lists(spark, folder, js_only).select("url")


@query("a01_read_url_lists", f"select url from ({o.CLEAN})")
def _(spark, sf):
    return _url_round_trip(spark, sf)


@query(
    "a01_read_url_lists_js_only",
    f"with {o.url_parts(o.CLEAN, 'ord')} select url from parsed where {o.IS_JS}",
)
def _(spark, sf):
    return _url_round_trip(spark, sf, js_only=True)


def _write_each(texts: DataFrame, folder: str) -> None:
    """One file for each text, closed by a line feed, as Spark's text writer does with one record a file; in a local or mounted folder the tasks
    write by themselves, since that writer starts a process for the mode of every file and the driver moves them one by one."""
    at = urlsplit(folder)
    if at.scheme not in ("", "file"):
        texts.toDF("value").write.option("maxRecordsPerFile", 1).text(folder)
        return

    def write(rows):
        os.makedirs(at.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        for n, (value,) in enumerate(rows):
            # Named by place, so a task that runs again replaces its own files; a name appears when the file is whole.
            name = f"part-{part:05d}-{n:08d}.txt"
            whole = f"{at.path}/.{name}.{TaskContext.get().taskAttemptId()}"
            with open(whole, "wb") as out:
                out.write((value or "").encode() + b"\n")
            os.rename(whole, f"{at.path}/{name}")

    os.makedirs(at.path, exist_ok=True)
    texts.foreachPartition(write)


@query("a02_read_files", "select md5(concat(html, chr(10))) as digest, cast(length(html) + 1 as integer) as n, true as fetched from pages")
def _(spark, sf):
    folder = scratch(spark, "files")
    stored = spark.read.parquet(f"{sf}/pages.parquet").select("html")
    _write_each(stored, folder)
    # Spark takes every file for 4 MB at least; these are small, so a task has as many as a split of the table.
    tasks = max(stored.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    read = readers.read_files(spark, folder, suffix=".txt").coalesce(tasks)
    return read.select(F.md5("content").alias("digest"), F.length("content").alias("n"), "fetched")


@query(
    "a03_files_from_table",
    "select cast(doc_id as varchar) as file, md5(text) as digest, source as url, true as fetched from documents",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = readers.files_from_table(docs, "doc_id", "text", "source")
    return found.select("file", F.md5("content").alias("digest"), "url", "fetched")


@query(
    "a04_load_rules",
    """select concat('low', min(doc_id)) as rule_id, concat('c', quality) as category, 'medium' as severity, cast(75 as integer) as confidence,
 'loaded' as state from labels group by quality, toxic
 union all select concat('bad', max(doc_id)), null, null, null, 'rejected' from labels group by quality, toxic""",
)
def _(spark, sf):
    """One pack per kind of label, written and loaded again; its second rule does not compile."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kinds = labels.groupBy("quality", "toxic").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    good = F.struct(F.concat(F.lit("low"), "low").alias("id"), F.concat(F.lit("doc_"), "low", F.lit("[0-9]*")).alias("regex"))
    bad = F.struct(F.concat(F.lit("bad"), "high").alias("id"), F.lit("(unclosed").alias("regex"))
    folder = scratch(spark, "packs")
    packs = kinds.select(F.concat(F.lit("c"), "quality").alias("category"), F.array(good, bad).alias("patterns"))
    packs.write.option("maxRecordsPerFile", 1).json(folder)
    rules, rejects = readers.load_rules(spark, folder)
    loaded = rules.df(spark).select("rule_id", "category", "severity", "confidence", F.lit("loaded").alias("state"))
    nothing = F.lit(None).cast("string")
    refused = rejects.select(
        "rule_id", nothing.alias("category"), nothing.alias("severity"), nothing.cast("int").alias("confidence"), F.lit("rejected").alias("state")
    )
    return loaded.unionByName(refused)


@query(
    "a05_read_manifest",
    f"""select url, arg_max(filename, ord) as filename from (select split_part(value, '|', 1) as url,
 substr(value, instr(value, '|') + 1) as filename, ord from ({i.MANIFEST_LINES_SQL}) where contains(value, '|')) group by url""",
)
def _(spark, sf):
    return readers.parse_manifest(i.derive(spark, sf, i.MANIFEST_LINES_SQL))


@query(
    "a06_ingest_external_endpoints",
    f"""select trim(value) as path, 'GET' as method, file, 'LinkFinder' as source from ({i.EXTERNAL_SQL})
 where trim(value) <> '' and not starts_with(trim(value), 'Running')""",
)
def _(spark, sf):
    return readers.external_lines(i.derive(spark, sf, i.EXTERNAL_SQL), readers.LINK_SOURCE)


@query(
    "a06_ingest_external_findings",
    "select 'token' as type, md5(text) as value, concat('doc_', doc_id) as file, cast(doc_id % 90 as integer) as line,"
    " 'gitleaks' as detector from documents",
)
def _(spark, sf):
    folder = scratch(spark, "external")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.select(
        F.lit("token").alias("type"),
        F.md5("text").alias("value"),
        F.concat(F.lit("doc_"), "doc_id").alias("file"),
        (F.col("doc_id") % 90).alias("line"),
    ).write.json(folder)
    return readers.ingest_external_findings(spark, folder, "gitleaks")


@query(
    "a06_read_external_endpoints",
    f"""select trim(value) as path, 'GET' as method, 'LinkFinder' as source from ({i.EXTERNAL_SQL})
 where trim(value) <> '' and not starts_with(trim(value), 'Running')""",
)
def _(spark, sf):
    folder = scratch(spark, "endpoints")
    i.derive(spark, sf, i.EXTERNAL_SQL).select("value").write.text(folder)
    return readers.ingest_external_endpoints(spark, folder).select("path", "method", "source")


def _scanner_query(scanner: str, record: str, whole: bool, expected: str):
    """A record per document in the form that the scanner writes, next to broken ones, read back."""

    @query(f"a06_{scanner}_output", expected)
    def _(spark, sf):
        folder = scratch(spark, scanner)
        rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", f"{record} as value")
        if whole:
            # One array per file, some of them cut off.
            arrays = rows.groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))
            arrays.select(F.concat(F.lit("["), "value", F.when(F.col("file") % 4 == 3, "").otherwise("]"))).write.option("maxRecordsPerFile", 1).text(folder)
        else:
            rows.select(F.when(F.col("doc_id") % 10 == 9, F.left("value", F.lit(20))).otherwise(F.col("value"))).write.text(folder)
        found = readers.read_scanner_output(spark, folder, scanner)
        return found.select("type", "value", "file", "line", "detector", "severity", "reject")


_scanner_query(
    "gitleaks",
    """to_json(named_struct('RuleID', concat('rule-', doc_id % 7), 'Description', 'x', 'StartLine', doc_id % 90, 'Secret', if(doc_id % 11 = 5, '', md5(text)),
 'File', concat('src/', doc_id, '.js'), 'Entropy', 3.5, 'Tags', array('a', lang)))""",
    True,
    """select concat('rule-', doc_id % 7) as type, case when doc_id % 11 = 5 then null else md5(text) end as value, concat('src/', doc_id, '.js') as file,
 cast(doc_id % 90 as integer) as line, 'gitleaks' as detector, cast(null as varchar) as severity, case when doc_id % 11 = 5 then 'no value' end as reject
 from documents where doc_id // 100 % 4 <> 3 union all
 select null, null, null, null, 'gitleaks', null, 'no JSON' from (select distinct doc_id // 100 from documents where doc_id // 100 % 4 = 3)""",
)
_scanner_query(
    "trufflehog",
    """to_json(named_struct('SourceMetadata', named_struct('Data', if(doc_id % 2 = 0, map('Filesystem', named_struct('file', concat(doc_id, '.js'), 'line', doc_id % 90)),
 map('Git', named_struct('file', concat(doc_id, '.git'), 'line', doc_id % 80)))), 'DetectorName', lang, 'Verified', doc_id % 3 = 0, 'Raw', md5(text), 'Redacted', ''))""",
    False,
    """select case when doc_id % 10 <> 9 then lang end as type, case when doc_id % 10 <> 9 then md5(text) end as value,
 case when doc_id % 10 <> 9 then concat(doc_id, case when doc_id % 2 = 0 then '.js' else '.git' end) end as file,
 case when doc_id % 10 <> 9 then cast(case when doc_id % 2 = 0 then doc_id % 90 else doc_id % 80 end as integer) end as line, 'trufflehog' as detector,
 case when doc_id % 10 <> 9 and doc_id % 3 = 0 then 'critical' else 'high' end as severity, case when doc_id % 10 = 9 then 'no JSON' end as reject from documents""",
)
_scanner_query(
    "jsluice",
    """if(doc_id % 2 = 0, to_json(named_struct('url', concat('/api/', doc_id), 'method', 'GET', 'type', 'fetch', 'filename', concat(doc_id, '.js'), 'queryParams', array())),
 to_json(named_struct('kind', 'AWSAccessKey', 'data', named_struct('key', md5(text), 'secret', md5(lang), 'region', cast(null as string)), 'severity', 'high', 'filename', concat(doc_id, '.js'))))""",
    False,
    """select 'url.fetch' as type, concat('/api/', doc_id) as value, concat(doc_id, '.js') as file, cast(null as integer) as line, 'jsluice' as detector,
 cast(null as varchar) as severity, cast(null as varchar) as reject from documents where doc_id % 2 = 0
 union all select concat('AWSAccessKey.', part), case part when 'key' then md5(text) else md5(lang) end, concat(doc_id, '.js'), null, 'jsluice', 'high', null
 from documents, (values ('key'), ('secret')) as t(part) where doc_id % 2 = 1 and doc_id % 10 <> 9
 union all select 'url', null, null, null, 'jsluice', null, 'no JSON' from documents where doc_id % 10 = 9""",
)


@query("a07_write_findings", f"{o.secrets(built_in().by_family('github'))} select rule_id, value, file, line, detector from secrets")
def _(spark, sf):
    folder = scratch(spark, "findings")
    writers.write_findings(scan_secrets(files(spark, sf), built_in().by_family("github"), "deep"), folder)
    return spark.read.parquet(folder).select("rule_id", "value", "file", "line", "detector")


@query("a08_write_urls_by_tool", f"select tool, url from ({o.CLEAN})")
def _(spark, sf):
    folder = scratch(spark, "tools")
    writers.write_urls_by_tool(cleaned(spark, sf), folder)
    return spark.read.text(folder).select("tool", F.col("value").alias("url"))


@query(
    "a09_append_manifest",
    "select distinct url, concat('f', page_id, '.js') as filename from (select min(page_id) as page_id, url from pages group by url)"
    " where page_id % 3 <> 1",
)
def _(spark, sf):
    folder = scratch(spark, "manifest")
    per_url = spark.read.parquet(f"{sf}/pages.parquet").groupBy("url").agg(F.min("page_id").alias("page_id"))
    fetched = per_url.select(
        "url", F.concat(F.lit("f"), "page_id", F.lit(".js")).alias("filename"), (F.col("page_id") % 3 != 1).alias("success")
    )
    writers.append_manifest(fetched, folder)
    return readers.read_manifest(spark, folder)


@query(
    "a10_write_scan_log",
    f"""{o.endpoints()} select 'endpoints' as scanner, (select count(*) from files) as files, count(*) as findings,
 cast(1.5 as double) as seconds from endpoints
 union all select 'absolute paths', (select count(*) from files), (select count(*) from ({o.paths(0)})), null""",
)
def _(spark, sf):
    folder = scratch(spark, "log")
    texts = page_texts(spark, sf)
    results = {"endpoints": scan_endpoints(texts), "absolute paths": endpoints.abs_paths(texts)}
    writers.write_scan_log(results, texts, {"endpoints": 1.5}, folder)
    return spark.read.schema("scanner string, files bigint, findings bigint, seconds double").json(folder)


@query(
    "a10_write_scans",
    f"""{o.endpoints()}, counts as (select 'endpoints' as scanner, (select count(*) from endpoints) as findings, null as error
  union all select 'paths', (select count(*) from ({o.paths(0)})), null union all select 'broken', null, 'failed')
 select scanner, (select count(*) from files) as files, findings, error from counts
 union all select 'total', (select count(*) from files), cast(sum(findings) as bigint), '1 failed' from counts""",
)
def _(spark, sf):
    folder = scratch(spark, "scans")
    texts = page_texts(spark, sf)
    broken = texts.select(F.raise_error(F.lit("no such scanner")).cast("string").alias("value"))
    scans = {"endpoints": scan_endpoints(texts), "paths": endpoints.abs_paths(texts), "broken": broken}
    writers.write_scans(scans, texts, f"{folder}/found", f"{folder}/log")
    log = spark.read.schema(writers.SCAN_LOG).json(f"{folder}/log")
    return log.select("scanner", "files", "findings", F.when(F.col("scanner") != "broken", F.col("error")).otherwise("failed").alias("error"))


# ------------------------------------------------------------------- URLs


@query("b01_clean_urls", o.CLEAN)
def _(spark, sf):
    return cleaned(spark, sf)


@query("b02_is_js_url", f"with {o.url_parts(o.CLEAN, 'ord')} select ord, url, ok as parsable, {o.IS_JS} as js from parsed")
def _(spark, sf):
    url = F.col("url")
    return cleaned(spark, sf).select("ord", "url", urls.is_parsable_url(url).alias("parsable"), urls.is_js_url(url).alias("js"))


@query("b03_is_third_party", f"select ord, url, {o.IS_THIRD_PARTY} as third_party from ({o.CLEAN})")
def _(spark, sf):
    return cleaned(spark, sf).select("ord", "url", urls.is_third_party(F.col("url")).alias("third_party"))


@query("b04_third_party_reason", f"select ord, url, {o.REASON} as reason from ({o.CLEAN})")
def _(spark, sf):
    return cleaned(spark, sf).select("ord", "url", urls.third_party_reason(F.col("url")).alias("reason"))


@query("b05_drop_third_party", f"select * from ({o.CLEAN}) where not {o.IS_THIRD_PARTY}")
def _(spark, sf):
    return url_lists.drop_third_party(cleaned(spark, sf))


@query(
    "b06_safe_domain",
    "select page_id, replace(replace(replace(replace(url, 'http://', ''), 'https://', ''), '/', '_'), ':', '_') as folder from pages",
)
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", urls.safe_domain(F.col("url")).alias("folder"))


@query("b07_generate_filename", f"with {o.url_parts(o.CLEAN, 'ord')} select ord, url, {o.filename('ord')} as filename from parsed")
def _(spark, sf):
    return cleaned(spark, sf).select("ord", "url", urls.generate_filename(F.col("url"), F.col("ord")).alias("filename"))


@query("b08_sanitize_filename", f"select ord, {o.sanitized('url')} as name from ({i.URLS_SQL})")
def _(spark, sf):
    return feed(spark, sf).select("ord", urls.sanitize_filename(F.col("url")).alias("name"))


@query(
    "b09_format_size",
    f"""select url_id, case when bytes < 1024 then concat(bytes, 'B') when bytes < 1048576 then printf('%.1fKB', bytes / 1024.0)
 else printf('%.1fMB', bytes / 1048576.0) end as size from ({i.FETCH_LOG_SQL})""",
)
def _(spark, sf):
    return i.derive(spark, sf, i.FETCH_LOG_SQL).select("url_id", fetch.format_size(F.col("bytes")).alias("size"))


@query("b10_fetch_outcome", f"select url_id, {o.OUTCOME} as outcome from ({i.FETCH_LOG_SQL})")
def _(spark, sf):
    log = i.derive(spark, sf, i.FETCH_LOG_SQL)
    return log.select("url_id", fetch.fetch_outcome(F.col("status"), F.col("bytes"), F.col("attempt")).alias("outcome"))


@query(
    "b11_backoff_seconds",
    f"""select url_id, case when attempt >= 2 then null when status = 500 then cast(2 * pow(2, attempt) as bigint)
 when status in (429, 503, 504) then cast(pow(2, attempt) as bigint) end as seconds from ({i.FETCH_LOG_SQL})""",
)
def _(spark, sf):
    log = i.derive(spark, sf, i.FETCH_LOG_SQL)
    # The log holds no connection errors; status 500 stands for them here.
    kind = F.when(F.col("status") == 500, "connection").when(F.col("status").isin(*fetch.RETRYABLE_STATUSES), "status")
    return log.select("url_id", fetch.backoff_seconds(kind, F.col("attempt")).alias("seconds"))


# ------------------------------------------------------------------- rule tables


@query(
    "c01_rule_keyword",
    f"""with files as materialized ({i.FILES_SQL}), k as (select * from (values {','.join(
        sorted({f"({o.q(r['keyword'].lower())})" for r in built_in().indexed().rows}))}) as t(keyword))
 select keyword, count(*) as files from files join k on contains(lower(content), keyword) group by keyword""",
)
def _(spark, sf):
    """In how many files the keyword of each rule occurs."""
    rules = built_in()
    words = rules.df(spark).select("ord", F.lower("keyword").alias("keyword"))
    pairs = matching.prefilter(files(spark, sf), rules).join(F.broadcast(words), "ord")
    return pairs.groupBy("keyword").agg(F.countDistinct("file").alias("files"))


# One rule per document, with the keyword that the rule's form must have.
_LETTERS = "case when length(regexp_replace(text, '[^a-z]', '', 'g')) < 2 then 'wxy' else left(regexp_replace(text, '[^a-z]', '', 'g'), 2 + cast(doc_id % 9 as int)) end"
KEYWORD_RULES_SQL = f"""select doc_id, doc_id % 8 as form, {_LETTERS} as w from documents"""


@query(
    "c01_rule_keyword_by_form",
    f"""select doc_id, case form when 0 then w when 1 then case when length(w) >= 6 then upper(w) else 'SECRET' end when 2 then 'abc'
 when 3 then left(w, length(w) - 1) when 4 then w || '-' || w when 5 then w when 6 then w else null end as keyword from ({KEYWORD_RULES_SQL})""",
)
def _(spark, sf):
    words = i.derive(spark, sf, KEYWORD_RULES_SQL.replace(", 'g')", ")"))
    w, form = F.col("w"), F.col("form")
    forms = [
        F.concat(w, F.lit("[0-9]+")), F.concat(F.lit("(?i)"), w, F.lit(".{0,20}secret")), F.concat(F.lit("("), w, F.lit("){0,3}abc")),
        F.concat(F.lit("[0-9]*"), w, F.lit("?")), F.concat(w, F.lit("-"), w), F.concat(F.lit("("), w, F.lit(")+[0-9]")),
        F.concat(F.lit(r"\b(?:"), w, F.lit("){2,}")), F.concat(F.lit("(?:1"), w, F.lit("|2"), w, F.lit(")")),
    ]
    regex = F.coalesce(*(F.when(form == k, f) for k, f in enumerate(forms)))
    return words.select("doc_id", rule_tables.rule_keywords(regex).alias("keyword"))


@query("c02_is_valid_keyword", f"select ord, keyword, {o.VALID_KEYWORD} as valid from ({i.RULES_SQL})")
def _(spark, sf):
    return rule_table(spark, sf).select("ord", "keyword", keywords.is_valid_keyword(F.col("keyword")).alias("valid"))


@query("c03_index_rules", f"select keyword, ord from ({i.RULES_SQL}) where {o.VALID_KEYWORD}")
def _(spark, sf):
    return rule_tables.keyword_rules(rule_table(spark, sf))


@query(
    "c03_keyword_counts",
    f"select keyword, count(*) as rules, min(ord) as first_ord from ({i.RULES_SQL}) where {o.VALID_KEYWORD} group by keyword",
)
def _(spark, sf):
    return rule_tables.keyword_counts(rule_table(spark, sf))


@query("c03_fallback_rules", f"select ord, rule_id from ({i.RULES_SQL}) where not {o.VALID_KEYWORD}")
def _(spark, sf):
    return rule_tables.fallback_rules(rule_table(spark, sf)).select("ord", "rule_id")


@query(
    "c04_rule_index_stats",
    f"""select cast(count(*) filter ({o.VALID_KEYWORD}) as bigint) as indexed,
 count(distinct case when {o.VALID_KEYWORD} then keyword end) as unique_keywords,
 cast(count(*) filter (not {o.VALID_KEYWORD}) as bigint) as fallbacks from ({i.RULES_SQL})""",
)
def _(spark, sf):
    return rule_tables.rule_index_stats(rule_table(spark, sf))


@query("c05_rules_by_tag", f"select ord, rule_id from ({i.RULES_SQL}) where list_contains(list_transform(tags, lambda t: lower(t)), 'token')")
def _(spark, sf):
    return rule_tables.rules_by_tag(rule_table(spark, sf), "TOKEN").select("ord", "rule_id")


@query("c06_rules_by_severity", f"select ord, rule_id, severity from ({i.RULES_SQL}) where lower(severity) = 'high'")
def _(spark, sf):
    return rule_tables.rules_by_severity(rule_table(spark, sf), "HIGH").select("ord", "rule_id", "severity")


@query("c07_rule_count", f"select count(*) as rules from ({i.RULES_SQL})")
def _(spark, sf):
    return rule_tables.rule_count(rule_table(spark, sf))


@query(
    "c08_rule_defaults",
    f"""select ord, case when severity is null or severity = '' then 'medium' else severity end as severity,
 case when confidence is null or confidence = 0 then 75 else confidence end as confidence from ({i.RULES_SQL})""",
)
def _(spark, sf):
    return rule_tables.rule_defaults(rule_table(spark, sf)).select("ord", "severity", "confidence")


@query(
    "c09_pack_profile",
    f"""select category, provider, severity, count(*) as rules, min(confidence) as min_confidence, max(confidence) as max_confidence
 from ({i.RULES_SQL}) group by category, provider, severity""",
)
def _(spark, sf):
    return rule_tables.pack_profile(rule_table(spark, sf))


@query(
    "c09_tag_profile",
    f"select tag, count(*) as rules from (select unnest(list_distinct(tags)) as tag from ({i.RULES_SQL})) group by tag",
)
def _(spark, sf):
    return rule_tables.tag_profile(rule_table(spark, sf))


@query(
    "c10_duplicate_rules",
    f"select regex, count(*) as rules, min(ord) as first_ord from ({i.RULES_SQL}) group by regex having count(*) > 1",
)
def _(spark, sf):
    return rule_tables.duplicate_rules(rule_table(spark, sf))


@query("c11_min_entropy_active", f"select ord, entropy_check and min_entropy > 0 as active from ({i.RULES_SQL})")
def _(spark, sf):
    rules = rule_table(spark, sf)
    return rules.select("ord", matching.min_entropy_active(F.col("entropy_check"), F.col("min_entropy")).alias("active"))


BOUNDED = built_in().where(lambda r: r["max_length"] > 0)


@query(
    "c12_enforce_rule_bounds",
    o.scan(
        BOUNDED,
        extra="length(value) >= min_length and length(value) <= max_length and list_bool_or(list_transform("
        "string_split(context, '|'), lambda w: contains(lower(value), lower(w))))",
    ),
)
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), BOUNDED, "deep", enforce_bounds=True))


# ------------------------------------------------------------------- rule families


def _family(name: str):
    rules = built_in().by_family(name)
    planted = plants.files_sql(rules)

    @query(f"{FAMILY_CODES[name]}_{name}", o.scan(rules, files_sql=planted.replace("join plants", f"join {plants.values_sql(rules)}")))
    def _(spark, sf):
        texts = i.derive(spark, sf, planted, plants=plants.frame(spark, rules))
        return published(scan_secrets(texts, rules, "deep"))


for _pack in FAMILIES:
    _family(_pack["family"])


# ------------------------------------------------------------------- secret scan

FAST = built_in().indexed()
ENTROPIC = built_in().where(lambda r: r["entropy_check"])
ASSIGNMENTS = built_in().by_tag("assignment")


@query(
    "e01_prefilter",
    f"""with files as materialized ({i.FILES_SQL}), k as materialized (select * from (values {','.join(
        f"({r['ord']},{o.q(r['keyword'].lower())})" for r in FAST.rows)}) as t(ord, keyword)),
 hits as (select file, keyword from files join (select distinct keyword from k) as d on contains(lower(content), d.keyword))
 select file, cast(ord as integer) as ord from hits join k using (keyword)""",
)
def _(spark, sf):
    return matching.prefilter(files(spark, sf), built_in())


@query("e02_match_rules", f"with files as materialized ({i.FILES_SQL}) select file, ord, pos, value from ({o.found(FAST, distinct=False, position=True)})")
def _(spark, sf):
    return matching.match_rules(matching.candidates(files(spark, sf), FAST))


@query(
    "e03_shannon_entropy",
    f"""with t as (select doc_id, text as value from documents),
 e as ({o.ENTROPY.format(source='(select distinct value from t)')}) select doc_id, round(entropy, 6) as entropy from t join e using (value)""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", "text").select(
        "doc_id", F.round(text.shannon_entropy(F.col("text")), 6).alias("entropy")
    )


@query("e04_line_number", f"select file, {o._line('content', 'word')} as line from (select file, content, right(content, 12) as word from ({i.FILES_SQL}))")
def _(spark, sf):
    """Where the last twelve characters of each file first occur."""
    content = F.col("content")
    return files(spark, sf).select("file", text.line_number(content, F.right(content, F.lit(12))).cast("int").alias("line"))


@query("e05_entropy_filter", f"{o.surviving(ENTROPIC, placeholders=False)} select file, value, rank from kept")
def _(spark, sf):
    found = matching.candidates(files(spark, sf), ENTROPIC)
    return matching.entropy_filter(matching.distinct_matches(found)).select("file", "value", "rank")


@query("e06_false_positive_filter", f"{o.surviving(ASSIGNMENTS, entropy=False)} select file, value, rank from kept")
def _(spark, sf):
    found = matching.candidates(files(spark, sf), ASSIGNMENTS)
    return matching.false_positive_filter(matching.distinct_matches(found)).select("file", "value", "rank")


@query("e07_dedupe_matches", f"{o.surviving(built_in())} select file, value, min(rank) as rank from kept group by file, value")
def _(spark, sf):
    return matching.dedupe_matches(surviving_matches(files(spark, sf), built_in())).select("file", "value", "rank")


@query("e08_detector_label", f"{o.secrets(FAST)} select detector, severity, count(*) as findings from secrets group by detector, severity")
def _(spark, sf):
    found = scan_secrets(files(spark, sf))
    return found.groupBy("detector", "severity").agg(F.count("*").alias("findings"))


@query("e09_scan_secrets_fast", o.scan(FAST))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), mode="fast"))


@query("e10_scan_secrets_deep", o.scan(built_in()))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), mode="deep"))


@query("e10_scan_secrets_deep_strict", o.scan(built_in(), strict=True))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), mode="deep", strict_keyword_case=True))


@query("e10_scan_conversations_deep", o.scan(built_in(), files_sql=i.CONVERSATION_FILES_SQL))
def _(spark, sf):
    turns = i.derive(spark, sf, i.CONVERSATION_FILES_SQL)
    return published(scan_secrets(readers.files_from_table(turns, "file", "content"), mode="deep"))


@query("e10_scan_pages_deep", o.scan(built_in(), files_sql="select cast(page_id as varchar) as file, html as content from pages"))
def _(spark, sf):
    stored = spark.read.parquet(f"{sf}/pages.parquet")
    return published(scan_secrets(readers.files_from_table(stored, "page_id", "html", "url"), mode="deep"))


@query("e11_scan_by_tag", o.scan(FAST.by_tag("token")))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), tag="TOKEN"))


@query("e11_scan_by_severity", o.scan(FAST.by_severity("critical")))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), severity="Critical"))


def _detector(values: str, extra: str, kind: str, label: str) -> str:
    return f"""with files as materialized ({i.FILES_SQL}),
 found as materialized (select file, unnest(list_distinct({values})) as value from files), entropies as ({o.ENTROPY.format(
        source='(select distinct value from found)')})
 select '{kind}' as type, value, file, {o._line('content', 'value')} as line, '{label}' as detector
 from found join entropies using (value) join files using (file) where {extra}"""


ENTROPY_TOKENS = _detector("regexp_extract_all(content, '[A-Za-z0-9+/=_-]{20,}', 0)", "entropy >= 4.2", "High-entropy token", "Entropy (Pure)")
ASSIGNED = _detector(
    f"regexp_extract_all(content, {o.q(detectors.ASSIGNMENT)}, 0)", "true", "Assigned credential", "Regex (Vendor)"
)


@query("e12_entropy_tokens", ENTROPY_TOKENS)
def _(spark, sf):
    return detectors.entropy_tokens(files(spark, sf), threshold=4.2)


@query(
    "e12_random_stretches",
    f"""with files as materialized ({i.FILES_SQL}),
 tokens as materialized (select file, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z0-9+/=_-]{{20,}}', 0))) as token from files),
 lined as (select file, token, {o._line('content', 'token')} as line from tokens join files using (file)),
 windows as (select token, unnest(range(1, length(token) - 18)) as start from (select distinct token from tokens)),
 letters as (select token, start, substr(token, start + k, 1) as letter, count(*) as n from windows, range(20) as r(k) group by all),
 sums as (select token, start, sum(cast(round(1e9 * n / 20.0 * log2(20.0 / n)) as bigint)) as entropy from letters group by token, start),
 best as (select token, arg_min(start, struct_pack(e := -entropy, s := start)) as start, max(entropy) as entropy from sums group by token)
 select 'Random stretch' as type, substr(token, start, 20) as value, file, min(line) as line, 'Regex (Entropy)' as detector
 from best join lined using (token) where entropy >= 3600000000 group by file, substr(token, start, 20)""",
)
def _(spark, sf):
    return detectors.random_stretches(files(spark, sf), threshold=3.6)


@query("e13_assigned_secrets", ASSIGNED)
def _(spark, sf):
    return detectors.assigned_secrets(files(spark, sf))


@query("e14_union_detectors", f"select * from ({ENTROPY_TOKENS}) union all select * from ({ASSIGNED})")
def _(spark, sf):
    texts = files(spark, sf)
    return detectors.union_detectors(detectors.entropy_tokens(texts, threshold=4.2), detectors.assigned_secrets(texts))


@query(
    "e15_scan_both",
    f"""{o.secrets(FAST, files_sql="select file, content from (" + i.ENDPOINT_TEXTS_SQL + ") union all select file, content from ("
        + i.FILES_SQL + ")")}, endpoints as (select distinct file, path from ({o.ALL_PATHS}) where {o.GOOD_LENGTH} and {o.GOOD_PREFIX}
  and {o.NOT_EXCLUDED} and {o.GOOD_SHAPE})
 select 'secret' as kind, file, value as found from secrets union all select 'endpoint', file, path from endpoints""",
)
def _(spark, sf):
    texts = files(spark, sf).select("file", "content").unionByName(page_texts(spark, sf))
    return scan_both(texts).select("kind", "file", F.col("value").alias("found"))


@query(
    "e16_scan_masked",
    o.scan(FAST.by_family("stripe"), value="concat(left(value, 4), '...', sha256(value))"),
)
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), built_in().by_family("stripe"), mask_values=True))


@query("e17_scan_distinct_content", o.scan(built_in().by_family("github"), files_sql="select cast(doc_id as varchar) as file, text as content from documents"))
def _(spark, sf):
    docs = readers.files_from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return published(scan_secrets(docs, built_in().by_family("github"), "deep", distinct_content=True))


@query("h01_user_rules", o.scan(built_in().by_family("aws").union(USER_RULES)))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), built_in().by_family("aws").union(USER_RULES), "deep"))


# A repeated group whose way the next character decides, and a flag that is set in the middle.
LOOP_RULES = RuleSet.of([
    {"rule_id": "hex-runs", "regex": r'token = "(?:[0-9]+[a-f]+)+', "severity": "high"},
    {"rule_id": "late-flag", "regex": r'token(?i) = "[0-9A-F]{40}', "severity": "low"},
])


@query("h01_user_rules_with_loops", o.scan(LOOP_RULES))
def _(spark, sf):
    return published(scan_secrets(files(spark, sf), LOOP_RULES, "deep"))


# ------------------------------------------------------------------- endpoints


def _texts(select: str) -> str:
    return f"with files as materialized ({i.ENDPOINT_TEXTS_SQL}) {select}"


@query("f01_abs_paths", _texts(o.paths(0)))
def _(spark, sf):
    return endpoints.abs_paths(page_texts(spark, sf))


@query("f02_api_paths", _texts(o.paths(1)))
def _(spark, sf):
    return endpoints.api_paths(page_texts(spark, sf))


@query("f03_file_endpoints", _texts(o.paths(2)))
def _(spark, sf):
    return endpoints.file_endpoints(page_texts(spark, sf))


def all_paths(spark, sf) -> DataFrame:
    texts = page_texts(spark, sf)
    kinds = (endpoints.abs_paths, endpoints.api_paths, endpoints.file_endpoints)
    found = [kind(texts).select(F.lit(n).alias("pattern"), "file", "pos", "path") for n, kind in enumerate(kinds)]
    return url_lists.union_tools(*found)


def _path_filter(name: str, condition: str, keep):
    @query(name, _texts(f"select cast(pattern as integer) as pattern, file, pos, path from ({o.ALL_PATHS}) where {condition}"))
    def _(spark, sf):
        return all_paths(spark, sf).where(keep(F.col("path")))


_path_filter("f04_endpoint_length_filter", o.GOOD_LENGTH, endpoints.has_endpoint_length)
_path_filter("f05_endpoint_prefix_filter", o.GOOD_PREFIX, endpoints.has_endpoint_prefix)
_path_filter("f06_endpoint_exclude_filter", o.NOT_EXCLUDED, lambda path: ~endpoints.is_excluded(path))
_path_filter("f07_endpoint_shape_filter", o.GOOD_SHAPE, endpoints.has_endpoint_shape)


@query(
    "f08_dedupe_endpoints",
    _texts(
        "select file, path, cast(pattern as integer) as pattern, pos from (select *, row_number() over (partition by file, path"
        f" order by pattern, pos) as rn from ({o.ALL_PATHS})) where rn = 1"
    ),
)
def _(spark, sf):
    return endpoints.dedupe_endpoints(all_paths(spark, sf))


@query("f09_scan_endpoints", f"{o.endpoints()} select path, method, file, source from endpoints")
def _(spark, sf):
    return scan_endpoints(page_texts(spark, sf))


MERGED = f"""{o.endpoints()}, merged as (select path, method, file, source from endpoints union all
 select trim(value), 'GET', file, 'LinkFinder' from ({i.EXTERNAL_SQL}) where trim(value) <> '' and not starts_with(trim(value), 'Running'))"""


def merged(spark, sf) -> DataFrame:
    external = readers.external_lines(i.derive(spark, sf, i.EXTERNAL_SQL), readers.LINK_SOURCE)
    return endpoints.merge_endpoint_sources(scan_endpoints(page_texts(spark, sf)), external)


@query("f10_merge_endpoint_sources", f"{MERGED} select * from merged")
def _(spark, sf):
    return merged(spark, sf)


_REFERENCE = r"""'(?i)\s(?:src|href)\s*=\s*["'']([^"''<>]+)["'']'"""
_FOLDER = "regexp_replace(page, '[^/]*$', '')"
REFERENCES = f"""refs as (select page_id, regexp_extract(url, '^[^?#]*', 0) as page, cast(generate_subscripts(l, 1) - 1 as integer) as pos, unnest(l) as ref
  from (select page_id, url, regexp_extract_all(html, {_REFERENCE}, 1) as l from ({i.SCRIPT_PAGES_SQL}))),
 resolved as (select page_id, pos, case when regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') then ref
  when starts_with(ref, '//') then concat(split_part(page, '//', 1), ref)
  when starts_with(ref, '/') then concat(regexp_extract(page, '^[a-z]+://[^/]*', 0), ref)
  when regexp_matches(page, '^[a-z]+://[^/]*$') then concat(page, '/', ref) else concat({_FOLDER}, ref) end as url from refs)"""


@query(
    "f11_page_script_urls",
    f"with {REFERENCES}, {o.url_parts('select page_id, pos, url from resolved', 'page_id, pos')} select page_id, pos, url from parsed where {o.IS_JS}",
)
def _(spark, sf):
    return pages.page_script_urls(i.derive(spark, sf, i.SCRIPT_PAGES_SQL))


@query("f11_page_references", f"with {REFERENCES} select page_id, pos, url from resolved")
def _(spark, sf):
    return pages.page_references(i.derive(spark, sf, i.SCRIPT_PAGES_SQL))


@query(
    "f12_inline_scripts",
    f"""select url, file, content from (select url, concat('page_', page_id, '_', generate_subscripts(l, 1) - 1) as file, unnest(l) as content
 from (select page_id, url, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) as l from ({i.SCRIPT_PAGES_SQL}))) where trim(content) <> ''""",
)
def _(spark, sf):
    return pages.inline_scripts(i.derive(spark, sf, i.SCRIPT_PAGES_SQL))


def _re2(regex: str) -> str:
    """The same pattern without possessive repeats."""
    return o.q(re.sub(r"(?<=[*+?])\+", "", regex))


_DOTS = "case when starts_with(path, '/') then path else concat('/', path) end"
for _ in range(3):
    _DOTS = f"regexp_replace({_DOTS}, '/[.](/|$)', '/', 'g')"
for _ in range(5):
    _DOTS = f"regexp_replace({_DOTS}, '^(/[.][.])+(/|$)', '/')"
    _DOTS = f"regexp_replace({_DOTS}, '/[^/]+/[.][.](/|$)', '/')"
_DOTS = f"regexp_replace({_DOTS}, '^(/[.][.])+(/|$)', '/')"


def _resolved(ref: str, base: str) -> str:
    """SQL columns of a reference's parts, resolved step by step."""
    return f"""select *, case when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {ref} when starts_with({ref}, '//') then concat(split_part({base}, '//', 1), {ref})
  when {ref} = '' then split_part({base}, '#', 1) when starts_with({ref}, '#') then concat(split_part({base}, '#', 1), {ref})
  when starts_with({ref}, '?') then concat(split_part(split_part({base}, '#', 1), '?', 1), {ref})
  else concat(origin, {_DOTS}, rest) end as target from (
   select *, regexp_extract({base}, '^[a-z]+://[^/?#]*', 0) as origin, regexp_extract({ref}, '[?#].*$', 0) as rest,
    concat(case when starts_with({ref}, '/') then '' else regexp_extract(regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)?', 0) end,
     regexp_extract({ref}, '^[^?#]*', 0)) as path from"""


PAGE_PIECES = f"""pieces as (select page_id, url, generate_subscripts(l, 1) as n, unnest(l) as piece from (select page_id, url,
  regexp_extract_all(html, {_re2(pages.PIECE)}, 0) as l from ({{source}})))"""
_ATTRIBUTES = f"""attributes as (select page_id, url, n, lower(regexp_extract(tag, '^<[a-zA-Z]+', 0)) as element, generate_subscripts(names, 1) as m, unnest(names) as name, unnest(vals) as val
  from (select *, regexp_extract_all(tag, {_re2(pages.ATTRIBUTE)}, 1) as names, regexp_extract_all(tag, {_re2(pages.ATTRIBUTE)}, 2) as vals
   from (select *, regexp_extract(piece, {_re2(rf"(?i)^(?:{pages.SCRIPT_OPEN}|{pages.START_TAG})")}, 0) as tag from pieces where not starts_with(piece, '<!--')))),
 given as (select page_id, url, n, m, element, replace(replace(replace(replace(trim(regexp_replace(regexp_replace(val, '^[\"'']', ''), '[\"'']$', '')),
  '&#47;', '/'), '&#x2F;', '/'), '&lt;', '<'), '&amp;', '&') as ref from attributes where lower(name) in ('src', 'href') and val <> '')"""


@query(
    "f11_resolved_references",
    f"""with {PAGE_PIECES.format(source=i.REFERENCE_PAGES_SQL)}, {_ATTRIBUTES},
 bases as (select page_id, arg_min(target, n) as base from ({_resolved('ref', 'url')} (select * from given where element = '<base'))) group by page_id),
 placed as (select page_id, cast(row_number() over (partition by page_id order by n, m) - 1 as integer) as pos, ref, coalesce(base, url) as base
  from given left join bases using (page_id))
 select page_id, pos, target as url from ({_resolved('ref', 'base')} placed))""",
)
def _(spark, sf):
    return pages.page_references(i.derive(spark, sf, i.REFERENCE_PAGES_SQL))


@query(
    "f12_tokenized_scripts",
    f"""with {PAGE_PIECES.format(source=i.SCRIPT_TEXTS_SQL)}, scripts as (
  select page_id, url, row_number() over (partition by page_id order by n) - 1 as pos, regexp_extract(piece, {_re2(rf"(?is)^{pages.SCRIPT_OPEN}(.*){pages.SCRIPT_CLOSE}$")}, 1) as content
  from pieces where regexp_matches(piece, {_re2(rf"(?i)^{pages.SCRIPT_OPEN}")}))
 select url, concat('page_', page_id, '_', pos) as file, content from scripts where trim(content) <> ''""",
)
def _(spark, sf):
    return pages.inline_scripts(i.derive(spark, sf, i.SCRIPT_TEXTS_SQL))


# ------------------------------------------------------------------- URL lists


@query("g01_union_tools", i.URLS_SQL)
def _(spark, sf):
    feeds = [feed(spark, sf).where(F.col("tool") == tool) for tool in i.TOOLS]
    return url_lists.union_tools(*feeds)


DEDUPED = f"select url, min(ord) as ord from ({o.CLEAN}) group by url"


def deduped(spark, sf) -> DataFrame:
    return url_lists.dedupe_urls(cleaned(spark, sf))


@query("g02_dedupe_urls", DEDUPED)
def _(spark, sf):
    return deduped(spark, sf)


TOOL_STATS = (
    f"with {o.url_parts(o.CLEAN, 'tool, ord')} select tool, count(*) as total, cast(count(*) filter ({o.IS_JS}) as bigint) as js"
    " from parsed group by tool"
)


@query("g03_tool_stats", TOOL_STATS)
def _(spark, sf):
    return url_lists.tool_stats(cleaned(spark, sf))


@query(
    "g04_third_party_stats",
    f"select count(*) filter (not {o.IS_THIRD_PARTY}) as kept, count(*) filter ({o.IS_THIRD_PARTY}) as skipped from ({o.CLEAN})",
)
def _(spark, sf):
    return url_lists.third_party_stats(cleaned(spark, sf))


@query("g04_third_party_reasons", f"select coalesce({o.REASON}, 'first party') as reason, count(*) as urls from ({o.CLEAN}) group by 1")
def _(spark, sf):
    return url_lists.third_party_reasons(cleaned(spark, sf))


@query(
    "g05_fetch_stats",
    f"""with l as (select bytes, {o.OUTCOME} as outcome from ({i.FETCH_LOG_SQL}))
 select count(*) as total, count(*) filter (outcome in ('success', 'not modified')) as success,
 count(*) filter (outcome in ('failed', 'empty')) as failed,
 cast(sum(case when outcome = 'success' then bytes else 0 end) as bigint) as total_bytes from l where outcome <> 'retry'""",
)
def _(spark, sf):
    return reports.fetch_stats(i.derive(spark, sf, i.FETCH_LOG_SQL))


@query(
    "g06_filename_collisions",
    f"""with {o.url_parts(o.CLEAN, 'ord')} select filename, count(distinct url) as urls from (select url, {o.filename('ord')} as filename from parsed)
 group by filename having count(distinct url) > 1""",
)
def _(spark, sf):
    named = cleaned(spark, sf).select("url", urls.generate_filename(F.col("url"), F.col("ord")).alias("filename"))
    return url_lists.filename_collisions(named)


# ------------------------------------------------------------------- reports

SECTIONS = ",".join(f"('{name}', {n})" for n, name in enumerate(reports.DETECTORS, 1))
REFERENCE_SECTIONS = ",".join(f"('{name}', {n})" for n, name in enumerate(reports.REFERENCE_DETECTORS, 1))


def _by_detector(sections: str) -> str:
    return f"""{o.secrets(built_in())}, s as (select * from (values {sections}) as t(detector, pos))
 select s.detector, cast(s.pos as integer) as pos, count(secrets.value) as findings from s left join secrets on s.detector = secrets.detector
 group by s.detector, s.pos"""


def deep_findings(spark, sf) -> DataFrame:
    return scan_secrets(files(spark, sf), mode="deep")


@query("g07_findings_by_detector", _by_detector(SECTIONS))
def _(spark, sf):
    return reports.findings_by_detector(deep_findings(spark, sf))


@query("g07_findings_by_detector_reference_order", _by_detector(REFERENCE_SECTIONS))
def _(spark, sf):
    return reports.findings_by_detector(deep_findings(spark, sf), report_order="reference")


# Findings and endpoints of other origins than the fixed ones.
OTHER_DETECTORS = "case rule_id when 'aws-access-key-id' then 'Template (info)' when 'jwt' then 'own scanner' else detector end"


@query(
    "g07_findings_by_other_detectors",
    f"""{o.secrets(built_in())}, named as (select {OTHER_DETECTORS} as detector from secrets), s as (select * from (values {SECTIONS}) as t(detector, pos)),
 counts as (select coalesce(s.detector, named.detector) as detector, s.pos, count(named.detector) as findings
  from s full join named on s.detector = named.detector group by all)
 select detector, cast(coalesce(pos, {len(reports.DETECTORS)} + row_number() over (partition by pos is null order by detector)) as integer) as pos,
  findings from counts""",
)
def _(spark, sf):
    return reports.findings_by_detector(deep_findings(spark, sf).withColumn("detector", F.expr(OTHER_DETECTORS)))


@query(
    "g09_endpoints_by_other_sources",
    f"""{MERGED}, named as (select case when length(path) % 3 = 0 then 'jsluice' else source end as source from merged)
 select source, cast(case source when 'Regex' then 1 when 'LinkFinder' then 2 else 3 end as integer) as pos, count(*) as endpoints
 from named group by source""",
)
def _(spark, sf):
    other = F.when(F.length("path") % 3 == 0, "jsluice").otherwise(F.col("source"))
    return reports.endpoints_by_source(merged(spark, sf).withColumn("source", other))


@query(
    "g08_number_findings",
    f"""{o.secrets(built_in())} select detector, file, line, value, rule_id,
 row_number() over (partition by detector order by file, line, value, rule_id) as number from secrets""",
)
def _(spark, sf):
    return reports.number_findings(deep_findings(spark, sf).select("detector", "file", "line", "value", "rule_id"))


@query(
    "g09_endpoints_by_source",
    f"{MERGED} select source, cast(case source when 'Regex' then 1 else 2 end as integer) as pos, count(*) as endpoints from merged group by source",
)
def _(spark, sf):
    return reports.endpoints_by_source(merged(spark, sf))


@query("g10_distinct_paths_by_source", f"{MERGED} select source, path, min(file) as file from merged group by source, path")
def _(spark, sf):
    return reports.distinct_paths_by_source(merged(spark, sf))


@query("g11_findings_total", f"{o.secrets(built_in())} select count(*) as total from secrets")
def _(spark, sf):
    return reports.findings_total(deep_findings(spark, sf))


@query("g12_take_first", f"select url, ord from ({DEDUPED}) order by ord limit 25")
def _(spark, sf):
    return url_lists.take_first(deduped(spark, sf), 25)


@query("g13_take_range", f"select url, ord from ({DEDUPED}) order by ord limit 41 offset 9")
def _(spark, sf):
    return url_lists.take_range(deduped(spark, sf), "10-50")


@query(
    "g14_preview",
    f"""with d as ({DEDUPED}) select cast(row_number() over (order by ord) as integer) as position,
 case when length(url) > 50 then concat('...', right(url, 47)) else url end as url,
 greatest((select count(*) from d) - 20, 0) as more from d order by ord limit 20""",
)
def _(spark, sf):
    return url_lists.preview(deduped(spark, sf))


@query("g15_assign_index", f"select url, ord, row_number() over (order by ord) + 7 as index from ({DEDUPED})")
def _(spark, sf):
    return url_lists.assign_index(deduped(spark, sf), done=7)


def _report_lines(*blocks: str) -> str:
    """Blocks of ``(section, item, lines)`` as lines."""
    united = " union all ".join(blocks)
    return f"select section, item, cast(generate_subscripts(lines, 1) - 1 as integer) as at, unnest(lines) as line from ({united})"


_BAR, _DASH = "repeat('=', 80)", "repeat('-', 80)"


@query(
    "g16_render_secret_report",
    f"""{o.secrets(built_in())}, s as (select * from (values {SECTIONS}) as t(detector, pos)),
 counts as (select s.detector, cast(s.pos as integer) as pos, count(secrets.value) as n from s left join secrets using (detector) group by 1, 2),
 numbered as (select *, row_number() over (partition by detector order by file, line, value, rule_id) as number from secrets) """
    + _report_lines(
        f"""select cast(0 as integer) as section, cast(0 as bigint) as item, [{_BAR}, 'SECRET DETECTION REPORT', {_BAR}, '',
 concat('Total Secrets Found: ', count(*)), ''] as lines from secrets""",
        f"""select pos, 0, list_concat([{_DASH}, concat('DETECTOR: ', upper(detector), ' (', n, ' findings)'), {_DASH}, ''],
 case when n = 0 then ['  No findings from this detector.', ''] else [] end) from counts""",
        """select pos, number, [concat('[Finding #', number, ']'), concat('  File: ', file), concat('  Type: ', type),
 concat('  Line: ', line), concat('  Secret: ', value), ''] from numbered join counts using (detector)""",
    ),
)
def _(spark, sf):
    return reports.render_secret_report(deep_findings(spark, sf))


@query(
    "g16_render_endpoint_report",
    f"""{MERGED}, counts as (select source, cast(case source when 'Regex' then 1 else 2 end as integer) as pos, count(*) as n from merged group by source) """
    + _report_lines(
        f"""select cast(0 as integer) as section, '' as item, [{_BAR}, 'API ENDPOINTS REPORT', {_BAR}, '',
 concat('Total endpoints found: ', count(*)), ''] as lines from merged""",
        f"select pos, '', [{_DASH}, concat('SOURCE: ', upper(source), ' (', n, ' endpoints)'), {_DASH}, ''] from counts",
        "select distinct pos, path, [path] from merged join counts using (source)",
    ),
)
def _(spark, sf):
    return reports.render_endpoint_report(merged(spark, sf))


# ------------------------------------------------------------------- resume


def _resume_inputs(spark, sf):
    return tuple(i.derive(spark, sf, s) for s in (i.PAGE_URLS_SQL, i.MANIFEST_SQL, i.STORED_SQL))


FINISHED = f"""done as (select url, filename from ({i.MANIFEST_SQL}) where filename in (select file from ({i.STORED_SQL}) where content <> ''))"""


@query("h02_pending_urls", f"with {FINISHED} select url, ord from ({i.PAGE_URLS_SQL}) where url not in (select url from done)")
def _(spark, sf):
    return resume.pending_urls(*_resume_inputs(spark, sf))


@query("h03_done_urls", f"with {FINISHED} select url, ord, filename from ({i.PAGE_URLS_SQL}) join done using (url)")
def _(spark, sf):
    return resume.done_urls(*_resume_inputs(spark, sf))


@query(
    "h04_pending_files",
    f"select file, doc_id from ({i.FILES_SQL}) where file not in (select file from ({i.PROCESSED_SQL}) where content <> '')",
)
def _(spark, sf):
    return resume.pending_files(files(spark, sf), i.derive(spark, sf, i.PROCESSED_SQL)).select("file", "doc_id")


@query(
    "h05_only_fetched",
    f"""select f.file, md5(coalesce(p.content, f.content)) as digest from ({i.FILES_SQL}) as f
 left join (select * from ({i.PROCESSED_SQL}) where content <> '') as p on f.file = p.file where f.fetched""",
)
def _(spark, sf):
    kept = resume.only_fetched(files(spark, sf), i.derive(spark, sf, i.PROCESSED_SQL))
    return kept.select("file", F.md5("content").alias("digest"))


# ------------------------------------------------------------------- streams


def _as_stream(spark, df: DataFrame, name: str, parts: int = 3) -> DataFrame:
    """The same rows as a stream of files, taken in about ``parts`` turns. A table of more splits keeps them: one file each, and no shuffle."""
    folder = scratch(spark, name)
    files = max(parts, df.rdd.getNumPartitions())
    (df if files > parts else df.repartition(parts)).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // parts)).parquet(folder)


def _drain(spark, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream to its end; what it wrote, as a table."""
    folder = scratch(spark, name)
    if mode == "append":
        started = stream.writeStream.format("parquet").option("path", folder)
    else:
        # Each batch brings the groups that changed; the last value of a group counts.
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch_{batch_id}")

        started = stream.writeStream.foreachBatch(keep)
    checkpoint = scratch(spark, name + "-progress")
    started.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder) if mode == "append" else spark.read.option("recursiveFileLookup", "true").parquet(folder)


@query("i01_stream_scan_secrets", o.scan(FAST))
def _(spark, sf):
    stream = _as_stream(spark, files(spark, sf).select("file", "content"), "stream-files")
    folder = scratch(spark, "stream-findings")
    streams.stream_scan_secrets(stream, folder, scratch(spark, "stream-progress")).awaitTermination()
    return published(spark.read.parquet(folder).drop("batch"))


@query("i02_stream_scan_endpoints", f"{o.endpoints()} select path, method, file, source from endpoints")
def _(spark, sf):
    stream = _as_stream(spark, page_texts(spark, sf), "stream-pages")
    return _drain(spark, streams.stream_scan_endpoints(stream), "stream-endpoints", "append")


@query("i03_stream_dedupe_urls", f"with {o.url_parts(o.CLEAN, 'ord')} select distinct url from parsed where {o.IS_JS}")
def _(spark, sf):
    stream = _as_stream(spark, feed(spark, sf), "stream-urls")
    return _drain(spark, streams.stream_dedupe_urls(stream), "stream-deduped", "append").select("url")


@query("i04_stream_tool_stats", TOOL_STATS)
def _(spark, sf):
    stream = _as_stream(spark, cleaned(spark, sf), "stream-tools")
    updates = _drain(spark, streams.stream_tool_stats(stream), "stream-stats", "update")
    return updates.groupBy("tool").agg(F.max_by("total", "batch").alias("total"), F.max_by("js", "batch").alias("js"))
