"""Whole scans: properties, skew, incremental runs, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from checks import catalog
from spillwatch.operators import endpoints, matching, reports, resume, url_lists
from spillwatch.plans.endpoints import endpoints_of, scan_endpoints
from spillwatch.plans.secrets import scan_secrets, select_rules
from spillwatch.rules import RuleSet, built_in
from spillwatch.sources import readers, writers
from spillwatch.streaming import streams

RULES = RuleSet.of(
    [
        {"rule_id": "pair", "regex": r"key=[a-z0-9]{4}", "severity": "high"},
        {"rule_id": "random", "regex": r"zeta-[a-z0-9]+", "entropy_check": True, "min_entropy": 3.0},
        {"rule_id": "zeta", "regex": r"zeta-a+"},
        {"rule_id": "flag-only", "regex": r"flag-[a-z]+", "entropy_check": True},
        {"rule_id": "fallback", "regex": r"(?:one|two)=\d+", "severity": "critical"},
        {"rule_id": "late", "regex": r"prefix-one=\d+", "severity": "medium"},
    ]
)


def files(spark, *texts):
    return spark.createDataFrame([(f"f{n}", t) for n, t in enumerate(texts)], "file string, content string")


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_modes(spark):
    df = files(spark, "key=abcd\nprefix-one=1 one=1")
    fast = found(scan_secrets(df, RULES, "fast"), "rule_id", "value", "line")
    deep = found(scan_secrets(df, RULES, "deep"), "rule_id", "value", "line")
    assert fast == [("late", "prefix-one=1", 2), ("pair", "key=abcd", 1)]
    assert deep == [("fallback", "one=1", 2), *fast]
    with pytest.raises(ValueError):
        select_rules(RULES, "slow")


def test_keywordless_rules_name_a_shared_value_first(spark):
    rules = RuleSet.of([{"rule_id": "indexed", "regex": "token-one=1"}, {"rule_id": "open", "regex": r"(?:token-one=1|other)"}])
    assert found(scan_secrets(files(spark, "token-one=1"), rules, "deep"), "rule_id") == [("open",)]


def test_a_value_one_rule_refuses_can_be_reported_by_a_later_one(spark):
    df = files(spark, "zeta-aaaaaaaaaaaaaaaa", "zeta-q8w3e9r1t6y2")
    assert found(scan_secrets(df, RULES), "file", "rule_id") == [("f0", "zeta"), ("f1", "random")]


def test_entropy_flag_without_a_floor_does_nothing(spark):
    assert found(scan_secrets(files(spark, "flag-aaaa"), RULES), "rule_id") == [("flag-only",)]


def test_same_value_once_per_file(spark):
    df = files(spark, "key=abcd\nkey=abcd", "x\nkey=abcd")
    assert found(scan_secrets(df, RULES), "file", "line") == [("f0", 1), ("f1", 2)]


def test_filters_and_options(spark):
    df = files(spark, "key=abcd key=wxyz", None, "")
    assert found(scan_secrets(df, RULES, deny=["wx"]), "value") == [("key=abcd",)]
    assert found(scan_secrets(df, RULES, severity="HIGH"), "rule_id") == [("pair",)] * 2
    assert found(scan_secrets(df, RULES, tag="none"), "rule_id") == []
    (masked,) = found(scan_secrets(df, RULES, deny=["wx"], mask_values=True), "value")
    assert masked[0].startswith("key=...") and "abcd" not in masked[0]
    bounded = RuleSet.of(
        [
            {"rule_id": "long", "regex": "key=[a-z]+", "min_length": 9},
            {"rule_id": "context", "regex": "key=[a-z]+", "context_keywords": ["KEY"], "max_length": 8},
        ]
    )
    assert found(scan_secrets(df, bounded, "deep", enforce_bounds=True), "rule_id") == [("context",)] * 2


def test_no_rules(spark):
    assert scan_secrets(files(spark, "key=abcd"), RuleSet(())).count() == 0


def brute_force(texts, rules):
    """The same scan in plain Python, for small inputs of plain rules."""
    import re

    rows = set()
    ordered = sorted(rules.rows, key=lambda r: r["rank"])
    for name, text in texts:
        seen = set()
        for rule in ordered:
            for match in re.finditer(rule["regex"], text):
                value = match.group(0)
                if value not in seen:
                    seen.add(value)
                    rows.add((name, value, rule["rule_id"], text.count("\n", 0, text.index(value)) + 1))
    return rows


def test_hot_file_and_hot_value(spark):
    """One file holds most matches, one value most of the files."""
    plain = RuleSet.of([{"rule_id": "n", "regex": "num-[0-9]+"}, {"rule_id": "m", "regex": "num-[0-9]"}])
    texts = [("hot", "\n".join(f"num-{n % 3000}" for n in range(6000)))] + [(f"f{n}", f"a\nnum-7 num-{n}") for n in range(400)]
    df = spark.createDataFrame(texts, "file string, content string").repartition(7)
    rows = scan_secrets(df, plain).collect()
    assert {(r["file"], r["value"], r["rule_id"], r["line"]) for r in rows} == brute_force(texts, plain)
    assert len(rows) == len({(r["file"], r["value"]) for r in rows})


def test_equal_texts_scanned_once_give_the_same(spark):
    texts = [(f"f{n}", "key=same one=5" if n % 3 else f"key=k{n:03}") for n in range(90)]
    df = spark.createDataFrame(texts, "file string, content string").repartition(5)
    columns = ("file", "rule_id", "value", "line")
    assert found(scan_secrets(df, RULES, "deep", distinct_content=True), *columns) == found(scan_secrets(df, RULES, "deep"), *columns)


def test_text_is_not_shuffled_at_scale(spark, sf_dir):
    """With enough splits the only exchange carries matches, and nothing sorts or nests loops."""
    docs = readers.files_from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        plan = scan_secrets(docs)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if " Exchange" in line or "-Exchange" in line]
        assert len(exchanges) == 1 and "value" in exchanges[0]
        assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
        endpoint_plan = scan_endpoints(docs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in endpoint_plan
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_endpoint_dedupe_across_rows(spark):
    df = spark.createDataFrame([("f", "'/api/one'"), ("f", '"/api/one" \'/v1/two\'')], "file string, content string")
    kinds = (endpoints.abs_paths, endpoints.api_paths)
    rows = [kind(df).select(F.lit(n).alias("pattern"), "file", "pos", "path") for n, kind in enumerate(kinds)]
    firsts = endpoints.dedupe_endpoints(url_lists.union_tools(*rows))
    assert found(firsts, "path", "pattern", "pos") == [("/api/one", 0, 0), ("/v1/two", 0, 1)]


def test_numbering_is_dense_per_detector(spark):
    rows = [("A" if n % 3 else "B", f"f{n % 40:02}", n, f"v{n}", "r") for n in range(3000)]
    df = spark.createDataFrame(rows, "detector string, file string, line int, value string, rule_id string").repartition(6)
    numbered = reports.number_findings(df).collect()
    for detector in "AB":
        mine = sorted((r["file"], r["line"], r["value"], r["number"]) for r in numbered if r["detector"] == detector)
        assert [m[3] for m in mine] == list(range(1, len(mine) + 1))


def test_two_resumed_runs_cover_everything(spark):
    urls = spark.createDataFrame([(f"u{n}", n) for n in range(60)], "url string, ord bigint")
    stored = spark.createDataFrame([(f"n{n}", "" if n % 7 == 0 else "x") for n in range(0, 60, 2)], "file string, content string")
    manifest = spark.createDataFrame([(f"u{n}", f"n{n}") for n in range(0, 60, 3)], "url string, filename string")
    pending = {r["url"] for r in resume.pending_urls(urls, manifest, stored).collect()}
    done = {r["url"] for r in resume.done_urls(urls, manifest, stored).collect()}
    assert done == {f"u{n}" for n in range(0, 60, 6) if n % 7} and pending | done == {f"u{n}" for n in range(60)} and not pending & done
    sized = stored.withColumn("size", F.length("content")).drop("content")
    assert {r["url"] for r in resume.pending_urls(urls, manifest, sized).collect()} == pending


# ------------------------------------------------------------------- sources and sinks


def test_url_lists(spark, tmp_path):
    (tmp_path / "gau_urls.txt").write_text("https://h/a.js\n\nhttps://h/b.html\n")
    (tmp_path / "katana_urls.txt").write_text("https://h/c.js\n")
    everything = readers.read_url_lists(spark, str(tmp_path))
    assert found(everything, "tool", "url") == [("gau", "https://h/a.js"), ("gau", "https://h/b.html"), ("katana", "https://h/c.js")]
    assert found(readers.read_url_lists(spark, str(tmp_path), js_only=True), "url") == [("https://h/a.js",), ("https://h/c.js",)]


def test_external_endpoint_output(spark, tmp_path):
    (tmp_path / "a.js").write_text("Running against: a.js\n  /api/x \n\n/api/x\n")
    rows = readers.ingest_external_endpoints(spark, str(tmp_path / "a.js"))
    assert found(rows, "path", "method", "file", "source") == [("/api/x", "GET", "a.js", "LinkFinder")] * 2


def test_read_files(spark, tmp_path):
    (tmp_path / "a b+c.js").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.js").write_text("four")
    assert found(readers.read_files(spark, str(tmp_path), ".js"), "file", "content") == [("a b+c.js", "one\ntwo")]
    assert found(readers.read_files(spark, str(tmp_path)), "file") == [("a b+c.js",), ("b.txt",)]


def test_a_file_for_each_text_is_written_by_the_tasks(spark, tmp_path):
    texts = spark.createDataFrame([("a\nb",), ("é",), ("",), (None,)], "html string").repartition(3)
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        catalog._write_each(texts, folder)
        read = readers.read_files(spark, folder, suffix=".txt")
        assert sorted(r["content"] for r in read.collect()) == ["\n", "\n", "a\nb\n", "é\n"]
    # No driver's commit, which moves file by file, and nothing left half written.
    assert all(f.suffix == ".txt" and f.name.startswith("part-") for f in (tmp_path / "plain").iterdir())


def test_load_rules_from_folder(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "cloud").mkdir()
    (tmp_path / "cloud" / "a.yaml").write_text("category: c\npatterns:\n  - id: one\n    regex: 'custom_[0-9a-f]{32}'\n    entropy_check: true\n    min_entropy: 4.5\n")
    (tmp_path / "broken.yaml").write_text("patterns:\n  - id: x\n    regex: plain\nscalar\n  - id")
    (tmp_path / "b.json").write_text(json.dumps({"patterns": [{"id": "two", "regex": "(?<=x)y"}]}))
    (tmp_path / "notes.md").write_text("not a pack")
    rules, rejects = readers.load_rules(spark, str(tmp_path))
    assert [(r["rule_id"], r["min_entropy"]) for r in rules.rows] == [("one", 4.5)]
    assert sorted((r["path"].rsplit("/", 1)[1], r["rule_id"]) for r in rejects.collect()) == [("b.json", "two"), ("broken.yaml", None)]
    assert found(scan_secrets(files(spark, "custom_0123456789abcdef0123456789abcdef"), rules, "deep"), "rule_id") == []


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("u1", "a|b.js", True), ("u2", "c.js", False)], "url string, filename string, success boolean")
    writers.append_manifest(rows, path)
    writers.append_manifest(rows, path)
    assert found(readers.read_manifest(spark, path), "url", "filename") == [("u1", "a|b.js")]
    (tmp_path / "list.txt").write_text("u|old\nno bar\nu|new\n|empty\n")
    assert found(readers.read_manifest(spark, str(tmp_path / "list.txt")), "url", "filename") == [("", "empty"), ("u", "new")]


def test_sinks_append(spark, tmp_path):
    secrets = scan_secrets(files(spark, "key=abcd one=1"), RULES, "deep")
    paths = scan_endpoints(files(spark, "'/api/x1'"))
    for _ in range(2):
        writers.write_findings(secrets, str(tmp_path / "findings"))
        writers.write_endpoints(paths, str(tmp_path / "endpoints"))
        writers.write_scan_log({"secrets": secrets}, files(spark, "a"), {}, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == 4
    assert spark.read.parquet(str(tmp_path / "endpoints")).count() == 2
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_written_report_reads_in_order(spark, tmp_path):
    secrets = scan_secrets(files(spark, "key=abcd\nkey=wxyz", "one=1"), RULES, "deep")
    writers.write_report(reports.render_secret_report(secrets), str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[1] == "SECRET DETECTION REPORT" and lines[4] == "Total Secrets Found: 3"
    sections = [line for line in lines if line.startswith("DETECTOR")]
    assert sections[:3] == ["DETECTOR: TEMPLATE (CRITICAL) (1 findings)", "DETECTOR: TEMPLATE (HIGH) (2 findings)", "DETECTOR: TEMPLATE (MEDIUM) (0 findings)"]
    start = lines.index("DETECTOR: TEMPLATE (HIGH) (2 findings)")
    assert lines[start + 3 : start + 8] == ["[Finding #1]", "  File: f0", "  Type: pair", "  Line: 1", "  Secret: key=abcd"]
    assert reports.findings_by_detector(secrets, "reference").count() == 9


# ------------------------------------------------------------------- streams


def test_stream_scans_only_new_files(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    schema = "file string, content string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_scan_secrets(stream, out, progress, RULES).awaitTermination()
        return found(spark.read.parquet(out), "file", "value")

    files(spark, "key=abcd key=abcd").write.mode("append").parquet(source)
    assert run() == [("f0", "key=abcd")]
    spark.createDataFrame([("new", "key=wxyz")], schema).write.mode("append").parquet(source)
    assert run() == [("f0", "key=abcd"), ("new", "key=wxyz")]
    assert run() == [("f0", "key=abcd"), ("new", "key=wxyz")]


def test_stream_endpoints_equal_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("content"))
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    query = streams.stream_scan_endpoints(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    columns = ("file", "path", "method", "source")
    assert found(spark.read.parquet(str(tmp_path / "out")), *columns) == found(endpoints_of(pages), *columns)


def test_stream_dedupe_with_and_without_time(spark, tmp_path):
    rows = [("https://h/a.js", "2024-01-01 00:00:00"), (" https://h/a.js ", "2024-01-01 00:10:00"), ("https://h/b.css", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "url string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, event_time in (("plain", None), ("timed", "at")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = streams.stream_dedupe_urls(stream, event_time).writeStream.format("parquet").option("path", str(tmp_path / name))
        query.option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
        assert found(spark.read.parquet(str(tmp_path / name)), "url") == [("https://h/a.js",)]


def test_prefilter_pairs_are_exact(spark):
    df = files(spark, "KEY= zeta-", "flag-", "nothing")
    by_ord = {r["ord"]: r["keyword"] for r in RULES.rows if r["indexed"]}
    expected = sorted(
        (f"f{n}", o) for n, t in enumerate(["KEY= zeta-", "flag-", "nothing"]) for o, k in by_ord.items() if k.lower() in t.lower()
    )
    assert found(matching.prefilter(df, RULES), "file", "ord") == expected


def test_fast_findings_are_a_part_of_deep_matches(spark, sf_dir):
    from checks import catalog

    texts = catalog.files(spark, sf_dir)
    deep = {(r["file"], r["value"]) for r in scan_secrets(texts, mode="deep").collect()}
    fast = {(r["file"], r["value"]) for r in scan_secrets(texts, mode="fast").collect()}
    assert fast and fast <= deep and len(built_in().indexed()) < len(built_in())


def test_two_keys_in_one_text_are_two_findings(spark):
    block = "-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----"
    texts = [("a", f"{block.format('MIIE' * 700)}\nbetween\n{block.format('MIIF' * 9)}")]
    found = scan_secrets(spark.createDataFrame(texts, "file string, content string"), mode="deep").where("rule_id = 'pem-rsa-private-key'")
    assert sorted(len(r["value"]) for r in found.collect()) == sorted(len(block.format(x)) for x in ("MIIE" * 700, "MIIF" * 9))


def test_long_values_are_whole(spark):
    long = "A1b2C3d4/+" * 600
    texts = [("a", f'aws_session_token = "{long}x"\naws_session_token = "{long}y"\npassword = "{long}"\njwt_secret = "{long[:400]}"')]
    files = spark.createDataFrame(texts, "file string, content string")
    values = [r["value"] for r in scan_secrets(files, mode="deep").collect()]
    assert all(any(f"{long}{end}" in v for v in values) for end in "xy") and any("jwt_secret" in v and long[:400] in v for v in values)
    from spillwatch.operators.detectors import assigned_secrets

    assert any(long in r["value"] for r in assigned_secrets(files).collect())


def test_rule_that_matches_nothing_at_all(spark):
    from spillwatch.rules import RuleSet

    texts = [("a", "x1 " * 5), ("b", " ".join(f"x{k}" for k in range(200)))]
    rules = RuleSet.of([{"rule_id": "maybe", "regex": r"(?:x[0-9]+)?"}])
    found = scan_secrets(spark.createDataFrame(texts, "file string, content string"), rules, mode="deep")
    assert found.count() == 1 + 200


def test_streams_keep_the_splits_of_their_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "scratch", lambda spark, name: str(tmp_path / name))
    stream = catalog._as_stream(spark, spark.range(0, 700, 1, 7).toDF("n"), "many")
    assert len(list((tmp_path / "many").glob("part-*.parquet"))) == 7  # no three tasks that each read a third
    seen = []
    stream.writeStream.foreachBatch(lambda batch, _: seen.append([r.n for r in batch.collect()])).option(
        "checkpointLocation", str(tmp_path / "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sorted(n for batch in seen for n in batch) == list(range(700))
