from fractions import Fraction

import corpus_pipeline
from spillwatch.llm import decontam, quality, tokens

from . import brute

STAGES = dict(corpus_pipeline.STAGES)


def pairs(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_each_stage_equals_its_plain_version(spark, given, sf_dir, texts):
    from spillwatch.llm.common import stored

    docs = given("documents")
    columns = docs.columns
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, given("labels")).collect()}
    docs = stored(STAGES["quality"](spark, docs, sf_dir), "t")
    now = [(d, t) for d, t in texts if scored[d] == 1]
    assert docs.columns == columns and pairs(docs) == sorted(now, key=str)

    docs = stored(STAGES["line_dedup"](spark, docs, sf_dir), "t")
    wanted = {r[0]: r[3] for r in brute.line_dedup(now)}
    got = dict(pairs(docs))
    assert docs.columns == columns and {d: brute.sha(t) for d, t in got.items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = stored(STAGES["near_duplicates"](spark, docs, sf_dir), "t")
    stay = {d for d, _, c in brute.components(sorted(got.items()), 5, Fraction(4, 5)) if d == c}
    assert docs.columns == columns and {d for d, _ in pairs(docs)} == stay

    now = pairs(docs)
    docs = stored(STAGES["decontamination"](spark, docs, sf_dir), "t")
    items = [decontam.plain(r["text"])[0] for r in given("benchmark").collect()]
    held = {d for d, t in now if any(i in decontam.plain(t)[0] for i in items)}
    gone = {d for d, _ in now} - {d for d, _ in pairs(docs)}
    assert docs.columns == columns and held <= gone
    for d in gone - held:
        assert min(brute.edit_distance_to_part(i, decontam.plain(dict(now)[d])[0]) / len(i) for i in items) <= decontam.MAX_EDITS

    pieces = STAGES["packing"](spark, docs, sf_dir).collect()
    kept = pairs(docs)
    ids, starts = tokens.encoder(tokens.default_path()).encode([t for _, t in kept])
    sizes = dict(zip((d for d, _ in kept), (starts[1:] - starts[:-1]).tolist()))
    packed = {}
    for p in pieces:
        packed[p["doc_id"]] = packed.get(p["doc_id"], 0) + p["length"]
    assert packed == sizes


def test_odd_rows_pass_every_filter(spark, make_docs, sf_dir):
    rows = [(None, None), (None, "null number"), (1, ""), (2, "same words here and there again"), (2, "same words here and there again"), (3, "SAME words  here and there again"), (4, "other")]
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before, docs = docs.columns, stage(spark, docs, sf_dir)
        assert docs.columns == before, name
    assert pairs(docs) == sorted([(None, None), (None, "null number"), (1, ""), (2, "same words here and there again"), (4, "other")], key=str)


def test_unlike_texts_of_one_number_stay(spark, make_docs, sf_dir):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = make_docs([(5, a), (9, a), (9, b), (12, f"{b} more"), (20, c), (20, c), (20, "something else")])
    assert pairs(STAGES["near_duplicates"](spark, docs, sf_dir)) == sorted([(5, a), (9, b), (20, c), (20, "something else")], key=str)


def test_contaminated_rows_go_alone(spark, given, make_docs, sf_dir):
    item = given("benchmark").orderBy("item_id").first()["text"]
    clean = [(None, "clean words without a number"), (None, None), (7, "other clean words"), (8, "more")]
    docs = make_docs([(None, f"before {item} after"), (7, f"{item}!"), *clean])
    assert pairs(STAGES["decontamination"](spark, docs, sf_dir)) == sorted(clean, key=str)


def test_empty_table(spark, make_docs, sf_dir):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_run_gives_pieces(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).limit(1).count() == 1
