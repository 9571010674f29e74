"""Classifiers and decontamination: held-out accuracy, recall, odd rows."""

import random
import zlib

import numpy as np
import pytest

from spillwatch.llm import decontam, licenses, quality, queries

from . import brute


@pytest.fixture(scope="module")
def scored(spark):
    rows = queries.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    return rows, labels


def test_quality_on_held_out_rows(scored):
    rows, labels = scored
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y == 1]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)] + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(k, "GOOD text" if k % 2 else "###bad###") for k in range(1, 40)] + [(None, None), (50, ""), (51, "x"), (52, "long text " * 60000), (1, "GOOD text")])
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 44 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert quality.score_documents(make_docs([]), labels).count() == 0
    none = quality.score_documents(make_docs([(1, "x")]), labels.limit(0)).first()
    assert none["score"] == quality.PRIOR


def test_every_byte_is_scored():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(0, 1, (4, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.ones(2 * quality.FILTERS, np.float32), 0.0)
    tables = net.pair_tables()
    text = rng.integers(1, 256, quality.SLAB + 777).astype(np.uint8)
    padded = np.concatenate([text, np.zeros(3, np.uint8)])
    all_at_once = sum(net.bytes_[w][padded[w : w + len(text)]] for w in range(4)).max(axis=0)
    got = quality.pooled([text.tobytes()], net, tables)[0, quality.FILTERS :]
    assert np.allclose(got, np.maximum(all_at_once, 0), atol=1e-3)


def mutated(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        what = rnd.randrange(3)
        if what == 0:
            out[k] = rnd.choice("abcdefgh")
        elif what == 1:
            out.insert(k, rnd.choice("abcdefgh"))
        else:
            del out[k]
    return "".join(out)


def test_recall_of_edited_items(spark, given, texts):
    rnd = random.Random(8)
    items = sorted((r["item_id"], r["text"]) for r in given("benchmark").collect())
    index, wanted, hit = decontam.Index(items), 0, 0
    for k, (_, text) in enumerate(items):
        for share in (0.0, 0.05, 0.1, 0.15):
            near = mutated(rnd, text, int(share * len(text)))
            if brute.edit_distance_to_part(decontam.plain(text)[0], decontam.plain(near)[0]) > decontam.MAX_EDITS * len(text):
                continue
            found = index.matches([f"{texts[k][1][:300]} {near} {texts[k + 1][1][:300]}"])[0]
            wanted += 1
            hit += k in [f[0] for f in found]
    assert wanted > 100 and hit / wanted >= 0.95


def test_found_documents_are_those_that_hold_items(spark, given, sf_dir, texts):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    items = [(r["item_id"], decontam.plain(r["text"])[0]) for r in given("benchmark").collect()]
    plain = [(d, decontam.plain(t)[0]) for d, t in texts]
    held = {(d, i) for d, t in plain for i, x in items if x in t}
    assert held and held <= got
    by_doc, by_item = dict(plain), dict(items)
    for d, i in got - held:
        assert brute.edit_distance_to_part(by_item[i], by_doc[d]) <= decontam.MAX_EDITS * len(by_item[i])


def test_decontamination_of_odd_rows(spark, make_docs, monkeypatch):
    items = spark.createDataFrame([(1, "tiny one", "x"), (2, None, "x"), (3, "", "x"), (4, "A benchmark item of some length, with words", "x"), (None, "an item without a number but with words", "x")], "item_id long, text string, doc_id string")
    docs = make_docs([
        (1, "so TINY\none it is"), (2, "tiny onesies"), (3, None), (4, ""), (None, "a  benchmark\nitem of sum length, with words!"), (5, "see: an item without a number but with words"),
        (6, "clean words only"), (6, "clean words only"), (7, "word " * 50000 + "a benchmark item of some length, with words"),
    ])
    want = {(1, 1), (None, 4), (5, None), (7, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()} == want
    monkeypatch.setattr(decontam, "INDEX_BYTES", 40)  # several passes
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()} == want
    assert decontam.contaminated(make_docs([]), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_bit_parallel_distance_equals_the_table():
    rnd = random.Random(9)
    for _ in range(80):
        a, b = (bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, n))) for n in (25, 50))
        assert decontam.least_distance(a, b)[0] == brute.edit_distance_to_part(a, b)


@pytest.fixture(scope="module")
def model(texts):
    return licenses.train([line for _, t in texts for line in t.split("\n")[:8] if "icens" not in line][:1500])


def test_licences_of_the_corpus(model, texts):
    marks = {"mit": "MIT License", "apache-2.0": "Apache License", "gpl": "GNU General", "cc-by-nc": "CC BY-NC"}
    got = {(k, f) for k, f, *_ in model.scan([t for _, t in texts])}
    assert got == {(k, f) for k, (_, t) in enumerate(texts) for f, mark in marks.items() if mark in t} and got


def test_held_out_wordings(model):
    said = {
        "mit": "This file is released under the MIT license, see LICENSE for details.", "apache-2.0": "Licensed under the Apache License,\nversion 2.0 (the License)",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0.",
    }
    for family, text in said.items():
        assert family in [f for _, f, *_ in model.scan([text])], family
    clean = ["My driving license was renewed in 2020.", "The apache helicopter flew over MIT.", "", "version 2.0", "public domain of thought and other essays"]
    assert model.scan(clean) == []


def families(model, text):
    return [f for _, f, *_ in model.scan([text])]


def test_every_identifier_of_the_families(model):
    missed = [(f, i, got) for f, ids in licenses.SPDX.items() for i in ids for got in [families(model, f"SPDX-License-Identifier: {i}")] if got != [f]]
    assert not missed


def test_two_licences_of_one_line(model):
    assert families(model, "SPDX-License-Identifier: MIT OR Apache-2.0") == ["apache-2.0", "mit"]
    assert families(model, "Licensed under either of the Apache License, Version 2.0 or the MIT license") == ["apache-2.0", "mit"]
    assert families(model, "SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause") == ["bsd", "gpl"]


def test_other_licences_stay_unknown(model):
    for text in ["Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "Distributed under the Boost Software License, Version 1.0."]:
        assert families(model, text) == [], text
    for text in ["SPDX-License-Identifier: CDDL-1.1", "Licensed under the Open Software License version 3.0", "the license version 2.0 identifier", "Sleepycat License"]:
        assert families(model, text) == [], text


def test_short_notices_and_whole_licences(model):
    assert families(model, "License: MIT") == ["mit"] and families(model, "license: Apache-2.0") == ["apache-2.0"]
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    assert families(model, warranty) == ["mit"]
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert families(model, text.capitalize() + ".") == [family], text


def test_licences_of_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "Released under the MIT License."), (3, "word " * 30000 + "Licensed under CC BY-NC 4.0."), (4, "x"), (4, "x")])
    got = {(r["doc_id"], r["family"]) for r in licenses.scan_licences(docs).collect()}
    assert got == {(None, "mit"), (3, "cc-by-nc")}
    assert licenses.scan_licences(make_docs([])).count() == 0
