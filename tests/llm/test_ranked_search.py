import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given as drawn
from hypothesis import strategies as st

from checks.compare import rows_of_spark, rows_of_sql
from spillwatch.llm import queries, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """The formula, document by document."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    count = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        scored = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * count) // total if total else 0
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        key = hashlib.md5(text.encode()).hexdigest()
        out += [(item, n, None if gone else d, -s, key) for n, (s, gone, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, k=10):
    return sorted(map(tuple, ranked_search.search(docs, items, k).collect()), key=str)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, doc_id string, score string, rank string")


DOCS = (
    [(k, "the same words again") for k in range(40, 0, -1)]
    + [(None, "the same words again"), (None, None), (7, "other words"), (7, "other words"), (7, "words, WORDS; words_words")]
    + [(100, ""), (101, "  .,!"), (102, "naïve café 東京 ÉCOLE école"), (103, "a\x00b c\x7fd e`f g{h i@j"), (104, "rare1 " * 700 + "same"), (105, "x" * 5000)]
    + [(200 + k, f"word{k} word{k + 1} the") for k in range(700)]
)
ITEMS = [(1, "same words"), (1, "words other"), (1, "same words"), (2, None), (3, ""), (None, "rare1 rare1 same"), (4, "absent"), (5, "ÉCOLE café NAÏVE"), (6, "B d F h J the"), (8, "the " * 3000)]
ITEMS += [(20 + k, f"word{k} word{3 * k} the same") for k in range(300)]


@pytest.mark.parametrize("parts", [1, 7])
def test_agrees_with_the_formula(make_docs, make_items, parts):
    docs, items = make_docs(DOCS).repartition(parts), make_items([(i, t, "own", "own", "own") for i, t in ITEMS])
    assert found(docs, items) == plain(DOCS, ITEMS)


def test_small_tiles_slices_and_pieces(make_docs, make_items, monkeypatch):
    for name, value in [("TILE_DOCS", 5), ("TILE_BYTES", 200), ("PIECE_BYTES", 64), ("SLICE_ITEMS", 3), ("COLUMNS", 2), ("KEPT_ROWS", 40), ("BROADCAST_TERMS", 1)]:
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = make_docs(DOCS[:60]).repartition(3), make_items([(i, t, "own", "own", "own") for i, t in ITEMS[:40]])
    assert found(docs, items, 4) == plain(DOCS[:60], ITEMS[:40], 4)


def test_empty_tables(make_docs, make_items):
    docs, items = make_docs(DOCS[:3]), make_items([(1, "same", "", "", "")])
    assert found(docs.filter("doc_id < 0"), items) == found(docs, items.filter("item_id < 0")) == found(docs, make_items([(1, "..", "", "", "")])) == []


def test_query_agrees_with_its_sql(spark, duck, sf_dir):
    mine, theirs = rows_of_spark(queries.QUERIES["op11_ranked_search"](spark, sf_dir)), rows_of_sql(duck, queries.ORACLE["op11_ranked_search"])
    assert mine == theirs and sum(mine[1].values()) > 100


@drawn(st.lists(st.lists(st.integers(0, 10**6), min_size=5, max_size=5), min_size=1, max_size=4), st.integers(10, 40))
def test_products_stay_below_the_bound_and_are_exact(weights, bits):
    weights = np.array(weights, np.int64)
    impacts = np.arange(15).reshape(5, 3) * 66_000.0
    bound = 2**bits
    if bound > ranked_search.IMPACT_LIMIT:
        limit = (bound - 1) // ranked_search.IMPACT_LIMIT
        for part in ranked_search.weight_columns(weights // 10**4, limit):
            for lo, hi in ranked_search.column_cuts(part, limit):
                assert part[:, lo:hi].sum(axis=1).max() * ranked_search.IMPACT_LIMIT < bound
        assert (ranked_search.scores(weights // 10**4, impacts, bound) == (weights // 10**4) @ impacts.astype(np.int64)).all()


def test_a_long_row_equals_its_pieces(monkeypatch):
    text = "".join(f"w{k % 97}{'é' * (k % 5)}{' .-_'[k % 4]}" for k in range(5000)).encode()
    folded, everything = ranked_search._FOLD[np.frombuffer(text, np.uint8)], np.full(ranked_search.MAP_BITS // 8, 255, np.uint8)
    whole = ranked_search._long_row(folded, everything)
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 50)
    pieces = ranked_search._long_row(folded, everything)
    want = Counter(terms(text.decode()))
    for n, names, (_, term, tf) in (whole, pieces):
        assert n[0] == sum(want.values()) and {names[t].decode(): c for t, c in zip(term.tolist(), tf.tolist())} == want
