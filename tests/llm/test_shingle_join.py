import random
from fractions import Fraction

import numpy as np
import pytest

from spillwatch.llm import shingle_join
from spillwatch.llm.components import components

from . import brute


def found(docs, words, t):
    return sorted(tuple(r) for r in shingle_join.linked_components(docs, words, t).collect())


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return out


def corpus():
    """Copies, chains of near copies on both sides of the threshold, a passage that all share, tiny and odd texts."""
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    rows, at = [], 0
    for size in (12, 40, 200, 700):
        for _ in range(3):
            base = [f"w{rnd.randrange(10**6)}" for _ in range(size)] + passage
            for _ in range(12):
                rows.append((at, " ".join(base)))
                at += 1
                if rnd.random() < 0.4:
                    base = edited(rnd, base, max(1, size // rnd.choice([20, 60, 100])))
                else:
                    rows.append((at, "  ".join(edited(rnd, base, rnd.choice([1, 2, size // 30 + 1]))).upper()))
                    at += 1
    rows += [(at + 1, None), (at + 2, ""), (at + 3, " \n"), (at + 4, "one"), (at + 5, "ONE"), (at + 6, "one two"), (at + 7, "a b " * 60), (at + 8, "b a " * 60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(make_docs, words, t):
    rows = corpus()
    assert found(make_docs(rows), words, t) == brute.components(rows, words, t)


def test_small_blocks_lose_nothing(make_docs, monkeypatch):
    # The cut of large groups into pairs of blocks, on groups of a few.
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    monkeypatch.setattr(shingle_join, "PARTNERS", 3)
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", 0)
    rows = corpus()[:150]
    assert found(make_docs(rows), 3, Fraction(9, 10)) == brute.components(rows, 3, Fraction(9, 10))


def test_only_nodes_with_open_pairs_go_on():
    # Many unlike sets share a print with near ones of three components: two of them, 1 and 2, are alike.
    rng = np.random.default_rng(6)
    t, bits = Fraction(9, 10), shingle_join.bitmap_bits(100)
    near = rng.integers(0, 2**64, 100, np.uint64, endpoint=False)
    sets = [np.unique(np.r_[near[: 100 - k], rng.integers(0, 2**64, k, np.uint64, endpoint=False)]) for k in (0, 1, 1, 2)]
    sets += [np.unique(rng.integers(0, 2**64, 100, np.uint64, endpoint=False)) for _ in range(200)]
    rows = [(len(s), k, 1 if k == 2 else k, 0, shingle_join.bitmap(s, bits).tobytes(), frozenset()) for k, s in enumerate(sets)]
    pairs, waiting = shingle_join.pairs_of_tile(list(rows), t, 1)
    assert len(pairs) == 2 and {k for pair in pairs for k in pair} <= {0, 1, 2, 3}
    # Three components have a forest of two pairs; the other pairs between them wait, and nobody else does.
    assert waiting == [0, 1, 2, 3]
    every, none = shingle_join.pairs_of_tile(list(rows), t, 16)
    assert sorted(every) == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)] and none == []
    tried = [(*row[:5], frozenset(a + b - row[1] for a, b in every if row[1] in (a, b))) for row in rows]
    assert shingle_join.pairs_of_tile(tried, t, 16) == ([], [])


def test_given_table(given, texts):
    t = Fraction(9, 10)
    assert found(given("documents"), 3, t) == brute.components(texts, 3, t)


def test_repeated_rows_null_numbers_and_empty_table(make_docs):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "x y z")]
    got = [tuple(r) for r in shingle_join.linked_components(make_docs(rows), 3, Fraction(9, 10)).collect()]
    assert sorted(got, key=str) == [(2, 1, 2), (3, 2, None), (3, 2, None), (None, 2, None)]
    assert shingle_join.linked_components(make_docs([])).count() == 0


def test_documents_with_several_texts(make_docs):
    a, b, c, d, e, f = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcdef")
    t = Fraction(4, 5)
    rows = [(5, a), (9, a), (9, b), (12, f"{b} more"), (25, c), (26, d), (29, c), (29, d), (35, e), (39, e), (39, ""), (41, f), (49, f), (49, f"{a} {e}"), (50, "")]
    assert found(make_docs(rows), 5, t) == brute.components(rows, 5, t)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (5, 80, 900):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        bits = shingle_join.bitmap_bits(len(a))
        most = shingle_join.most_overlap(len(a), len(b), *(shingle_join.folded(shingle_join.bitmap(s, 2 * bits).tobytes(), bits) for s in (a, b)))
        assert most >= len(np.intersect1d(a, b))


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 90, 95: 90}
