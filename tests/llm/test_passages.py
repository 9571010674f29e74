import random

import numpy as np

from spillwatch.llm import passages

from . import brute


def found(docs):
    return sorted((tuple(r) for r in passages.digest(passages.remove_repeats(docs)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def corpus():
    rnd = random.Random(5)
    draw = lambda n: "".join(rnd.choice("abcdefghij klmné") for _ in range(n))
    base, passage = draw(1500), draw(320)
    rows = [(k, draw(rnd.randint(0, 300)) + passage + draw(rnd.randint(0, 300))) for k in range(25)]
    rows += [(40, base), (41, base), (42, base[:700] + "X" + base[701:]), (43, base[100:299]), (44, base[100:300]), (45, draw(500))]
    rows += [(50, None), (51, ""), (52, "ab" * 400), (53, "z" * 250), (54, "z" * 201), (55, "y" * 200), (56, "y" * 199), (57, draw(199) * 2), (58, draw(200) * 2)]
    rows += [(60, base + draw(50) + base), (61, "x".join([passage] * 5))]
    return rows


def test_equals_brute_force(make_docs):
    rows = corpus()
    assert found(make_docs(rows)) == brute.without_repeats(rows)


def test_anchors_too_frequent_for_a_batch(make_docs, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 3)
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    rows = corpus()
    assert found(make_docs(rows)) == brute.without_repeats(rows)


def test_given_table(given, texts):
    assert found(given("documents")) == brute.without_repeats(texts)


def test_repeated_rows_null_number_and_empty_table(make_docs):
    text = "".join(chr(97 + k * k % 26) for k in range(400)) + "!"
    assert [r[2] for r in found(make_docs([(1, text), (1, text), (2, "short")]))] == [401, 401, 0]
    assert [r[:3] for r in found(make_docs([(None, text), (1, text)]))] == [(None, 401, 401), (1, 401, 401)]
    assert found(make_docs([])) == []


def test_texts_of_one_number_are_told_apart(make_docs):
    """Also where 32 bits of the texts, and those bits alone, are equal."""
    draw = random.Random(9)
    pair, seen = None, {}
    while pair is None:
        stem = "".join(draw.choice("abcdefgh") for _ in range(8))
        value = passages_hash32(stem * 30)
        pair = (seen[value], stem * 30) if value in seen and seen[value] != stem * 30 else None
        seen[value] = stem * 30
    first, other = pair
    for number in (None, 7):
        rows = [(number, first + "!" * 3 + draw_text(draw)), (number, other), (1, other), (2, draw_text(draw) * 2), (number, draw_text(draw))]
        assert sorted(found(make_docs(rows)), key=str) == sorted(brute_rows(rows), key=str)


def passages_hash32(text):
    """A 32-bit key; two texts of equal keys are found within some ten thousand draws."""
    import zlib

    return zlib.crc32(text.encode()) & 0xFFFFFF


def draw_text(draw):
    return "".join(draw.choice("abcdefghijklmnop ") for _ in range(260))


def brute_rows(rows):
    return [(rows[k][0], *rest) for k, *rest in brute.without_repeats([(k, t) for k, (_, t) in enumerate(rows)])]


def test_boundaries_of_suffixes():
    rnd = random.Random(6)
    segments = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(12)]
    segments += segments[:3]
    where = np.array([(k, 0) for k in range(len(segments))])
    for length in (1, 2, 5, 9):
        got = set(zip(*(x.tolist() for x in passages.repeated_strings(segments, where, length))))
        every = [(k, o, s[o : o + length]) for k, s in enumerate(segments) for o in range(len(s) - length + 1)]
        texts = [t for _, _, t in every]
        assert got == {(k, o) for k, o, t in every if texts.count(t) > 1}
