import hashlib

import numpy as np

from spillwatch.llm import phrase_prints

from . import brute


def expected(rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (doc, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = phrase_prints.edited_text(text, following)
        a, b, c = (phrase_prints.fingerprint(t) for t in (text, edited, following))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, phrase_prints.likeness(a, b), phrase_prints.likeness(a, c)))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in phrase_prints.neighbour_prints(docs).collect()), key=str)


def test_given_table(given, texts):
    assert found(given("documents")) == expected(texts)


def test_odd_rows(make_docs):
    rows = [(9, "é😀" * 50), (None, "first"), (3, None), (4, ""), (5, "a"), (6, "twin text"), (6, "twin text"), (6, "another"), (8, "long " * 9000)]
    assert found(make_docs(rows)) == expected(rows)
    assert found(make_docs([(1, "alone at home")])) == expected([(1, "alone at home")])
    assert found(make_docs([])) == []


def test_phrases_are_those_of_a_plain_parse():
    for text in ("", "a", "aaaaaaaa", "abababcabc", "é" * 9 + "xyz"):
        ends, _ = phrase_prints.parse(text, set())
        assert {text[a:b] for a, b in zip([0, *ends], ends)} == brute.phrases(text)


def test_paths_give_the_phrases_of_the_definition(texts):
    for text in ["", "a", "aaaaaaaa", "é" * 9 + "xyz", "a\ud800\U0001f600a\U0001f600", *(t for _, t in texts[:60])]:
        for cut in (0, len(text) // 3, len(text)):
            seen, root = set(), {}
            head, resume = phrase_prints.parse(text, seen, 0, cut)
            assert phrase_prints.walk(text, root, 0, cut)[:2] == (head, resume)
            assert phrase_prints.walk(text, root, resume)[:2] == phrase_prints.parse(text, seen, resume)


def test_known_minima_end_the_rounds_early(texts, monkeypatch):
    rounds = []
    mixed = phrase_prints._mixed
    monkeypatch.setattr(phrase_prints, "_mixed", lambda x: rounds.append(len(x)) or mixed(x))
    for _, text in texts[:60]:
        ends, _ = phrase_prints.parse(text, set())
        codes, half = phrase_prints.codes_of(text), len(ends) * 3 // 4
        if not half:
            continue
        whole, head = phrase_prints.minima(codes, 0, ends), phrase_prints.minima(codes, 0, ends[:half])
        rounds.clear()
        tail = phrase_prints.minima(codes, ends[half - 1], ends[half:], head)
        assert np.array_equal(np.minimum(head, tail), whole)
        assert len(rounds) <= int(head.max() >> np.uint64(55)) + 2


def test_likeness_follows_the_phrase_sets(texts):
    long_ones = [t for _, t in texts if len(t) > 2000][:40]
    prints, sets = [phrase_prints.fingerprint(t) for t in long_ones], [brute.phrases(t) for t in long_ones]
    error = [phrase_prints.likeness(prints[k], prints[k - 1]) - len(sets[k] & sets[k - 1]) / len(sets[k] | sets[k - 1]) for k in range(len(sets))]
    assert abs(np.mean(error)) < 0.03 and np.max(np.abs(error)) < 0.2


def test_edited_texts_are_nearer_than_the_next(given):
    rows = [r for r in phrase_prints.neighbour_prints(given("documents")).collect() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97
