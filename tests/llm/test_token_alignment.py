import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st

from spillwatch.llm import queries, token_alignment, unit_tokens

ODD = [
    "", None, " ", "  ", "\n", "a", " a  b ", "tail  \n ", "x\n\n  y\t z", " a 　b c  d", "é è\nô  ç", "東京 は\n大 きい", "😀 😀😀 a", "<|endoftext|> <s> </s> <0x0A> [INST]",
    "a▁b", "▁", "plain ▁ mark", "\x00 nul\x00", "\x85 \x1c a\x1cb \x1c", "don't we'll I'M", "ﬁ é ÅÅ", "1234567890 12 3.14", "=" * 300, "    def f(x):\n        return x\r\n\r\n",
    "word " * 700, "same text of some length, and again", "same text of some length, and again", "   a  b  c  d ﻿e ​f",
]


@pytest.fixture(scope="module")
def libraries():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = unit_tokens.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    back, letters = {v: k for k, v in a.get_vocab().items()}, unit_tokens.byte_letters()

    def encode(text):
        """Numbers and bytes of both, over the whole text."""
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in back[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        want = (" " + text).encode()
        return (ids_a, ids_b, bytes_a, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == want else ([], [], [], [])

    return encode


def plain_links(size_a, size_b):
    """Overlaps of all tokens, and places where both end."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    links = [(i, j) for i in range(len(size_a)) for j in range(len(size_b)) if max(end_a[i] - size_a[i], end_b[j] - size_b[j]) < min(end_a[i], end_b[j])]
    return links, sorted(set(end_a.tolist()) & set(end_b.tolist()))


def plain(rows, encode):
    documents = []
    for doc, text in rows:
        ids_a, ids_b, bytes_a, bytes_b = encode(text)
        groups, links, i, j, first_a, first_b = [], [], 0, 0, 0, 0
        at_a, at_b = (len(bytes_a[0]), len(bytes_b[0])) if ids_a else (0, 0)
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            if at_a == at_b:
                groups.append(",".join(map(str, ids_a[first_a : i + 1])) + "|" + ",".join(map(str, ids_b[first_b : j + 1])))
                first_a, first_b = i + 1, j + 1
            step_a, step_b = at_a <= at_b, at_b <= at_a
            if step_a:
                i += 1
                at_a += len(bytes_a[i]) if i < len(ids_a) else 0
            if step_b:
                j += 1
                at_b += len(bytes_b[j]) if j < len(ids_b) else 0
        documents.append((doc, ids_a, ids_b, groups, links))
    count = Counter(pair for *_, links in documents for pair in set(links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for doc, ids_a, ids_b, groups, links in documents:
        name = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), name))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@drawn(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=60), st.integers(1, 30), st.booleans(), st.integers(1, 3))
def test_alignment_by_skipping_equals_all_overlaps(sizes, lanes, alike, repeats):
    size_a = [a for a, _ in sizes]
    size_b = list(size_a) if alike else [b for _, b in sizes]
    rest = sum(size_a) - sum(size_b)
    (size_b if rest > 0 else size_a).extend([1] * abs(rest))
    size_a, size_b = size_a * repeats + [9] * 20 * (repeats - 1), size_b * repeats + [9] * 20 * (repeats - 1)
    links, ends = plain_links(size_a, size_b)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = sorted({0, ends[-1], *ends[:: max(1, len(ends) // lanes)]})
    for some in ([0, ends[-1]], cuts):
        cuts_a, cuts_b = (np.searchsorted(np.append(0, e), some) for e in (end_a, end_b))
        got = token_alignment.align(end_a, end_b, cuts_a, cuts_b)
        assert sorted(zip(*map(np.ndarray.tolist, got.links()))) == links
        assert end_a[got.closes_a].tolist() == end_b[got.closes_b].tolist() == ends


@settings(max_examples=150, deadline=None)
@drawn(st.text(st.sampled_from(list(" \n\t aéb東😀'.1- 　▁\x85")), max_size=40))
def test_units_give_the_numbers_of_whole_texts(libraries, text):
    ids_a, ids_b, *_ = libraries(text)
    piece = token_alignment.Piece(*token_alignment._spaced([text]), unit_tokens.default_paths())
    assert (piece.a.tolist(), piece.b.tolist()) == (ids_a, ids_b)


def test_units_of_all_given_texts(libraries, texts):
    piece = token_alignment.Piece(*token_alignment._spaced([t for _, t in texts]), unit_tokens.default_paths())
    assert piece.a.tolist() == [i for _, t in texts for i in libraries(t)[0]] and piece.b.tolist() == [i for _, t in texts for i in libraries(t)[1]]


@pytest.mark.parametrize("small", [False, True])
def test_agrees_with_the_plain_version(make_docs, texts, libraries, monkeypatch, small):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null number"), (None, "null number"), (3, "again 3")] + [(d + 100, t) for d, t in texts]
    if small:
        for name, value in [("TILE_DOCS", 3), ("TILE_BYTES", 500), ("LANE_TOKENS", 7)]:
            monkeypatch.setattr(token_alignment, name, value)
    got = token_alignment.alignment_digest(make_docs(rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, libraries)


def test_groups_of_rows(make_docs, libraries):
    rows = [(k, t) for k, t in enumerate(ODD)]
    for row in token_alignment.token_groups(make_docs(rows)).collect():
        ids_a, ids_b, *_ = libraries(rows[row["doc_id"]][1])
        assert sum(row["a"], []) == ids_a and sum(row["b"], []) == ids_b and len(row["a"]) == len(row["b"])


def test_forgetting_units_changes_nothing(texts):
    small, large = (unit_tokens.UnitEncoder(*unit_tokens.default_paths(), keep=keep) for keep in (50, 10**6))
    for _, text in texts:
        data, rows = token_alignment._spaced([text])
        starts = unit_tokens.unit_starts(data, rows[:1]) if len(data) else rows[:0]
        (a, b), (c, d) = ([k.of(units)[0].tolist() for k in e.kept] for e in (small, large) for units in [e.units(data, starts)])
        assert (a, b) == (c, d)


def test_empty_table_and_the_query(make_docs, spark, sf_dir):
    assert token_alignment.alignment_digest(make_docs([(1, "x")]).filter("doc_id > 1")).collect() == []
    got = queries.QUERIES["op12_token_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.filter("n_groups > 0 and n_best > 0").count() > 100
