import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spillwatch.llm import id_coder, id_files, packing, tokens
from spillwatch.llm.common import new_folder

ODD = [
    "", " ", "a", "A.", "x,", "x.,", "É, ́b <|endoftext|> <|ENDOFTEXT|>, don't I'LL. 3.14", "a\x1c\x85b\xa0ǅ İ. Σ, ΑΣ.", "<|startoftext|>.", "'s, 's.",
    "x\x0by\x0cz", "word " * 3000, "😀" * 50,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def pieces():
    return tokens.PieceEncoder(tokens.default_path(), keep=500)


def whole(tokenizer, texts):
    return [[*e.ids, tokens.END_ID] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_numbers_of_whole_texts(tokenizer, pieces, texts):
    for part in (ODD, [t for _, t in texts], ODD):
        ids, starts = pieces.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole(tokenizer, part)


@settings(max_examples=60, deadline=None)
@drawn(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_pieces_give_the_numbers_of_any_text(drawn_texts):
    encoder = tokens.encoder(tokens.default_path())
    ids, starts = encoder.encode(drawn_texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole(encoder.tokenizer, drawn_texts)


def test_letters_and_marks_of_all_kinds(tokenizer):
    encoder = tokens.PieceEncoder(tokens.default_path())
    assert encoder.direct("élan...")
    parts = ["don't", "ab's'", "é", "é's", "ßüÿ÷×ªº", "naïve$$$", "a#b##", "x<|", "<|endoftext|>", "ab<|endoftext|>", "ÉTÉ!", "e\u0301t", "æøåþð???", "ﬁn.", "i\u0307", "a_b__", "ab/", "ab\\\\", "ab\"\"`~"]
    drawn = [" ".join(parts), *parts, *(p + m for p in parts for m in ("!!", "'", "'t.", "9", "—", "\u0301"))]
    ids, starts = encoder.encode(drawn)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole(tokenizer, drawn)


def test_kept_pieces_outlive_a_full_store():
    encoder = tokens.PieceEncoder(tokens.default_path(), keep=60)
    encoded = []
    encode_new = encoder._encode_new
    encoder._encode_new = lambda pieces: (encoded.extend(pieces), encode_new(pieces))
    for k in range(40):
        drawn = [f"often seen here word{'abcdefghij'[k % 10]}{'klmnopqrst'[j]}{'uvwx'[k // 10]} Ünd-{k}x{j}." for j in range(10)]
        ids, starts = encoder.encode(drawn)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole(encoder.tokenizer, drawn)
    assert encoded.count("often") == encoded.count(".") == 1 and len(encoder.index) < 100


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    blocks = [
        np.zeros(0, np.uint16), np.array([65535], np.uint16), np.full(5000, 7, np.uint16), rng.integers(0, 65536, 900).astype(np.uint16),
        np.tile(np.arange(9, dtype=np.uint16), 90),
    ]
    raw = id_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode_blocks(raw, [len(b) for b in blocks])))
    # Each block can be read alone, and what repeats gets small.
    assert np.array_equal(id_coder.decode_blocks(raw[4:], [len(blocks[4])])[0], blocks[4])
    assert len(raw[2]) < 100 and len(raw[4]) < 200


def test_blocks_are_smaller_than_order_0_and_zlib(texts):
    encoder = tokens.encoder(tokens.default_path())
    ids = np.concatenate([encoder.encode([t for _, t in texts])[0]] * 2)
    blocks = [ids[k : k + id_coder.BLOCK] for k in range(0, len(ids) // 2, id_coder.BLOCK)]
    table = id_coder.table_of(blocks)
    raw = id_coder.encode_blocks(blocks, table)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode_blocks(raw, [len(b) for b in blocks], table)))
    counts = np.bincount(np.concatenate(blocks))
    share = counts[counts > 0] / counts.sum()
    order0 = -(share * np.log2(share)).sum() / 8 * counts.sum()
    assert sum(map(len, raw)) < min(order0, sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks))
    # A block is read alone with the table, and a damaged one gives wrong numbers, but numbers.
    assert np.array_equal(id_coder.decode_blocks(raw[3:4], [len(blocks[3])], table)[0], blocks[3])
    hurt = id_coder.decode_blocks([raw[3][:50] + bytes(len(raw[3]) - 50), b"\xff" * 90, b""], [len(blocks[3])] * 3, table)
    assert all(len(h) == len(blocks[3]) and not np.array_equal(h, blocks[3]) for h in hurt)


@settings(max_examples=40, deadline=None)
@drawn(st.lists(st.lists(st.sampled_from([0, 1, 2, 7, 300, 65535]), max_size=70), max_size=5))
def test_any_blocks_come_back(drawn_blocks):
    blocks = [np.array(b, np.uint16) for b in drawn_blocks]
    for table in (None, id_coder.table_of(blocks)):
        decoded = id_coder.decode_blocks(id_coder.encode_blocks(blocks, table), [len(b) for b in blocks], table)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, decoded))


def file_rows(spark, docs):
    folder = new_folder(spark, "ids")
    id_files.write_ids(docs, folder)
    return folder, sorted((tuple(r) for r in id_files.read_ids(spark, folder).collect()), key=lambda r: r[1])


def test_files_come_back_in_order(spark, make_docs, tokenizer):
    rows = [(5, "five five"), (None, "no number"), (3, None), (9, "nine " * 9000), (4, ""), (5, "a twin"), (5, "a twin"), *((k, t) for k, t in enumerate(ODD, 100))]
    _, got = file_rows(spark, make_docs(rows))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (doc, _), ids in zip(ordered, whole(tokenizer, [t or "" for _, t in ordered])):
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_damage_is_found(spark, make_docs):
    from pyspark.sql import functions as F

    folder, _ = file_rows(spark, make_docs([(1, "some text"), (2, "other text")]))
    hurt = new_folder(spark, "hurt")
    spark.read.parquet(folder).withColumn("crc", F.col("crc") + 1).write.parquet(hurt)
    with pytest.raises(Exception, match="checksum"):
        id_files.read_ids(spark, hurt).collect()


def test_empty_table(spark, make_docs):
    assert file_rows(spark, make_docs([]))[1] == []
    assert packing.pack(make_docs([])).count() == 0


def test_texts_in_arrow_are_encoded_like_lists(make_docs, tokenizer):
    texts = ["one two, three.", "", "É <|x|> \n ünd 😀", "word " * 300, "a"]
    for array in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string())[1:]):
        slabs = list(tokens.encoded_slabs(array, tokens.default_path(), 20))
        listed = list(tokens.encoded_slabs(texts, tokens.default_path(), 20))
        assert [s[0] for s in slabs] == [s[0] for s in listed]
        assert all(np.array_equal(a, b) for one, two in zip(slabs, listed) for a, b in zip(one[1:], two[1:]))
    # Packing makes no Python strings of a batch of texts.
    assert "MapInArrow" in packing.pack(make_docs([(1, "one")]))._jdf.queryExecution().executedPlan().toString()


def check_packing(rows, ids_of, window=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = ids_of[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids_of)
    for pieces, size in [(v, len(ids_of[d])) for d, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for since, n in sorted(pieces):
            assert since == at
            at += n
        assert size is None and at <= window and (at == window or at & (at - 1) == 0) or at == size


def test_packing_keeps_every_number_once(make_docs, tokenizer):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (51, "long " * 20000)] + [(100 + k, "word and " * (k * 7)) for k in range(60)]
    ids = dict(zip((d for d, _ in rows), whole(tokenizer, [t or "" for _, t in rows])))
    check_packing(packing.pack(make_docs(rows)).collect(), ids)


@settings(max_examples=40, deadline=None)
@drawn(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([3, 8, 2000]))
def test_packer_pads_nothing(sizes, max_open):
    packer, windows = packing.Packer(32, max_open), []
    docs = [np.arange(n, dtype=np.uint16) for n in sizes]
    for k, ids in enumerate(docs):
        windows += packer.document(k, ids)
    windows += packer.close()
    got = {k: [] for k in range(len(docs))}
    for w in windows:
        n = sum(len(p[2]) for p in w)
        assert 0 < n <= 32 and n & (n - 1) == 0
        for doc, start, ids, total in w:
            got[doc].append((start, ids))
            assert total == len(docs[doc])
    for k, ids in enumerate(docs):
        assert np.array_equal(np.concatenate([x for _, x in sorted(got[k], key=lambda p: p[0])]), ids)


def test_rests_go_where_squares_grow_least():
    packer, counts = packing.Packer(16), lambda: {k: n for k, n in enumerate(packer.counts.tolist()) if n}
    place = lambda n: list(packer.document(0, np.zeros(n, np.uint16)))
    for _ in range(3):
        place(9)
    assert counts() == {9: 3}
    # A full window takes 5 off the sum of squares, a new one adds 1.
    assert len(place(7)) == 1 and counts() == {9: 2}
    place(3)
    assert counts() == {9: 1, 12: 1}


def test_numbers_can_be_kept(make_docs):
    row = packing.pack(make_docs([(1, "one two")]), with_ids=True).collect()
    got = np.frombuffer(b"".join(r["ids"] for r in sorted(row, key=lambda r: r["start"])), "<u2")
    assert got[-1] == tokens.END_ID
