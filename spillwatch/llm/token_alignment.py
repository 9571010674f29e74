"""Alignment of two tokenizations of a text, and how many documents hold each pair of linked numbers.

A (byte-level) and B (pieces) give each text, with a space before it, two arrays of byte ends. Places where both have an end cut the tokens into
groups. ``align`` finds them by *diagonal run skipping*: at the current shift between the two numberings it compares blocks of the end arrays, each
block twice as long as the one before while all ends agree, and so jumps stretches of one token to one token. Where they part, the group is
resolved token by token, always on the side that ends first, until ends meet again, and the shift is what the numberings then differ by. Stretches
between ends known to be common are aligned side by side as lanes, so one array operation serves thousands of places.

``token_groups`` gives each row its groups. ``alignment_digest`` also counts, corpus-wide, the documents that hold a pair of an A and a B number
linked (token bytes that overlap), and sums these counts over each document's links:

1. Documents become tiles of about ``TILE_BYTES`` of text: per tile the distinct pairs with their number of documents, and which document holds
   which pair how often. Tiles are written once. A longer text is a tile of its own and is read in pieces.
2. The tiles' pairs are added up (one row per tile and pair, so a frequent pair is as many rows as there are tiles), with the highest count of
   each A number.
3. Pairs of each tile get their counts back by a join on the pair, come together by tile, and the sums per document follow.

Defined cases: null and empty texts, and texts whose joined token bytes are not the space and the text (a literal U+2581, say), have no tokens:
zeros and an empty hash column. Tokens give a text back if they give back each of its units, since B's bytes of a unit are never longer than the
unit. Each row is a document of its own, repeated rows and those with null ``doc_id`` too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, texts_of
from .unit_tokens import default_paths, encoder, unit_starts

TILE_DOCS, TILE_BYTES = 2048, 3 << 20
FIRST_BLOCK, LONGEST_BLOCK, LANE_TOKENS = 4, 1024, 128

_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
TILE = pa.schema(
    [("tile", pa.int64()), ("doc_id", _LONGS)]
    + [(name, _LONGS) for name in PER_DOC]
    + [("groups_sha256", pa.list_(pa.string())), ("a", _INTS), ("b", _INTS), ("docs", _INTS), ("holders", pa.binary()), ("links", pa.binary())]
)
TILE_DDL = (
    "tile long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "a array<int>, b array<int>, docs array<int>, holders binary, links binary"
)
DIGEST = pa.schema(
    [("doc_id", pa.int64()), *[(name, pa.int64()) for name in PER_DOC], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)
DIGEST_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligned:
    """Which tokens close a group, and the linked pairs by place."""

    def __init__(self, n_a: int, n_b: int):
        self.closes_a, self.closes_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray, closed) -> None:
        self.pairs.append((a, b))
        self.closes_a[a[closed]] = True
        self.closes_b[b[closed]] = True

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in self.pairs]), np.concatenate([p[1] for p in self.pairs])


def align(end_a: np.ndarray, end_b: np.ndarray, cuts_a: np.ndarray | None = None, cuts_b: np.ndarray | None = None) -> Aligned:
    """Groups of two arrays of rising byte ends with the same last end.

    ``cuts_a`` and ``cuts_b`` are numbers of tokens before known common ends, from 0 to all; each stretch between two is a lane.
    """
    if cuts_a is None:
        cuts_a, cuts_b = np.array([0, len(end_a)]), np.array([0, len(end_b)])
    out = Aligned(len(end_a), len(end_b))
    at, shift = cuts_a[:-1].astype(np.int64), (cuts_b[:-1] - cuts_a[:-1]).astype(np.int64)
    last_a, last_b = cuts_a[1:], cuts_b[1:]
    block = np.full(len(at), FIRST_BLOCK)
    live = np.flatnonzero(at < last_a)
    while len(live):
        parted, widths = [], block[live]
        for width in np.unique(widths):
            lanes = live[widths == width]
            # One token to one token, for as long as the ends agree at this shift.
            places = at[lanes, None] + np.arange(width)
            others = places + shift[lanes, None]
            inside = (places < last_a[lanes, None]) & (others < last_b[lanes, None])
            same = inside & (end_a[np.minimum(places, len(end_a) - 1)] == end_b[np.minimum(others, len(end_b) - 1)])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            chosen = np.arange(width) < run[:, None]
            out.link(places[chosen], others[chosen], slice(None))
            at[lanes] += run
            block[lanes] = np.minimum(2 * width, LONGEST_BLOCK)
            parted.append(lanes[(run < width) & (at[lanes] < last_a[lanes])])
        lanes = np.concatenate(parted)
        block[lanes] = FIRST_BLOCK
        a, b = at[lanes], at[lanes] + shift[lanes]
        while len(lanes):
            ends, other = end_a[a], end_b[b]
            met = ends == other
            out.link(a, b, met)
            at[lanes[met]], shift[lanes[met]] = a[met] + 1, b[met] - a[met]
            behind, lanes = ends < other, lanes[~met]
            a, b = (a + behind)[~met], (b + ~behind)[~met]
        live = live[at[live] < last_a[live]]
    return out


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Piece:
    """Tokens of a stretch of texts, aligned; ``rows`` says where each text begins in ``data``, and where the last ends."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, paths):
        tokens = encoder(paths)
        starts = unit_starts(data, rows[:-1][np.diff(rows) > 0]) if len(data) else np.zeros(0, np.int64)
        units = tokens.units(data, starts) if len(starts) else np.zeros(0, np.int64)
        text = np.searchsorted(rows, starts, "right") - 1
        self.whole = np.ones(len(rows) - 1, bool)
        self.whole[text[~tokens.whole[units]]] = False
        units, text = units[self.whole[text]], text[self.whole[text]]
        (self.a, size_a), (self.b, size_b) = (kept.of(units) for kept in tokens.kept)
        (end_a, end_b) = (np.cumsum(w.sizes[ids]) for w, ids in zip(tokens.words, (self.a, self.b)))
        upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
        # Lanes end with a unit, every so many tokens.
        lane = np.flatnonzero(np.diff(np.append(upto_a, 2**62) // LANE_TOKENS))
        found = align(end_a, end_b, np.append(0, upto_a[lane]), np.append(0, upto_b[lane])) if len(units) else Aligned(0, 0)
        self.closed_a, self.closed_b = np.flatnonzero(found.closes_a) + 1, np.flatnonzero(found.closes_b) + 1
        self.link_a, self.link_b = found.links()
        bounds = np.searchsorted(text, np.arange(len(rows)))
        self.from_a, self.from_b = np.append(0, upto_a)[bounds], np.append(0, upto_b)[bounds]
        self.first_group = np.searchsorted(self.closed_a, self.from_a, "right")
        self.text_of_link = np.searchsorted(self.from_a, self.link_a, "right") - 1
        self.codes = self.a[self.link_a].astype(np.int64) * len(tokens.words[1].bytes) + self.b[self.link_b]

    def counts(self) -> np.ndarray:
        """Tokens of A and B, groups and links of each text."""
        links = np.bincount(self.text_of_link, minlength=len(self.whole))
        return np.array([np.diff(self.from_a), np.diff(self.from_b), np.diff(self.first_group), links], np.int64)

    def group_lists(self):
        """The groups' token numbers as two Arrow lists."""
        sides = ((self.a, self.closed_a), (self.b, self.closed_b))
        return [_lists(np.append(0, closed), pa.array(ids, pa.int32())) for ids, closed in sides]

    def written(self) -> list[str]:
        """``a1,a2|b1;...`` of each text."""
        sides = [pc.binary_join(groups.cast(pa.list_(pa.string())), ",") for groups in self.group_lists()]
        return pc.binary_join(_lists(self.first_group, pc.binary_join_element_wise(*sides, "|")), ";").to_pylist()


def _spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, a space before each that is not empty, and where each begins."""
    parts = [b" " + t.encode() if t else b"" for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])


def _pieces(data: np.ndarray):
    """A long text in stretches that end where a unit does."""
    lo = 0
    while lo < len(data):
        hi = min(lo + TILE_BYTES, len(data))
        while hi < len(data):
            starts = unit_starts(data[hi - 8 : hi + 65536], np.zeros(0, np.int64))
            starts = starts[starts >= 8]
            if len(starts):
                hi += int(starts[0]) - 8
                break
            hi = min(hi + 65536 - 8, len(data))
        yield data[lo:hi]
        lo = hi


def _long_tile(data: np.ndarray, paths):
    """Counts, hash and pairs of one text, piece by piece."""
    counts, whole, digest = np.zeros((4, 1), np.int64), True, hashlib.sha256()
    codes, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for n, stretch in enumerate(_pieces(data)):
        piece = Piece(stretch, np.array([0, len(stretch)]), paths)
        whole &= bool(piece.whole[0])
        if not whole:
            return np.zeros((4, 1), np.int64), [""], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts += piece.counts()
        digest.update((";" if n else "").encode() + piece.written()[0].encode())
        some, times = np.unique(piece.codes, return_counts=True)
        codes, place = np.unique(np.concatenate([codes, some]), return_inverse=True)
        links = np.bincount(place, np.concatenate([links, times])).astype(np.int64)
    return counts, [digest.hexdigest()], codes, np.zeros(len(codes), np.int64), links


def _tile(texts: list[str], paths):
    """Counts and hashes of the texts; then pair, holder and number of links, in order of pair and holder."""
    data, rows = _spaced(texts)
    if len(texts) == 1 and len(data) > TILE_BYTES:
        return _long_tile(data, paths)
    piece = Piece(data, rows, paths)
    counts = piece.counts()
    hashes = [hashlib.sha256(w.encode()).hexdigest() if n else "" for w, n in zip(piece.written(), counts[0])]
    both, links = np.unique(piece.codes * TILE_DOCS + piece.text_of_link, return_counts=True)
    return counts, hashes, both // TILE_DOCS, both % TILE_DOCS, links


def _dealt(batches):
    """Documents in groups of bounded rows and characters; a longer one is alone."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        lo = held = 0
        for hi, size in enumerate(sizes.tolist()):
            if hi > lo and (hi - lo >= TILE_DOCS or held + size > TILE_BYTES):
                yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()
                lo, held = hi, 0
            held += size
        if len(sizes):
            yield ids.slice(lo), texts.slice(lo).to_pylist()


def _tiles(paths):
    def run(batches):
        size_b = None
        for n, (ids, texts) in enumerate(_dealt(batches)):
            counts, hashes, codes, holders, links = _tile(texts, paths)
            size_b = size_b or len(encoder(paths).words[1].bytes)
            new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
            pairs, docs = codes[new], np.diff(np.append(np.flatnonzero(new), len(codes)))
            values = [(TaskContext.get().partitionId() << 32) + n, ids.to_pylist(), *counts, hashes, pairs // size_b, pairs % size_b, docs]
            values += [holders.astype("<u2").tobytes(), links.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, TILE)], schema=TILE)

    return run


def _summed(batches):
    for batch in batches:
        for tile in range(batch.num_rows):
            def flat(name):
                return batch.column(name)[tile].values

            def numbers(name):
                return flat(name).to_numpy(zero_copy_only=False).astype(np.int64)

            ids, docs = flat("doc_id"), numbers("docs")
            holders = np.frombuffer(batch.column("holders")[tile].as_py(), "<u2")
            links = np.frombuffer(batch.column("links")[tile].as_py(), "<u4").astype(np.int64)
            held, best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            found = batch.column("found")[tile].values
            if found is not None and len(found):
                place = found.field("place").to_numpy(zero_copy_only=False)
                held[place] = found.field("held").to_numpy(zero_copy_only=False)
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
            pair = np.repeat(np.arange(len(docs)), docs)
            sums = np.zeros((2, len(ids)), np.int64)
            np.add.at(sums[0], holders, links * best[pair])
            np.add.at(sums[1], holders, links * held[pair])
            columns = [ids, *[flat(name) for name in PER_DOC], pa.array(sums[0]), pa.array(sums[1]), flat("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, schema=DIGEST)


def alignment_tiles(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    prepare(docs)
    return texts_of(docs).mapInArrow(_tiles(paths or default_paths()), TILE_DDL)


def link_counts(tiles: DataFrame) -> DataFrame:
    """``a, b, held, best``: in how many documents each pair is linked, and whether no other pair of its A number is in more."""
    pairs = tiles.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.a", "p.b", "p.docs")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("held")), "link-counts")
    highest = counts.groupBy("a").agg(F.max("held").alias("highest"))
    # One row per number of the vocabulary.
    return counts.join(F.broadcast(highest), "a").select("a", "b", "held", (F.col("held") == F.col("highest")).cast("int").alias("best"))


def alignment_digest(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: tokens, groups, links, and the sums of corpus-wide counts over its links."""
    tiles = stored(alignment_tiles(docs, paths), "alignment-tiles")
    counts = stored(link_counts(tiles), "link-ranks")
    asked = tiles.select("tile", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("tile", "place", "p.a", "p.b")
    found = asked.join(counts, ["a", "b"]).groupBy("tile").agg(F.collect_list(F.struct("place", "held", "best")).alias("found"))
    return tiles.drop("a", "b").join(found, "tile", "left").mapInArrow(_summed, DIGEST_DDL)


def _groups(paths):
    kind = pa.schema([("doc_id", pa.int64()), ("a", pa.list_(_INTS)), ("b", pa.list_(_INTS))])

    def run(batches):
        for ids, texts in _dealt(batches):
            data, rows = _spaced(texts)
            piece = Piece(data, rows, paths)
            sides = [_lists(piece.first_group, side) for side in piece.group_lists()]
            yield pa.RecordBatch.from_arrays([ids, *sides], schema=kind)

    return run


def token_groups(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id`` and the groups of each row: the A numbers and the B numbers of each group, in order."""
    prepare(docs)
    return texts_of(docs).mapInArrow(_groups(paths or default_paths()), "doc_id long, a array<array<int>>, b array<array<int>>")
