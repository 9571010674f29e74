"""Ranked lexical search of every item over all documents, by dense matrix products of compact tiles.

``search`` gives each item its ``k`` best documents. Terms, weights and scores are whole numbers (see ``queries.RANKED_SQL`` for the
formula): a document's score is the sum over the item's terms of the term's weight times the document's impact of that term.

1. Documents become *tiles* of at most ``TILE_DOCS`` rows and about ``TILE_BYTES`` of text: per tile the terms that items may hold, and where
   and how often they occur. What items may hold is a bitmap of term hashes, 1 MB however many items there are; it only saves space. A longer
   text is read piece by piece. Tiles are written once.
2. The number of documents and terms and each term's documents come from the tiles; a term's weight follows.
3. Items are dealt into *slices* of about ``SLICE_ITEMS`` items and ``SLICE_TERMS`` terms. Every tile meets every slice: the terms that both
   hold are the columns of two dense float64 matrices, item weights and document impacts, multiplied by BLAS over at most ``COLUMNS`` columns at a
   time. An impact is below 10**6, so columns are also cut where a row's weights would let a partial sum reach 2**53; every partial product is a
   whole number and exact, and is added as a 64-bit integer.
4. A task keeps the best ``k`` of each item over its tiles: all scores above the k-th and, of those equal to it, the least ``doc_id``. A window
   over the items takes the best of all tasks.

Slices are broadcast if they have at most ``BROADCAST_TERMS`` terms in all, and shuffled to the tiles otherwise. Nothing of documents or items
goes to the driver but counts and the bitmap.

Defined cases: null text has no terms; an item without terms, or whose terms no document holds, has no rows; rows of documents with one
``doc_id`` are ranked apart; null ``doc_id`` comes last among equal scores; items with equal ``item_id`` and text are one, with equal ``item_id``
alone they are told apart by ``item_key``; a null ``item_id`` is an item too; other columns are ignored; empty tables give no rows. Scores of
items whose terms occur so often that they pass 2**63 are not defined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, prepare, stored, text_key, texts_of

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
TILE_DOCS, TILE_BYTES, PIECE_BYTES = 512, 4 << 20, 2 << 20
SLICE_ITEMS, SLICE_TERMS, BROADCAST_TERMS = 128, 20_000, 1_000_000
COLUMNS = 1024
MAP_BITS, BUCKET_BITS = 1 << 23, 1 << 15
IMPACT_LIMIT = 10**6
# Candidates that a task keeps before it hands them on.
KEPT_ROWS = 1_000_000

TILE = (
    "docs long, total long, doc_id array<long>, n array<long>, terms array<string>, df array<long>, at_doc array<int>, at_term array<int>, tf array<int>"
)
FOUND = "item_id long, item_key string, doc_id long, score long"

# Bytes of a term in lower case, 0 for those that part terms.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0
_FOLD[65:91] += 32


def term_position(column):
    """Which bit of the map stands for a term; from 1."""
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS)) + 1


def _has_bit(bitmap: np.ndarray, terms: list[bytes]) -> np.ndarray:
    places = np.fromiter((xxhash.xxh64_intdigest(t, 42) % MAP_BITS for t in terms), np.int64, len(terms))
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _counted(folded: np.ndarray, rows: np.ndarray, bitmap: np.ndarray):
    """Terms of a stretch of folded bytes; ``rows`` says where each row begins in it, and where the last ends.

    Returns the number of terms of each row, and of the terms in the map: names, and row, number of the term and count of each occurrence.
    """
    word = np.concatenate([[False], folded != 0, [False]])
    breaks = np.zeros(len(folded) + 1, bool)
    breaks[rows] = True
    begins = np.flatnonzero(word[1:] & (~word[:-1] | breaks))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | breaks))
    per_row = np.diff(np.searchsorted(begins, rows))
    if not len(begins):
        return per_row, [], np.zeros((3, 0), np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    letters = np.ascontiguousarray(folded[folded != 0])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    names = terms.dictionary.to_pylist()
    known = _has_bit(bitmap, names)
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chosen = known[code]
    row = np.repeat(np.arange(len(per_row)), per_row)[chosen]
    code = (np.cumsum(known) - 1)[code[chosen]]
    names = [t for t, k in zip(names, known) if k]
    both, tf = np.unique(row * max(1, len(names)) + code, return_counts=True)
    return per_row, names, np.array([both // max(1, len(names)), both % max(1, len(names)), tf], np.int64)


def _long_row(folded: np.ndarray, bitmap: np.ndarray):
    """The same for one row of any length, piece by piece; a piece ends between terms."""
    n, tf, lo = 0, {}, 0
    while lo < len(folded):
        hi = min(lo + PIECE_BYTES, len(folded))
        while hi < len(folded) and folded[hi]:
            gap = np.flatnonzero(folded[hi : hi + 65536] == 0)
            hi = min(hi + (int(gap[0]) if len(gap) else 65536), len(folded))
        per_row, names, found = _counted(folded[lo:hi], np.array([0, hi - lo]), bitmap)
        n += int(per_row[0])
        for term, count in zip(found[1].tolist(), found[2].tolist()):
            tf[names[term]] = tf.get(names[term], 0) + count
        lo = hi
    counts = np.array(list(tf.values()), np.int64)
    return np.array([n]), list(tf), np.array([np.zeros(len(tf), np.int64), np.arange(len(tf)), counts])


def tile_bounds(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive rows in tiles of bounded rows and bytes; a row beyond the bound is alone."""
    out, lo, held = [], 0, 0
    for hi, size in enumerate(sizes.tolist()):
        if hi > lo and (hi - lo >= TILE_DOCS or held + size > TILE_BYTES):
            out.append((lo, hi))
            lo, held = hi, 0
        held += size
    return [*out, (lo, len(sizes))] if len(sizes) else out


def _tiles(bitmap: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for lo, hi in tile_bounds(np.diff(offsets)):
                folded = _FOLD[data[offsets[lo] : offsets[hi]]]
                if hi - lo == 1:
                    per_row, names, (doc, term, tf) = _long_row(folded, bitmap)
                else:
                    per_row, names, (doc, term, tf) = _counted(folded, offsets[lo : hi + 1] - offsets[lo], bitmap)
                some = np.unique(doc)
                tile = {
                    "docs": int((per_row > 0).sum()), "total": int(per_row.sum()), "doc_id": [ids[lo + d] for d in some], "n": per_row[some],
                    "terms": [t.decode() for t in names], "df": np.bincount(term, minlength=len(names)),
                    "at_doc": np.searchsorted(some, doc), "at_term": term, "tf": tf,
                }
                yield pa.RecordBatch.from_arrays([pa.array([tile[f.name]], f.type) for f in _TILE_TYPES], schema=_TILE_TYPES)

    return run


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_TILE_TYPES = pa.schema(
    [("docs", pa.int64()), ("total", pa.int64()), ("doc_id", _LONGS), ("n", _LONGS), ("terms", pa.list_(pa.string())), ("df", _LONGS)]
    + [("at_doc", _INTS), ("at_term", _INTS), ("tf", _INTS)]
)


def weight_columns(weights: np.ndarray, limit: int) -> list[np.ndarray]:
    """Matrices of whole numbers that add up to ``weights`` (items, terms), none above ``limit``; one, unless a term is repeated very often."""
    out = []
    while True:
        part = np.minimum(weights, limit)
        out.append(part)
        weights = weights - part
        if not weights.any():
            return out


def column_cuts(weights: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``COLUMNS`` columns in which no row of ``weights`` adds up to more than ``limit``."""
    out, lo = [], 0
    while lo < weights.shape[1]:
        upto = np.cumsum(weights[:, lo : lo + COLUMNS], axis=1).max(axis=0)
        hi = lo + max(1, int(np.searchsorted(upto, limit, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def scores(weights: np.ndarray, impacts: np.ndarray, bound: int = 2**53) -> np.ndarray:
    """``weights`` (items, terms) times ``impacts`` (terms, documents), exact: each float64 product stays below ``bound``."""
    limit = (bound - 1) // IMPACT_LIMIT
    out = np.zeros((weights.shape[0], impacts.shape[1]), np.int64)
    for part in weight_columns(weights, limit):
        for lo, hi in column_cuts(part, limit):
            out += (part[:, lo:hi].astype(np.float64) @ impacts[lo:hi]).astype(np.int64)
    return out


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each item: by score, then ``doc_id``, missing ones last."""
    order = np.lexsort((doc, missing, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def _candidates(found: np.ndarray, k: int):
    """Item and document of all scores that can be among the ``k`` best of a tile, those equal to the k-th included."""
    least = np.ones((found.shape[0], 1), np.int64)
    if found.shape[1] > k:
        least = np.maximum(np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k][:, None], 1)
    return np.nonzero(found >= least)


class Slice:
    """The items of a slice as a matrix over their own terms."""

    def __init__(self, items: list[dict]):
        self.ids = [(i["item_id"], i["item_key"]) for i in items]
        self.column: dict[str, int] = {}
        entries = [(r, self.column.setdefault(t["term"], len(self.column)), t["weight"]) for r, i in enumerate(items) for t in i["terms"]]
        self.entries = np.array(entries, np.int64).reshape(-1, 3)
        self.kept = np.zeros((4, 0), np.int64)

    def meet(self, tile: dict, impact: np.ndarray, k: int) -> None:
        place = np.array([self.column.get(t, -1) for t in tile["terms"]], np.int64)
        shared = np.unique(place[place >= 0])
        if not len(shared):
            return
        compact = np.full(len(self.column) + 1, -1, np.int64)
        compact[shared] = np.arange(len(shared))
        mine = compact[self.entries[:, 1]]
        weights = np.zeros((len(self.ids), len(shared)), np.int64)
        weights[self.entries[mine >= 0, 0], mine[mine >= 0]] = self.entries[mine >= 0, 2]
        at = compact[place[tile["at_term"]]]
        impacts = np.zeros((len(shared), len(tile["n"])))
        impacts[at[at >= 0], tile["at_doc"][at >= 0]] = impact[at >= 0]
        found = scores(weights, impacts)
        item, doc = _candidates(found, k)
        new = np.array([item, found[item, doc], tile["doc_id"][doc], tile["missing"][doc]])
        kept = np.concatenate([self.kept, new[:, best(*new, k)]], axis=1)
        self.kept = kept[:, best(*kept, k)]

    def result(self) -> pa.RecordBatch:
        item, score, doc, missing = self.kept
        who = [self.ids[i] for i in item.tolist()]
        docs = pa.array(doc, pa.int64(), mask=missing.astype(bool))
        names = ["item_id", "item_key", "doc_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array([w[0] for w in who], pa.int64()), pa.array([w[1] for w in who], pa.string()), docs, pa.array(score)], names)


def _tile_of(batch, row: int) -> dict:
    def flat(name):
        return batch.column(name)[row].values

    def numbers(name):
        return flat(name).to_numpy(zero_copy_only=False).astype(np.int64)

    ids = flat("doc_id")
    return {
        "terms": flat("terms").to_pylist(), "n": numbers("n"), "at_doc": numbers("at_doc"), "at_term": numbers("at_term"), "tf": numbers("tf"),
        "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False), "missing": ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
    }


def _ranked(docs: int, total: int, k: int):
    def run(batches):
        held: dict[int, Slice] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("slice")[row].as_py()
                if number not in held:
                    held[number] = Slice(batch.column("items")[row].as_py())
                tile = _tile_of(batch, row)
                m = 100 - 75 + 75 * tile["n"] * docs // total
                impact = 1_000_000_000 * tile["tf"] // (1000 * tile["tf"] + 8 * m[tile["at_doc"]])
                held[number].meet(tile, impact, k)
                if sum(s.kept.shape[1] + len(s.entries) for s in held.values()) > KEPT_ROWS:
                    yield from (s.result() for s in held.values())
                    held = {}
        yield from (s.result() for s in held.values())

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, item_key, term, q``: how often each distinct item holds each of its terms."""
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = each.select("item_id", text_key(F.col("text")).alias("item_key"), lower_ascii(F.col("text")).alias("text")).dropDuplicates(["item_id", "item_key"])
    each = each.select("item_id", "item_key", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(1))).alias("term"))
    return each.groupBy("item_id", "item_key", "term").agg(F.count("*").alias("q"))


def term_map(terms: DataFrame) -> np.ndarray:
    """The bitmap of the terms' hashes."""
    place = term_position(F.col("term"))
    buckets = terms.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for row in buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        lo = (row["bucket"] - 1) * (BUCKET_BITS // 8)
        bits[lo : lo + BUCKET_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score, item_key``: the ``k`` best documents of each item."""
    spark = prepare(docs)
    terms = stored(item_terms(items), "item-terms")
    tiles = stored(texts_of(docs).mapInArrow(_tiles(term_map(terms)), TILE), "search-tiles")
    count, total = tiles.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = tiles.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * count + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = stored(terms.join(held, "term").select("item_id", "item_key", "term", (F.col("q") * weight).alias("weight")).filter("weight > 0"), "item-weights")
    n_items, n_terms = weighted.agg(F.count_distinct(F.coalesce("item_id", F.lit(0)), "item_key"), F.count("*")).first()
    n_slices = max(1, -(-n_items // SLICE_ITEMS), -(-n_terms // SLICE_TERMS))
    each = weighted.groupBy("item_id", "item_key").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    number = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(n_slices)).cast("int")
    slices = each.groupBy(number.alias("slice")).agg(F.collect_list(F.struct("item_id", "item_key", "terms")).alias("items"))
    slices = stored(slices, "item-slices")
    met = tiles.drop("docs", "total", "df").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    met = met.join(F.broadcast(slices) if n_terms <= BROADCAST_TERMS else slices, "slice")
    found = met.mapInArrow(_ranked(count, max(1, total), k), FOUND)
    order = Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score", "item_key")
