"""Exact Jaccard join of documents on word shingles.

Sets are 64-bit hashes of shingles, sorted. Equal sets are folded into one node, named by the smallest ``doc_id``. Between nodes:

1. Tiles. Sizes fall into bands of powers of two; a pair meets in the tile of its smaller set's band. For sets of one tile
   that reach the threshold the symmetric difference is at most ``d``. The hash range is cut into more than ``d`` parts, so at least one part
   holds the same hashes in both sets. A set is dealt by the fingerprints of its parts. (Parts that are empty
   count only for sets with unusually many of them: there are enough parts that the others meet in one that is not.)
2. First links. Nodes that share a fingerprint have a centre, the smallest of them. Every node is compared with the centre that
   it shares most fingerprints with.
3. Whatever fingerprint still joins nodes of several components goes on: its nodes are compared by bitmaps, in which a bit is the parity of the
   hashes that fall on it. Differing bits count differing hashes at most once, so they bound the overlap from above. Of the pairs
   that pass, a spanning forest is compared exactly, by intersecting the sorted arrays. This repeats, without pairs already
   compared and with ``MORE_PAIRS`` times as many of every two components, until no pair of different components is left, which takes a few
   rounds. Of a fingerprint's nodes only those that have such a pair left go on to the next. Groups beyond ``BLOCK`` nodes are cut into
   pairs of blocks.

So no pair of a group is written out unless its comparison may join two components, and the components are exact. Pairs of texts just below
the threshold that nothing else connects must all be compared; there the work follows the number of such pairs.

Defined cases: null text is empty; an empty set is linked with nothing; rows that share a ``doc_id`` count as one document with the links of all
its texts; null ``doc_id`` is such an id, the smallest, and comes back as null; repeated rows are equal sets; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_of, prepare, stored, text_key, texts_of, tidy
from .components import components

NO_ID = -(2**63)
WORDS, THRESHOLD = 5, Fraction(4, 5)
BLOCK = 1024
MORE_PAIRS = 16
# Rows of document numbers that may be broadcast (16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
# Characters whose words are hashed at once, and those whose rows leave a Python worker at once.
SLAB_CHARS, YIELD_CHARS = 250_000, 2_000_000
# Partners of a centre that share one copy of its set.
PARTNERS = 100
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_up = _down = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    global _up, _down
    if len(_up) < n:
        _up, _down = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
    return _up, _down


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    firsts = split.offsets.to_numpy()
    words = split.values
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64), firsts
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # Powers start anew every so often, so their table stays small; a word's hash doesn't depend on where it stands.
    span = 1 << 16
    up, down = _powers(2 * span + int(np.diff(ends).max()))
    place = np.arange(len(data)) - np.repeat((ends[:-1] // span) * span, np.diff(ends))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[place], dtype=np.uint64)])
    raw = (sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1] % span]
    hashes = mixed(raw + np.diff(ends).astype(np.uint64))
    # White space at an end of a text makes an empty piece there.
    real = ends[1:] > ends[:-1]
    return hashes[real], np.concatenate([[0], np.cumsum(real)])[firsts - firsts[0]]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence is the one shingle."""
    out: list[np.ndarray] = []
    # Unrelated factors: with a regular sequence of them, other orders of the same words could add up to the same sum.
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    lo = size = 0
    for hi, text in enumerate(texts):
        size += len(text)
        if size < SLAB_CHARS and hi < len(texts) - 1:
            continue
        hashes, firsts = word_hashes(texts[lo : hi + 1])
        n = len(hashes)
        rolled = np.zeros(n, np.uint64)
        for k in range(min(words, n)):
            rolled[: n - k] += hashes[k:] * factors[k]
        rolled = mixed(rolled)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                few = sum(int(h) * int(factors[k]) for k, h in enumerate(hashes[a:b])) + (b - a)
                out.append(mixed(np.array([few % 2**64], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        lo, size = hi + 1, 0
    return out


def is_link(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * t.denominator < max(len(a), len(b)) * t.numerator:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return both * t.denominator >= (len(a) + len(b) - both) * t.numerator


class Tiles:
    """Parts and bitmaps by band."""

    def __init__(self, t: Fraction):
        self.t, self._plans = t, {}

    def of(self, n: int) -> list[int]:
        """Bands of the tiles in which a set of this size may have its partners."""
        band = n.bit_length() - 1
        smaller = band >= 1 and n * self.t <= (1 << band) - 1
        return [band, band - 1] if smaller else [band]

    def plan(self, band: int) -> tuple[int, int, np.ndarray]:
        """Parts, how many of them may be empty unsaid, and the parts' first hashes."""
        if band not in self._plans:
            largest = (1 << (band + 1)) - 1
            d = int(largest * (1 - self.t) / self.t)
            spare = 0
            if d:
                for _ in range(8):
                    mean = (d + 1 + spare) * np.exp(-(1 << band) / (d + 1 + spare))
                    spare = int(mean + 3 * np.sqrt(mean)) + 1
            parts = d + 1 + spare
            bounds = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
            self._plans[band] = parts, spare, bounds
        return self._plans[band]

    def fingerprints(self, hashes: np.ndarray) -> np.ndarray:
        out = []
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes), dtype=np.uint64)])
        for band in self.of(len(hashes)):
            parts, spare, bounds = self.plan(band)
            at = np.concatenate([np.searchsorted(hashes, bounds), [len(hashes)]])
            full = at[1:] > at[:-1]
            salt = np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)
            prints = mixed(sums[at[1:]] - sums[at[:-1]] + mixed(salt))
            out.append(prints if parts - np.count_nonzero(full) > spare else prints[full])
        return np.concatenate(out)


def bitmap_bits(n: int) -> int:
    return 1 << max(6, (n.bit_length() - 1) + 2)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def folded(raw: bytes, bits: int) -> np.ndarray:
    """A bitmap brought to a smaller width: neighbouring parities add up."""
    wide = np.frombuffer(raw, np.uint8)
    while 8 * len(wide) > bits:
        wide = np.packbits(np.bitwise_xor.reduce(np.unpackbits(wide).reshape(-1, 2), axis=1))
    return wide.view(np.uint64)


def most_overlap(n: int, m: int, a: np.ndarray, b: np.ndarray) -> int:
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


# ------------------------------------------------------------------ stages


def with_several_sets(rows: DataFrame) -> DataFrame:
    """``doc`` of the documents whose rows hold different sets."""
    return rows.groupBy("doc").agg(F.min(F.struct("f1", "f2")).alias("lo"), F.max(F.struct("f1", "f2")).alias("hi")).filter("lo <> hi").select("doc")


def parts_of(batches):
    """Batches of texts cut into parts of about ``YIELD_CHARS`` characters, so memory doesn't follow the batch."""
    for batch in batches:
        sizes = np.cumsum(batch["text"].str.len().to_numpy(np.int64)) // YIELD_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.iloc[lo:hi]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def work(batches):
        for batch in parts_of(batches):
            sets = shingle_sets(batch["text"].tolist(), words)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            wide = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            keys = {"text_key": batch["text_key"]} if "text_key" in batch else {}
            yield pd.DataFrame({"doc": batch["doc"], "n": [len(s) for s in sets], "f1": wide[:, 0], "f2": wide[:, 1], **keys})

    return docs.mapInPandas(tidy(work), "doc long, n int, f1 long, f2 long" + ", text_key string" * ("text_key" in docs.columns))


def _dealt(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    def work(batches):
        tiles = Tiles(t)
        for batch in parts_of(batches):
            sets = shingle_sets(batch["text"].tolist(), words)
            some = [(doc, tiles.fingerprints(hashes)) for doc, hashes in zip(batch["doc"].tolist(), sets) if len(hashes)]
            if some:
                ids = np.repeat(np.array([doc for doc, _ in some], np.int64), [len(prints) for _, prints in some])
                yield pd.DataFrame({"print": np.concatenate([prints for _, prints in some]).view(np.int64), "node": ids})

    return docs.mapInPandas(tidy(work), "print long, node long")


def _with_centres(batches):
    """Sorted by print and node: rows of prints that several nodes share, with the smallest of them."""
    last, centre, waiting = None, None, False
    for batch in batches:
        key, node = batch["print"].to_numpy(), batch["node"].to_numpy()
        if not len(key):
            continue
        new = np.r_[last is None or key[0] != last, key[1:] != key[:-1]]
        run = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        centres = node[firsts]
        if not new[0]:
            centres, run = np.r_[centre, centres], run + 1
        own = centres[run]
        others = node != own
        shared = np.zeros(len(centres), bool)
        np.logical_or.at(shared, run, others)
        if not new[0] and not waiting:
            shared[0] = True  # its centre has been written before
        # A centre is written with the first other node of its run.
        keep = shared[run] & (others | (node == own))
        out = pd.DataFrame({"print": key[keep], "node": node[keep], "centre": own[keep]})
        if not new[0] and waiting and shared[0]:
            out = pd.concat([pd.DataFrame({"print": [last], "node": [centre], "centre": [centre]}), out])
        yield out
        tail_shared = bool(shared[run[-1]])
        last, centre, waiting = key[-1], own[-1], not tail_shared


def chosen(docs: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc") -> DataFrame:
    """Rows of ``docs`` whose ``doc``, or other key, is (not) among ``ids``; texts are not shuffled while the numbers are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def _bitmaps(docs: DataFrame, words: int) -> DataFrame:
    """``node, n, map``, a bitmap of the width of the set's band."""

    def work(batches):
        for batch in parts_of(batches):
            sets = shingle_sets(batch["text"].tolist(), words)
            maps = [bitmap(s, bitmap_bits(max(1, len(s)))).tobytes() for s in sets]
            yield pd.DataFrame({"node": batch["doc"], "n": [len(s) for s in sets], "map": maps})

    return docs.mapInPandas(tidy(work), "node long, n int, map binary")


def _sets_of(docs: DataFrame, words: int) -> DataFrame:
    def work(batches):
        for batch in parts_of(batches):
            sets = shingle_sets(batch["text"].tolist(), words)
            yield pd.DataFrame({"node": batch["doc"], "hashes": [s.tobytes() for s in sets]})

    return docs.mapInPandas(tidy(work), "node long, hashes binary")


def _allowed(pairs: DataFrame, maps: DataFrame, t: Fraction) -> DataFrame:
    """Pairs that sizes and bitmaps allow to be links."""
    sizes = maps.select("node", "n")
    side = lambda df, c: df.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in df.columns[1:]))
    near = pairs.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    near = near.filter(F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator).select("a", "b")

    @F.pandas_udf("boolean")
    def allowed(n_a: pd.Series, map_a: pd.Series, n_b: pd.Series, map_b: pd.Series) -> pd.Series:
        return pd.Series([
            most_overlap(n, m, folded(a, m_bits), folded(b, m_bits)) * t.denominator
            >= (n + m - most_overlap(n, m, folded(a, m_bits), folded(b, m_bits))) * t.numerator
            for n, a, m, b in zip(n_a, map_a, n_b, map_b)
            for m_bits in (8 * min(len(a), len(b)),)
        ])

    full = near.join(side(maps, "a"), "a").join(side(maps, "b"), "b")
    return full.filter(allowed("n_a", "map_a", "n_b", "map_b")).select("a", "b").distinct()


def _verified_texts(pairs: DataFrame, texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """As ``_verified``, with the sets of these pairs' nodes made from their texts."""
    ids = stored(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "compared-nodes")
    return _verified(pairs, stored(_sets_of(chosen(texts, ids, "inner"), words), "compared-sets"), t)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """``a, b, linked`` of pairs, compared exactly. A centre's set is copied once per ``PARTNERS`` of its partners."""
    spread = F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / PARTNERS)).cast("int")
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    partners = pairs.join(counts, "a").select("a", "b", spread.alias("salt"))
    centres = counts.select("a", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("partners") / PARTNERS) - 1).cast("int"))).alias("salt"))
    rows = (
        centres.join(sets, centres["a"] == sets["node"]).select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "hashes")
        .unionByName(partners.join(sets, partners["b"] == sets["node"]).select("a", "salt", F.lit(1).alias("side"), "b", "hashes"))
    )

    def compare(batches):
        key, own = None, []
        for batch in batches:
            found = []
            for a, salt, side, b, raw in zip(*(batch[c].tolist() for c in ("a", "salt", "side", "b", "hashes"))):
                if (a, salt) != key:
                    key, own = (a, salt), []
                if side == 0:
                    own.append(np.frombuffer(raw, np.uint64))
                else:
                    found.append((a, b, any(is_link(x, np.frombuffer(raw, np.uint64), t) for x in own)))
            yield pd.DataFrame(found, columns=["a", "b", "linked"])

    n = partitions_of(pairs.sparkSession)
    compared = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "side").mapInPandas(tidy(compare), "a long, b long, linked boolean")
    return stored(compared.groupBy("a", "b").agg(F.max("linked").alias("linked")), "compared")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def pairs_of_tile(rows: list[tuple], t: Fraction, each: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Untried pairs of nodes of different components whose bitmaps allow a link: a spanning forest of them if ``each`` is 1, else up to
    ``each`` of every two components; and the nodes of such pairs beyond these. ``rows``: size, node, component, block, bitmap and the nodes
    it was compared with."""
    rows.sort(key=lambda r: r[:2])
    sizes, comps, block_of = [r[0] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    all_sizes = np.array(sizes)
    bits = bitmap_bits(1 << (sizes[0].bit_length() - 1))
    blocks = block_of.min() < block_of.max()
    maps = None
    forest, out, waiting = _Forest(), [], set()
    taken: dict[tuple[int, int], int] = {}
    for i in range(len(rows) - 1):
        n, node, comp, block, _, tried = rows[i]
        hi = bisect_right(sizes, n * t.denominator // t.numerator)
        # Nodes of one component aren't compared, however many they are.
        js = np.flatnonzero(comps[i + 1 : hi] != comp) + i + 1
        if blocks:
            js = js[block_of[js] != block]
        if not len(js):
            continue
        if maps is None:
            maps = np.stack([folded(r[4], bits) for r in rows])
        overlap = (n + all_sizes[js] - np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1).astype(np.int64)) // 2
        for j in js[overlap * t.denominator >= (n + all_sizes[js] - overlap) * t.numerator].tolist():
            _, other, other_comp, _, _, other_tried = rows[j]
            if other in tried or node in other_tried:
                continue
            if each == 1:
                taking = forest.join(comp, other_comp)
            else:
                two = (min(comp, other_comp), max(comp, other_comp))
                taken[two] = taken.get(two, 0) + 1
                taking = taken[two] <= each
            if taking:
                out.append((min(node, other), max(node, other)))
            else:
                waiting.update((node, other))
    return out, sorted(waiting)


def _members() -> list:
    """What tells the nodes of a print from those of another: equal only for equal sets of nodes."""
    number = F.xxhash64("node")
    return [F.bit_xor(number).alias("x"), F.sum(number.cast("decimal(38,0)")).alias("s"), F.count("*").alias("members")]


def _open_pairs(shared: DataFrame, labels: DataFrame, maps: DataFrame, compared: DataFrame, t: Fraction, each: int) -> DataFrame:
    """``print, a, b``: pairs that must be compared now, of prints that join several components; where ``a`` is ``b``, a node
    that has more such pairs in the print."""
    labelled = shared.select("print", "node").join(labels, "node", "left").select("print", "node", F.coalesce("component", "node").alias("component"))
    mixed_prints = (
        labelled.groupBy("print")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *_members())
        .filter("lo < hi").groupBy("x", "s", "members").agg(F.min("print").alias("print"))
    )
    rows = labelled.join(mixed_prints.select("print", "members"), "print")
    # Blocks by a hash of the node; a row goes to one tile per block of its group.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = rows.select("print", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("print", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Pairs tried before travel with their tiles' smaller node.
    tried = compared.select(F.col("a").alias("node"), "b").unionByName(compared.select(F.col("b").alias("node"), F.col("a").alias("b")))
    tried = tried.groupBy("node").agg(F.collect_set("b").alias("tried"))
    full = tiles.join(maps, "node").join(tried, "node", "left")

    columns = ["print", "i", "j", "n", "node", "component", "block", "map", "tried"]

    def rows_of(key, held):
        if len(held) < 2:
            return []
        pairs, waiting = pairs_of_tile(held, t, each)
        return [(key[0], a, b) for a, b in pairs] + [(key[0], node, node) for node in waiting]

    def work(batches):
        held, key = [], None
        for batch in batches:
            found = []
            for row in zip(*(batch[c].tolist() for c in columns)):
                if row[:3] != key:
                    found += rows_of(key, held)
                    held, key = [], row[:3]
                held.append((*row[3:8], frozenset(row[8].tolist()) if row[8] is not None else frozenset()))
            yield pd.DataFrame(found, columns=["print", "a", "b"])
        yield pd.DataFrame(rows_of(key, held), columns=["print", "a", "b"])

    n = partitions_of(shared.sparkSession)
    return full.repartition(n, "print", "i", "j").sortWithinPartitions("print", "i", "j").mapInPandas(tidy(work), "print long, a long, b long")


def linked_components(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    prepare(docs)
    texts = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    placed = _placed(texts, stored(_sets(texts, words), "sets"), words, threshold)
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return placed.select(shown("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), shown("component").alias("component_id"))


def linked_texts(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``doc, text_key, n, component`` of every row of ``docs``, where different sets of one ``doc_id`` are nodes of their own."""
    prepare(docs)
    texts = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", text_key(F.col("text")).alias("text_key"))
    rows = stored(_sets(texts, words), "sets")
    several = stored(with_several_sets(rows), "several-sets")
    # Such a set's node is its fingerprint.
    own = F.when(F.col("apart"), F.col("f1")).otherwise(F.col("doc"))
    rows = rows.join(several.withColumn("apart", F.lit(True)), "doc", "left").select("text_key", "n", "f1", "f2", F.col("doc").alias("number"), own.alias("doc"), "apart")
    rows = stored(rows, "nodes")
    nodes = rows.filter("apart").select(F.col("number").alias("doc"), "text_key", F.col("doc").alias("node")).distinct()
    apart = stored(chosen(texts, several, "inner").join(nodes, ["doc", "text_key"]).select(F.col("node").alias("doc"), "text"), "texts-apart")
    placed = _placed(chosen(texts, several, "left_anti").select("doc", "text").unionByName(apart), rows.drop("apart"), words, threshold)
    return placed.select(F.col("number").alias("doc"), "text_key", "n", "component")


def _placed(texts: DataFrame, rows: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """``rows``, the sets of ``texts``, with their components."""
    equal = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
    repeated = stored(equal.filter("copies > 1"), "equal-sets")
    # Copies of a set, all but the first, have no part in the join between sets, unless their document has another set too: then
    # it stays a node and is linked with the first of each of its sets.
    copies = rows.join(repeated.drop("copies"), ["f1", "f2"]).filter(F.col("doc") != F.col("node")).select("doc", "node").distinct()
    several = stored(with_several_sets(rows), "several-sets")
    same = stored(copies.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("node").alias("b")), "same-documents")
    copies = copies.select("doc").distinct().join(several, "doc", "left_anti")
    nodes = chosen(texts, stored(copies, "copies"), "left_anti")
    n = partitions_of(texts.sparkSession)
    dealt = _dealt(nodes, words, threshold).repartition(n, "print").sortWithinPartitions("print", "node")
    shared = stored(dealt.mapInPandas(tidy(_with_centres), "print long, node long, centre long").distinct(), "all-shared-prints")
    # Prints that the same nodes share say the same; one of them stays, with how many it stands for.
    same_nodes = (
        shared.groupBy("print").agg(*_members()).groupBy("x", "s", "members").agg(F.min("print").alias("print"), F.count("*").alias("prints"))
    )
    shared = stored(shared.join(same_nodes.select("print", "prints"), "print"), "shared-prints")
    candidates = stored(shared.select(F.col("node").alias("doc")).distinct(), "candidates")
    maps = stored(_bitmaps(chosen(texts, candidates, "inner"), words).filter("n > 0"), "bitmaps")

    best = (
        shared.filter(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.sum("prints").alias("n"))
        .groupBy("node").agg(F.max(F.struct("n", (-F.xxhash64("centre")).alias("h"), "centre")).alias("best"))
        .select(F.col("best.centre").alias("a"), F.col("node").alias("b"))
    )
    compared = _verified_texts(stored(_allowed(best, maps, threshold), "first-pairs"), texts, words, threshold)
    each = 1
    while True:
        labels = components(compared.filter("linked").select("a", "b").unionByName(same))
        if shared.isEmpty():
            break
        found = stored(_open_pairs(shared, labels, maps, compared, threshold, each), "open-pairs")
        if found.isEmpty():
            break
        pairs = found.filter("a <> b").select("a", "b").distinct()
        # A node without another such pair in a print has none there later, since components only grow.
        shared = stored(found.filter("a = b").select("print", F.col("a").alias("node")).distinct(), "waiting-nodes")
        compared = compared.unionByName(_verified_texts(pairs, texts, words, threshold))
        each *= MORE_PAIRS
    by_set = repeated.select("f1", "f2", "node", F.lit(True).alias("known"))
    named = rows.join(by_set.drop("known"), ["f1", "f2"], "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("node", "doc")).otherwise(F.col("doc")))
    return named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
