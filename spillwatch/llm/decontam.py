"""Benchmark decontamination: documents that hold a benchmark item, up to a share of edits.

Texts and items are compared in lower-case ASCII letters with white space runs as one space.

1. Pieces. An item of m bytes is cut into pieces of four bytes (fewer, where four are too many for a short item). k edits touch at most k of
   the pieces and move the others by at most k places against each other. So a match holds at least ``m // 4 - k`` whole pieces in
   a range of k places. Pieces are looked up at every byte of a document, counted in cells of k / 3 places, and where four neighbouring cells
   hold enough, counted again with each piece once. Nothing within the allowed edits can be lost here.
2. Parts of up to 64 bytes of the item are compared with such a place, many side by side: one of them at least must be within its share of the edits.
3. Exact verification: the least edit distance of the item to any part of the place, by a bit-parallel scan.

The work grows with the product of the text and the items that share pieces with it.

Items are a bounded table per pass: pieces of at most ``INDEX_BYTES`` of item text goes to the tasks, more items make more passes. Texts are not
shuffled.

Defined cases: null text or item is empty and matches nothing; items of fewer than ``SHORT`` bytes match, with the
edits they may have, between edges of words only (any place in scripts without blanks is one); rows with null ``doc_id``
or ``item_id`` are compared and keep the null; repeated documents are reported each, repeated items once per row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_key, tidy

MAX_EDITS = 0.2  # of the item's length
# Items with fewer bytes match between the edges of words only.
SHORT = 12
INDEX_BYTES = 16 << 20
# Bytes of documents that are searched at once, and of a part of them; cells of a table of counts; pieces written out at once.
GROUP_BYTES, SLAB_BYTES, CELLS, HITS = 1 << 22, 1 << 15, 1 << 21, 1 << 21
# Parts of items compared side by side.
LANES = 4096
_PLAIN = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
# Thai to Tibetan, Burmese, Khmer, kana and Chinese characters: scripts without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain(text: str) -> tuple[bytes, np.ndarray | None]:
    """Normal form, and for each of its bytes the place in the text's own bytes (None: the same place)."""
    raw = text.encode().translate(_PLAIN)
    if b"  " not in raw:
        return raw, None
    data = np.frombuffer(raw, np.uint8)
    keep = np.flatnonzero((data != 32) | np.r_[True, data[:-1] != 32])
    return data[keep].tobytes(), keep


def least_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where such a part ends; bit-parallel after Myers."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << k)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for place, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, place
    return best, end


def least_distances(parts: list[bytes], of: np.ndarray, text: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """``least_distance`` of ``parts[of]``, of up to 64 bytes each, to their places of the text, all side by side."""
    masks = np.zeros((len(parts), 256), np.uint64)
    for k, part in enumerate(parts):
        np.bitwise_or.at(masks[k], np.frombuffer(part, np.uint8), np.uint64(1) << np.arange(len(part), dtype=np.uint64))
    masks = masks.reshape(-1)
    lengths = np.array([len(t) for t in parts])[of]
    one, top = np.uint64(1), (lengths - 1).astype(np.uint64)
    plus, minus = np.full(len(of), ~np.uint64(0)), np.zeros(len(of), np.uint64)
    score, best = lengths.astype(np.int32), lengths.astype(np.int32)
    row, sizes = of * 256, highs - lows
    for step in range(int(sizes.max())):
        eq = masks[row + text[np.minimum(lows + step, len(text) - 1)]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
        ph <<= one
        mh <<= one
        plus, minus = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best, where=step < sizes)
    return best


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def is_edge(text: bytes, at: int) -> bool:
    """Whether no word goes on at this place."""
    if not 0 < at < len(text):
        return True
    if text[at] & 0xC0 == 0x80:
        return False
    sides = text[max(0, at - 4) : at].decode(errors="ignore")[-1:], text[at : at + 4].decode(errors="ignore")[:1]
    return not all(c.isalnum() and not _UNSPACED.match(c) for c in sides)


def edits_of(length: int) -> int:
    return int(MAX_EDITS * length)


def piece_bytes(length: int) -> int:
    """The longest pieces, up to four bytes, of which more fit into an item than it may have edits."""
    return next(q for q in (4, 3, 2, 1) if length // q > edits_of(length))


class Pieces:
    """Pieces of ``q`` bytes of some items, looked up at every byte of a text."""

    def __init__(self, q: int, items: list[tuple[int, bytes]], often: np.ndarray):
        self.q, self.numbers = q, np.array([k for k, _ in items], np.int64)
        self.length = np.array([len(t) for _, t in items], np.int64)
        self.edits = np.array([edits_of(len(t)) for _, t in items], np.int64)
        self.need = np.zeros(len(items), np.int64)
        values, item, offset = [], [], []
        for k, (_, text) in enumerate(items):
            all_values = grams(text, q)
            rare = often[slots(all_values, 16)]
            fit = len(text) // q
            phases = [np.arange(p, p + (fit - 1) * q + 1, q) for p in range(len(text) - fit * q + 1)]
            at = min(phases, key=lambda p: int(rare[p].sum()))
            self.need[k] = fit - self.edits[k]
            values.append(all_values[at])
            item.append(np.full(len(at), k, np.int64))
            offset.append(at)
        values, item, offset = map(np.concatenate, (values, item, offset))
        self.bits = min(24, max(16, int(len(values) * 16).bit_length()))
        slot = slots(values, self.bits)
        order = np.argsort(slot, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.rank = self.offset // q
        self.count = np.bincount(slot, minlength=1 << self.bits).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)
        self.known = self.count > 0
        self.needs = None
        self.width = -(-np.maximum(self.edits, 1) // 3)
        self.width_of = self.width[self.item].astype(np.int32)
        self.moved = (self.length[self.item] - self.offset).astype(np.int32)
        # Bytes that the longest match may take.
        self.reach = int((self.length + self.edits).max())

    def near(self, text: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, start, end)`` of parts of the text, such that each match of an item lies in one of its own."""
        out = []
        step = max(SLAB_BYTES, 2 * self.reach)
        for at in range(0, max(1, len(text) - self.q + 1), step):
            out += [(k, at + lo, at + hi) for k, lo, hi in self._near(text[at : at + step + self.reach])]
        return out

    def _near(self, text: np.ndarray):
        if len(text) < self.q:
            return []
        slot = slots(grams(text, self.q), self.bits)
        at = np.flatnonzero(self.known[slot])
        slot = slot[at]
        n, lo, at = self.count[slot], self.first[slot], at.astype(np.int32)
        # A match with k edits moves its pieces by no more than k against each other: all of them lie in four neighbouring cells of k / 3 places.
        cells = (len(text) + self.length) // self.width + 4
        base = (np.cumsum(cells) - cells).astype(np.int32)
        start = base[self.item]
        total = np.cumsum(n, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(total // HITS)) + 1).tolist(), len(at)]
        counts = np.zeros(int(cells.sum()) + 3, np.int64)
        if len(cuts) == 2:
            held = self._hits(at, n, lo, start)
            counts = np.bincount(held[0], minlength=len(counts))
        else:
            held = None
            for a, b in zip(cuts[:-1], cuts[1:]):
                counts += np.bincount(self._hits(at[a:b], n[a:b], lo[a:b], start)[0], minlength=len(counts))
        if self.needs is None or len(self.needs) != len(counts) - 3:
            self.needs = np.repeat(self.need, cells).astype(np.uint16)
        # A sum of four stays below 2**16.
        few = np.minimum(counts, 16000, out=counts).astype(np.uint16)
        two = few[:-1] + few[1:]
        full = np.flatnonzero(two[:-2] + two[2:] >= self.needs)
        if len(full) and held:
            full = self._distinct(full, *held, len(counts), base)
        item = np.searchsorted(base, full, "right") - 1
        since = (full - base[item]) * self.width[item] - self.length[item]
        lows, highs = since - self.edits[item], since + 4 * self.width[item] + self.length[item] + self.edits[item]
        return zip(self.numbers[item].tolist(), lows.tolist(), highs.tolist())

    def _hits(self, at, n, lo, start):
        """The cell and the piece of each hit."""
        k = np.repeat(lo - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(int(n.sum()), dtype=np.int32)
        return (np.repeat(at, n) + self.moved[k]) // self.width_of[k] + start[k], k

    def _distinct(self, full, cell, k, n, base):
        """The full windows of four cells that are full when a piece counts once."""
        window = np.full(n + 3, -1, np.int32)
        window[full + 3] = np.arange(len(full))
        near = np.zeros(n, bool)
        for back in range(4):
            near[full + back] = True
        some = np.flatnonzero(near[cell])
        cell, k = cell[some], k[some]
        item = np.searchsorted(base, full, "right") - 1
        many = self.need[item] + self.edits[item]
        place = np.cumsum(many) - many
        seen = np.zeros(int(many.sum()), bool)
        rank = self.rank[k]
        for back in range(4):
            own = window[cell + (3 - back)]
            # The last cells of an item reach into the next one's.
            there = (own >= 0) & (item[own] == self.item[k])
            seen[place[own[there]] + rank[there]] = True
        return full[np.add.reduceat(seen, place, dtype=np.int64) >= self.need[item]]


def grams(text, q: int) -> np.ndarray:
    """The ``q`` bytes at each place as numbers."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    out = data[: len(data) - q + 1].astype(np.uint32)
    for k in range(1, q):
        out |= data[k : len(data) - q + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


class Index:
    """Pieces of a bounded set of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(item_id, plain(text)[0].strip()) for item_id, text in items]
        by_bytes: dict[int, list[tuple[int, bytes]]] = {}
        for k, (_, text) in enumerate(self.items):
            if text:
                by_bytes.setdefault(piece_bytes(len(text)), []).append((k, text))
        self.pieces = []
        for q, own in by_bytes.items():
            often = np.zeros(1 << 16, np.int64)
            for _, text in own:
                often += np.bincount(slots(grams(text, q), 16), minlength=1 << 16)
            own.sort(key=lambda item: len(item[1]))
            some, cells = [], 0
            for item in own:
                more = 3 * max(SLAB_BYTES, 3 * len(item[1])) // max(1, edits_of(len(item[1])))
                if some and cells + more > CELLS:
                    self.pieces.append(Pieces(q, some, often))
                    some, cells = [], 0
                some.append(item)
                cells += more
            self.pieces.append(Pieces(q, some, often))

    def matches(self, texts: list[str]):
        """For each text ``(item number, distance, start, end)`` in bytes of its normal form, the best place of each item."""
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append(plain(text)[0])
            size += len(held[-1])
            if size >= GROUP_BYTES or k == len(texts) - 1:
                out += self._matches(held)
                held, size = [], 0
        return out

    def _matches(self, raws: list[bytes]):
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in raws]
        # No normal form holds a line feed.
        joined = np.frombuffer(b"\n".join(raws), np.uint8)
        firsts = [0, *np.cumsum([len(raw) + 1 for raw in raws]).tolist()]
        lanes = []
        for item, lo, hi in merged(sorted(near for pieces in self.pieces for near in pieces.near(joined))):
            least = len(self.items[item][1]) - edits_of(len(self.items[item][1]))
            for k in range(max(0, bisect_right(firsts, lo) - 1), len(raws)):
                if firsts[k] >= hi:
                    break
                since, upto = max(lo, firsts[k]), min(hi, firsts[k + 1] - 1)
                # Long places are cut into some that share what a match may take; a match in one of those may begin and end anywhere.
                own, allowed = len(self.items[item][1]), edits_of(len(self.items[item][1]))
                if least <= upto - since <= 3 * own:
                    lanes.append((item, k, since, upto, lo, hi))
                elif upto - since > 3 * own:
                    for a in range(since, upto - own - allowed, 2 * own - allowed):
                        lanes.append((item, k, a, min(upto, a + 3 * own), a - allowed, min(upto, a + 3 * own) + allowed))
        for item, k, lo, hi in self.within(joined, lanes):
            found = self._match(item, raws[k], lo - firsts[k], hi - firsts[k])
            if found and (item not in best[k] or found < best[k][item]):
                best[k][item] = found
        return [[(item, *found) for item, found in sorted(b.items())] for b in best]

    def within(self, text: np.ndarray, lanes: list[tuple[int, int, int, int, int, int]]):
        """``(item, document, start, end)`` of the lanes that may hold their item with the edits it may have.

        An item is cut into parts of up to 64 bytes. Of the edits of a match, one part at least has no more than by its share of the bytes.
        """
        parts, sub = [], []
        numbers: dict[int, int] = {}
        for k, (item, _, since, upto, lo, hi) in enumerate(lanes):
            own = self.items[item][1]
            n = -(-len(own) // 64)
            if item not in numbers:
                numbers[item] = len(parts)
                parts += [own[j * len(own) // n : (j + 1) * len(own) // n] for j in range(n)]
            for j in range(n):
                a, b = j * len(own) // n, (j + 1) * len(own) // n
                sub.append((k, numbers[item] + j, max(since, lo + a), min(upto, hi - len(own) + b), edits_of(len(own)) * (b - a) // len(own)))
        if not sub:
            return []
        lane, part, lows, highs, allowed = np.array(sub, np.int64).T
        good = np.zeros(len(lanes), bool)
        order = np.argsort(highs - lows, kind="stable")
        for at in range(0, len(sub), LANES):
            some = order[at : at + LANES]
            used, of = np.unique(part[some], return_inverse=True)
            least = least_distances([parts[k] for k in used.tolist()], of, text, lows[some], highs[some])
            good[lane[some][least <= allowed[some]]] = True
        return [lanes[k][:4] for k in np.flatnonzero(good).tolist()]

    def _match(self, item: int, raw: bytes, lo: int, hi: int) -> tuple[int, int, int] | None:
        own, part = self.items[item][1], raw[lo:hi]
        allowed = edits_of(len(own))
        least, end = least_distance(own, part)
        if least > allowed:
            return None
        if len(own) >= SHORT:
            _, back = least_distance(own[::-1], part[:end][::-1])
            return least, lo + end - back, lo + end
        edges = [at for at in range(lo, hi + 1) if is_edge(raw, at)]
        spans = [(a, b) for k, a in enumerate(edges) for b in edges[k + 1 : k + 2 + len(own) + allowed] if abs(b - a - len(own)) <= allowed]
        found = min(((distance(own, raw[a:b]), a, b) for a, b in spans), default=None)
        return found if found and found[0] <= allowed else None


def merged(parts: list[tuple[int, int, int]]):
    """Sorted parts, with those of an item that overlap made one."""
    held = None
    for item, lo, hi in parts:
        if held and held[0] == item and lo <= held[2]:
            held = item, held[1], max(held[2], hi)
            continue
        if held:
            yield held
        held = item, lo, hi
    if held:
        yield held


FOUND = "doc_id long, item_id long, distance int, similarity double, start int, end int, text_key string"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds; places count bytes of the document's normal form."""
    return _contaminated(docs, benchmark).drop("text_key")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id`` and ``text_key(text)`` of the rows that hold an item."""
    return _contaminated(docs, benchmark).select("doc_id", "text_key")


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = prepare(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // INDEX_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("text_key"))
    out = spark.createDataFrame([], FOUND)
    for k in range(passes):
        # About INDEX_BYTES of items each.
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if rows:
            out = out.unionByName(texts.mapInPandas(tidy(_finder(rows)), FOUND))
    return out


def _finder(items):
    def work(batches):
        index = Index(items)
        for batch in batches:
            rows = []
            for doc, key, found in zip(batch["doc_id"].astype("Int64").tolist(), batch["text_key"].tolist(), index.matches(batch["text"].tolist())):
                for item, distance, start, end in found:
                    item_id, own = index.items[item]
                    rows.append((None if doc is pd.NA else doc, item_id, distance, 1 - distance / len(own), start, end, key))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            for c in ("doc_id", "item_id"):
                out[c] = out[c].astype("Int64")
            yield out

    return work
