"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right: a phrase is the shortest piece that is not yet in the document's own dictionary, and enters it.
Texts that compress well together share phrases, so the likeness of the phrase sets stands for likeness under compression. The
set is hashed and sketched by ``PLACES`` minimum hashes of which 8 bits each are kept; equal places, less the share expected by
chance, estimate the Jaccard similarity of the sets. A hash falls into one place per round, and rounds follow until every place has a
minimum, so a large set needs one round and a small one some dozens; minima of earlier rounds are smaller.

``neighbour_prints`` also fingerprints each text with its last quarter exchanged for the beginning of the next document in order of
``doc_id``. Documents are dealt into ranges of ``doc_id``; every range also gets the first document of the range after it (the last
one the very first), so no window over the whole table is needed. A range is streamed in order, one document at a time. The parse of
the unchanged part is shared by both texts.

Defined cases: null text is empty, and an empty text has an empty fingerprint, like only another empty one (likeness 1, else 0); a null
``doc_id`` comes first; equal ``doc_id`` are ordered by text, and repeated rows follow each other; a table of one row is its own
next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_of, prepare, texts_of

PLACES = 128
BUCKETS_PER_PARTITION = 4
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_NOTHING = np.full(PLACES, 2**64 - 1, np.uint64)
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))]) for base in (_BASE, _BASE_INVERSE)
            )


_powers = Powers()


def parse(text: str, seen: set[str], start: int = 0, upto: int | None = None) -> tuple[list[int], int]:
    """Ends of the phrases that end at ``upto`` at most; and where the unfinished one starts. The definition; documents use ``walk``."""
    ends = []
    add, note = seen.add, ends.append
    end, last = start + 1, len(text) if upto is None else upto
    while end <= last:
        phrase = text[start:end]
        if phrase not in seen:
            add(phrase)
            note(end)
            start = end
        end += 1
    return ends, start


def walk(text: str, root: dict, start: int = 0, upto: int | None = None) -> tuple[list[int], int, list[dict]]:
    """As ``parse``, with the phrases as paths below ``root``, so a character is one look-up however long its phrase; and the nodes that grew."""
    ends, grown = [], []
    node, add, note = root, grown.append, ends.append
    for end, char in enumerate(text[start:upto], start + 1):
        below = node.get(char)
        if below is None:
            node[char] = {}
            add(node)
            note(end)
            node = root
        else:
            node = below
    return ends, ends[-1] if ends else start, grown


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def minima(codes: np.ndarray, start: int, ends: list[int], known: np.ndarray = _NOTHING) -> np.ndarray:
    """Minimum hashes of the phrases between ``start`` and ``ends``; with those ``known`` of other phrases, as far as they can be smaller."""
    if not ends:
        return _NOTHING
    _powers.to(len(codes))
    part = codes[start : ends[-1]].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(part * _powers.up[: len(part)], dtype=np.uint64)])
    to = np.array(ends) - start
    since = np.concatenate([[0], to[:-1]])
    hashes = _mixed((sums[to] - sums[since]) * _powers.down[since] + (to - since).astype(np.uint64))
    least = np.full(PLACES, 2**64 - 1, np.uint64)
    # A later round has no smaller minima, so rounds end with the last that the known ones needed.
    for turn in range(2 * PLACES if known is _NOTHING else int(known.max() >> np.uint64(55)) + 1):
        drawn = _mixed(hashes + np.uint64((turn * _BASE) % 2**64))
        value = (drawn >> np.uint64(9)) | np.uint64(turn << 55)
        if turn < PLACES:
            np.minimum.at(least, (drawn & np.uint64(PLACES - 1)).astype(np.intp), value)
        else:  # the places that are left, one by one
            least[turn - PLACES] = min(least[turn - PLACES], value.min())
        if least.max() < 2**64 - 1:
            break
    return least


def text_of_print(least: np.ndarray) -> str:
    if least is _NOTHING:
        return ""
    return (_mixed(least) & np.uint64(255)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    same = np.mean(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8))
    return float(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def edited_text(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class Parsed:
    """A document's fingerprint, and what is needed to fingerprint its edited text."""

    def __init__(self, text: str):
        self.text, self.root = text, {}
        self.cut = len(text) - len(text) // 4
        codes = codes_of(text)
        head, self.resume, _ = walk(text, self.root, 0, self.cut)
        self.head = minima(codes, 0, head)
        tail, _, grown = walk(text, self.root, self.resume)
        for node, end in zip(grown, tail):
            del node[text[end - 1]]
        self.print = text_of_print(self._joined(minima(codes, self.resume, tail, self.head)))

    def _joined(self, tail: np.ndarray) -> np.ndarray:
        return tail if self.head is _NOTHING else self.head if tail is _NOTHING else np.minimum(self.head, tail)

    def edited_print(self, edited: str) -> str:
        tail, _, _ = walk(edited, self.root, self.resume)
        return text_of_print(self._joined(minima(codes_of(edited), self.resume, tail, self.head)))


def fingerprint(text: str) -> str:
    return Parsed(text).print


def _stream(batches):
    bucket, before = None, None
    for batch in batches:
        rows = []
        for b, doc, text in zip(batch["bucket"].tolist(), batch["doc"].tolist(), batch["text"].tolist()):
            now = (doc, Parsed(text))
            if b == bucket:
                own, parsed = before
                edited = edited_text(parsed.text, text)
                changed = parsed.edited_print(edited)
                rows.append((
                    None if own == NO_ID else own, len(parsed.text), hashlib.sha256(edited.encode()).hexdigest(), parsed.print, changed,
                    likeness(parsed.print, changed), likeness(parsed.print, now[1].print),
                ))
            bucket, before = b, now
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def neighbour_prints(docs: DataFrame) -> DataFrame:
    spark = prepare(docs)
    texts = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    parts = partitions_of(spark)
    buckets = parts * BUCKETS_PER_PARTITION
    found = texts.agg(F.percentile_approx("doc", [k / buckets for k in range(1, buckets)] or [0.5], 100 * buckets)).first()[0]
    splits = sorted(set(found or []))

    @F.pandas_udf("int")
    def bucket_of(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(splits, np.int64), doc.to_numpy(), side="right").astype(np.int32))

    dealt = texts.withColumn("bucket", bucket_of("doc"))
    # The smallest document of each range: as many rows as ranges.
    firsts = sorted((r["bucket"], r["doc"]) for r in dealt.groupBy("bucket").agg(F.min("doc").alias("doc")).collect())
    if not firsts:
        return spark.createDataFrame([], OUT)
    names = [b for b, _ in firsts]
    before = [(names[bisect.bisect_left(names, b) - 1], doc) for b, doc in firsts]
    heads = (
        texts.join(F.broadcast(spark.createDataFrame(before, "bucket int, doc long")), "doc")
        .groupBy("bucket", "doc").agg(F.min("text").alias("text"))
        .select("doc", "text", "bucket", F.lit(True).alias("is_next"))
    )
    ranges = dealt.withColumn("is_next", F.lit(False)).unionByName(heads)
    ordered = ranges.repartition(parts, "bucket").sortWithinPartitions("bucket", "is_next", "doc", "text")
    return ordered.mapInPandas(_stream, OUT)
