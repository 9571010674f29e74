"""Line dedup: which lines of a document to keep, as one compressed bitmap per document.

A line's key is the line without white space at both ends and with A-Z in lower case. A key of at least ``min_chars`` code points
in at least ``min_docs`` documents loses its lines everywhere but in the largest ``doc_id`` that holds it.

1. Lines become rows (128-bit hash, document, positions), one per document and key; texts stay behind.
2. The rows are range-partitioned and sorted by hash and document. The document is part of the range key, so a key that a third of
   all documents hold is spread over many partitions.
3. Each partition is streamed in order. Inside a partition the first row of a run is the document that keeps the line. A run
   that touches a partition's edge may go on in the next one; its rows are left open, and are settled by the counts of these few
   keys (two per partition at most, which bounds the broadcast).
4. Dropped positions are gathered by document and packed into bitmaps.

Defined cases: null or empty text is one empty line; an empty key is never dropped; equal rows count as one document and are treated
alike; rows of one ``doc_id`` with other texts count as one document; a null ``doc_id`` is the smallest; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, partitions_of, prepare, stored, texts_of

MIN_CHARS, MIN_DOCS = 40, 5
# Stands for a null document number; no smaller number exists.
NO_ID = -(2**63)
DROPPED, OPEN, SETTLED = 0, 1, 2
STREAMED = "kind byte, h1 long, h2 long, doc long, row_key long, n_lines int, at array<int>, docs int"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _doc(docs: DataFrame) -> DataFrame:
    """One row per document and text, with the key under which its bitmap is found again."""
    return texts_of(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text").alias("row_key"), "text"
    )


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc, row_key, n_lines, at``: the positions of each long enough key in each document."""
    lines = _doc(docs).select("doc", "row_key", F.split("text", "\n", -1).alias("lines"))
    keys = lines.select(
        "doc", "row_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    ).select("doc", "row_key", "n_lines", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc", "row_key", "n_lines", F.array("pos").alias("at")
    )


def _streamer(min_docs: int):
    def emit(kind, rows, docs=0):
        out = rows.assign(kind=np.int8(kind), docs=np.int32(docs))
        return out[["kind", "h1", "h2", "doc", "row_key", "n_lines", "at", "docs"]]

    def stream(batches):
        # The run at the end of what was read: its key, its first document, its documents so far, and rows not yet decided.
        first_key, key, keeper, docs, last_doc, held = None, None, 0, 0, None, []
        for batch in batches:
            if not len(batch):
                continue
            h1, h2, doc = (batch[c].to_numpy() for c in ("h1", "h2", "doc"))
            if first_key is None:
                first_key = (h1[0], h2[0])
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(batch)]
            # Runs that begin and end inside the batch, all at once.
            inner = np.zeros(len(batch), bool)
            if len(starts) > 2:
                lo, hi = starts[1], ends[-2]
                new_doc = np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]]
                run = np.repeat(np.arange(len(starts) - 2), (ends - starts)[1:-1])
                new_doc[starts[1:-1] - lo] = True
                counts = np.bincount(run, weights=new_doc).astype(int)
                inner[lo:hi] = (counts[run] >= min_docs) & (doc[lo:hi] != doc[starts[1:-1]][run])
                inner_rows = batch[inner]
            else:
                inner_rows = batch[:0]
            for k in dict.fromkeys((0, len(starts) - 1)):
                rows = batch.iloc[starts[k] : ends[k]]
                now = (h1[starts[k]], h2[starts[k]])
                if now != key:
                    # The run before ended inside this partition; rows still held are of too few documents, their lines stay.
                    key, keeper, docs, last_doc, held = now, rows["doc"].iloc[0], 0, None, []
                own = rows["doc"].to_numpy()
                docs += int(np.count_nonzero(own[1:] != own[:-1])) + (last_doc is None or own[0] != last_doc)
                last_doc = own[-1]
                if key == first_key:
                    yield emit(OPEN, rows)
                    continue
                held.append(rows)
                if docs >= min_docs:
                    rows = pd.concat(held)
                    held = []
                    yield emit(DROPPED, rows[rows["doc"] != keeper])
            if len(inner_rows):
                yield emit(DROPPED, inner_rows)
        if key is not None and key != first_key:
            if held and docs < min_docs:
                yield emit(OPEN, pd.concat(held))
            else:
                end = pd.DataFrame({"h1": [key[0]], "h2": [key[1]], "doc": [keeper], "row_key": [0], "n_lines": [0], "at": [[]]})
                yield emit(SETTLED, end, docs)

    return stream


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, row_key, n_lines, n_dropped, bitmap`` of every document that loses lines."""
    spark = prepare(docs)
    rows = line_rows(docs, min_chars)
    dealt = rows.repartitionByRange(partitions_of(spark), F.col("h1"), F.col("h2"), F.col("doc").desc())
    ordered = dealt.sortWithinPartitions("h1", "h2", F.col("doc").desc())
    streamed = stored(ordered.mapInPandas(_streamer(min_docs), STREAMED), "line-runs")

    edge = streamed.filter(F.col("kind") != DROPPED)
    per_doc = edge.groupBy("h1", "h2", "doc").agg(F.max(F.when(F.col("kind") == SETTLED, F.col("docs")).otherwise(1)).alias("docs"))
    per_key = per_doc.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("keeper")).filter(F.col("docs") >= min_docs)
    late = (
        streamed.filter(F.col("kind") == OPEN)
        .select("h1", "h2", "doc", "row_key", "n_lines", "at")
        .join(F.broadcast(per_key), ["h1", "h2"])
        .filter(F.col("doc") != F.col("keeper"))
    )
    wanted = ["doc", "row_key", "n_lines", "at"]
    dropped = streamed.filter(F.col("kind") == DROPPED).select(*wanted).unionByName(late.select(*wanted))
    gathered = dropped.groupBy("doc", "row_key").agg(
        F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")
    )

    @F.pandas_udf("binary")
    def packed(n_lines: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([pack_bitmap(n, a) for n, a in zip(n_lines, at, strict=True)])

    return gathered.select("doc", "row_key", "n_lines", F.size("at").alias("n_dropped"), packed("n_lines", "at").alias("bitmap"))


def pack_bitmap(n_lines: int, dropped) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped, dtype=np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def kept_lines(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines = text.split("\n")
    return "\n".join(line for line, stays in zip(lines, unpack_bitmap(bitmap, len(lines)), strict=True) if stays)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept, row``: the kept text of each row, and the row as it came."""
    whole = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce("row.text", F.lit("")).alias("text"),
    )
    keyed = whole.withColumn("row_key", F.xxhash64("doc", "text"))
    joined = keyed.join(bitmaps.select("doc", "row_key", "n_dropped", "bitmap"), ["doc", "row_key"], "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([kept_lines(t, b) for t, b in zip(text, bitmap, strict=True)])

    # Python sees only the texts that lose lines.
    after = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(kept(F.when(F.col("bitmap").isNull(), F.lit("")).otherwise(F.col("text")), "bitmap"))
    return joined.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        after.alias("kept"),
        "row",
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


