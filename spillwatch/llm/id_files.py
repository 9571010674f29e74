"""Token-number files: documents in order of ``doc_id``, as range-coded blocks.

A task writes one shard, the documents of a range of ``doc_id`` in order; shard k holds smaller numbers than shard k + 1. A shard is
cut into blocks of ``BLOCK`` numbers regardless of documents. The container is Parquet, so any store and Spark's committer serve; a row
is a block:

    shard int, block int, n_ids int, crc long (CRC-32 of the numbers as 16-bit little-endian integers), payload binary,
    doc_ids array<long>, doc_tokens array<int> (the documents that begin in this block, in order),
    order0 binary (the shares of all numbers in this and the next blocks; null: those of the block before)

Blocks are coded by ``id_coder``, each from a fresh model and the last table of shares at or before it. Reading decodes a shard's blocks side by
side, checks every block, and puts documents together across blocks; a block that fails its check fails the read and is named.

Defined cases: null text is empty, a document of the end number alone; null ``doc_id`` comes first; rows of one ``doc_id`` follow in order of
their text; an empty table gives no blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_of, prepare, texts_of
from .id_coder import BLOCK, LANES, checksum, decode_blocks, encode_blocks, table_of
from .tokens import crc_of, default_path, encoded_slabs

BLOCK_ROW = "shard int, block int, n_ids int, crc long, payload binary, doc_ids array<long>, doc_tokens array<int>, order0 binary"
READ_ROW = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    spark = prepare(docs)
    path = tokenizer or default_path()

    def encode(batches):
        shard, number = TaskContext.get().partitionId(), itertools.count()
        held: list[np.ndarray] = []
        size = 0
        begun: list[tuple[int, int | None, int]] = []  # where in ``held`` a document begins, its number and length

        def blocks(last: bool):
            nonlocal held, size, begun
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            whole = len(ids) if last else len(ids) - len(ids) % BLOCK
            parts = [ids[k : min(k + BLOCK, whole)] for k in range(0, whole, BLOCK)]
            inside: list[list] = [[] for _ in parts]
            for at, doc, n in begun:
                if at < whole:
                    inside[at // BLOCK].append((doc, n))
            begun = [(at - whole, doc, n) for at, doc, n in begun if at >= whole]
            held, size = [ids[whole:]], len(ids) - whole
            table = table_of(parts)
            rows = [
                (shard, next(number), len(p), checksum(p), payload, [d for d, _ in own], [n for _, n in own], None if k else table)
                for k, (p, payload, own) in enumerate(zip(parts, encode_blocks(parts, table), inside))
            ]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK_ROW.split(", ")])

        for batch in batches:
            doc_ids = [None if d is pd.NA else d for d in batch["doc_id"].astype("Int64").tolist()]
            for first, ids, starts in encoded_slabs(batch["text"].tolist(), path):
                for k in range(len(starts) - 1):
                    begun.append((size + int(starts[k]), doc_ids[first + k], int(starts[k + 1] - starts[k])))
                held.append(ids)
                size += len(ids)
                if size >= BLOCK * LANES:
                    yield blocks(False)
        if size:
            yield blocks(True)

    texts = texts_of(docs)
    ordered = texts.repartitionByRange(partitions_of(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(encode, BLOCK_ROW).write.option("compression", "uncompressed").mode("overwrite").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def decode(batches):
        shard, at = None, 0
        waiting: deque[list] = deque()  # documents begun: number, tokens, start, parts, numbers still to come

        def take(ids: np.ndarray, rows):
            done = []
            while len(ids):
                doc = waiting[0]
                part, ids = ids[: doc[4]], ids[doc[4] :]
                doc[3].append(part)
                doc[4] -= len(part)
                if not doc[4]:
                    whole = np.concatenate(doc[3])
                    done.append((shard, doc[0], doc[2], doc[1], crc_of(whole)))
                    waiting.popleft()
            rows += done

        table = None
        for batch in batches:
            rows: list[tuple] = []
            columns = {c: batch[c].tolist() for c in batch}
            begins = [k for k, own in enumerate(columns["order0"]) if own is not None]
            for lo, hi in itertools.pairwise(sorted({0, *begins, *range(0, len(batch), LANES), len(batch)})):
                if columns["order0"][lo] is not None:
                    table = columns["order0"][lo]
                part = {c: values[lo:hi] for c, values in columns.items()}
                decoded = decode_blocks(part["payload"], part["n_ids"], table)
                for ids, of, block, crc, docs, tokens in zip(decoded, *(part[c] for c in ("shard", "block", "crc", "doc_ids", "doc_tokens"))):
                    if checksum(ids) != crc:
                        raise ValueError(f"block {block} of shard {of} doesn't match its checksum")
                    if of != shard:
                        shard, at = of, 0
                    for doc, n in zip(docs, tokens):
                        waiting.append([None if pd.isna(doc) else int(doc), int(n), at, [], int(n)])
                        at += int(n)
                    take(ids, rows)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_ROW.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    blocks = spark.read.schema(BLOCK_ROW).parquet(folder)
    prepare(blocks)
    # One row per shard, so as many as the writer had tasks.
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = list(itertools.accumulate([0, *(n for _, n in sizes)]))[:-1]
    offsets = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, before)], "shard int, before long")
    ordered = blocks.repartitionByRange(partitions_of(spark), "shard").sortWithinPartitions("shard", "block")
    found = ordered.mapInPandas(decode, READ_ROW).join(F.broadcast(offsets), "shard")
    return found.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
