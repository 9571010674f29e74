"""Quality classifier: a small convolutional network over bytes, written in numpy.

Filters of ``WIDTH`` bytes slide over the whole text. Their responses are max-pooled in chunks of ``CHUNK`` bytes, each chunk
overlapping the next by half, rectified, and the chunks' vectors are combined by their mean and their maximum into one
probability. A filter is a table of byte weights per place, so scoring is table lookups over the bytes of many documents at once.

Training sees whole texts of at most ``SAMPLE`` labelled documents, those with the smallest hash of ``doc_id`` of the rows that are not held
out, and no more of them than ``SAMPLE_BYTES`` hold (a longer text is no part of the sample). Both are parameters; windows are drawn from all of a
text, and scoring reads every byte of every document.

Defined cases: null text is empty, and an empty text has the score of a zero vector; null labels are no labels; a labelled row without
a document is ignored; a null ``doc_id`` has hash 0 and is held out; with no labelled rows at all every score is ``PRIOR``; equal
rows get equal scores; an empty table gives no rows; other columns pass through ``rejected`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, texts_of

WIDTH, FILTERS, CHUNK = 4, 8, 256
HALF = CHUNK // 2
SAMPLE, SAMPLE_BYTES, STEPS = 2000, 64 << 20, 700
FOLDS, THRESHOLD, PRIOR = 5, 0.3, 0.5
# Bytes of text that are scored at once.
SLAB = 1 << 20


@dataclass
class Network:
    bytes_: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    out_bias: float

    def pair_tables(self) -> list[np.ndarray]:
        """Weights of two neighbouring bytes in one table: half as many lookups."""
        first, second = self.bytes_[0::2], self.bytes_[1::2]
        return [(b[:, None, :] + a[None, :, :]).reshape(65536, -1).astype(np.float32) for a, b in zip(first, second, strict=True)]


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def half_chunk_maxima(data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Maxima of all filters per ``HALF`` bytes of ``data``; the last WIDTH - 1 bytes of it start no filter."""
    pairs = data[:-1].astype(np.uint16)
    pairs |= data[1:].astype(np.uint16) << 8
    n = len(data) - WIDTH + 1
    response = np.take(tables[0], pairs[:n], axis=0)
    response += np.take(tables[1], pairs[2 : 2 + n], axis=0)
    return np.maximum.reduceat(response, np.arange(0, n, HALF), axis=0)


def pooled(texts: list[bytes], network: Network, tables: list[np.ndarray]) -> np.ndarray:
    """(documents, 2 * FILTERS): mean and maximum over chunks of the rectified chunk maxima."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    for k, text in enumerate(texts):
        if not text:
            continue
        maxima = []
        # Slabs share WIDTH - 1 bytes, so no place of a filter is lost; zero bytes pad the end.
        for lo in range(0, len(text), SLAB):
            part = np.frombuffer(text[lo : lo + SLAB + WIDTH - 1].ljust(min(SLAB, len(text) - lo) + WIDTH - 1, b"\0"), np.uint8)
            maxima.append(half_chunk_maxima(part, tables))
        halves = np.concatenate(maxima)
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        active = np.maximum(chunks + network.bias, 0)
        out[k, :FILTERS], out[k, FILTERS:] = active.mean(axis=0), active.max(axis=0)
    return out


def score(texts: list[bytes], network: Network, tables: list[np.ndarray]) -> np.ndarray:
    z = pooled(texts, network, tables) @ network.out + network.out_bias
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Network:
    """Adam on the logistic loss; only the places that win the max-pooling carry gradients."""
    rng = np.random.default_rng(seed)
    p = {
        "bytes": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.3, 2 * FILTERS),
        "out_bias": np.zeros(1),
    }
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    groups = [np.flatnonzero(labels == y) for y in (0, 1)]
    groups = [g for g in groups if len(g)]
    padded = [np.frombuffer(t.ljust(CHUNK + WIDTH - 1, b"\0"), np.uint8) for t in texts]
    batch, per_doc = 48, 6
    for step in range(1, steps + 1):
        # Both labels equally often; the bias is put back to the labels' true share at the end.
        docs = np.concatenate([rng.choice(g, batch // len(groups)) for g in groups])
        pieces = np.empty((len(docs), per_doc, CHUNK + WIDTH - 1), np.uint8)
        for i, d in enumerate(docs):
            starts = rng.integers(0, len(padded[d]) - CHUNK - WIDTH + 2, per_doc)
            for j, s in enumerate(starts):
                pieces[i, j] = padded[d][s : s + CHUNK + WIDTH - 1]
        response = sum(p["bytes"][w][pieces[:, :, w : w + CHUNK]] for w in range(WIDTH))
        at = response.argmax(axis=2)
        top = np.take_along_axis(response, at[:, :, None, :], axis=2)[:, :, 0, :] + p["bias"]
        active = np.maximum(top, 0)
        best = active.argmax(axis=1)
        features = np.concatenate([active.mean(axis=1), active.max(axis=1)], axis=1)
        error = 1 / (1 + np.exp(-(features @ p["out"] + p["out_bias"]))) - labels[docs]
        error /= len(docs)
        grad = {"out": features.T @ error + 1e-4 * p["out"], "out_bias": np.array([error.sum()])}
        back = np.repeat((error[:, None] * p["out"][:FILTERS] / per_doc)[:, None, :], per_doc, axis=1)
        add = error[:, None] * p["out"][FILTERS:]
        np.put_along_axis(back, best[:, None, :], np.take_along_axis(back, best[:, None, :], axis=1) + add[:, None, :], axis=1)
        back *= top > 0
        grad["bias"] = back.sum(axis=(0, 1))
        grad["bytes"] = 1e-5 * p["bytes"]
        i, j, f = np.indices(at.shape)
        for w in range(WIDTH):
            np.add.at(grad["bytes"][w], (pieces[i, j, at + w], f), back)
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
            square[k] = 0.99 * square[k] + 0.01 * grad[k] ** 2
            p[k] = p[k] - 0.02 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Network(p["bytes"].astype(np.float32), p["bias"].astype(np.float32), p["out"].astype(np.float32), float(p["out_bias"][0]))


def calibrated(network: Network, texts: list[bytes], labels: np.ndarray) -> Network:
    """Scale and shift of the last layer, fitted on the whole sample in its true mixture of labels."""
    tables = network.pair_tables()
    z = pooled(texts, network, tables).astype(np.float64) @ network.out + network.out_bias
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a prior on the scale
        s = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(s * (1 - s), 1e-6)
        g = np.array([((s - labels) * z).sum() + 0.1 * (a - 1), (s - labels).sum() + 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return Network(network.bytes_, network.bias, (network.out * a).astype(np.float32), network.out_bias * a + b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network for ``labels.quality`` from at most ``sample`` whole documents of ``sample_bytes`` in all; None where there is none."""
    prepare(docs)
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    wanted = (
        rows.filter(fold_of(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # ``wanted`` has ``sample`` rows at most, so it is safe to broadcast.
    found = texts_of(docs).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    found = stored(found.withColumn("size", F.octet_length("text")), "quality-sample")
    taken, held = [], 0
    for row in found.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + row["size"] <= sample_bytes:
            taken.append(row["doc_id"])
            held += row["size"]
    got = found.filter(F.col("doc_id").isin(taken)).select("doc_id", "quality", F.encode("text", "utf-8").alias("seen")).collect()
    if not got:
        return None
    got.sort(key=lambda r: r["doc_id"])
    texts, truth = [bytes(r["seen"]) for r in got], np.array([r["quality"] for r in got])
    if len(set(truth)) < 2:
        share = (truth.sum() + 1) / (len(truth) + 2)
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(share / (1 - share))))
    return calibrated(train(texts, truth), texts, truth)


def scorer(network: Network | None):
    @F.pandas_udf("double")
    def scored(batches: pd.Series) -> pd.Series:
        if network is None:
            return pd.Series(np.full(len(batches), PRIOR))
        tables = network.pair_tables()
        return pd.Series(score([t.encode() for t in batches], network, tables))

    return scored


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, row`` for every row of ``docs``."""
    prepare(docs)
    network = fit(docs, labels)
    whole = docs.select(F.struct("*").alias("row"))
    scored = whole.select(
        F.col("row.doc_id").alias("doc_id"),
        (fold_of(F.col("row.doc_id")) == 0).alias("held_out"),
        scorer(network)(F.coalesce("row.text", F.lit(""))).alias("score"),
        "row",
    )
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "row")
