"""Generic detectors that need no rule pack, and the union of all detectors' findings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shannon_entropy
from ..shipping import ship_package
from .lines import explode_lined

# What a token and an assignment look like.
TOKEN_CHARACTERS = "[A-Za-z0-9+/=_-]"
ASSIGNED_NAMES = "password|passwd|secret|token|api_?key|access_?key|auth_?key|private_?key|client_?secret"
ASSIGNMENT = rf"(?i)(?:{ASSIGNED_NAMES})\s*[:=]\s*[\"'][^\"'\s]{{8,}}[\"']"
ENTROPY_DETECTOR, ASSIGNMENT_DETECTOR, STRETCH_DETECTOR = "Entropy (Pure)", "Regex (Vendor)", "Regex (Entropy)"
# Entropies of windows are whole numbers of this part of a bit, so that equal ones are equal.
ENTROPY_UNIT = 10**9
# Windows of a long token that are counted at once.
WINDOWS = 1 << 16


def _finding(value, detector: str, kind: str):
    return [F.lit(kind).alias("type"), value, "file", "line", F.lit(detector).alias("detector")]


def _lined(files: DataFrame, values) -> DataFrame:
    """Distinct values of each file with their first line; the text is gone from here on."""
    return explode_lined(files.select("file", "content"), values, ["file"])


def entropy_tokens(files: DataFrame, min_length: int = 20, threshold: float = 4.5) -> DataFrame:
    """Long tokens that look random, whatever they belong to."""
    tokens = F.regexp_extract_all("content", F.lit(f"{TOKEN_CHARACTERS}{{{min_length},}}"), F.lit(0))
    found = _lined(files, tokens)
    random = found.where(shannon_entropy(F.col("value")) >= threshold)
    return random.select(*_finding("value", ENTROPY_DETECTOR, "High-entropy token"))


def assigned_secrets(files: DataFrame) -> DataFrame:
    """``name = "value"`` where the name says credential."""
    found = _lined(files, F.regexp_extract_all("content", F.lit(ASSIGNMENT.replace(r"\s", r"[\t\n\f\r ]")), F.lit(0)))
    return found.select(*_finding("value", ASSIGNMENT_DETECTOR, "Assigned credential"))


def window_terms(width: int) -> np.ndarray:
    """What a character that a window holds 0, 1, ... times adds to the window's entropy."""
    share = np.arange(1, width + 1) / width
    return np.concatenate([[0], np.round(ENTROPY_UNIT * -share * np.log2(share))]).astype(np.int64)


def most_random(token: str, width: int, terms: np.ndarray) -> tuple[int, int]:
    """Start and entropy of the first of the most random windows; counts per character come from their sums over prefixes."""
    data = np.frombuffer(token.encode("utf-32-le"), np.uint32)
    best = (-1, 0)
    for lo in range(0, len(data) - width + 1, WINDOWS):
        part = data[lo : lo + WINDOWS + width - 1]
        total = np.zeros(len(part) - width + 1, np.int64)
        for character in np.unique(part):
            upto = np.concatenate([[0], np.cumsum(part == character)])
            total += terms[upto[width:] - upto[:-width]]
        at = int(total.argmax())
        best = max(best, (int(total[at]), -(lo + at)))
    return -best[1], best[0]


def random_stretch(token: Column, width: int) -> Column:
    """``start`` (from 1) and ``entropy``, in bits, of the most random ``width`` characters; null for a shorter token."""
    terms = window_terms(width)

    @F.arrow_udf("struct<start:int,entropy:double>")
    def stretch(tokens: pa.Array) -> pa.Array:
        found = [most_random(t, width, terms) if t is not None and len(t) >= width else None for t in tokens.to_pylist()]
        rows = [None if f is None else {"start": f[0] + 1, "entropy": f[1] / ENTROPY_UNIT} for f in found]
        return pa.array(rows, pa.struct([("start", pa.int32()), ("entropy", pa.float64())]))

    return stretch(token)


def random_stretches(files: DataFrame, width: int = 20, threshold: float = 4.0) -> DataFrame:
    """The most random stretch of each long token, so that a key is found inside a longer path, name or blob.

    A stretch is reported once per file, on the line of the first token that it stands in.
    """
    ship_package(files.sparkSession)
    tokens = _lined(files, F.regexp_extract_all("content", F.lit(f"{TOKEN_CHARACTERS}{{{width},}}"), F.lit(0)))
    found = tokens.withColumn("stretch", random_stretch(F.col("value"), width)).where(F.col("stretch.entropy") >= threshold)
    part = F.substring("value", F.col("stretch.start"), F.lit(width))
    firsts = found.groupBy("file", part.alias("value")).agg(F.min("line").alias("line"))
    return firsts.select(*_finding("value", STRETCH_DETECTOR, "Random stretch"))


def union_detectors(*findings: DataFrame) -> DataFrame:
    """All findings, also those that several detectors share."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)
