"""Secret scans: base patterns as they stand, and encoded keys and signed tokens that their own structure confirms.

``scan_texts`` gives every row of ``docs`` an array of spans (``kind, start, end, detail``; code points, end exclusive), in order of start
and then of ``KINDS``. Base kinds are ``assign``, ``access`` and ``hex``: leftmost matches that don't overlap within a kind, those too
short dropped afterwards. The others come from candidates: runs of base64 (line breaks, also escaped ones, may lie inside) or of hex, and dotted
triples. A candidate is decoded and parsed (``encoded_keys``): the outermost length says how much of the run belongs to it, all nested lengths
must fit, the primes of a key must give its modulus, a token's header must be an object that names its algorithm. Only then it is reported.
Runs that decode to text are searched in turn, to any depth, and report the outer run. A confirmed span never hides a base one.

One pass over the texts, no shuffle. A multi-pattern test over a whole Arrow column finds the texts that can hold anything; only those are read
by Python. Null text is empty and has no spans; each row, repeated or with null ``doc_id``, is judged by itself; other columns are kept in
``row``. A text is one cell and is read whole, in time linear in its length but for planted runs of nested headers.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import prepare
from .encoded_keys import from_base64, key_of, needed_bytes, token_of

BASE = ("assign", "access", "hex")
CONFIRMED = ("private_key", "encrypted_key", "key_store", "signed_token")
KINDS = BASE + CONFIRMED

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Runs of hex digits don't overlap, so only the long ones need to be stopped at.
HEX = re.compile("[0-9a-f]{%d,}" % HEX_LEAST)

RUN_LEAST = 32
# Runs of base64 in its two alphabets, the lines that may go on with one, runs of hex digits in pairs, and tokens.
RUNS = [re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{%d,}" % RUN_LEAST), re.compile(r"(?<![A-Za-z0-9_-])-*([A-Za-z0-9_][A-Za-z0-9_-]{%d,})" % RUN_LEAST)]
NEXT_LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*([A-Za-z0-9+/]+)")
PADDING = re.compile("={0,2}")
# After an escaped line break a run seems to begin one letter too early.
ESCAPE = re.compile(r"(?<=\\)n([A-Za-z0-9+/]{%d,})" % RUN_LEAST)
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){%d,}(?![0-9A-Fa-f])" % RUN_LEAST)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*){2,4}")

# What a text must hold to have any span at all; wider than the patterns.
ANYTHING = (
    r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{%d}|[A-Za-z0-9+/]{%d}|[A-Za-z0-9_-]{%d}|e[w-z0-9_-][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]*\."
    % (HEX_LEAST, RUN_LEAST, RUN_LEAST)
)

SPANS = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("detail", "string"))


def base_spans(text: str) -> list[tuple]:
    out = [("assign", *m.span(), "") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", *m.span(), "") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", *m.span(), "") for m in HEX.finditer(text)]


class Wrapped:
    """A run of base64 and the lines after it, read only as far as asked for."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.parts, self.size, self.open = text, [(start, end)], end - start, True

    def reach(self, chars: int | None) -> str:
        """At least ``chars`` digits if there are so many; None: all."""
        while self.open and (chars is None or self.size < chars):
            more = NEXT_LINE.match(self.text, self.parts[-1][1])
            if more is None:
                self.open = False
            else:
                self.parts.append(more.span(1))
                self.size += more.end(1) - more.start(1)
        return "".join(self.text[a:b] for a, b in self.parts)

    def end_of(self, chars: int) -> int:
        """Where in the text the first ``chars`` digits end, with padding."""
        for a, b in self.parts:
            if chars <= b - a:
                return PADDING.match(self.text, a + chars).end() if a + chars == b else a + chars
            chars -= b - a
        return self.parts[-1][1]


def _digits(size: int) -> int:
    return (size * 4 + 2) // 3


def _as_text(data: bytes | None) -> str | None:
    try:
        text = data.decode() if data else ""
    except UnicodeDecodeError:
        return None
    return text if len(text) >= RUN_LEAST and all(c.isprintable() or c in "\t\r\n" for c in text[:64]) else None


def _base64_key(text: str, start: int, end: int) -> tuple | None:
    """The key that a run encodes from its first digit on."""
    head = from_base64(text[start : start + 32])
    size = needed_bytes(head) if head else None
    if size is None:
        return None
    run = Wrapped(text, start, end)
    digits = run.reach(None if size < 0 else _digits(size))
    if size >= 0:
        digits = digits[: _digits(size)]
    data = from_base64(digits if len(digits) % 4 != 1 else digits[:-1])
    found = key_of(data) if data else None
    return (found[0], start, run.end_of(_digits(found[2])), found[1]) if found else None


def _base64_text(text: str, start: int, end: int) -> tuple[int, tuple | None]:
    """Where the run and its lines end, and the first key or token in the text that they encode, if they do."""
    run = Wrapped(text, start, end)
    first = text[start:end]
    if _as_text(from_base64(first[: len(first) - len(first) % 4])) is None:
        return end, None
    digits = run.reach(None)
    inner, last = _as_text(from_base64(digits)), run.end_of(len(digits))
    if inner is None:
        inner, last = _as_text(from_base64(first)), run.end_of(end - start)
    found = confirmed_spans(inner) if inner is not None else []
    return run.parts[-1][1], (found[0][0], start, last, f"{found[0][3]} in base64") if found else None


def _hex_key(text: str, start: int, end: int) -> tuple | None:
    data = bytes.fromhex(text[start:end])
    found = key_of(data)
    if found:
        return (found[0], start, start + 2 * found[2], f"{found[1]} in hex")
    inner = _as_text(data)
    found = confirmed_spans(inner) if inner is not None else []
    return (found[0][0], start, end, f"{found[0][3]} in hex") if found else None


def confirmed_spans(text: str) -> list[tuple]:
    """Keys, key stores and tokens whose structure holds; each in one span, the leftmost first."""
    out, upto, block = [], 0, 0
    runs = {m.span() for m in RUNS[0].finditer(text)} | {m.span(1) for m in RUNS[1].finditer(text)}
    if "\\n" in text:
        runs |= {m.span(1) for m in ESCAPE.finditer(text)}
    for start, end in sorted(runs):
        if start < upto:
            continue
        found = _base64_key(text, start, end)
        # Encoded text is looked at once a block of lines, from its first line.
        if found is None and start >= block:
            block, found = _base64_text(text, start, end)
        if found:
            out.append(found)
            upto = found[2]
    for m in HEX_RUN.finditer(text):
        if found := _hex_key(text, *m.span()):
            out.append(found)
    for m in TOKEN.finditer(text):
        parts = m.group().split(".")
        n = 5 if len(parts) == 5 and token_of(parts) else 3
        alg = token_of(parts[:n])
        if alg:
            out.append(("signed_token", m.start(), m.start() + len(".".join(parts[:n])), alg))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_of(text: str) -> list[tuple]:
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches):
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        some = pc.fill_null(pc.match_substring_regex(texts, ANYTHING), False)
        spans = [None] * len(texts)
        for k in pc.indices_nonzero(some).to_pylist():
            spans[k] = [dict(zip(("kind", "start", "end", "detail"), s)) for s in spans_of(texts[k].as_py())]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))
        yield pa.RecordBatch.from_arrays([rows, pa.array([s or [] for s in spans], kind)], ["row", "spans"])


def scan_texts(docs: DataFrame) -> DataFrame:
    """``row`` (the given columns but ``text``) and ``spans``."""
    prepare(docs)
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() != "text"]
    given = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_scan, StructType([given.schema["row"], StructField("spans", SPANS)]))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, a hash of them, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_confirmed"),
    )
