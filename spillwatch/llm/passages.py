"""Removal of long repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same document or another.

1. Equal texts are folded: if a long enough text occurs twice, all of it goes, and one copy stays as a partner for other texts.
2. Every string of ``LENGTH`` bytes holds an anchor: the smallest hash of ``GRAM`` bytes among those inside it. Equal strings hold equal
   anchors at equal places, so only equal anchors have to meet. A row per anchor carries hashes, no text; what surrounds it, as far as
   strings with this anchor reach, is its segment. Equal segments of one anchor repeat all their strings and are settled there.
3. The distinct segments of an anchor are read from the texts and joined. For a batch of anchors the suffixes are ordered, to a
   depth beyond ``LENGTH``, and from the transform the common prefixes follow by increasing value: a boundary between neighbouring
   suffixes with a common prefix of l bytes gives, extended backwards by every byte, boundaries with l + 1. Breadth first, this stops
   at ``LENGTH``. Boundaries not reached separate suffixes that share at least ``LENGTH`` bytes; these strings repeat.
4. An anchor with more than ``HOT`` distinct segments doesn't fit a batch. Its strings are hashed one by one and counted, which is exact too
   and spreads over all tasks.
5. Spans are merged by document.

Defined cases: null text is empty; texts shorter than ``LENGTH`` stay whole; repeated rows are documents of their own; texts that share a ``doc_id``, or
have a null one, are told apart by 128 bits of number and text, and null comes back as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_of, prepare, stored, texts_of
from .shingle_join import BROADCAST_ROWS, mixed

LENGTH, GRAM = 200, 128
REACH = LENGTH - GRAM  # an anchor lies at most so far into a string
HOT, BATCH_BYTES = 150, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_down(n: int):
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE)]
    return _powers


def sums_of(data: np.ndarray) -> np.ndarray:
    up, _ = _up_down(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def hashes_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _up_down(len(sums))[1][start])


def anchors_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text: in every ``REACH + 1`` neighbouring places the smallest hash, the last one of equals."""
    n = len(sums) - GRAM
    place = np.arange(n)
    grams = hashes_of(sums, place, place + GRAM)
    order = (grams & np.uint64((2**33 - 1) << 31)) | (np.uint64(2**31 - 1) - place.astype(np.uint64))
    w = REACH + 1
    full = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    full[:n] = order
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    least = least[np.r_[True, least[1:] != least[:-1]]]
    at = np.unique((np.uint64(2**31 - 1) - (least & np.uint64(2**31 - 1))).astype(np.int64))
    return at, grams[at]


ANCHOR = "a long, seg long, doc long, rk long, start int, len int, at int"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            out, held = [], 0
            for doc, rk, text in zip(batch["doc"].tolist(), batch["rk"].tolist(), batch["text"].tolist()):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) < LENGTH:
                    continue
                sums = sums_of(data)
                at, grams = anchors_of(sums)
                start, end = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(data))
                seg = hashes_of(sums, start, end) + mixed((at - start).astype(np.uint64) * np.uint64(512) + (end - start).astype(np.uint64))
                out.append((grams.view(np.int64), seg.view(np.int64), np.full(len(at), doc), np.full(len(at), rk), start, end - start, at - start))
                held += len(at)
                if held > 50_000:
                    yield _frame(out)
                    out, held = [], 0
            if out:
                yield _frame(out)

    return docs.mapInPandas(work, ANCHOR)


def _frame(parts) -> pd.DataFrame:
    columns = [c.split()[0] for c in ANCHOR.split(", ")]
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*parts)))))


SAME, DISTINCT = 0, 1


def _resolve(batches):
    """Sorted by anchor and segment: rows whose segment repeats, and a row of each segment where an anchor has several."""
    carry, before, head, head_out = None, None, None, False
    columns = ["a", "seg", "doc", "rk", "start", "len", "at"]

    def judged(rows, following):
        """All of ``rows``; ``following`` is the key after them."""
        nonlocal before, head, head_out
        a, seg = rows["a"].to_numpy(), rows["seg"].to_numpy()
        n = len(rows)
        same_a, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        same_a[1:n] = a[1:] == a[:-1]
        same[1:n] = same_a[1:n] & (seg[1:] == seg[:-1])
        if before is not None:
            same_a[0] = a[0] == before[0]
            same[0] = same_a[0] and seg[0] == before[1]
        if following is not None:
            same_a[n] = a[-1] == following[0]
            same[n] = same_a[n] and seg[-1] == following[1]
        repeated = same[:n] | same[1:]
        first_of_seg = ~same[:n]
        first_of_run = ~same_a[:n]
        later = first_of_seg & ~first_of_run
        run = np.cumsum(first_of_run)
        several = np.zeros(run[-1] + 1, bool)
        several[run[later]] = True
        distinct = later | (first_of_run & several[run])
        parts = [rows[repeated].assign(kind=np.int8(SAME)), rows[distinct].assign(kind=np.int8(DISTINCT))]
        if several[0] and head is not None and not head_out:
            parts.append(head.assign(kind=np.int8(DISTINCT)))
            head_out = True
        starts = np.flatnonzero(first_of_run)
        if len(starts):
            head, head_out = rows.iloc[starts[-1] : starts[-1] + 1], bool(several[run[-1]])
        before = (a[-1], seg[-1])
        return pd.concat(parts)

    for batch in batches:
        if not len(batch):
            continue
        rows = batch[columns] if carry is None else pd.concat([carry, batch[columns]], ignore_index=True)
        carry = rows.iloc[-1:]
        if len(rows) > 1:
            yield judged(rows.iloc[:-1], (carry["a"].iloc[0], carry["seg"].iloc[0]))
    if carry is not None:
        yield judged(carry, None)


# ------------------------------------------------------------------ suffixes of a batch


def ordered_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first 256 bytes; every end mark (a zero byte at ``ends``) is a symbol of its own."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(to_end > k, padded[k : k + n], np.uint64(0))
    alone = to_end < 8
    order = np.argsort(key, kind="stable")
    ranks = _ranks(key[order], order, alone)
    depth = 8
    # Later sorts need no stable order: equal ranks stay equal, and are put in order of place at the end.
    while depth < 256 and ranks.max() < n - 1:
        following = np.zeros(n, np.uint64)
        following[: n - depth] = ranks[depth:]
        key = (ranks.astype(np.uint64) << np.uint64(32)) | following
        order = np.argsort(key)
        ranks = _ranks(key[order], order, alone)
        depth *= 2
    return np.argsort((ranks.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))


def _ranks(ordered: np.ndarray, order: np.ndarray, alone: np.ndarray) -> np.ndarray:
    new = np.r_[False, (ordered[1:] != ordered[:-1]) | alone[order[1:]] | alone[order[:-1]]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def shared_boundaries(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and for each whether it shares ``length`` bytes with the one before."""
    order = ordered_suffixes(text, ends)
    n = len(text)
    symbols = np.unique(np.r_[np.uint8(0), text])
    code = np.zeros(256, np.int64)
    code[symbols] = np.arange(len(symbols))
    coded = code[text]
    bwt = coded[order - 1]  # before the first suffix stands the last end mark
    totals = np.bincount(bwt, minlength=len(symbols))
    first = np.concatenate([[0], np.cumsum(totals)])[:-1]
    # How often each byte stands in the transform before each place; a row per byte, without the end mark.
    seen = np.zeros((len(symbols) - 1, n + 1), np.int32)
    for k in range(1, len(symbols)):
        np.cumsum(bwt == k, out=seen[k - 1, 1:])
    reached = np.zeros(n + 1, bool)
    # Common prefixes of zero bytes: where the first symbol changes, and between end marks.
    front = np.unique(np.r_[np.arange(totals[0] + 1), first[totals > 0]])
    front = front[front < n]
    before = np.array([0, n])  # boundaries of earlier steps
    for _ in range(length - 1):
        reached[front] = True
        # A byte matters at a boundary only if it stands on both sides of it inside the interval that it splits, so the bytes of
        # the smaller side are enough, unless these are more than all bytes.
        at = np.searchsorted(before, front)
        low, high = before[np.maximum(at - 1, 0)], before[np.minimum(at, len(before) - 1)]
        left = front - low <= high - front
        since, size = np.where(left, low, front), np.where(left, front - low, high - front)
        few = size < len(symbols)
        p = np.repeat(front[few], size[few])
        ends_at = np.cumsum(size[few])
        byte = bwt[np.repeat(since[few] - ends_at + size[few], size[few]) + np.arange(len(p))]
        p, byte = p[byte > 0], byte[byte > 0]
        count = seen[byte - 1, p]
        some = (first[byte] + count)[(count > 0) & (count < totals[byte])]
        counts = seen[:, front[~few]]
        rest = (first[1:, None] + counts)[(counts > 0) & (counts < totals[1:, None])]
        target = np.concatenate([some, rest])
        before = np.append(np.flatnonzero(reached[:n]), n)
        front = np.unique(target[~reached[target]])
        if not len(front):
            break
    reached[front] = True
    return order, ~reached[:n]


def repeated_strings(segments: list[bytes], where: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(segment, offset)`` of strings that occur at two places at least. ``where``: for each segment two numbers, its
    document and its start, so that one place seen through two segments isn't taken for two."""
    sizes = np.array([len(s) + 1 for s in segments])
    firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    # Bytes are moved up by one, so that zero is the end mark; no valid text holds the byte 255.
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    ends = firsts + sizes - 1
    order, shares = shared_boundaries(text, ends, length)
    run = np.cumsum(~shares)
    in_run = shares | np.r_[shares[1:], False]
    order, run = order[in_run], run[in_run]
    if not len(order):
        return order, order
    segment = np.searchsorted(firsts, order, side="right") - 1
    offset = order - firsts[segment]
    place = mixed(where[segment, 0].astype(np.uint64) * np.uint64(_BASE) + mixed((where[segment, 1] + offset).astype(np.uint64)))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    twice = np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
    good = np.repeat(twice, np.diff(np.r_[starts, len(run)]))
    return segment[good], offset[good]


SPAN = "doc long, rk long, start int, end int"


def _spans_of_batches(batches):
    held: list[tuple] = []
    group: list[tuple] = []
    size, key = 0, None

    def done():
        where = np.array([(hash((d, r)), s) for _, d, r, s, _ in held], np.int64)
        segment, offset = repeated_strings([h[4] for h in held], where)
        if not len(segment):
            return pd.DataFrame({"doc": [], "rk": [], "start": [], "end": []})
        start = np.array([h[3] for h in held])[segment] + offset
        return merged(pd.DataFrame({"doc": np.array([h[1] for h in held], np.int64)[segment], "rk": np.array([h[2] for h in held])[segment], "start": start, "end": start + LENGTH}))

    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in ("a", "doc", "rk", "start", "seg", "at"))):
            if row[0] != key:
                some = promising(group)
                held += some
                size += sum(len(r[4]) for r in some)
                group, key = [], row[0]
                if size > BATCH_BYTES // 2:
                    yield done()
                    held, size = [], 0
            group.append(row[:5] + (row[5],))
    held += promising(group)
    if held:
        yield done()


def promising(group: list[tuple]) -> list[tuple]:
    """Segments of one anchor that can repeat a string with another: a string reaches ``REACH`` beyond the anchor in all, so at
    least half of that on one side, and there both must agree."""
    half = REACH // 2
    left, right = [r[4][max(0, r[5] - half) : r[5] + GRAM] for r in group], [r[4][r[5] : r[5] + GRAM + half] for r in group]
    lefts, rights = Counter(left), Counter(right)
    return [r[:5] for r, x, y in zip(group, left, right) if (lefts[x] > 1 and len(x) == GRAM + half) or (rights[y] > 1 and len(y) == GRAM + half)]


def merged(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans of each document that touch or overlap made one."""
    s = spans.sort_values(["doc", "rk", "start"])
    doc, rk, start, end = (s[c].to_numpy() for c in ("doc", "rk", "start", "end"))
    new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1])]
    group = np.cumsum(new_doc).astype(np.int64)
    reach = np.maximum.accumulate(end + (group << 32)) - (group << 32)
    new = new_doc | np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return pd.DataFrame({"doc": doc[at], "rk": rk[at], "start": start[at], "end": np.maximum.reduceat(end, at)})


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc`` and ``rk`` are 128 bits that stand for a row's number and text: texts that share a number, or have none, are told apart."""
    return texts_of(docs).select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("doc"),
        F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id")).alias("rk"),
        "text",
        F.octet_length("text").alias("n_bytes"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc, rk, start, end``: bytes that go; spans may overlap."""
    spark = prepare(docs)
    n = partitions_of(spark)
    texts = _keyed(docs)
    long_texts = texts.filter(F.col("n_bytes") >= LENGTH)
    keys = long_texts.select("doc", "rk", "n_bytes", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.col("text")).alias("h2"))
    keys = stored(keys, "text-keys")
    equal = keys.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc").alias("node")).filter("copies > 1")
    copies = stored(keys.join(equal, ["h1", "h2"]).select("doc", "rk", "n_bytes", "node"), "copies")
    whole = copies.select("doc", "rk", F.lit(0).alias("start"), F.col("n_bytes").alias("end"))
    others = copies.filter("doc <> node").select("doc", "rk").distinct()
    others = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    nodes = long_texts.join(others, ["doc", "rk"], "left_anti")

    dealt = _anchor_rows(nodes.select("doc", "rk", "text")).repartition(n, "a").sortWithinPartitions("a", "seg", "doc", "rk", "start")
    judged = stored(dealt.mapInPandas(_resolve, ANCHOR + ", kind byte"), "anchors")
    same = judged.filter(F.col("kind") == SAME).select("doc", "rk", "start", (F.col("start") + F.col("len")).alias("end"))

    distinct = judged.filter(F.col("kind") == DISTINCT)
    hot = distinct.groupBy("a").count().filter(F.col("count") > HOT).select("a", F.lit(True).alias("hot"))
    by_doc = (
        distinct.join(hot, "a", "left").groupBy("doc", "rk")
        .agg(F.collect_list(F.struct("a", "start", "len", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    by_doc = stored(by_doc, "wanted")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, rk, text, wanted in zip(*(batch[c].tolist() for c in ("doc", "rk", "text", "wanted"))):
                data = text.encode()
                rows += [(w["a"], doc, rk, w["start"], data[w["start"] : w["start"] + w["len"]], w["at"], w["hot"]) for w in wanted]
            yield pd.DataFrame(rows, columns=["a", "doc", "rk", "start", "seg", "at", "hot"])

    wide = long_texts.select("doc", "rk", "text").join(by_doc, ["doc", "rk"])
    # The same segments may be cut from repeated rows of one document.
    segments = stored(wide.mapInPandas(cut, "a long, doc long, rk long, start int, seg binary, at int, hot boolean").dropDuplicates(["a", "doc", "rk", "start"]), "segments")
    cold = segments.filter("not hot").repartition(n, "a").sortWithinPartitions("a", "doc", "start")
    from_transform = cold.mapInPandas(_spans_of_batches, SPAN)

    def strings(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                first, second, starts, counts = [], [], [], []
                for start, seg in zip(part["start"].tolist(), part["seg"].tolist()):
                    data = np.frombuffer(seg, np.uint8)
                    at = np.arange(len(data) - LENGTH + 1)
                    first.append(hashes_of(sums_of(data), at, at + LENGTH).view(np.int64))
                    second.append(hashes_of(sums_of(data ^ np.uint8(0x5A)), at, at + LENGTH).view(np.int64))
                    starts.append(start + at)
                    counts.append(len(at))
                yield pd.DataFrame({
                    "w1": np.concatenate(first), "w2": np.concatenate(second), "doc": np.repeat(part["doc"].to_numpy(), counts),
                    "rk": np.repeat(part["rk"].to_numpy(), counts), "start": np.concatenate(starts),
                })

    each = segments.filter("hot").mapInPandas(strings, "w1 long, w2 long, doc long, rk long, start int")
    place = F.xxhash64("doc", "rk", "start")
    twice = each.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("w1", "w2")
    from_strings = each.join(twice, ["w1", "w2"], "left_semi").select("doc", "rk", "start", (F.col("start") + LENGTH).alias("end"))
    return whole.unionByName(same).unionByName(from_transform).unionByName(from_strings)


def without_spans(text: bytes, starts, ends) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    if starts is None or not len(starts):
        return text, 0, 0
    left, since, removed, count = [], 0, 0, 0
    for start, end in sorted(zip(starts.tolist(), ends.tolist())):
        if start > since or not count:
            left.append(text[since:start])
            count += 1
            since = start
        if end > since:
            removed += end - since
            since = end
    return b"".join([*left, text[since:]]), removed, count


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: kept are the bytes that are left, end to end."""
    spans = repeated_spans(docs)
    gathered = spans.groupBy("doc", "rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = _keyed(docs).join(gathered, ["doc", "rk"], "left").select("doc_id", "text", "n_bytes", "spans.start", "spans.end")

    def work(batches):
        for batch in batches:
            rows = []
            for text, n, starts, ends in zip(*(batch[c].tolist() for c in ("text", "n_bytes", "start", "end"))):
                left, removed, count = without_spans(text.encode(), starts, ends)
                rows.append((n, removed, count, left))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return joined.mapInPandas(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


