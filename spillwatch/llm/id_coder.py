"""Adaptive range coding of token numbers, many blocks side by side.

Every block starts from the same fresh model and a table of order-0 shares, so blocks can be read alone with their table. A block is a lane;
all lanes take step k together, so a step is some array operations over lanes. Per number:

* Order 2 (the two numbers before) and order 1 (the one before) each predict the number that came last in their context, with a
  confidence; order 0 gives every number its share in the table.
* The chance that the leading prediction is right is mixed in the logistic domain from what each order says of it, with weights that the
  confidences select and that learn from every number. An adaptive chance for order 1's prediction, where it is another one, takes
  a part of the rest, and order 0's shares all that is left.
* One range-coding step takes the outcome: leading prediction, second, or the number by its share.

Amounts are whole numbers below 2**53 in floats. These and the model are only added, multiplied, divided and rounded down, so every machine
decodes the same.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 4096, 2048
SLOTS2, SLOTS1 = 1 << 12, 1 << 11
# Ranges lie between BOTTOM and TOP; a step deals out TOTAL parts of one, of which order 0 keeps at least SHARES.
TOP, BOTTOM, WORD = 2.0**48, 2.0**32, 2.0**16
TOTAL, SHARES = 2.0**24, 2.0**18
FLAGS = TOTAL - SHARES - 2
# Log-odds are counted in parts of 1 / UNIT.
UNIT = 64.0
RATE, RATE0, RATE_SECOND = 0.1, 0.03 / UNIT, 0.06
# Confidence of a prediction in bits above the number: how often it was right at a stretch.
SURE, SURE_MOST = 1 << 16, 7 << 16
# Constants of a step as arrays: numpy takes these sooner than Python's numbers.
HASH, _EIGHT, _SIXTEEN, _ZERO, _LOW16, _SURE, _MOST, _BEFORE_MOST = (np.array(x, np.int32) for x in (40503, 8, 16, 0, 0xFFFF, SURE, SURE_MOST, SURE_MOST - SURE))
_TWO, _THREE, _FIVE, _MASK2, _MASK1 = (np.array(x, np.int32) for x in (2, 3, 5, SLOTS2 - 1, SLOTS1 - 1))
_FLAGS, _ONE, _STEP, _RATE0, _RATE_SECOND = (np.array(x) for x in (FLAGS, 1.0, RATE * UNIT, RATE0, RATE_SECOND))
_TOTAL, _LAST_PART, _PER_TOTAL, _SHARES, _LAST_SHARE, _PER_SHARES = (np.array(x) for x in (TOTAL, TOTAL - 1, 1 / TOTAL, SHARES, SHARES - 1, 1 / SHARES))
_BOTTOM, _PER_BOTTOM, _MORE_WORD = (np.array(x) for x in (BOTTOM, 1 / BOTTOM, WORD - 1))
# Steps that the encoder predicts before their outcomes are put into ranges.
AHEAD = 32


def _squash() -> np.ndarray:
    """Chances of log-odds from -10 to 10 in steps of 1/64, from products alone."""
    powers, x = [1.0], 1.0
    for _ in range(640):
        x *= 0.9844964370054085  # exp(-1/64)
        powers.append(x)
    upper = [1 / (1 + x) for x in powers]
    return np.array([1 - p for p in upper[:0:-1]] + upper)


_SQUASH = _squash()
_START = np.array([-1.2, -0.3, 0.4, 0.8, 1.1, 1.4, 1.7, 2.0] + [-1.0, -1.2, -1.0, -0.8, -0.6, -0.5, -0.4, -0.3] + [-1.0, 0.0, 0.4, 0.7, 0.9, 1.1, 1.3, 1.5]) * UNIT
# The place of chance 1/2, and half a part to round, come in with order 2.
_START[:8] += len(_SQUASH) // 2 + 0.5


def shares_of(counts: np.ndarray) -> np.ndarray:
    """Counts of all numbers as whole shares of ``SHARES``, at least one for a number that occurs; without any, equal shares."""
    if not counts.any():
        return np.full(1 << 16, int(SHARES) >> 16, np.int64)
    seen = counts > 0
    spare = int(SHARES) - int(seen.sum())
    shares = np.where(seen, 1 + counts * spare // int(counts.sum()), 0)
    shares[np.argmax(counts)] += int(SHARES) - int(shares.sum())
    return shares


def table_of(blocks: list[np.ndarray]) -> bytes:
    """The order-0 table of some blocks, as it is kept in files."""
    counts = np.zeros(1 << 16, np.int64)
    for block in blocks:
        counts += np.bincount(block, minlength=1 << 16)
    return zlib.compress(shares_of(counts).astype("<u4").tobytes())


class Order0:
    def __init__(self, table: bytes | None):
        shares = shares_of(np.zeros(1 << 16, np.int64)) if table is None else np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64)
        upto = np.cumsum(shares)
        self.since, self.upto = (upto - shares).astype(np.float64), upto.astype(np.float64)
        self.number = np.repeat(np.arange(1 << 16, dtype=np.int32), shares)
        # The log-odds of a number, about: its power of two and a straight line up to the next.
        part, power = np.frexp(np.maximum(shares, 0.25) / SHARES)
        self.odds = 0.6875 * (power + 2 * part - 2)


class Model:
    """The state of all lanes before one step."""

    def __init__(self, lanes: int, order0: Order0):
        self.odds0 = order0.odds
        lane = np.arange(lanes)
        self.base2, self.base1, self.base_mix = lane * SLOTS2, lane * SLOTS1, lane * 24
        self.last2, self.last1 = _zeros(lanes * SLOTS2), _zeros(lanes * SLOTS1)
        self.mix, self.mix0 = np.tile(_START, lanes), np.full(lanes, 0.3 * UNIT)
        self.second = np.full(lanes * 24, 0.05)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the predictions of order 2 and order 1 are kept, from the hashes of the number before and the one before that."""
        k = h1.shape[-1]
        return self.base2[:k] + (((h2 << _FIVE) + h1 >> _THREE) & _MASK2), self.base1[:k] + ((h1 >> _TWO) & _MASK1)

    def predict(self, k: int, at2: np.ndarray, at1: np.ndarray):
        """For the first ``k`` lanes the parts of ``TOTAL`` below which the leading prediction and the second lie."""
        self.e2, self.e1 = self.last2.take(at2), self.last1.take(at1)
        self.c2, self.c1 = self.e2 & _LOW16, self.e1 & _LOW16
        f2 = self.e2 >> _SIXTEEN
        self.lead = self.c1 + (self.c2 - self.c1) * (f2 > _ZERO)
        self.other = self.c1 != self.lead
        base = self.base_mix[:k]
        self.in2, self.in1 = base + f2, base + ((self.e1 >> _SIXTEEN) + (_SIXTEEN - self.other * _EIGHT))
        self.m2, self.m1 = self.mix.take(self.in2), self.mix.take(self.in1)
        self.odds = self.odds0.take(self.lead)
        self.p = _SQUASH.take((self.m2 + self.m1 + self.mix0[:k] * self.odds).astype(np.int64), mode="clip")
        self.q = self.second.take(self.in1)
        first = np.floor(self.p * _FLAGS)
        return first, first + (np.floor(self.q * (_FLAGS - first)) + _ONE) * self.other

    def learn(self, k: int, at2: np.ndarray, at1: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the numbers in; whether the leading prediction was right, and order 1's."""
        hit, right1 = now == self.lead, now == self.c1
        err = hit - self.p
        step = err * _STEP
        self.mix[self.in2] = self.m2 + step
        self.mix[self.in1] = self.m1 + step
        self.mix0[:k] += step * self.odds * _RATE0
        self.second[self.in1] = self.q + (right1 - self.q) * _RATE_SECOND
        fresh = now + _SURE
        self.last2[at2] = fresh + np.minimum(self.e2 & _MOST, _BEFORE_MOST) * (now == self.c2)
        self.last1[at1] = fresh + np.minimum(self.e1 & _MOST, _BEFORE_MOST) * right1
        return hit, right1


def _zeros(n: int) -> np.ndarray:
    # Written at once, which lets the system take large pages.
    out = np.empty(n, np.int32)
    out.fill(0)
    return out


def _slabs(lengths: np.ndarray):
    """Lanes in order of falling length, in groups of ``LANES``."""
    order = np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), LANES):
        yield order[lo : lo + LANES]


def _shared(second, since0, upto0):
    """The parts of ``TOTAL`` that a number takes by its share: where they begin, and how many."""
    scale = (_TOTAL - second) * _PER_SHARES
    since = np.floor(since0 * scale)
    parts = np.floor(upto0 * scale) - since
    since += second
    return since, parts


def _predicted(since, parts, at, is_first, first, second):
    """Puts in the parts of numbers that were predicted, at these places."""
    since[at] = first * ~is_first
    parts[at] = first + (second - first - first) * ~is_first


def encode_blocks(blocks: list[np.ndarray], table: bytes | None = None) -> list[bytes]:
    """Codes blocks by an order-0 table that has all of their numbers (``None``: equal shares)."""
    order0 = Order0(table)
    out: list[bytes] = [b""] * len(blocks)
    lengths = np.array([len(b) for b in blocks], np.int64)
    for some in _slabs(lengths):
        n, lanes = lengths[some], len(some)
        steps = int(n[0])
        # Two numbers 0 come before the first.
        ids = np.zeros((lanes, steps + 2), np.uint16)
        for lane, b in enumerate(some.tolist()):
            ids[lane, 2 : n[lane] + 2] = blocks[b]
        ids = np.ascontiguousarray(ids.T)
        model = Model(lanes, order0)
        low, span = np.zeros(lanes), np.full(lanes, TOP)
        width = 2 * steps + 4
        written, place = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width

        def carry(lanes):
            low[lanes] -= TOP  # noqa: B023
            at = place[lanes] - 1  # noqa: B023
            while len(at):
                written[at] += 1  # noqa: B023
                at = at[written[at] == 0] - 1  # noqa: B023

        active = np.searchsorted(-n, -np.arange(steps), side="left").tolist()  # lanes that are longer than a step
        firsts, seconds, hits, others = (np.zeros((AHEAD, lanes), t) for t in (np.float64, np.float64, bool, bool))
        for begin in range(0, steps, AHEAD):
            rows = ids[begin : begin + AHEAD + 2].astype(np.int32)
            hashes = rows[:-1] * HASH
            at2, at1 = model.places(hashes[1:], hashes[:-1])
            rows = rows[2:]
            for r in range(len(rows)):
                k = active[begin + r]
                a2, a1, now = at2[r, :k], at1[r, :k], rows[r, :k]
                firsts[r, :k], seconds[r, :k] = model.predict(k, a2, a1)
                hits[r, :k], right = model.learn(k, a2, a1, now)
                np.logical_and(right, model.other, out=others[r, :k])
            m = len(rows)
            since, parts = _shared(seconds[:m], order0.since.take(rows), order0.upto.take(rows))
            at = np.flatnonzero(hits[:m] | others[:m])
            _predicted(since.ravel(), parts.ravel(), at, hits.ravel()[at], firsts.ravel()[at], seconds.ravel()[at])
            for r in range(m):
                k = active[begin + r]
                lo, sp, at = low[:k], span[:k], place[:k]
                unit = np.floor(sp * _PER_TOTAL)
                lo += unit * since[r, :k]
                np.multiply(unit, parts[r, :k], out=sp)
                if np.maximum.reduce(lo) >= TOP:
                    carry(np.flatnonzero(lo >= TOP))
                while True:
                    narrow = sp < _BOTTOM
                    word = np.floor(lo * _PER_BOTTOM)
                    written[at] = word.astype(np.uint16)
                    grow = narrow * _MORE_WORD + _ONE
                    lo -= word * narrow * _BOTTOM
                    lo *= grow
                    sp *= grow
                    at += narrow
                    if np.minimum.reduce(sp) >= BOTTOM:
                        break
        # The first whole word in the span is enough, zeros follow.
        low[:] = np.ceil(low * (1 / BOTTOM)) * BOTTOM
        carry(np.flatnonzero(low >= TOP))
        written[place] = low * (1 / BOTTOM)
        for lane, b in enumerate(some.tolist()):
            out[b] = written[lane * width : place[lane] + 1].astype(">u2").tobytes()
    return out


@np.errstate(over="ignore")  # of damaged blocks
def decode_blocks(payloads: list[bytes], lengths: list[int], table: bytes | None = None) -> list[np.ndarray]:
    order0 = Order0(table)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(payloads)
    sizes = np.array(lengths, np.int64)
    for some in _slabs(sizes):
        n, lanes = sizes[some], len(some)
        steps = int(n[0])
        # A step takes two words at most, also of damaged blocks.
        width = 2 * steps + 4
        words = np.zeros((lanes, width), np.uint16)
        for lane, b in enumerate(some.tolist()):
            own = np.frombuffer(payloads[b], ">u2")[:width]
            words[lane, : len(own)] = own
        ids = np.zeros((steps, lanes), np.uint16)
        model = Model(lanes, order0)
        span = np.full(lanes, TOP)
        code = (words[:, 0] * WORD + words[:, 1]) * WORD + words[:, 2]
        words = words.ravel()
        place = np.arange(lanes) * width + 3
        h1, h2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        active = np.searchsorted(-n, -np.arange(steps), side="left").tolist()
        for step in range(steps):
            k = active[step]
            at2, at1 = model.places(h1[:k], h2[:k])
            first, second = model.predict(k, at2, at1)
            co, sp, at = code[:k], span[:k], place[:k]
            unit = np.floor(sp * _PER_TOTAL)
            value = np.minimum(np.floor(co / unit), _LAST_PART)
            # The last share that begins at the value or before.
            share = ((value - second) * _SHARES + _LAST_SHARE) / (_TOTAL - second)
            now = order0.number.take(share.astype(np.int64), mode="clip")
            since, parts = _shared(second, order0.since.take(now), order0.upto.take(now))
            hits = np.flatnonzero(value < second)
            if len(hits):
                is_first, first = value[hits] < first[hits], first[hits]
                _predicted(since, parts, hits, is_first, first, second[hits])
                now[hits] = np.where(is_first, model.lead[hits], model.c1[hits])
            co -= unit * since
            np.multiply(unit, parts, out=sp)
            while True:
                narrow = sp < _BOTTOM
                grow = narrow * _MORE_WORD + _ONE
                co *= grow
                co += words.take(at) * narrow
                sp *= grow
                at += narrow
                if np.minimum.reduce(sp) >= BOTTOM:
                    break
            ids[step, :k] = now
            model.learn(k, at2, at1, now)
            h2, h1 = h1, now * HASH
        whole = np.ascontiguousarray(ids.T)
        for lane, b in enumerate(some.tolist()):
            out[b] = whole[lane, : n[lane]].copy()
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())
