"""Which rules can match a text: one pass over the bytes of a whole Arrow batch.

Texts lie end to end in the batch's value buffer. It is read in blocks of ``BLOCK`` bytes, whatever the texts' lengths, so memory follows the block.
Every place gives a number of its next four bytes (fewer for shorter words); a small table of hashed numbers tells the few
places where a word may begin, and these are compared with the words' bytes, many at once. Nothing loops over texts. Only the
numbers of rules leave this function; the matching itself stays in the JVM.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.dialect import MIN_RUN_LENGTH, RUN_CHARACTERS

BLOCK, ROWS = 1 << 18, 2048
TABLE_BITS = 16
# Letters and signs by how often text has them; pieces of a word that are rarer give fewer places to look at.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz-_.0123456789"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(RUN_CHARACTERS)] = True


def _rarest(word: bytes, size: int) -> int:
    """Where in a word its rarest ``size`` bytes begin."""
    weight = [FREQUENT.find(chr(c).lower()) if chr(c).lower() in FREQUENT else len(FREQUENT) for c in word]
    return max(range(len(word) - size + 1), key=lambda k: sum(weight[k : k + size]))


class Words:
    """Finds words in blocks of bytes."""

    def __init__(self, words: list[bytes]):
        self.longest = max(map(len, words), default=1)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.bytes = np.zeros((len(words), self.longest), np.uint8)
        self.tables = []
        for k, word in enumerate(words):
            self.bytes[k, : len(word)] = np.frombuffer(word, np.uint8)
        for size in sorted({min(4, len(w)) for w in words}):
            own = [k for k, w in enumerate(words) if min(4, len(w)) == size]
            offset = np.array([_rarest(words[k], size) for k in own], np.int64)
            piece = np.array([int.from_bytes(words[k][o : o + size], "little") for k, o in zip(own, offset.tolist())], np.uint32)
            order = np.argsort(piece, kind="stable")
            known = np.zeros(1 << TABLE_BITS, bool)
            known[self._slots(piece)] = True
            self.tables.append((np.uint32((1 << 8 * size) - 1), known, piece[order], np.array(own, np.int64)[order], offset[order]))

    @staticmethod
    def _slots(pieces: np.ndarray) -> np.ndarray:
        return (pieces * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start, word)`` of all places where a word's bytes stand."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        four = np.empty(n + 4 - n % 4, np.uint32)
        for k in range(4):
            four[k::4] = np.frombuffer(padded, "<u4", len(four) // 4, k)
        four = four[:n]
        starts, numbers = [], []
        for mask, known, piece, word, offset in self.tables:
            values = four if mask == 0xFFFFFFFF else four & mask
            at = np.flatnonzero(known[self._slots(values)])
            value = values[at]
            lo, hi = np.searchsorted(piece, value, "left"), np.searchsorted(piece, value, "right")
            count = hi - lo
            entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            start, number = np.repeat(at, count) - offset[entry], word[entry]
            fits = (start >= 0) & (start + self.lengths[number] <= n)
            start, number = start[fits], number[fits]
            for k in range(self.longest):
                if not len(start):
                    break
                same = (self.lengths[number] <= k) | (padded[np.minimum(start + k, n)] == self.bytes[number, k])
                start, number = start[same], number[same]
            starts.append(start)
            numbers.append(number)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(numbers)


class Screen:
    """From texts to the places of rules that can match them."""

    def __init__(self, spec: tuple, fold: bool):
        words = sorted({word for _, sets, _ in spec for any_of in sets for word in any_of})
        number = {word: k for k, word in enumerate(words)}
        self.fold, self.words = fold, Words([w.encode() for w in words])
        self.n_words = len(words)
        self.rules = [(place, [np.array([number[w] for w in any_of]) for any_of in sets], run) for place, sets, run in spec]
        self.needs_runs = any(run for *_, run in spec)

    def _scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words each row holds, and its longest run of word characters."""
        rows = len(offsets) - 1
        held, longest = np.zeros((self.n_words, rows), bool), np.zeros(rows, np.int64)
        since = int(offsets[0])
        for lo in range(int(offsets[0]), int(offsets[-1]), BLOCK):
            hi = min(lo + BLOCK, int(offsets[-1]))
            block = data[lo : min(hi + self.words.longest - 1, int(offsets[-1]))]
            start, word = self.words.find(_LOWER[block] if self.fold else block)
            # A word belongs to the block that it begins in, and to one row.
            own = lo + start < hi
            start, word = lo + start[own], word[own]
            row = np.searchsorted(offsets, start, "right") - 1
            inside = start + self.words.lengths[word] <= offsets[row + 1]
            held[word[inside], row[inside]] = True
            if self.needs_runs and since < hi:
                since = self._runs(data, offsets, max(lo, since), hi, longest)
        return held, longest

    @staticmethod
    def _runs(data, offsets, lo, hi, longest) -> int:
        """Takes the runs that begin in a block into ``longest``; returns where the next block's may begin."""
        last = int(offsets[-1])
        inside = _IN_RUN[data[lo : min(hi + MIN_RUN_LENGTH - 1, last)]]
        # Places from which so many characters of a run follow, by doubling.
        many, size = inside, 1
        while size < MIN_RUN_LENGTH and len(many):
            step = min(size, MIN_RUN_LENGTH - size)
            many = many[:-step] & many[step:]
            size += step
        at = np.flatnonzero(many)
        if not len(at):
            return hi
        new = np.append(True, np.diff(at) > 1)
        begins = lo + at[new]
        ends = lo + at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + MIN_RUN_LENGTH
        # The last one may go on beyond the block.
        end = int(ends[-1])
        while end < last and _IN_RUN[data[end]]:
            gap = np.flatnonzero(~_IN_RUN[data[end : end + 65536]])
            end = min(end + (int(gap[0]) if len(gap) else 65536), last)
        ends[-1] = end
        # A row ends a run without a character between.
        first, final = np.searchsorted(offsets, begins, "right") - 1, np.searchsorted(offsets, ends, "left") - 1
        pieces = final - first + 1
        row = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(int(pieces.sum()))
        length = np.minimum(np.repeat(ends, pieces), offsets[row + 1]) - np.maximum(np.repeat(begins, pieces), offsets[row])
        np.maximum.at(longest, row, length)
        return max(hi, end)

    def places(self, texts: pa.Array) -> pa.Array:
        """For each text the sorted places of the rules that can match it; none for null."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        counts, found = [], []
        for lo in range(0, len(texts), ROWS):
            held, longest = self._scan(data, offsets[lo : lo + ROWS + 1])
            passed = np.ones((len(self.rules), len(longest)), bool)
            for k, (_, sets, run) in enumerate(self.rules):
                for any_of in sets:
                    passed[k] &= held[any_of].any(axis=0) if len(any_of) > 1 else held[any_of[0]]
                if run:
                    passed[k] &= longest >= run
            rules, rows = np.nonzero(passed)
            counts.append(np.bincount(rows, minlength=len(longest)))
            found.append(rules[np.argsort(rows, kind="stable")])
        places = np.array([place for place, *_ in self.rules], np.int32)
        ends = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(places[np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)]))


@lru_cache(maxsize=8)
def screen(spec: tuple, fold: bool) -> Screen:
    """Built once per Python worker."""
    return Screen(spec, fold)


def text_screen(content: Column, spec: tuple, fold: bool = True) -> Column:
    """Places of the rules that can match; a rule left out has no match in the text. A null text has none."""

    @F.arrow_udf("array<int>")
    def screened(texts: pa.Array) -> pa.Array:
        found = screen(spec, fold).places(texts)
        if not texts.null_count:
            return found
        # A null text matches nothing, not even a rule that needs nothing.
        return pa.array([None if gone else rules for gone, rules in zip(texts.is_null().to_pylist(), found.to_pylist())], pa.list_(pa.int32()))

    return screened(content)
