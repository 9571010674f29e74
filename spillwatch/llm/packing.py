"""Packing of token sequences by the sum-of-squares rule.

A document is cut into whole windows and a rest. Rests are placed online: among the windows that have room and a new one, the rest goes
where the sum of squared counts of partially filled windows, taken over fill levels, grows least. A level array holds these counts.
Full windows leave at once. When the input ends, or ``MAX_OPEN`` windows are open, the open ones are closed without padding: windows
filled to a power of two stay as they are, the fullest others are topped up with pieces of the emptiest, and what is left of the last one
is cut into powers of two.

Every task packs the documents of its partition, texts are not shuffled, and a task holds the open windows only. Sequence numbers are the
partition's number in the upper bits and a counter in the lower ones, so a repeated task gives the same rows.

Defined cases: null text is empty and has the end number alone; a null ``doc_id`` stays null; repeated rows are documents of their own;
very long texts are encoded slab by slab; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import prepare, texts_of, tidy
from .tokens import crc_of, default_path, encoded_slabs

WINDOW, MAX_OPEN = 4096, 2048
PARTITION_BITS = 36
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Takes pieces ``(doc, start, ids, doc_tokens)`` and gives back finished windows as lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.at_level: dict[int, list[list]] = {}
        self.open = 0

    def document(self, doc, ids: np.ndarray):
        n, window = len(ids), self.window
        whole = n - n % window
        for start in range(0, whole, window):
            yield [(doc, start, ids[start : start + window], n)]
        if n > whole:
            yield from self._place((doc, whole, ids[whole:], n))

    def _place(self, piece):
        size, window, counts = len(piece[2]), self.window, self.counts
        # Growth of the sum of squares if the piece joins a window of level 1, 2, ...; a full window counts no longer.
        levels = counts[1 : window - size + 1]
        growth = 2 * (counts[size + 1 :] - levels) + 2
        if len(growth):
            growth[-1] = 1 - 2 * levels[-1]
        used = np.flatnonzero(levels)
        best = used[::-1][np.argmin(growth[used[::-1]])] if len(used) else -1  # of equals the fullest
        if best >= 0 and growth[best] <= 2 * counts[size] + 1:
            level = int(best) + 1
            pieces = self.at_level[level].pop()
            counts[level] -= 1
            self.open -= 1
        else:
            level, pieces = 0, []
        pieces.append(piece)
        level += size
        if level == window:
            yield pieces
            return
        self.at_level.setdefault(level, []).append(pieces)
        counts[level] += 1
        self.open += 1
        if self.open >= self.max_open:
            yield from self.close()

    def close(self):
        """All open windows, filled up or of a power of two."""
        rest = [(level, pieces) for level in sorted(self.at_level) for pieces in self.at_level[level]]
        self.at_level, self.open = {}, 0
        self.counts[:] = 0
        for level, pieces in rest:
            if level & (level - 1) == 0:
                yield pieces
        rest = [(level, pieces) for level, pieces in rest if level & (level - 1)]
        lo, hi = 0, len(rest) - 1
        spare: list = []
        while lo <= hi or spare:
            if not spare:
                spare = rest[lo][1]
                lo += 1
            if lo > hi:
                break
            fullness, pieces = rest[hi]
            while fullness < self.window and spare:
                taken = _cut(spare, self.window - fullness)
                pieces += taken
                fullness += sum(len(p[2]) for p in taken)
            rest[hi] = (fullness, pieces)
            if fullness == self.window:
                yield pieces
                hi -= 1
                if lo > hi:
                    break
        left = sum(len(p[2]) for p in spare) + (rest[hi][0] if lo == hi else 0)
        pool = spare + (rest[hi][1] if lo == hi else [])
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            yield _cut(pool, size)
            left -= size


def _cut(pieces: list, size: int) -> list:
    """Takes ``size`` numbers, or all there are, off the front of ``pieces``."""
    taken = []
    while size and pieces:
        doc, start, ids, total = pieces[0]
        taken.append((doc, start, ids[:size], total))
        if len(ids) > size:
            pieces[0] = (doc, start + size, ids[size:], total)
            break
        size -= len(ids)
        pieces.pop(0)
    return taken


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the numbers themselves as little-endian 16-bit integers."""
    prepare(docs)
    path = tokenizer or default_path()

    def stream(batches):
        packer, next_id = Packer(window), TaskContext.get().partitionId() << PARTITION_BITS
        rows = []

        def finished(pieces):
            nonlocal next_id
            offset = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), crc_of(ids), total, next_id, offset)
                rows.append((*row, ids.astype("<u2").tobytes()) if with_ids else row)
                offset += len(ids)
            next_id += 1

        def table():
            columns = list(zip(*rows)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            # The texts stay in Arrow: as Python's strings they would be there several times over.
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, ids, starts in encoded_slabs(texts, path):
                for k in range(len(starts) - 1):
                    # A copy, so an open window doesn't hold the whole slab.
                    for pieces in packer.document(doc_ids[first + k], ids[starts[k] : starts[k + 1]].copy()):
                        finished(pieces)
            # Not two batches at a time.
            batch = texts = ids = starts = None
            pa.default_memory_pool().release_unused()
            yield table()
        for pieces in packer.close():
            finished(pieces)
        yield table()

    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")] + [("ids", pa.binary())] * with_ids)
    return texts_of(docs).mapInArrow(tidy(stream), PIECE + ", ids binary" * with_ids)
