"""Token numbers and byte lengths of texts under two tokenizers, unit by unit.

A text with a space before it is cut into units: before a blank or line break that follows a character which is no white space. Both
tokenizers part the text there by themselves. The byte-level one never joins what a run of white space begins to what is before it, and the
piece one has no piece with a blank behind another character, nor one with a line break (both checked when the file is read). So the numbers of
a text are those of its units in order, each distinct unit is encoded once by the libraries and kept in the worker, and a unit's end is an end of
both. ``tests/llm`` compares with encoding whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Distinct units kept between batches of one Python worker; only speed depends on it.
KEPT_UNITS = 300_000
SPACE, LINE = 0x20, 0x0A


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[k] .. starts[k] + sizes[k]`` of all k, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def unit_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where units begin in UTF-8 bytes; ``rows`` are the starts of the texts."""
    blank = np.flatnonzero((data == SPACE) | (data == LINE))
    blank = blank[blank > 0]
    last = data[blank - 1]
    # A printable ASCII character, or one whose first byte is of no white space.
    parted = (last > 0x20) & (last < 0x7F)
    high = last >= 0x80
    for back, low, top in ((2, 0xC3, 0xDF), (3, 0xE4, 0xEF), (4, 0xF0, 0xF4)):
        lead = data[np.maximum(blank - back, 0)]
        parted |= high & (blank >= back) & (lead >= low) & (lead <= top)
    return np.union1d(blank[parted], rows)


class Vocabulary:
    """Numbers and token bytes of one library."""

    def __init__(self, table: list[bytes], encode):
        self.bytes, self.encode = table, encode
        self.sizes = np.array([len(t) for t in table], np.int64)


def byte_vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    entries = tokenizer.get_vocab(with_added_tokens=False)
    table = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        table[number] = bytes(letters[c] for c in entry)
    return Vocabulary(table, lambda units: [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])


def piece_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("a piece goes on beyond a blank or line break")
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    # A letter before a unit takes the blank that the library adds; it is a token of its own.
    first = model.encode("a")
    if len(first) != 1:
        raise ValueError("no piece for a single letter")
    return Vocabulary(table, lambda units: [ids[1:] for ids in model.encode(["a" + u for u in units], num_threads=1)])


class Kept:
    """Token numbers of the units seen so far, under one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.words, self.ids, self.ends = words, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, units: list[str]) -> np.ndarray:
        """Adds units; which of them the tokens give back."""
        found = self.words.encode(units)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        table = self.words.bytes
        return np.array([b"".join([table[i] for i in ids]) == u.encode() for ids, u in zip(found, units)], bool)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a sequence of units, and how many each has."""
        sizes = np.diff(self.ends)[units]
        return self.ids[ragged(self.ends[units], sizes)], sizes


class UnitEncoder:
    def __init__(self, path_a: str, path_b: str, keep: int = KEPT_UNITS):
        self.words, self.keep = (byte_vocabulary(path_a), piece_vocabulary(path_b)), keep
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.kept = tuple(Kept(w) for w in self.words)
        self.whole = np.zeros(0, bool)

    def units(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The kept numbers of the units that begin at ``starts``."""
        if len(self.index) > self.keep:
            self._forget()
        offsets = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = column.dictionary.to_pylist()
        new = [u for u in names if u not in self.index]
        if new:
            whole = np.ones(len(new), bool)
            for kept in self.kept:
                whole &= kept.add(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.whole = np.concatenate([self.whole, whole])
        place = np.fromiter((self.index[u] for u in names), np.int64, len(names))
        return place[column.indices.to_numpy(zero_copy_only=False)]


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(paths: tuple[str, str]) -> UnitEncoder:
    """One per Python worker, so what it has seen serves later tasks."""
    if paths not in _encoders:
        _encoders[paths] = UnitEncoder(*paths)
    return _encoders[paths]
