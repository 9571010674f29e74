"""Token numbers of whole texts, by a public tokenizer file named by its path.

Running the tokenizer over running text repeats its work for every occurrence of a word. Here a text is cut at ASCII white space, which the
tokenizer drops itself and never joins over, so the numbers of a text are those of its pieces in order. Each distinct piece of a batch
is encoded once and kept for later batches. ASCII letters are lowered first, as the tokenizer does, and a comma or full stop after an
ASCII letter at the end of a piece is taken off, as its pattern does; both make for fewer pieces. Lower-case letters of
Latin-1 and the ASCII marks behind them go straight to the tokenizer's model, in its letters for bytes, where its normalizer leaves them as
they are and its pattern cuts between the two. ``tests/llm`` compares with encoding whole texts.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# Pieces kept between batches of one Python worker; only speed depends on it.
KEPT_PIECES = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class PieceEncoder:
    """Encodes batches of texts; holds the numbers of pieces it has seen."""

    def __init__(self, path: str, keep: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.direct = _LETTERS_MARKS.fullmatch if _cuts_plainly(self.tokenizer) else lambda piece: None
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint16)
        self.ends = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self):
        """Keeps the pieces of several batches, at most half as many as may be kept."""
        least = 2
        while np.count_nonzero(self.uses >= least) > self.keep // 2:
            least *= 2
        kept = self.uses >= least
        at, sizes = self.ends[:-1][kept], np.diff(self.ends)[kept]
        self.index = {p: k for k, p in enumerate(itertools.compress(self.index, kept.tolist()))}
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(ends[-1]), np.uint16)
        _copy(ids, ends[:-1], self.ids, at, sizes)
        self.ids, self.ends, self.uses = ids, ends, np.zeros(len(sizes), np.int64)

    def _encode_new(self, pieces: list[str]) -> None:
        direct = list(map(self.direct, pieces))
        others = [p for p, d in zip(pieces, direct) if not d]
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        encoded = [self._of_parts(*d.groups()) if d else next(rest).ids for d in direct]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))
        if len(flat) and flat.max() > 65535:
            raise ValueError("token numbers beyond 16 bits")
        base = len(self.ends) - 1
        self.index.update(zip(pieces, range(base, base + len(pieces))))
        self.ids = np.concatenate([self.ids, flat.astype(np.uint16)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])

    def _of_parts(self, letters: str, marks: str) -> list[int]:
        tokenize = self.model.tokenize
        ids = [t.id for t in tokenize(letters if letters.isascii() else _in_bytes(letters))]
        return ids + [t.id for t in tokenize(marks)] if marks else ids

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where each of the distinct pieces is kept."""
        if len(self.index) > self.keep:
            self._forget()
        get = self.index.get
        found = [get(p, -1) for p in pieces]
        new = [p for p, k in zip(pieces, found) if k < 0]
        if new:
            self._encode_new(new)
            get = self.index.get
            found = [k if k >= 0 else get(p) for p, k in zip(pieces, found)]
        places = np.array(found, np.int64)
        self.uses[places] += 1
        return places

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of all texts, each text closed by ``END_ID``, and where each text begins (one more than texts)."""
        if isinstance(texts, pa.Array):
            # A copy that begins at its buffers' beginning: slices cast to wider offsets lose their place.
            column = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        else:
            column = pa.array(texts, pa.large_string())
        # A special token is found before letters are lowered, so texts that may hold one stay as they are.
        column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        split = pc.ascii_split_whitespace(column)
        offsets = split.offsets.to_numpy()
        flat = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        words = flat.dictionary
        # A comma or full stop after an ASCII letter at the end.
        tail = pc.match_substring_regex(words, "[a-z],$"), pc.match_substring_regex(words, r"[a-z]\.$")
        has_tail = pc.or_(*tail)
        stems = pc.if_else(has_tail, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        places = self._places([*stems.dictionary.to_numpy(zero_copy_only=False).tolist(), ",", "."])
        marks = places[-2:]
        stem_at = places[:-2][stems.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        mark_at = np.where(tail[0].to_numpy(zero_copy_only=False), marks[0], marks[1]) if len(words) else stem_at
        sizes = np.diff(self.ends)
        mark_n = np.where(has_tail.to_numpy(zero_copy_only=False), sizes[mark_at], 0) if len(words) else stem_at
        # The numbers of each distinct word, end to end.
        word_n = sizes[stem_at] + mark_n
        word_ends = np.concatenate([[0], np.cumsum(word_n)])
        table = np.empty(int(word_ends[-1]), np.uint16)
        _copy(table, word_ends[:-1], self.ids, self.ends[stem_at], sizes[stem_at])
        _copy(table, word_ends[:-1] + sizes[stem_at], self.ids, self.ends[mark_at], mark_n)
        # The numbers of each word of each text, and an end after each text.
        order = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = word_n[order]
        before = np.concatenate([[0], np.cumsum(counts)])
        starts = before[offsets] + np.arange(len(offsets))
        out = np.empty(int(starts[-1]), np.uint16)
        words_per_text = np.diff(offsets)
        _copy(out, before[:-1] + np.repeat(np.arange(len(texts)), words_per_text), table, word_ends[:-1][order], counts)
        out[starts[1:] - 1] = END_ID
        return out, starts


# Lower-case letters, then marks other than the apostrophe, which the pattern may take with letters.
_LETTERS_MARKS = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# Byte-level tokenizers write a byte that is no printable character of Latin-1 as the next one from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTER_OF = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))


def _in_bytes(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTER_OF)


def _cuts_plainly(tokenizer) -> bool:
    """Whether normalizer and pattern treat letters and marks as ``_LETTERS_MARKS`` does."""
    if not tokenizer.normalizer or not tokenizer.pre_tokenizer:
        return False
    letters = [c for c in map(chr, range(256)) if _LETTERS_MARKS.fullmatch(c)]
    marks = [c for c in map(chr, range(128)) if _LETTERS_MARKS.fullmatch("a" + c) and not c.isalpha()]
    probes = [(a + b, "") for a in letters for b in letters] + [("".join(letters), m + n) for m in marks for n in marks]
    # Many probes at once, between blanks.
    text = " ".join(a + b for a, b in probes)
    cut = [part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    return tokenizer.normalizer.normalize_str(text) == text and cut == [_in_bytes(part) for probe in probes for part in probe if part]


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, since: np.ndarray, sizes: np.ndarray) -> None:
    """Copies many short runs: places beyond the first of a run only for those that have them."""
    k = 0
    rows = np.flatnonzero(sizes > 0)
    to, since, sizes = to[rows], since[rows], sizes[rows]
    while len(to):
        out[to + k] = source[since + k]
        k += 1
        more = sizes > k
        to, since, sizes = to[more], since[more], sizes[more]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker, so what it has seen serves later tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of numbers as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded_slabs(texts: list[str] | pa.Array, path: str, chars: int = 2_000_000):
    """Yields ``(first, ids, starts)`` for slabs of texts of about ``chars`` characters, so memory doesn't follow the batch."""
    lo = size = 0
    for hi, n in enumerate(pc.utf8_length(texts).to_pylist() if isinstance(texts, pa.Array) else map(len, texts)):
        size += n
        if size >= chars or hi == len(texts) - 1:
            yield (lo, *encoder(path).encode(texts[lo : hi + 1]))
            lo, size = hi + 1, 0
