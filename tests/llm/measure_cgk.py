"""What random-walk embedding and bit sampling reach on benchmark items with edits: the figures in the README.

``python tests/llm/measure_cgk.py [sf_dir]``. Best case for the method: the window begins and ends exactly where the edited item does. Prints the
median chance that all of ``PLACES`` sampled places agree, and how many tables of such samples find nine of ten items.
"""

import random
import sys

import numpy as np
import pyarrow.parquet as pq

PLACES, WALKS, ITEMS = 12, 4, 60


def embedded(text: bytes, bits: list[list[int]]) -> np.ndarray:
    """The walk: at each step the character at the place is written, and its random bit says whether the place moves on."""
    place, out = 0, np.full(len(bits), 256)
    for step, row in enumerate(bits):
        if place < len(text):
            out[step] = text[place]
            place += row[text[place]]
    return out


def edited(text: bytes, share: float, evenly: bool, draw: random.Random) -> bytes:
    out, n = bytearray(text), int(share * len(text))
    for j in range(n):
        at = int((j + 0.5) * len(out) / n) if evenly else draw.randrange(len(out))
        kind = 0 if evenly else draw.randrange(3)
        out[at : at + (kind < 2)] = b"" if kind == 1 else bytes([draw.choice(b"0123456789")])
    return bytes(out)


def main(sf_dir: str) -> None:
    texts = [t.lower().encode() for t in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist() if t and len(t) > 150][:ITEMS]
    rng, draw = np.random.default_rng(1), random.Random(1)
    for evenly in (True, False):
        for share in (0.05, 0.1, 0.15, 0.2):
            chances = []
            for text in texts:
                other, own = edited(text, share, evenly, draw), []
                for _ in range(WALKS):
                    bits = rng.integers(0, 2, (3 * len(text), 257)).tolist()
                    # Both walks have reached the end by about twice the length.
                    same = (embedded(text, bits) == embedded(other, bits))[: 2 * len(text)]
                    own.append(np.prod([max(0, same.sum() - z) / (len(same) - z) for z in range(PLACES)]))
                chances.append(np.mean(own))
            chances = np.array(chances)
            tables = next((t for t in (1, 10, 30, 100, 300, 1000, 3000, 10_000, 100_000) if np.mean(1 - (1 - chances) ** t) >= 0.9), "over 100,000")
            print("evenly" if evenly else "at random", share, float(np.median(chances)), tables)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
