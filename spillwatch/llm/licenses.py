"""Licence scans: a trained classifier of text windows, confirmed by comparison with licence templates.

A text is cut into lines, lines that were wrapped are joined again, and what is longer than ``WINDOW`` words is read in overlapping
windows. Hashed word unigrams and bigrams feed one logistic regression per licence family, and one for the unknown class, each against the
rest, so a window may have several families. They are trained on pieces of ``TEMPLATES``, of SPDX lines and of two of them together in varied
surroundings. Unknown are other licences and lines of the corpus: at most ``PER_DOC`` lines of each of ``SAMPLED_DOCS`` documents, those with the
smallest hash of ``doc_id``, lines up to ``LINE_CHARS`` characters taken whole; a bounded, documented sample. Temperature and the least
probability of a finding are set on pieces kept out of training.

A finding counts if it shares enough word pairs with a template of its family, and either names the family (``NAMES``) or has
``OWN_PAIRS`` pairs that the templates of no other family have.

Defined cases: null or empty text has no findings; a null ``doc_id`` stays null; repeated rows are reported each; without any document
in the sample the fixed unknown sentences are the only negatives; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .shingle_join import word_hashes

WINDOW, STRIDE = 32, 16
FEATURE_BITS = 17
SAMPLED_DOCS, PER_DOC, LINE_CHARS = 400, 10, 20_000
# Training pieces of a template, and of two of different families.
VARIANTS, DUAL = 60, 1500
# Words of a piece and around it: together a window.
PIECE, AROUND = 22, 5
OWN_PAIRS = 6
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Notices by which licences are commonly given.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "the mit license",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
        "distributed under the apache license 2.0",
        "apache license version 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "released under the gnu general public license version 2",
        "the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "licensed under the gpl",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "licensed under the lgpl",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
        "licensed under the agpl",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "the bsd license",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
        "licensed under the isc license",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0": ["to the extent possible under law the author has waived all copyright under cc0 1.0", "released under cc0 1.0 universal public domain dedication"],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "licensed under cc by nc sa 4.0",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ],
}
# SPDX identifiers of the families.
SPDX = {
    "mit": ["MIT", "MIT-0"],
    "apache-2.0": ["Apache-2.0"],
    "gpl": [f"GPL-{v}{end}" for v in ("1.0", "2.0", "3.0") for end in ("", "+", "-only", "-or-later")],
    "lgpl": [f"LGPL-{v}{end}" for v in ("2.0", "2.1", "3.0") for end in ("", "+", "-only", "-or-later")],
    "agpl": [f"AGPL-{v}{end}" for v in ("1.0", "3.0") for end in ("", "-only", "-or-later")],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD"],
    "mpl-2.0": ["MPL-2.0"],
    "isc": ["ISC"],
    "unlicense": ["Unlicense"],
    "cc0": ["CC0-1.0"],
    "cc-by-nc": [f"CC-BY-NC{more}-{v}" for more in ("", "-SA", "-ND") for v in ("3.0", "4.0")],
    "cc-by": [f"CC-BY{more}-{v}" for more in ("", "-SA", "-ND") for v in ("3.0", "4.0")],
}
# Words that name a family and no other.
NAMES = {
    "mit": ["mit"],
    "apache-2.0": ["apache"],
    "gpl": ["gpl", "gplv2", "gplv3", "gnu general"],
    "lgpl": ["lgpl", "lesser general", "library general"],
    "agpl": ["agpl", "affero general"],
    "bsd": ["bsd", "0bsd"],
    "mpl-2.0": ["mpl", "mozilla public"],
    "isc": ["isc"],
    "unlicense": ["unlicense"],
    "cc0": ["cc0"],
    "cc-by-nc": ["by nc", "attribution noncommercial", "attribution non"],
    "cc-by": ["by 3", "by 4", "by sa", "by nd", "attribution 3", "attribution 4", "attribution sharealike", "attribution noderivatives"],
}
# Other licences, and sentences with the same words that give none.
NO_LICENCE = [
    "eclipse public license v 2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "spdx license identifier epl 2.0",
    "spdx license identifier zlib",
    "spdx license identifier bsl 1.0",
    "distributed under the boost software license version 1.0",
    "licensed under the european union public licence version 1.2",
    "licensed under the artistic license 2.0",
    "common development and distribution license version 1.0",
    "licensed under the microsoft public license",
    "do what the fuck you want to public license version 2",
    "licensed under the open font license version 1.1",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
    "he lost his driving license last week and had to apply for a new one",
    "version 2.0 of the program was released under a lot of pressure",
    "the general public may use the software in the library free of charge",
    "the terms of the agreement were published by the foundation",
    "all rights reserved under the copyright law of the country",
    "a license fee is due for any person using the work",
    "the university granted permission to distribute the documentation",
]
_WORDS_ONLY = {ord(c): " " for c in string.punctuation}
FAMILIES = [UNKNOWN, *TEMPLATES]


def templates_of(family: str) -> list[str]:
    """Notices of a family, and lines that give one of its identifiers."""
    named = [f"{before} {plain_words(i).lower()}" for i in SPDX[family] for before in ("spdx license identifier", "license")]
    return TEMPLATES[family] + named


def plain_words(text: str) -> str:
    return text.translate(_WORDS_ONLY)


def units(text: str):
    """``(line number, text)``; a line that goes on in the next, in small letters or in capitals as it does, is joined with it."""
    held, since = "", 0
    for k, line in enumerate(text.split("\n")):
        if held and (line[:1].islower() or (line.isupper() and held.isupper())) and held[-1:] not in ".!?:;":
            held = f"{held} {line}"
            continue
        if held:
            yield since, held
        held, since = line.strip(), k
    if held:
        yield since, held


class Windows:
    """Word windows of many texts at once, with hashed features."""

    def __init__(self, texts: list[str]):
        hashes, firsts = word_hashes([plain_words(t) for t in texts])
        n = np.diff(firsts)
        per_text = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(int))
        self.text = np.repeat(np.arange(len(texts)), per_text)
        step = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.start = firsts[self.text] + step * STRIDE
        self.end = np.minimum(self.start + WINDOW, firsts[self.text + 1])
        self.words = hashes
        pairs = np.zeros_like(hashes)
        pairs[:-1] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        self.pairs = pairs
        shift = np.uint64(64 - FEATURE_BITS)
        self.one = (hashes >> shift).astype(np.int64)
        self.two = ((pairs * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)

    def __len__(self):
        return len(self.start)

    def pair_set(self, k: int) -> set[int]:
        return set(self.pairs[self.start[k] : max(self.start[k], self.end[k] - 1)].tolist())

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of a window's features times the root of their number."""
        if not len(self):
            return np.zeros((0, weights.shape[1]))
        total = lambda x: np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        ones, twos = total(weights[self.one]), total(weights[self.two])
        last = np.maximum(self.end - 1, self.start)
        sums = ones[self.end] - ones[self.start] + twos[last] - twos[self.start]
        return sums / np.sqrt((self.end - self.start) + (last - self.start))[:, None]

    def features(self):
        """Rows, columns and values of the feature matrix (for training)."""
        rows, columns, values = [], [], []
        for k in range(len(self)):
            s, e = self.start[k], self.end[k]
            f = np.concatenate([self.one[s:e], self.two[s : max(s, e - 1)]])
            rows.append(np.full(len(f), k))
            columns.append(f)
            values.append(np.full(len(f), 1 / np.sqrt(len(f))))
        return tuple(map(np.concatenate, (rows, columns, values)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, temperature: float, least: float):
        self.weights, self.temperature, self.least = weights.astype(np.float32), temperature, least
        self.templates, self.names = {}, {}
        for family in TEMPLATES:
            texts = templates_of(family)
            # Each text is one window or several; its pairs are taken as a whole.
            w = Windows(texts)
            self.templates[family] = [set().union(*(w.pair_set(k) for k in np.flatnonzero(w.text == t))) for t in range(len(texts))]
            names = Windows(NAMES[family])
            self.names[family] = {int(names.words[s]) for s, e in zip(names.start, names.end) if e - s == 1} | set().union(*(names.pair_set(k) for k in range(len(names))))
        every = {f: set().union(*sets) for f, sets in self.templates.items()}
        self.own = {f: pairs.difference(*(every[g] for g in every if g != f)) for f, pairs in every.items()}

    def probabilities(self, windows: Windows) -> np.ndarray:
        return sigmoid(windows.logits(self.weights) / self.temperature)

    def similarity(self, family: str, pairs: set[int]) -> float:
        best = 0.0
        for own in self.templates[family]:
            both = len(own & pairs)
            # One or two pairs say too little, unless they are the whole template.
            if both >= 3 or both == len(own) >= 1:
                best = max(best, both / min(len(own), len(pairs)))
        return best

    def confirmed(self, family: str, windows: Windows, k: int) -> float:
        """Similarity of a window to the family's templates; 0 if it doesn't name the family or say what only that one says."""
        pairs = windows.pair_set(k)
        seen = pairs | set(windows.words[windows.start[k] : windows.end[k]].tolist())
        if not seen & self.names[family] and len(pairs & self.own[family]) < OWN_PAIRS:
            return 0.0
        return self.similarity(family, pairs)

    def scan(self, texts: list[str]):
        """``(text, family, probability, similarity, line)``, the best window of each family in each text."""
        pieces = [(k, line, unit) for k, t in enumerate(texts) for line, unit in units(t)]
        windows = Windows([p[2] for p in pieces])
        p = self.probabilities(windows)
        best: dict[tuple[int, str], tuple] = {}
        for w, family in zip(*(x.tolist() for x in np.nonzero(p[:, 1:] >= self.least))):
            name = FAMILIES[family + 1]
            alike = self.confirmed(name, windows, w)
            if alike < CONFIRMED:
                continue
            k, line, _ = pieces[windows.text[w]]
            found = (round(alike, 6), round(float(p[w, family + 1]), 6), -line)
            best[k, name] = max(best.get((k, name), found), found)
        return [(k, name, prob, alike, -line) for (k, name), (alike, prob, line) in sorted(best.items())]


def _logistic_fit(rows, columns, values, truth, n, steps=150, decay=1e-4):
    """One regression per column of ``truth``, each against the rest."""
    weights = np.zeros((1 << FEATURE_BITS, len(FAMILIES)))
    used, at = np.unique(columns, return_inverse=True)
    w, square = np.zeros((len(used), len(FAMILIES))), np.full((len(used), len(FAMILIES)), 1e-8)
    # The rarer answer of each regression weighs more.
    share = truth.mean(axis=0)
    balance = np.where(truth > 0, np.sqrt(0.5 / np.maximum(share, 1e-3)), 1.0)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    by_feature = np.argsort(at, kind="stable")
    groups = np.flatnonzero(np.r_[True, np.diff(at[by_feature]) > 0])
    for _ in range(steps):
        z = np.add.reduceat(w[at] * values[:, None], starts)
        error = (sigmoid(z) - truth) * balance / n
        grad = decay * w + np.add.reduceat((error[rows] * values[:, None])[by_feature], groups)
        square += grad**2
        w -= 0.5 * grad / np.sqrt(square)
    weights[used] = w
    return weights


def train(negatives: list[str], seed: int = 3) -> Model:
    rng = random.Random(seed)
    pool = [plain_words(t).split() for t in negatives if len(t.split()) >= 4] or [plain_words(t).split() for t in NO_LICENCE]
    texts: list[str] = []
    labels: list[tuple[int, ...]] = []

    def around() -> list[str]:
        if rng.random() < 0.5:
            return []
        words = rng.choice(pool)
        k = rng.randrange(len(words))
        return words[k : k + rng.randint(0, AROUND)]

    def piece(template: str) -> list[str]:
        """A part of a long template, from anywhere in it; a short one whole."""
        words = plain_words(template).split()
        if len(words) <= 12:
            return words
        n = rng.randint(10, min(PIECE, len(words)))
        k = rng.randint(0, len(words) - n)
        return [w for w in words[k : k + n] if rng.random() > 0.04]

    def add(words: list[str], *families: str) -> None:
        texts.append(" ".join([*around(), *words, *around()]))
        labels.append(tuple(FAMILIES.index(f) for f in families))

    for family in TEMPLATES:
        for template in TEMPLATES[family]:
            for _ in range(VARIANTS * (1 + len(template.split()) // PIECE)):
                add(piece(template), family)
        for template in templates_of(family)[len(TEMPLATES[family]) :]:
            for _ in range(VARIANTS // 6):
                add(piece(template), family)
    # Two licences in one sentence or one expression.
    short = {f: [t for t in TEMPLATES[f] if len(t.split()) <= 10] for f in TEMPLATES}
    for _ in range(DUAL):
        one, two = rng.sample(list(TEMPLATES), 2)
        if rng.random() < 0.5:
            ids = [plain_words(rng.choice(SPDX[f])).lower().split() for f in (one, two)]
            add(["spdx", "license", "identifier", *ids[0], rng.choice(["or", "and"]), *ids[1]], one, two)
        elif short[one] and short[two]:
            add([*rng.choice(short[one]).replace(".", " ").split(), rng.choice(["or", "and"]), *rng.choice(short[two]).replace(".", " ").split()], one, two)
    for text in NO_LICENCE * 20:
        add(plain_words(text).split(), UNKNOWN)
    for text in negatives:
        texts.append(plain_words(text))
        labels.append((0,))
    order = [k for k in range(len(texts)) if texts[k].strip()]
    rng.shuffle(order)

    def part(chosen: list[int]):
        """All windows of the texts, and which families each has."""
        windows = Windows([texts[k] for k in chosen])
        truth = np.zeros((len(windows), len(FAMILIES)))
        for w, t in enumerate(windows.text.tolist()):
            truth[w, list(labels[chosen[t]])] = 1
        return windows, truth

    windows, truth = part(order[len(order) // 5 :])
    weights = _logistic_fit(*windows.features(), truth, len(windows))
    # Temperature: least log loss on what was kept out. Least probability: the highest that a kept-out unknown reaches wrongly.
    outside, y = part(order[: len(order) // 5])
    z = outside.logits(weights.astype(np.float32))

    def loss(temperature):
        p = np.clip(sigmoid(z / temperature), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    temperature = min(np.geomspace(0.1, 4, 40), key=loss)
    unknown = y[:, 0] > 0
    wrong = sigmoid(z[unknown, 1:] / temperature).max(axis=1) if unknown.any() else np.zeros(1)
    return Model(weights, float(temperature), float(min(0.5, max(0.2, np.quantile(wrong, 0.999)))))


FOUND = "doc_id long, family string, probability double, similarity double, line int"


def corpus_negatives(docs: DataFrame) -> list[str]:
    """At most ``PER_DOC`` whole lines, of up to ``LINE_CHARS``, of each of ``SAMPLED_DOCS`` documents, without those that are like a template."""
    # Numbers first, so that no task gathers whole texts to sort them.
    wanted = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED_DOCS)
    lines = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select(
        F.col("doc_id"),
        F.slice(F.shuffle(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) <= LINE_CHARS), 5), 1, PER_DOC).alias("lines"),
    )
    rows = sorted(lines.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["lines"]))
    texts = [t for r in rows for t in r["lines"] if t.strip()]
    probe = Model(np.zeros((1 << FEATURE_BITS, len(FAMILIES)), np.float32), 1.0, 0.0)
    windows = Windows(texts)
    like = {int(windows.text[k]) for k in range(len(windows)) for f in TEMPLATES if probe.similarity(f, windows.pair_set(k)) >= 0.5}
    return [t for k, t in enumerate(texts) if k not in like]


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document and licence family found in it, with the best line."""
    prepare(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(corpus_negatives(texts))

    def work(batches):
        for batch in batches:
            doc_ids, texts = batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist()
            lo = size = 0
            for hi, text in enumerate(texts):
                size += len(text)
                if size < 1_000_000 and hi < len(texts) - 1:
                    continue
                found = model.scan(texts[lo : hi + 1])
                out = pd.DataFrame([(doc_ids[lo + k], *rest) for k, *rest in found], columns=[c.split()[0] for c in FOUND.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
                lo, size = hi + 1, 0

    return texts.mapInPandas(work, FOUND)
