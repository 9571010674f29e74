"""Plain versions of what the operators compute."""

import hashlib
import re

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            who = holders.get(line.strip(BLANKS).translate(LOWER), ())
            if len(who) < min_docs or doc == max(who):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text, words):
    found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}


def components(rows, words, t):
    sets = [(d, shingles(x, words)) for d, x in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            both = len(s & r)
            if s and r and both * t.denominator >= (len(s) + len(r) - both) * t.numerator:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


def without_repeats(rows, length=200):
    count = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for d, b in data:
        gone, last = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[max(k, last) : k + length] = b"\1" * (k + length - max(k, last))
                last = k + length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def edit_distance_to_part(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)
