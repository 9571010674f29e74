"""Items with edits of every share and placing, items without blanks, short items."""

import random

import pytest

from spillwatch.llm import decontam

from . import brute


def found(index, text):
    return [f[0] for f in index.matches([text])[0]]


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("placed", ["evenly", "at random"])
def test_every_item_within_its_edits_is_found(given, texts, share, placed):
    rnd = random.Random(5)
    items = sorted((r["item_id"], r["text"]) for r in given("benchmark").collect())
    index, wanted = decontam.Index(items), 0
    for k, (_, text) in enumerate(items):
        own = decontam.plain(text)[0]
        n = int(share * len(own))
        near = list(text)
        for j in range(n):
            at = int((j + 0.5) * len(near) / n) if placed == "evenly" else rnd.randrange(len(near))
            what = 0 if placed == "evenly" else rnd.randrange(3)
            near[at : at + (what < 2)] = [] if what == 1 else [rnd.choice("0123456789")]
        near = "".join(near)
        if brute.edit_distance_to_part(own, decontam.plain(near)[0]) <= decontam.MAX_EDITS * len(own):
            wanted += 1
            assert k in found(index, f"{texts[k][1][:300]} {near} {texts[k + 1][1][:300]}")
    assert wanted > len(items) / 2


def test_places_between_slabs_lose_nothing(monkeypatch):
    monkeypatch.setattr(decontam, "SLAB_BYTES", 64)
    monkeypatch.setattr(decontam, "GROUP_BYTES", 300)
    monkeypatch.setattr(decontam, "HITS", 50)
    monkeypatch.setattr(decontam, "CELLS", 100)
    rnd = random.Random(6)
    items = [(k, "".join(rnd.choice("abcd ") for _ in range(n)).strip() + "x") for k, n in enumerate([15, 30, 60, 90])]
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.choice([0, 40, 200]))) + (text if rnd.random() < 0.7 else "") for _ in range(10) for _, text in items]
    got = {(k, f[0]): f[1] for k, fs in enumerate(decontam.Index(items).matches(texts)) for f in fs}
    want = {}
    for k, text in enumerate(texts):
        for i, item in items:
            own = decontam.plain(item)[0].strip()
            least = brute.edit_distance_to_part(own, decontam.plain(text)[0])
            if least <= int(decontam.MAX_EDITS * len(own)):
                want[k, i] = least
    assert got == want and len(want) > 10


def test_items_without_blanks_are_found_anywhere():
    items = [(1, "地球到太阳的平均距离是多少千米"), (2, "for(i=0;i<n;i++)s+=a[i];"), (3, "Who wrote it?")]
    index = decontam.Index(items)
    assert found(index, "前文地球到太阳的平均距离是多少千米后文") == [0]
    assert found(index, "Q:地球到太阳的平均距离是多少千米") == [0]
    assert found(index, "{for(i=0;i<n;i++)s+=a[i];}") == [1]
    assert found(index, 'see "who wrote it?"') == [2]


def test_short_items_between_edges_of_words_with_their_edits():
    index = decontam.Index([(1, "2+2=4?"), (2, "tiny one"), (3, "谁写的"), (4, "no")])
    assert found(index, "(2+2=4?)") == [0]
    assert found(index, "say: tinyone.") == [1] and found(index, "[tiny ome]") == [1]
    assert found(index, "tiny onesies") == [] and found(index, "a snow") == [] and found(index, "no.") == [3]
    assert found(index, "是谁写的书") == [2]
