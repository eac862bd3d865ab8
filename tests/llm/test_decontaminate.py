"""Spaced seeds: no stretch within the similarity is missed, and all leaks equal those of comparing everything."""

import random
from itertools import combinations

import pytest

from sparkwright.llm import decontaminate as D


@pytest.mark.parametrize("length", range(5, 26))
def test_every_placement_of_substitutions_leaves_a_window(length):
    masks = D.SHORT if length < D.LEAST_LONG else D.LONG
    bits = [[sum(1 << i + at for i, c in enumerate(m) if c == "1") for at in range(length - len(m) + 1)] for m in masks]
    windows = [w for one in bits for w in one]
    for changed in combinations(range(length), length // 5):
        bad = sum(1 << i for i in changed)
        assert any(not w & bad for w in windows), changed


def alike(words, item, shift):
    """Longest stretch of the diagonal with 80 % agreement, by trying all of them."""
    same = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
    inside = [k for k in range(len(item)) if 0 <= k + shift < len(words)]
    best = (0, 0)
    for b in inside:
        good = 0
        for e in range(b, inside[-1] + 1):
            good += same[e]
            if 5 * good >= 4 * (e + 1 - b) and e + 1 - b > best[1] - best[0]:
                best = (b, e + 1)
    return best[1] - best[0], sum(same[best[0] : best[1]])


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(60)]
    items = [(str(i), " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((4, 5, 6, 7, 9, 10, 11, 12, 13, 15, 16, 20, 25, 33, 40))]
    items += [("same", items[8][1]), (None, items[5][1]), ("han", "天地玄黃宇宙洪荒日月盈昃辰宿列張"), ("null", None)]
    texts = []
    for _, body in items[:15] * 6:
        w = body.split()
        for at in rng.sample(range(len(w)), len(w) // 5 + rng.randrange(2)):
            w[at] = "other"
        w = w[rng.randrange(3) :] if len(w) > 13 and rng.random() < 0.4 else w
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randrange(30))] + w + [rng.choice(vocab) for _ in range(rng.randrange(30))]))
    texts += [*texts[:4], None, "", "序天地玄黃宇宙洪荒日月改昃辰宿列張終", " ".join(texts), "_" * 5000]
    docs = spark.createDataFrame([(i, t, "old", "x") for i, t in enumerate(texts)], "doc_id long, text string, leaks string, item_id string")
    got = {r.doc_id: r for r in D.find_leaks(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got) == len(texts) and got[0].item_id == "x"
    for i, t in enumerate(texts):
        words, want = D.word_list(t or ""), []
        for name, body in items:
            item = D.word_list(body or "")
            if len(item) >= 5:
                for shift in range(-len(item) + 1, len(words)):
                    n, matched = alike(words, item, shift)
                    if n >= min(13, len(item)):
                        want.append((name, shift, n, matched))
        have = [(x.item_id, x.start_word - x.item_start, x.end_word - x.start_word, x.matched) for x in got[i].leaks]
        key = lambda x: (x[0] is not None, x[0] or "", x[1:])
        assert sorted(have, key=key) == sorted(want, key=key), i


def test_hits_are_found_without_a_large_map(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (1 << 15, 1 << 20):
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in D.find_leaks(docs, bench, most_bits=bits).collect()}
        assert got == {i: [str(i)] for i, _ in items}
    with pytest.raises(ValueError):
        D.find_leaks(docs, bench, min_words=4)


def test_slices_give_the_hashes_of_the_whole(monkeypatch):
    import numpy as np

    words = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    whole = {m: h for m, _, h in D.window_hashes(words, range(len(D.MASKS)))}
    monkeypatch.setattr(D, "SLICE", 700)
    parts = {m: np.empty(0, np.uint64) for m in whole}
    for m, begin, h in D.window_hashes(words, range(len(D.MASKS))):
        assert begin == len(parts[m])
        parts[m] = np.concatenate([parts[m], h])
    assert all((whole[m] == parts[m]).all() and len(whole[m]) == 3001 - len(D.MASKS[m]) for m in whole)
