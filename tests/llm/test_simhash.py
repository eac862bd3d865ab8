"""SimHash components against brute force, the covering guarantee, and edge cases."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from sparkwright.llm import simhash
from test_operators import texts

SCHEMA = "doc_id long, text string, fp string, root string, bucket string, mask string, component string"


def brute(rows, radius=4):
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(r[0], prints[i], least.get(find(i))) for i, r in enumerate(rows)]


def plain(found):
    return sorted(((r["__id"], r["fp"] % 2**64, r["component"]) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    rng = random.Random(5)
    for i, (_, t) in enumerate(list(out)[:20]):
        w = (t or "").split()
        if w:
            w.insert(rng.randrange(len(w)), "added")
            out.append((100 + i, " ".join(w).upper()))
    return [*out, out[3], (None, out[3][1]), (None, "a text all by itself without any id")]


@pytest.mark.parametrize("radius, small", [(4, 64), (4, 1), (2, 2), (6, 1)])
def test_equals_brute_force(spark, rows, radius, small):
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)
    assert plain(simhash.link(docs, radius=radius, small=small)) == sorted(brute(rows, radius), key=repr)


def test_empty_table(spark):
    assert simhash.link(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("small", [4, 64])
def test_dense_groups_equal_brute_force(spark, small):
    # groups of fingerprints around common centres at distances that partly link: large buckets of several components
    rng = random.Random(11)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for b in rng.sample(range(64), rng.choice([2, 3, 5, 6, 8])):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    a = np.array(prints, np.uint64)
    close = np.bitwise_count(a[:, None] ^ a[None]) <= 4
    label = np.arange(len(a))
    while True:
        least = np.where(close, label[None], len(a)).min(1)
        if (least == label).all():
            break
        label = least
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    got = {r.node: r.root for r in simhash.near(spark.createDataFrame([(x,) for x in signed], "fp long"), small=small).collect()}
    groups = {}
    for x, of in zip(signed, label.tolist(), strict=True):
        groups.setdefault(of, []).append(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


@pytest.mark.parametrize("family", range(len(simhash.FAMILIES)))
def test_any_four_positions_are_left_free_by_some_mask(family):
    masks = np.array([m % 2**64 for m in simhash.covering_masks(4, family)], np.uint64)
    assert len(masks) == 31 and (np.bitwise_count(masks) >= 30).all()
    held = (masks[None] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)  # position, mask
    fours = np.array(list(itertools.combinations(range(64), 4)))
    free = np.zeros(len(fours), bool)
    for k in range(31):
        free |= ~held[fours, k].any(1)
    assert free.all()


def test_no_join_is_broadcast_by_an_estimate(spark, rows, monkeypatch):
    # Spark takes the 31 rows that masks make of a class for one, so that any small table of classes is below its threshold
    plans, written, components = {}, simhash.common.written, simhash.components

    def planned(label, df):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash.common, "written", lambda df, label: written(planned(label, df), label))
    monkeypatch.setattr(simhash, "components", lambda links: components(planned("links of buckets", links)))
    found = simhash.link(spark.createDataFrame(rows, "doc_id long, text string"), small=1)
    planned("found", found)
    assert {"classes", "buckets", "links of buckets", "roots", "torn", "found"} <= set(plans)
    assert all("Join" in p for k in ("buckets", "links of buckets", "torn", "found") for p in plans[k])
    assert not [k for k in ("buckets", "links of buckets") if any("Broadcast" in p for p in plans[k])]
    # the estimate of a join is the product of both sides, so only the joins with the roots' files could be broadcast in error
    assert not [x for k in ("torn", "found") for p in plans[k] for x in p.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]
