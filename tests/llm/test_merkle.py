"""The Merkle manifest against a plain recomputation, its layout, and its edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, leaf string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(r, text):
    def piece(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(piece, (r[0], r[3], r[2], r[4], text))))


def climb(digests):
    """Root, and for each digest its (left, right) sibling texts, level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 16 * 16
            path.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 16])))
            at[i] //= 16
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, plain_leaf(r, r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        found[name] = climb([x[1] for x in groups[name]])
    root, upper = climb([found[name][0] for name in names])
    out = []
    for name, above in zip(names, upper, strict=True):
        for (r, leaf), path in zip(groups[name], found[name][1], strict=True):
            path = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[1]
            if tampered and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = plain_leaf(r, text)
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], leaf, found[name][0], root, sha("".join(x + y for x, y in path)), h, h == root))
    return out


def prove(docs, height):
    rows = merkle.document_leaves(docs).withColumn("tampered", F.coalesce("tampered", "digest"))
    p = merkle.prove(merkle.manifest(rows, ["doc_id"], height), "tampered")
    return p.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["Text A", "plain", "É über Z", "", None]), "en" if i % 3 else None, rng.choice(["a", "a", "a", "b", None, "", "Ω"]), i % 9, "clash", 7, "x", "y")
            for i in range(700)]
    rows += [rows[5], rows[5], (5, "other text of id 5", "en", rows[5][3], 4, "c", 1, "x", "y"), (None, "No Id", None, "a", None, None, None, None, None),
             (None, "No Id", None, "a", None, None, None, None, None), (-3, "NEGATIVE " * 3000, "en", "lonely", 1, "c", 1, "x", "y")]
    return rows + [(1000 + i, f"One {i}", "en", f"host{i}", 1, "c", 1, "x", "y") for i in range(40)]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_equals_plain_recomputation(spark, rows, height):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = prove(docs, height).collect()
    assert in_order(got) == in_order(brute(rows))
    assert {r.verified for r in got} == {True, False}


def test_single_row_and_empty_table(spark, rows):
    one = spark.createDataFrame(rows[:1], SCHEMA)
    r = prove(one, 3).collect()[0]
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    assert prove(spark.createDataFrame([], SCHEMA), 3).collect() == []


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_subtrees_in_one_piece(levels):
    places = np.concatenate([merkle.address(d, np.arange(16**d), levels) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(merkle.size(levels)))
    # the first subtree below the upper half follows it directly and is contiguous
    top = levels // 2
    if top:
        below = np.concatenate([merkle.address(top + d, np.arange(16**d), levels) for d in range(levels - top)])
        assert sorted(below.tolist()) == list(range(merkle.size(top), merkle.size(top) + merkle.size(levels - top)))


def test_blocks_hold_bounded_leaves(spark, rows):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "one", 1, "c", 1, "x", "y") for i in range(600)], SCHEMA)
    found = merkle.manifest(merkle.document_leaves(docs), ["doc_id"], 1)
    assert len(found.stages) == 3 and found.stages[0].agg(F.max("width")).first()[0] == 16
    assert found.stages[0].count() == 38
