"""The pipeline's decisions on a small corpus with planted cases, and its edge cases."""

import random
import re

import corpus_pipeline
import pytest
from sparkwright.llm import bpe, registry

from test_operators import PLAIN, prose, shingles  # noqa: E402


def planted(spark, folder):
    rng = random.Random(4)
    bench = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(25))) for i in range(5)]
    good = [(i, prose(rng, 60), "en", "s", 0) for i in range(200)]
    noise = [(300 + i, "".join(rng.choice("#%&$@!~^|QXZ") for _ in range(200)), "en", "s", 0) for i in range(20)]
    copies = [(400 + i, good[i][1], "en", "s", 0) for i in range(10)]
    leaks = [(500 + i, prose(rng, 40) + " " + bench[i][1] + " " + prose(rng, 40), "en", "s", 0) for i in range(5)]
    private = [(600, prose(rng, 400) + " write to some.body@mail.example.org now", "en", "s", 0), (601, None, None, None, None)]
    docs = spark.createDataFrame([*good, *noise, *copies, *leaks, *private], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(300 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    planted(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len([i for i in got if i < 200]) >= 195
    assert not any(i in got for i in [*range(300, 320), *range(400, 410), *range(500, 505)])
    assert "<EMAIL>" in got[600].text and "some.body" not in got[600].text and got[600].n_chars == len(got[600].text)
    assert got[601].text is None and got[601].ids == [] and got[600].n_tokens == len(got[600].ids) > 0


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def likeness(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_run_equals_brute_force_with_near_copies_from_80_percent(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    planted(spark, tmp_path)
    folder = tmp_path / "near"
    folder.mkdir()
    for table in ("labels", "benchmark"):
        (folder / f"{table}.parquet").symlink_to(tmp_path / f"{table}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = []
    for r in docs.where("doc_id < 40").orderBy("doc_id").collect():
        words = r.text.split()  # 56 shingles; likenesses of 51, 50 and 49 common ones: 0.836, 0.806, 0.778
        words[3 if r.doc_id % 3 == 0 else 4] = "kappa"
        words[-2 if r.doc_id % 3 == 2 else -1] = "lambda"
        near.append((700 + r.doc_id, " ".join(words), "en", "s", 0))
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(f"{folder}/documents.parquet")

    given = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), str(folder)).collect()
    between = [(r.doc_id - 700, r.doc_id) for r in given if 700 <= r.doc_id]
    texts = {r.doc_id: r.text for r in given}
    assert sum(a in texts and 0.8 <= likeness(texts[a], texts[b]) < 0.85 for a, b in between) >= 10
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for b in sorted(texts):
        for a in sorted(texts):
            if a < b and sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    masked = {k: texts[k] for k, v in root.items() if k == v and not any(x in (texts[k] or "") for x in items)}
    for kind, pattern, ok in PLAIN:
        masked = {k: t and re.sub(pattern, lambda m: f"<{kind.upper()}>" if ok(m[0]) else m[0], t) for k, t in masked.items()}
    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = {k: (t, reference.encode(t or "", add_special_tokens=False).ids) for k, t in masked.items()}
    got = {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, str(folder)).collect()}
    assert got == want
