"""The operators against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import bpe, decontaminate, fingerprint, html_text, interpolation, minmax, pii, quality, repeats, warc

WORDS = "the of and to in that is was for it alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, kept string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def texts():
    """Prose, copies, near copies, long and empty texts, nulls and ties."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(40)]
    near = []
    for b in base[:12]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *base[:5], *near, None, "", "  \n", "one", "one two three", "ONE two", prose(rng, 6000), "x" * 3000, "a b " * 400,
            "mail a.b@c.example.org, 10.0.0.1 or 4111 1111 1111 1111 call +1 (499) 555-6503 1.2.3.400 a@b.c_x@d.e", "é ß 日本 <|endoftext|> Σ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts())]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "null id alpha beta gamma", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_merges_in_rank_order_and_decodes(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    reference = tokenizers.Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    for r in got:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)
    assert len(got) == docs.count() and bpe.encode(empty, path).count() == 0
    once = bpe.encode(docs, path, decoded="decoded").collect()
    assert sorted(map(tuple, once), key=repr) == sorted(map(tuple, got), key=repr)


def test_every_token_encodes_to_itself():
    with open(bpe.default_path(), "rb") as f:
        t = bpe.Tables(f.read())
    assert all(t.encode_symbols(s) == [i] for s, i in list(t.id_of.items())[::7])


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(d)) % 10 == 0


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(map(str.isdigit, m)) <= 15))


def test_pii_base_spans_equal_the_plain_patterns(spark, docs, empty):
    rng = random.Random(3)
    noise = ["".join(rng.choice("01259+ ()-.@_ab%é😀") for _ in range(rng.randrange(120))) for _ in range(400)]
    more = spark.createDataFrame(list(enumerate(noise + ["4111111111111111" * 3, "1" * 20_000, "a" * 20_000 + "@b"])), "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), more):
        want = collections.Counter((r.doc_id, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, r.text or "") if ok(m[0]))) for r in frame.collect())
        got = collections.Counter((r.id, r.s) for r in pii.find(frame).select("id", pii.listed(F.col("base")).alias("s")).collect())
        assert got == want
    assert pii.find(empty).count() == 0


def test_pii_learns_cues_and_masks(spark):
    seeds = [(i, f"please write contact: user{i}@mail.example.org today") for i in range(8)]
    frame = spark.createDataFrame([*seeds, (90, "please write contact: member-4477-88 today"), (91, "the code 4477-889 stays"), (92, None)], "doc_id long, text string")
    spans = {r.id: [s.kind for s in r.spans] for r in pii.find(frame).collect()}
    assert spans[90] == ["context"] and spans[91] == [] and spans[92] == [] and spans[0] == ["email"]
    masked = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert masked[90] == "please write contact: <CONTEXT> today" and masked[0] == "please write contact: <EMAIL> today" and masked[92] is None


def test_pii_learns_cues_of_prose_and_goes_on_from_what_it_found(spark):
    rng = random.Random(9)
    noise = iter(rng.sample(range(10**6), 900))
    word = lambda: f"w{''.join(rng.choice('abcdefgh') for _ in range(6))}"
    told = lambda cue, x: f"{word()} {word()} {cue} {x} {word()} {word()}"
    codes = [f"kx-{1000 + i}-{i}" for i in range(30)]
    rows = [told("my phone is", f"+1 (499) 555-{6000 + i}") for i in range(60)]  # seeds
    rows += [told("my phone is", x) for x in codes[:12]]  # found by the cue of the seeds
    rows += [told("account number", x) for x in [*codes[:12], "kx-5555-1"]]  # no seed: only found instances support it
    rows += [told("since the", f"{next(noise):06d}") for _ in range(40)] + [told("since the", "+1 (499) 555-6001")]  # vague
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.id: [s.kind for s in r.spans] for r in pii.find(frame).collect()}
    assert all(found[i] == ["context"] for i in range(60, 85)) and all(found[i] == [] for i in range(85, 125))
    assert found[0] == found[125] == ["phone"]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_minmax_components_equal_brute_force(spark, docs, empty):
    rows = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    want = linked(rows.items())
    got = {r["__id"]: (r.n_shingles, r.component) for r in minmax.link(docs).collect()}
    assert got.pop(None) == (1, None) and got == want
    kept = minmax.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 1
    assert {r.doc_id for r in kept.collect()} == {None, *(k for k, v in want.items() if v[1] == k)}
    assert minmax.link(empty).count() == 0


def test_minmax_stage_keeps_one_row_of_each_component_with_repeated_and_null_ids(spark):
    rng = random.Random(31)
    a, b = prose(rng, 80), prose(rng, 80)
    other = " ".join([*b.split()[:-1], "ending"])
    rows = [(1, a), (5, a), (5, b), (None, a), (None, other), (7, a.upper()), (7, a.upper()), (8, None), (8, None), (9, ""), (None, prose(rng, 60))]
    kept = minmax.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # of a's component document 1, of b's document 5, of the one without an id its only row; rows without words once each
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (5, b), (8, None), (9, ""), rows[-1]], key=repr)


def test_minmax_links_copies_that_are_not_alike_among_themselves(spark, monkeypatch):
    # copies of one base with edits of their own: most linked to the base alone, which is no hub of their buckets
    monkeypatch.setattr(minmax, "SMALL", 2)
    monkeypatch.setattr(minmax, "HUBS", 1)
    rng = random.Random(32)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for at in rng.sample(range(400), rng.choice([4, 5, 6, 7])):
            w[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(w)))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["__id"]: r.component for r in minmax.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) > 3


def test_minmax_large_family_with_chains(spark):
    """A bucket beyond SMALL whose classes are only partly linked: hubs, then the exact filter."""
    rng = random.Random(11)
    base = prose(rng, 80).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = {r["__id"]: (r.n_shingles, r.component) for r in minmax.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


def test_minmax_group_of_near_copies_gives_few_links_to_the_components(spark, monkeypatch):
    given = []
    real = minmax.components
    monkeypatch.setattr(minmax, "components", lambda links: (given.append(links.count()), real(links))[1])
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component for r in got} == {0}
    # each class once and the links between hubs, not each class with each hub of its 28 buckets
    assert 299 <= given[0] < 1500


def test_minmax_bundled_links_have_the_same_components(spark):
    rng = random.Random(4)
    links = {(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(180)}
    links = spark.createDataFrame([x for x in links if x[0] != x[1]], "a string, b string")
    few = minmax.bundled(links)
    want, got = ({r.node: r.root for r in minmax.components(x).collect()} for x in (links, few))
    assert got == want and few.count() <= links.count()


def test_quality_separates_noise(spark, empty):
    rng = random.Random(5)
    good = [(i, prose(rng, 60), "en", 1, 0) for i in range(300)]
    bad = [(1000 + i, "".join(rng.choice("#%&$@!~^|QXZ") for _ in range(200)), "en", 0, 0) for i in range(60)]
    frame = spark.createDataFrame([*good, *bad, (5000, None, None, 1, 0), (5001, "", "xx", 1, 1)], "doc_id long, text string, lang string, quality int, toxic int")
    labels = frame.where("doc_id < 200 OR doc_id > 1040").select("doc_id", "quality", "toxic")
    got = {r.doc_id: r.kept for r in quality.classify(frame, labels).collect()}
    assert sum(got[i] for i in range(300)) >= 295 and not any(got[1000 + i] for i in range(60)) and len(got) == 362
    none = quality.classify(frame, labels.where("false"))
    assert none.where("kept").count() == 362
    assert quality.classify(empty, labels).count() == 0


class KneserNey:
    """Interpolated modified Kneser-Ney over character trigrams, written out over dictionaries."""

    def __init__(self, texts):
        three = collections.Counter(tuple(("", "", *t, "")[i : i + 3]) for t in texts for i in range(len(t) + 1))
        two = collections.Counter(g[1:] for g in three)
        one = collections.Counter(g[1:] for g in two)
        self.orders = [self.order(c) for c in (one, two, three)]
        self.base = 1 / (len(one) + 1)

    @staticmethod
    def order(counts):
        seen = [max(1, sum(n == 1 for n in counts.values()))] + [sum(n == k for n in counts.values()) for k in (2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        cut = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * seen[k] / seen[k - 1] if seen[k - 1] else 0.5 * k
            cut.append(max(0.1, min(d, k - 0.05)))
        whole, gone = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            whole[g[:-1]] += n
            gone[g[:-1]] += min(cut[min(n, 3) - 1], n)
        return counts, cut, whole, gone

    def p(self, gram):
        if not gram:
            return self.base
        counts, cut, whole, gone = self.orders[len(gram) - 1]
        low, n = self.p(gram[1:]), counts.get(gram, 0)
        if gram[:-1] not in whole:
            return low
        own = (n - min(cut[min(n, 3) - 1], n)) / whole[gram[:-1]] if n else 0
        return own + gone[gram[:-1]] / whole[gram[:-1]] * low

    def nll(self, text):
        signs = ("", "", *text, "")
        return -sum(math.log(self.p(signs[i : i + 3])) for i in range(len(text) + 1))


def test_quality_perplexity_equals_written_out_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)  # many blocks
    rng = random.Random(6)
    fit = [("=en", prose(rng, 12), False) for _ in range(50)] + [("", prose(rng, 12).upper(), False) for _ in range(50)] + [("=xx", "few", False)]
    models, tables = quality.train(spark.createDataFrame(fit, "lang string, text string, held boolean"), 50)
    number = {r.lang: r.model for r in models.collect()}
    assert set(number) == {"=en", ""} and sorted(number.values()) == [1, 2]
    brute = {0: KneserNey([t for _, t, _ in fit])} | {number[x]: KneserNey([t for y, t, _ in fit if y == x]) for x in number}
    texts_ = [prose(rng, 20), prose(rng, 5).upper(), "", None, "日本 é # unseen", "alpha", prose(rng, 400), "alpha"]
    rows = [(i, m, t) for i, (m, t) in enumerate((m, t) for m in brute for t in texts_)]
    got = quality.score(spark.createDataFrame(rows, "id int, __model int, text string").repartition(3).sortWithinPartitions("id"), tables, "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["__n"] == len(r.text or "") + 1
        assert r["__nll"] == pytest.approx(brute[r["__model"]].nll(r.text or ""), rel=1e-9)


def test_quality_probabilities_sum_to_one(spark):
    rng = random.Random(6)
    model = KneserNey([prose(rng, 50) for _ in range(20)])
    chars = [g[0] for g in model.orders[0][0]] + ["unseen"]
    for context in (("a", "l"), ("", ""), ("q", "z"), ("unseen", "a")):
        assert abs(sum(model.p((*context, c)) for c in chars) - 1) < 1e-9


def test_quality_null_and_empty_languages_are_languages_of_their_own(spark):
    rng = random.Random(14)
    made = {"en": lambda: prose(rng, 40), None: lambda: prose(rng, 40).upper(), "": lambda: prose(rng, 40)[::-1]}
    rows = [(i, made[k](), k, 1, 0, "clash", "clash", "clash") for i, k in enumerate([*made] * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int, perplexity string, threshold string, kept string")
    labels = frame.select("doc_id", "quality", "toxic")
    got = quality.classify(frame, labels).collect()
    assert len(got) == len(rows)
    by = {k: [r for r in got if r.lang == k] for k in made}
    assert len({r.threshold for r in got}) == 3 and all(len({r.threshold for r in v}) == 1 for v in by.values())
    assert all(sum(r.kept for r in v) >= 380 for v in by.values())
    # text of another language is far off a language's own
    swapped = frame.withColumn("lang", F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.lit(None)))
    assert quality.classify(swapped.unionByName(frame), labels).columns[-3:] == ["perplexity", "threshold", "kept"]
    assert quality.keep_good(frame, labels).columns == frame.columns


def test_quality_sample_is_even(spark):
    assert quality.even_quota([5, 100, 1000], 205) == 100 and quality.even_quota([3, 4], 50) == 4


def test_quality_threshold_is_the_quantile_and_small_languages_keep_their_labels(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 60), "en" if i < 2000 else "xx", 1, 0) for i in range(2100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    labels = frame.select("doc_id", "quality", "toxic")
    sample = quality.trusted_sample(frame, labels, "doc_id", "text", "lang", 600)
    assert sample.where("lang = '=xx'").count() == 100 and 400 <= sample.where("lang = '=en'").count() <= 600
    got = quality.classify(frame, labels, prior_chars=0, sample_labels=5000)
    held = got.where("lang = 'en' AND pmod(xxhash64('held', cast(doc_id AS string)), 5) = 0")
    bound, threshold = held.agg(F.percentile("perplexity", 0.99), F.max("threshold")).first()
    assert abs(bound - threshold) < 1e-9


def test_quality_learns_from_every_trusted_document(spark, monkeypatch):
    # more trusted documents than a sample of 20,000 would take, repeated ids among them; the rows of others don't count
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab "), F.col("id").cast("string")).alias("text"),
                                      F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    rows = rows.unionByName(rows.where("doc_id < 10"))
    labels = rows.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    got = quality.trusted(rows, labels, "doc_id", "text", "lang")
    want = rows.where("doc_id % 10 <> 0")
    assert got.count() == want.count() == 27_009
    assert got.select("text").exceptAll(want.select("text")).count() == 0
    held = "pmod(xxhash64('held', cast(doc_id AS string)), 5) = 0"
    assert got.where("held").count() == want.where(held).count()
    seen = []
    monkeypatch.setattr(quality, "Tables", lambda fit: seen.append(fit.groupBy("model").count().collect()))
    quality.classify(rows, labels)
    assert sum(r["count"] for r in seen[0] if r.model == 0) == want.where(f"NOT {held}").count()
    # the bitmap's join comes first, below the shuffle of the texts
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("rightHint=(strategy=merge)") < plan.index("rightHint=(strategy=broadcast)")
    # ids of another type join as before
    assert quality.trusted(rows, labels.withColumn("doc_id", F.col("doc_id").cast("int")), "doc_id", "text", "lang").count() == 27_009


def test_fingerprints(spark, docs, empty):
    got = fingerprint.fingerprints(docs, bucket_bytes=3000, keep={"text": F.col("text"), "edited": F.col("edited")}).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = collections.Counter()
    for i, (k, t) in enumerate(rows):
        half = len(t) // 2
        want[(k, t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half])] += 1
    assert collections.Counter((r.id, r.edited) for r in got) == want
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) == 8 * fingerprint.FUNCTIONS
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_fingerprint_sees_order(spark):
    rng = random.Random(8)
    w = prose(rng, 400).split()
    frame = spark.createDataFrame([(3, " ".join(w)), (2, " ".join(w[:200] + ["new"] + w[201:])), (1, " ".join(w[300:] + w[:300])), (0, prose(rng, 400))], "doc_id long, text string")
    near = {r.id: r.fingerprint for r in fingerprint.fingerprints(frame).collect()}
    like = lambda a, b: sum(near[a][i : i + 8] == near[b][i : i + 8] for i in range(0, len(near[a]), 8))
    assert like(3, 2) > like(3, 1) > like(3, 0)


@pytest.mark.parametrize("crowd", [2000, 0])
def test_repeats_equal_brute_force(docs, empty, crowd):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    size = 60
    seen = collections.Counter(t[i : i + size] for _, t in rows for i in range(len(t) - size + 1))
    want = collections.Counter()
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        want[(k, bytes(c for c, g in zip(t, gone) if not g), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)))] += 1
    got = repeats.find(docs, length=size, shard_bytes=2000, crowd=crowd).collect()
    assert collections.Counter((r.id, bytes(r.kept), len(r.spans)) for r in got) == want
    assert repeats.find(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "word " * 50
    pages = [(1, "http://a/", long), (2, "http://b/", long), (3, None, None), (4, "http://c\r\nd", "short"), (5, "u", "short"), (None, "n", "WARC/1.0\r\n\r\n" * 3), (7, "é", "日本" * 100)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    where = str(tmp_path / "w")
    warc.write_archives(frame, where)
    got = {r.record_id: r for r in warc.read_archives(spark, where).collect()}
    assert len(got) == 7 and all(r.gap is None for r in got.values())
    assert got["2"].record_type == "revisit" and got["2"].refers_to == "1" and got["2"].payload_length == len(long)
    assert bytes(got["1"].payload).decode() == long and got["4"].url == "http://c%0D%0Ad" and got["5"].record_type == "response"
    assert bytes(got[None].payload).decode() == pages[5][2] and bytes(got["3"].payload) == b""
    warc.write_archives(frame.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def record(n, body, digest=None):
    digest = digest or hashlib.sha256(body).hexdigest()
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_salvages_every_undamaged_record(zipped):
    import gzip

    shut = gzip.compress if zipped else bytes
    rng = random.Random(1)
    for _ in range(60):
        parts = [shut(record(i, bytes(rng.randrange(256) for _ in range(200)))) for i in range(6)]
        hurt = rng.randrange(6)
        p = bytearray(parts[hurt])
        cut = rng.random() < 0.5
        if cut:
            del p[rng.randrange(20, len(p)) :]
        else:
            at = rng.randrange(len(p) - 120, len(p) - 30)
            p[at] ^= 0x55
        raw = b"".join(parts[:hurt]) + bytes(p) + b"".join(parts[hurt + 1 :])
        found = list(warc.parse_archive(raw))
        assert {h["warc-record-id"] for _, _, h, _ in found if h} >= {f"<urn:page:{i}>" for i in range(6) if i != hurt}
        covered = sorted({(a, b) for a, b, _, _ in found})
        assert covered[0][0] == 0 and covered[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_warc_takes_long_headers_and_large_pages(spark, tmp_path):
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    pages = [(0, "data:" + "x" * 200_000, "page of a long URL")] + [(i, f"http://{i}/", text((300, 5_000, 30_000)[i % 3])) for i in range(1, 60)]
    where = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(where), records_per_file=100, archive_bytes=100_000)
    got = {r.record_id: r for r in warc.read_archives(spark, str(where)).collect()}
    assert len(got) == 60 and all(r.gap is None for r in got.values())
    assert all(got[str(i)].url == url and bytes(got[str(i)].payload).decode() == html for i, url, html in pages)
    sizes = sorted(p.stat().st_size for p in where.glob("part-*"))
    assert sizes[-1] > 200_000 >= 100_000 >= sizes[-2]


def test_warc_salvages_within_a_member():
    import gzip

    parts = [record(i, b"body %d " % i * 20, "0" * 64 if i == 2 else None) for i in range(5)]
    raw = gzip.compress(b"".join(parts)) + gzip.compress(record(9, b"next"))
    found = list(warc.parse_archive(raw))
    assert [h["warc-record-id"] for _, _, h, _ in found if h] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 9)]
    assert [why for _, _, h, why in found if not h] == ["wrong digest"] and found[0][0] == 0 and found[-1][1] == len(raw)


def test_leaks_with_substitutions(spark, docs, empty):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for i in range(12)] + [(50, None), (51, "a b"), (52, "short item of six words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(12):
        w = items[i][1].split()
        for at in rng.sample(range(30), 3):
            w[at] = "other"
        rows.append((i, prose(rng, 30) + " " + " ".join(w).upper() + "! " + prose(rng, 30)))
    rows += [(20, items[0][1][: len(items[0][1]) // 4]), (21, prose(rng, 200)), (22, None), (23, "x Short item, of six words here y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1 << 27, 1 << 15):
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(frame, bench, most_bits=bits).collect()}
        assert all(got[i] == [str(i)] for i in range(12)) and got[20] == got[21] == got[22] == [] and got[23] == ["52"]
    assert decontaminate.decontaminate(frame, bench).count() == 3 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_main_text():
    tree = html_text.train()
    assert all(html_text.decide(tree, r[:-1]) == r[-1] for r in html_text.LABELLED)
    page = ('<!DOCTYPE html><title>t</title><header><a href=x>Home</a></header><div id="cookie-notice">We use cookies here</div><nav><li><a href="/a">A</a></nav>'
            '<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text.<br>More<p>Second<script>if (a<b) x="</p>"</script> block<!-- no --> end.'
            '<aside>side</aside><form>q<input></form></article><div class="comments"><p>reader words that go on for quite a while, as they do, in many a comment</div><footer>f')
    assert html_text.main_text(page, tree) == "Head & line First bold text. More Second block end."
    assert html_text.main_text("", tree) == html_text.main_text("<!-- open", tree) == html_text.main_text("<script>x", tree) == ""


def test_extract_edge_cases(spark):
    frame = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<article><p>" + "word " * 30_000, "old")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert got[1] == got[2] == "" and len(got[3].split()) == 30_000
    assert html_text.extract(frame.where("false")).count() == 0


def test_scores_equal_brute_force(docs, empty):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    learn = [w for k, w in rows if k is not None and zlib.crc32(str(k).encode()) % 10]
    c = collections.Counter(x for w in learn for x in w)
    pairs = collections.Counter(p for w in learn for p in zip([0, *w], w))
    total, vocab = sum(c.values()), len(c)
    got = interpolation.score(docs, bucket_tokens=1500).collect()
    want = collections.Counter((k, k is None or zlib.crc32(str(k).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), total) for k, w in rows)
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    base = {k: sum(math.log10((c[x] + 0.1) / (total + 0.1 * (vocab + 1))) for x in w) for k, w in rows}
    assert all(abs(r.base_score - base[r.id]) < 1e-6 * max(1, abs(base[r.id])) for r in got)
    # the mixture is worked out from the fitted weights
    frame = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), interpolation.learns("doc_id").alias("learn"), F.xxhash64("doc_id", "text").alias("key"))
    model, _ = interpolation.fitted(frame, 1500)
    often = {x for x, n in c.items() if n >= 2 and x is not None}
    history = lambda x: x if x == 0 or x in often else "rare"
    classed = collections.Counter()
    for (h, x), n in pairs.items():
        classed[(history(h), x)] += n
    contexts = collections.Counter()
    for (h, _), n in classed.items():
        contexts[h] += n
    for r in got:
        w = next(w for k, w in rows if k == r.id)
        want_score = 0.0
        for h, x in zip([0, *w], w):
            h = history(h)
            weight = model.weights[math.frexp(max(contexts[h], 1))[1]]
            want_score += math.log10(weight * classed[(h, x)] / max(contexts[h], 1) + (1 - weight) * (c[x] + 0.1) / (total + 0.1 * (vocab + 1)))
        assert abs(r.score - want_score) < 1e-6 * max(1, abs(want_score))
    assert interpolation.score(empty).count() == 0
    assert all(r.score == 0 for r in interpolation.score(docs.where("doc_id IS NULL")).collect())


@pytest.mark.parametrize("share", [0.0009, 0.003, 0.05])
def test_scores_give_rare_words_histories_of_their_own(spark, monkeypatch, share):
    monkeypatch.setattr(interpolation, "SHARE", share)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "w1 w2 unseen w3 unseen words"), (500, None), rows[3]]
    split = [(k, (t or "").split() + [None]) for k, t in rows]
    learn = [w for k, w in split if k is not None and zlib.crc32(str(k).encode()) % 10]
    c = collections.Counter(x for w in learn for x in w)
    total, vocab = sum(c.values()), len(c)
    history = lambda x: x if x == 0 or c[x] >= 2 else "once"
    pairs = collections.Counter((history(h), x) for w in learn for h, x in zip([0, *w], w))
    contexts = collections.Counter()
    for (h, _), n in pairs.items():
        contexts[h] += n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), interpolation.learns("doc_id").alias("learn"), F.xxhash64("doc_id", "text").alias("key"))
    model, buckets = interpolation.fitted(frame, 700)
    # words with an own history that the frequent ones leave out, and more buckets than one
    assert buckets > 3 and sum(n >= 2 for n in c.values()) > len(model.words)

    # the weights come from the same deleted counts as with every word of two occurrences among the frequent ones
    monkeypatch.setattr(interpolation, "SHARE", 1e-6)
    plain, _ = interpolation.fitted(frame, 700)
    monkeypatch.setattr(interpolation, "SHARE", share)
    assert sum(n >= 2 for n in c.values()) == len(plain.words) and abs(plain.weights - model.weights).max() < 1e-9

    want = collections.Counter()
    for k, w in split:
        score = 0.0
        for h, x in zip([0, *w], w):
            h = history(h)
            weight = model.weights[math.frexp(max(contexts[h], 1))[1]]
            score += math.log10(weight * pairs[(h, x)] / max(contexts[h], 1) + (1 - weight) * (c[x] + 0.1) / (total + 0.1 * (vocab + 1)))
        want[(k, len(w), sum(c[x] > 0 for x in w), round(score, 5))] += 1
    got = interpolation.score(docs, bucket_tokens=700).collect()
    assert collections.Counter((r.id, r.n_tokens, r.n_known, round(r.score, 5)) for r in got) == want
