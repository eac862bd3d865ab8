"""Operator 10: language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood bigram estimate with a smoothed unigram,
    p(w | h) = L[b(h)] * c(h, w) / c(h) + (1 - L[b(h)]) * (c(w) + 0.1) / (N + 0.1 * (V + 1)),
where b(h) is the bucket of the history's frequency (powers of two). Every word that occurs twice in the training text
is a history of its own, whatever the input's size. Words that occur once form one class with unknown ones: without its
only occurrence such a history has no counts. The weights L come from expectation-maximisation on deleted counts: every
training occurrence is predicted from the counts without it.

Words with the share ``SHARE`` of all tokens are frequent, the others rare.

All counts cover all training documents; what is gathered grows with the input:
1. word counts, combined per task, then by word;
2. word pairs with a large share of the tokens (at most some 1 / SHARE of them), counted on their own, so that no hot
   pair is ever gathered in a bucket;
3. all other training pairs in buckets: those of two frequent words by pair, a rare word's by word, with the frequent word
   that follows it, so those of a rare history and a frequent word by history. A bucket has pair and word counts whole and so the history's, too, but for
   two rare words: the counts of the rare histories that occur there are joined to it. It gives the deleted counts as a
   histogram of estimate ratios, on which the weights are fitted, and the counts of frequent words after the class;
4. the tokens of all documents in the same buckets, which reply to each batch with its sums by document; hot pairs
   are scored where they are read. A batch's replies are added up, then those of equal keys.
Buckets hold some ``bucket_tokens`` tokens each, whatever the input's size. A reply has a sum for each document that
has tokens in the bucket, so the sums grow with documents times buckets until they reach one for each token.

Defined results: null or empty text is the end token alone; rows with a null id are scored and not learned from;
repeated rows get equal results; without training text the score is 0 for each token; an empty table gives an empty
table; other columns are not read.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

common.ship(__name__)

SHARE = 1e-6
#: Marks beside the words' hashes (their numbers in a batch are 0 and 1), and places in the table of histories.
END, START = 2, 1
END_CODE, START_CODE = 0, 1
RARE_AT, START_AT = 0, 1
#: Steps of the histogram of ratios in an octave, and its range in octaves.
STEPS, OCTAVES = 16, 64


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10))


def learns(id_col: str) -> Column:
    return F.coalesce(fold(id_col) != 0, F.lit(False))


class WordCodes(dict):
    """Running numbers of words (bytes) seen in this process, and their 64-bit hashes by number."""

    def __init__(self):
        import array

        super().__init__()
        self.hashes = array.array("Q", [END, START])

    def __missing__(self, word):
        import xxhash

        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def token_batches(batch, column: int, size: int = 2_000_000, most: int = 120_000):
    """(texts' places, word numbers with the end after each text, hashes by number, tokens of each text), some ``size``
    tokens at a time. Numbers hold within a batch; between batches the words are forgotten beyond ``most``."""
    import array

    import numpy as np

    words = common.per_process("codes", WordCodes)
    at, codes, sizes = 0, array.array("i"), []
    texts = batch.column(column)
    for i, x in enumerate(texts):
        before_this = len(codes)
        codes.extend(map(words.__getitem__, (x.as_py() or "").encode("utf-8", "surrogatepass").lower().split()))
        codes.append(END_CODE)
        sizes.append(len(codes) - before_this)
        if len(codes) >= size or i == len(texts) - 1:
            yield slice(at, i + 1), np.array(codes, np.int32), np.array(words.hashes, np.uint64), np.array(sizes)
            at, codes, sizes = i + 1, array.array("i"), []
            if len(words) > most:
                words.clear()
                del words.hashes[2:]


def before(codes, sizes):
    """The word before each, START_CODE at the start of each text."""
    import numpy as np

    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = START_CODE
    return out


class Model:
    """Bounded tables: frequent words with counts, histories, hot pairs with counts, totals."""

    def __init__(self, hashes, counts, total: int, words: int, texts: int, once: int, hints):
        import numpy as np

        order = np.argsort(hashes)
        self.words, self.word_counts = hashes[order], counts[order]
        self.total, self.n_words = total, words
        self.floor = 0.1 / (total + 0.1 * (words + 1))
        # histories: the class of words that occur once, the start, then the frequent words
        self.history = np.concatenate([[once, texts], self.word_counts]).astype(np.int64)
        self.base = len(self.history)
        rare = np.arange(len(self.words), dtype=np.int64) + RARE_AT * self.base
        (h, _), (_, w) = self.places(hints[:, 0]), self.places(hints[:, 1])
        self.hot = np.unique(np.concatenate([rare, (h * self.base + w)[w >= 0]]))
        self.hot_counts = np.zeros(len(self.hot), np.int64)
        self.weights = np.zeros(64)

    def places(self, hashes):
        """Places of words as history and as word; a rare word is -1."""
        import numpy as np

        if not len(self.words):
            at = np.full(len(hashes), -1)
        else:
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            at = np.where(self.words[at] == hashes, at, -1)
        return np.where(hashes == np.uint64(START), START_AT, np.where(at >= 0, at + 2, RARE_AT)), at

    def hot_at(self, pairs):
        """Place among the hot pairs, -1 for others."""
        import numpy as np

        if not len(self.hot):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.hot, pairs), len(self.hot) - 1)
        return np.where(self.hot[at] == pairs, at, -1)

    def unigram(self, counts):
        return (counts + 0.1) * (self.floor / 0.1)

    def bucket(self, history):
        import numpy as np

        return np.frexp(np.maximum(history, 1).astype(np.float64))[1]

    def mixed(self, pair_counts, history, word_counts):
        import numpy as np

        weight = self.weights[self.bucket(history)]
        return weight * pair_counts / np.maximum(history, 1) + (1 - weight) * self.unigram(word_counts)

    def logs(self, pair_counts, history, word_counts):
        """1.0 for a known word, base and model log10 probabilities."""
        import numpy as np

        return (word_counts > 0).astype(np.float64), np.log10(self.unigram(word_counts)), np.log10(self.mixed(pair_counts, history, word_counts))

    def histogram(self, pair_counts, history, word_counts):
        """Weights of the deleted counts by history bucket and ratio step; step 0 is a ratio of 0."""
        import numpy as np

        seen = pair_counts > 0
        c, h, w = pair_counts[seen], history[seen], word_counts[seen]
        ratio = (c - 1) / np.maximum(h - 1, 1) / ((w - 1 + 0.1) / (self.total - 1 + 0.1 * (self.n_words + 1)))
        step = np.zeros(len(c), np.int64)
        some = ratio > 0
        step[some] = np.clip(np.round(np.log2(ratio[some]) * STEPS), -OCTAVES * STEPS, OCTAVES * STEPS).astype(np.int64) + OCTAVES * STEPS + 1
        width = 2 * OCTAVES * STEPS + 2
        return np.bincount(self.bucket(h) * width + step, weights=c, minlength=64 * width)

    def fit(self, histogram, rounds: int = 200) -> None:
        import numpy as np

        width = 2 * OCTAVES * STEPS + 2
        ratio = np.concatenate([[0.0], np.exp2((np.arange(width - 1) - OCTAVES * STEPS) / STEPS)])
        for b, n in enumerate(histogram.reshape(64, width)):
            weight = 0.5
            if n.sum() > 0:
                for _ in range(rounds):
                    weight = float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum())
                    weight = min(max(weight, 1e-9), 1 - 1e-6)
            self.weights[b] = weight if n.sum() > 0 else 0.0


def pack(values) -> bytes:
    """Bytes of an array, byte planes apart and compressed."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind):
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def counted_words(rows: DataFrame) -> DataFrame:
    """kind (0 word, 1 pair hint), left, word, n of the training rows, combined by task. A hint is a pair that is
    frequent in its batch."""
    import pyarrow as pa

    def count(batches):
        import numpy as np

        for batch in batches:
            for _, codes, hashes, sizes in token_batches(batch, 0):
                n = np.bincount(codes, minlength=len(hashes))
                words = np.flatnonzero(n)
                pairs, times = np.unique(before(codes, sizes).astype(np.int64) * len(hashes) + codes, return_counts=True)
                often = times >= max(16, len(codes) * SHARE)
                pairs, times = pairs[often], times[often]
                signed = hashes.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.zeros(len(words), np.int32), np.ones(len(pairs), np.int32)])),
                    pa.array(np.concatenate([np.zeros(len(words), np.int64), signed[pairs // len(hashes)]])),
                    pa.array(np.concatenate([signed[words], signed[pairs % len(hashes)]])),
                    pa.array(np.concatenate([n[words], times]).astype(np.int64))], ["kind", "left", "word", "n"])

    return (rows.select("text").mapInArrow(count, "kind int, left long, word long, n long")
            .groupBy("kind", "left", "word").agg(F.sum("n").alias("n")))


def place_in(buckets: int, values):
    """Buckets of 64-bit values."""
    import numpy as np

    return (common.mix64(values) % np.uint64(buckets)).astype(np.int64)


def hot_pairs_and_needs(rows: DataFrame, sent, buckets: int) -> DataFrame:
    """bucket, at, n: hot pairs in the training rows with their counts (bucket null), and the rare words (at, a hash) of
    which a bucket needs the counts, as they come before rare words in any rows."""
    import pyarrow as pa

    def count(batches):
        import numpy as np

        m = sent.value
        total = np.zeros(len(m.hot), np.int64)
        for batch in batches:
            for part, codes, hashes, sizes in token_batches(batch, 0):
                learn = np.repeat(np.array(batch.column(1)[part].to_pylist(), bool), sizes)
                as_history, as_word = m.places(hashes)
                left = before(codes, sizes)
                h, w = as_history[left], as_word[codes]
                at = m.hot_at((h * m.base + w)[learn & (w >= 0) & (h != RARE_AT)])
                total += np.bincount(at[at >= 0], minlength=len(m.hot))
                both = (w < 0) & (h == RARE_AT)
                to = place_in(buckets, hashes + np.uint64(1))[codes[both]]
                need = np.unique(left[both].astype(np.int64) * buckets + to)
                yield pa.RecordBatch.from_arrays([pa.array(need % buckets), pa.array(hashes.view(np.int64)[need // buckets]), pa.array(np.zeros(len(need), np.int64))], ["bucket", "at", "n"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some), pa.array(total[some])], ["bucket", "at", "n"])

    return rows.select("text", "learn").mapInArrow(count, "bucket long, at long, n long").groupBy("bucket", "at").agg(F.sum("n").alias("n"))


ENTRIES = ("bucket long, batch long, pairs binary, pair_docs binary, lefts binary, words binary, word_docs binary, "
           "nexts binary, docs binary, learns binary, sums binary")


def entries(rows: DataFrame, sent, buckets: int, by_doc: bool) -> DataFrame:
    """Packed tokens by bucket, without hot pairs. by_doc: every token with its document, and for each batch a row with
    the documents' sums over hot pairs, whose counts are known; else the training pairs alone."""
    import pyarrow as pa

    def deal(batches):
        import numpy as np
        from pyspark import TaskContext

        m = sent.value
        logs = m.logs(m.hot_counts, m.history[m.hot // m.base], m.word_counts[m.hot % m.base]) if by_doc and len(m.hot) else []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, codes, hashes, sizes in token_batches(batch, 0):
                number += 1
                keys = batch.column(1)[part.start : part.stop].to_numpy(zero_copy_only=False).astype(np.int64)
                learn = np.array(batch.column(2)[part.start : part.stop].to_pylist(), bool)
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                as_history, as_word = m.places(hashes)
                lefts = before(codes, sizes)
                h, w = as_history[lefts], as_word[codes]
                often, known = w >= 0, h != RARE_AT
                pair, pair_doc, word_doc = (h * m.base + w)[often & known], doc[often & known], doc[~often]
                at = m.hot_at(pair)
                hot = at >= 0
                out = {n.split()[0]: [] for n in ENTRIES.split(", ")}

                def put(out=out, **row):
                    for n, held in out.items():
                        held.append(row.get(n))

                if by_doc and hot.any():
                    hot_doc, hot_at = pair_doc[hot], at[hot]
                    sums = [np.bincount(hot_doc, minlength=len(sizes)), *(np.bincount(hot_doc, x[hot_at], len(sizes)) for x in logs)]
                    put(bucket=number % buckets, batch=number, docs=pack(keys), sums=pack(np.concatenate(sums).astype(np.float64)))
                pair, pair_doc = pair[~hot], pair_doc[~hot]
                # before a rare word: the place of a history, or the hash of a rare one; after it: a frequent word's place or -1
                left, word = np.where(as_history == RARE_AT, hashes, as_history.astype(np.uint64))[lefts[~often]], hashes[codes[~often]]
                following = np.append(w[1:], -1).astype(np.int32)
                following[codes == END_CODE] = -1
                following = following[~often]
                to, to_word = place_in(buckets, pair.view(np.uint64)), place_in(buckets, word + np.uint64(1))
                a, b = np.argsort(to, kind="stable"), np.argsort(to_word, kind="stable")
                ends_a = np.searchsorted(to[a], np.arange(buckets + 1))
                ends_b = np.searchsorted(to_word[b], np.arange(buckets + 1))
                for k in np.flatnonzero((np.diff(ends_a) > 0) | (np.diff(ends_b) > 0)).tolist():
                    x, y = a[ends_a[k] : ends_a[k + 1]], b[ends_b[k] : ends_b[k + 1]]
                    row = {"bucket": k, "batch": number, "pairs": pack(pair[x]), "lefts": pack(left[y]), "words": pack(word[y]), "nexts": pack(following[y])}
                    if by_doc:
                        found = np.zeros(len(sizes), bool)
                        found[pair_doc[x]] = found[word_doc[y]] = True
                        place = (np.cumsum(found) - 1).astype(np.uint32)
                        row |= {"pair_docs": pack(place[pair_doc[x]]), "word_docs": pack(place[word_doc[y]]), "docs": pack(keys[found]), "learns": learn[found].tobytes()}
                    put(**row)
                kinds = {"bucket": pa.int64(), "batch": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()], list(out))

    return rows.select("text", "key", "learn").mapInArrow(deal, ENTRIES)


class Bucket:
    """The entries of one bucket (rows of tokens), the counts of rare histories that it needs (word, n), and its counts."""

    def __init__(self, rows: list[dict], needs, m: Model, by_doc: bool):
        import numpy as np

        kinds = {"pairs": np.int64, "lefts": np.uint64, "words": np.uint64, "nexts": np.int32}
        kinds |= {"pair_docs": np.uint32, "word_docs": np.uint32} if by_doc else {}
        got = {n: [np.empty(0, kind)] for n, kind in kinds.items()}
        learns, self.ends = [np.empty(0, bool)], [0]  # documents of each row
        for row in rows:
            for n, kind in kinds.items():
                values = unpack(row[n], kind)
                got[n].append(values + np.uint32(self.ends[-1]) if kind is np.uint32 else values)
            if by_doc:
                learns.append(np.frombuffer(row["learns"], bool))
                self.ends.append(self.ends[-1] + len(learns[-1]))
        got = {n: np.concatenate(v) for n, v in got.items()}
        learns = np.concatenate(learns).astype(np.float64)
        self.got, self.m = got, m
        count = lambda inverse, docs, n: np.bincount(inverse, learns[got[docs]] if by_doc else None, n).astype(np.int64)

        # frequent words after frequent ones: pairs are whole here
        pairs, pair_of = np.unique(got["pairs"], return_inverse=True)
        pair_word = m.word_counts[pairs % m.base] if len(pairs) else pairs
        # rare words: all of a word's pairs are here; a history that occurs less than twice is the class
        words, word_of = np.unique(got["words"], return_inverse=True)
        words_n = count(word_of, "word_docs", len(words))
        lefts, left_of = np.unique(got["lefts"], return_inverse=True)
        place = lefts < m.base
        times = np.zeros(len(lefts), np.int64)
        if len(needs[0]):
            at = np.minimum(np.searchsorted(needs[0], lefts), len(needs[0]) - 1)
            times = np.where(needs[0][at] == lefts, needs[1][at], 0)
        lefts, same = np.unique(np.where(place | (times >= 2), lefts, np.uint64(RARE_AT)), return_inverse=True)
        histories = np.zeros(len(lefts), np.int64)
        histories[same] = np.where(place | (times < 2), m.history[np.where(place, lefts[same], RARE_AT).astype(np.int64)], times)
        width = max(1, len(lefts))
        rares, rare_of = np.unique(word_of * width + same[left_of], return_inverse=True)
        # frequent words after rare ones: all of the history's pairs are here, and all of it as a word
        some = got["nexts"] >= 0
        head, following = word_of[some], got["nexts"][some].astype(np.int64)
        own = words_n[head] >= 2
        nexts, next_of = np.unique(head[own] * m.base + following[own], return_inverse=True)
        self.after_class = following[~own]  # also the numbers of the pairs, as the class comes first
        if by_doc:
            docs = got["word_docs"][some]
            got |= {"own_docs": docs[own], "class_docs": docs[~own]}
        #: For each kind of tokens: the pair of each, documents; of each pair its count, the history's, the word's.
        self.kinds = [
            (pair_of, "pair_docs", count(pair_of, "pair_docs", len(pairs)), m.history[pairs // m.base], pair_word),
            (rare_of, "word_docs", count(rare_of, "word_docs", len(rares)), histories[rares % width], words_n[rares // width]),
            (next_of, "own_docs", count(next_of, "own_docs", len(nexts)), words_n[nexts // m.base], m.word_counts[nexts % m.base]),
        ]

    def histogram(self):
        """Of all pairs but those of a frequent word after the class, which only all buckets together count."""
        return sum(self.m.histogram(*counts) for _, _, *counts in self.kinds)

    def sums(self):
        """For each row: tokens, known tokens, base and model log10 probabilities by document."""
        import numpy as np

        m, n = self.m, self.ends[-1]
        total = np.zeros((4, n))
        after, after_of = np.unique(self.after_class, return_inverse=True)
        in_class = (after_of, "class_docs", m.hot_counts[m.hot_at(after)], np.full(len(after), m.history[RARE_AT]), m.word_counts[after])
        for of, docs, *counts in [*self.kinds, in_class]:
            if len(of):
                at = self.got[docs]
                total[0] += np.bincount(at, minlength=n)
                for k, x in enumerate(m.logs(*counts), 1):
                    total[k] += np.bincount(at, x[of], n)
        return [total[:, i:j] for i, j in zip(self.ends[:-1], self.ends[1:], strict=True)]


def counts_needed(table):
    """The sorted hashes and the counts of a bucket's needs."""
    import numpy as np

    words, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def fitted(rows: DataFrame, bucket_tokens: int) -> tuple[Model, int]:
    """The model and the number of buckets."""
    return trained(rows, bucket_tokens)[:2]


def trained(rows: DataFrame, bucket_tokens: int) -> tuple[Model, int, DataFrame]:
    """The model, the number of buckets and the counts of rare histories by bucket (bucket, word, n)."""
    import numpy as np

    spark = rows.sparkSession
    learn = rows.where("learn")
    counts = common.written(counted_words(learn), "word_counts")
    once = F.count(F.when((F.col("n") == 1) & (F.col("word") != END), 1))
    totals = counts.where("kind = 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), once.alias("once")).first()
    total, n_words = int(totals.n or 0), int(totals.v)
    ends = counts.where(F.col("kind") == 0).where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    # at most 1 / SHARE words have the share, and as many pairs
    least = max(2.0, SHARE * total)
    often = counts.where((F.col("kind") == 0) & (F.col("n") >= least)).select("word", "n").toPandas()
    hints = counts.where((F.col("kind") == 1) & (F.col("n") >= least)).select("left", "word").toPandas()
    model = Model(often["word"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64), total, n_words, int(ends), int(totals.once),
                  hints.to_numpy(np.int64).reshape(-1, 2).view(np.uint64))
    buckets = max(1, math.ceil(total / bucket_tokens))
    if not total:
        return model, buckets, spark.createDataFrame([], "bucket long, word long, n long")
    found = common.written(hot_pairs_and_needs(rows, spark.sparkContext.broadcast(model), buckets), "needs")
    rare = counts.where(F.col("kind") == 0).where((F.col("n") >= 2) & (F.col("n") < least)).select("word", "n")
    needs = found.where("bucket IS NOT NULL").select("bucket", F.col("at").alias("word")).join(rare, "word")
    needs = common.written(needs.select("bucket", "word", "n"), "histories")
    hot = found.where("bucket IS NULL").select("at", "n").toPandas()  # bounded like the hot pairs
    model.hot_counts[hot["at"].to_numpy(np.int64)] = hot["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(model)
    import pyarrow as pa

    def stats(table: pa.Table, needed: pa.Table) -> pa.Table:
        bucket = Bucket(table.to_pylist(), counts_needed(needed), sent.value, False)
        n = bucket.histogram()
        at = np.flatnonzero(n)
        after, times = np.unique(bucket.after_class, return_counts=True)
        return pa.table({"at": pa.array(np.concatenate([at, after + len(n)])), "n": pa.array(np.concatenate([n[at], times.astype(np.float64)]))})

    found = (entries(learn, sent, buckets, False).groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(stats, "at long, n double")
             .groupBy("at").agg(F.sum("n").alias("n")).toPandas())  # bounded: buckets of histories x steps, frequent words
    at, n = found["at"].to_numpy(np.int64), found["n"].to_numpy()
    width = len(model.histogram(*(np.empty(0, np.int64),) * 3))
    model.hot_counts[model.hot_at(at[at >= width] - width)] = n[at >= width]
    histogram = model.histogram(model.hot_counts, model.history[model.hot // model.base], model.word_counts[model.hot % model.base])
    np.add.at(histogram, at[at < width], n[at < width])
    model.fit(histogram)
    return model, buckets, needs


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = 4_000_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of ``docs``."""
    import pyarrow as pa

    text = common.text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), learns(id_col).alias("learn"),
                       F.xxhash64(F.col(id_col).cast("string"), text).alias("key"))
    model, buckets, needs = trained(rows, bucket_tokens)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def replies(table: pa.Table, needed: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens = [r for r in rows if r["sums"] is None]
        for row, sums in zip(tokens, Bucket(tokens, counts_needed(needed), sent.value, True).sums(), strict=True):
            row["sums"] = pack(sums.ravel())
        return pa.table({n: pa.array([r[n] for r in rows], kind) for n, kind in (("batch", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()))})

    def added(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        keys, of = np.unique(np.concatenate([unpack(r["docs"], np.int64) for r in rows]), return_inverse=True)
        sums = np.concatenate([unpack(r["sums"], np.float64).reshape(4, -1) for r in rows], 1)
        return pa.table({"key": keys} | {n: np.bincount(of, x, len(keys)) for n, x in zip(("n", "known", "base", "mixed"), sums, strict=True)})

    got = (entries(rows, sent, buckets, True).groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(replies, "batch long, docs binary, sums binary")
           .groupBy("batch").applyInArrow(added, "key long, n double, known double, base double, mixed double")
           .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "mixed")]))
    # rows of one key repeat a text; their sums came together and are dealt back evenly
    same = rows.groupBy("key", "id", "learn").agg(F.count(F.lit(1)).alias("times"))
    each = same.join(got, "key").withColumn("__", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    part = lambda c: F.round(F.col(c) / F.col("times")).cast("long")
    return each.select("id", (~F.col("learn")).alias("held_out"), part("n").alias("n_tokens"), part("known").alias("n_known"),
                       F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("times")).alias("base_score"),
                       (F.col("mixed") / F.col("times")).alias("score"))


def op10_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")
