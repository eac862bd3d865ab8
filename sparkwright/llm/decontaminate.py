"""Operator 8: benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower case; in scripts written without spaces every character is a word. Fixed
masks read some word positions of a window and ignore the others, so a window still hits where ignored words were
substituted. The seed hashes of all windows of all documents are joined with those of the benchmark, and around each
hit the two word sequences are compared position by position on the hit's diagonal: the longest stretch of which 80 %
agree is a leak if it has ``min_words`` words, or as many as the item if that is shorter.

No such stretch is missed: every placement of up to a fifth of substitutions leaves a window of some mask whole, for
every length from 10 to 25 with ``LONG`` and from 5 to 9 with ``SHORT`` (tests enumerate them). A longer stretch has a
shorter one that is as alike: of two halves, one is. A similarity below 0.8 has no such guarantee.

Plan: a bitmap of the benchmark's hashes, of at most ``MOST_BITS`` bits whatever the benchmark's size, goes to the
executors and keeps the windows that can hit; these are joined by hash with the benchmark's windows in Spark. Texts
are named by a 128-bit hash, so copies ask once. What a text is asked (items and diagonals) is written, joined to the
documents, and compared there. Nothing is collected but the bitmap and the numbers of the masks. A seed that many items
and many documents share makes one row for each pair of them that meets on it.

Defined results: null text counts as empty and has no leak; items of fewer than five words are not sought (five words
are the least evidence); repeated rows get equal results, equal items are all reported; an empty benchmark leaks
nothing; an input column with an output's name is replaced, other columns are kept.
"""

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

common.ship(__name__)

#: 1: the word at this place counts; 0: it is ignored. For stretches from ten words up, and for those of five to nine.
LONG = ("11111", "111011", "11001011")
SHORT = ("1111", "11101", "11011", "10111")
MASKS = LONG + SHORT
LEAST_WORDS, LEAST_LONG = 5, 10
#: Bits of the map for each seed of the benchmark, and at most (16 MB).
SEED_BITS, MOST_BITS = 64, 1 << 27
#: Windows that are hashed at once.
SLICE = 1 << 18
LEAK = "array<struct<item_id: string, start_word: int, end_word: int, item_start: int, matched: int>>"
#: Thai to Lao, Myanmar, Khmer, kana and Han: scripts that put no spaces between words.
NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def word_list(text: str) -> list[str]:
    import re

    return re.findall(f"[{NO_SPACES}]|[^\\W_{NO_SPACES}]+", text.lower())


def word_hashes(chunk: str) -> tuple[int, ...]:
    import xxhash

    return tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in word_list(chunk))


class ChunkCodes(dict):
    """Running numbers of text chunks seen in this process; the hashes of their words are runs of one array."""

    def __init__(self):
        import array

        super().__init__()
        self.hashes, self.ends = array.array("Q"), array.array("q", [0])

    def __missing__(self, chunk):
        self.hashes.extend(word_hashes(chunk))
        self.ends.append(len(self.hashes))
        if len(chunk) <= 64:
            self[chunk] = len(self.ends) - 2
        return len(self.ends) - 2


def sequences(texts: list[str], most: int = 200_000):
    """The hashes of the words of all texts in one array, and where each text begins in it (and the last one ends).

    No word holds white space: chunks between white space are numbered, and forgotten between calls beyond ``most``."""
    import array

    import numpy as np

    codes = common.per_process("chunks", ChunkCodes)
    if len(codes.hashes) > most or len(codes) > most:
        codes.clear()
        del codes.hashes[:], codes.ends[1:]
    chunks, starts = array.array("q"), [0]
    for text in texts:
        chunks.extend(map(codes.__getitem__, text.lower().split()))
        starts.append(len(chunks))
    chunks, ends, hashes = np.array(chunks, np.int64), np.array(codes.ends, np.int64), np.array(codes.hashes, np.uint64)
    first, n = ends[chunks], ends[chunks + 1] - ends[chunks]
    place = np.concatenate([[0], np.cumsum(n)])
    return hashes[np.repeat(first - place[:-1], n) + np.arange(place[-1])], place[starts]


def window_hashes(words, masks: list[int]):
    """mask, first window, and the hashes of the places the mask reads in the windows from there on, slice by slice.
    Words' hashes are spread evenly, so their sum, each times an odd number of its place, is too."""
    import numpy as np

    factors = common.mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for begin in range(0, len(words), SLICE):
        parts = [words[begin : begin + SLICE + 7] * f for f in factors]
        for mask in masks:
            places = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
            n = min(SLICE, len(parts[0]) - len(MASKS[mask]) + 1)
            if n > 0:
                h = parts[0][:n].copy()
                for i in places[1:]:
                    h += parts[i][i : i + n]
                yield mask, begin, h


def longest_alike(same, similarity: float) -> tuple[int, int]:
    """The longest stretch of which at least the share ``similarity`` is true (the first of equally long ones)."""
    import numpy as np

    score = np.concatenate([[0], np.cumsum(np.where(same, 1.0 - similarity, -similarity))]) + 1e-9 * np.arange(len(same) + 1)
    lows = np.flatnonzero(score < np.concatenate([[np.inf], np.minimum.accumulate(score)[:-1]]))
    best, e = (0, 0), len(score) - 1
    highs = np.maximum.accumulate(score[::-1])[::-1]  # the highest score from here on
    for b in lows.tolist():
        e = max(b, int(len(highs) - np.searchsorted(highs[::-1], score[b], side="left")) - 1)
        if e - b > best[1] - best[0]:
            best = (b, e)
    return best


def in_map(table, places):
    import numpy as np

    return (table[(places >> np.uint64(3)).view(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1)


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str, min_words: int) -> DataFrame:
    """item (digest of the word sequence), words (the sequence as bytes), names (of all items that have it), seeds."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))

    @F.arrow_udf("binary")
    def words_of(texts: pa.Array) -> pa.Array:
        words, starts = sequences(texts.to_pylist())
        return pa.array([words[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())

    @F.arrow_udf("array<struct<mask: int, hash: long, at: int>>")
    def seeds_of(words: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for x in words:
            seq = np.frombuffer(x.as_buffer(), np.uint64)
            long = min(min_words, len(seq)) >= LEAST_LONG
            masks = range(len(LONG)) if long else range(len(LONG), len(MASKS))
            out.append([(m, h, at) for m, first, found in window_hashes(seq, masks) for at, h in enumerate(found.view(np.int64).tolist(), first)])
        return pa.array([[dict(zip(("mask", "hash", "at"), x, strict=True)) for x in one] for one in out], kind)

    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), words_of(common.text_or_empty(text_col)).alias("words"))
    rows = rows.where(F.octet_length("words") >= 8 * LEAST_WORDS)
    # a struct keeps null names in the list
    same = rows.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("name"))).alias("names"))
    return same.select(F.unhex(F.md5("words")).alias("item"), "words", "names", seeds_of("words").alias("seeds"))


def bit_map(seeds: DataFrame, bits: int) -> bytes:
    """The map with both places of every seed set: bits / 32768 rows of 4 KB, or fewer, are collected."""
    most = F.lit(bits - 1)
    places = seeds.select(F.explode(F.array(F.col("hash").bitwiseAND(most), F.shiftrightunsigned("hash", 32).bitwiseAND(most))).alias("place"))
    parts = places.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(bits // 8)
    for row in parts.collect():
        out[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return bytes(out)


def possible_hits(texts: DataFrame, sent, bits: int, masks: list[int]) -> DataFrame:
    """k1, k2 (of the text), hash, at: the windows of ``texts`` (k1, k2, text) whose hash is in the map."""
    import pyarrow as pa

    def search(batches):
        import numpy as np

        table = np.frombuffer(sent.value, np.uint8)

        most = np.uint64(bits - 1)

        def found(keys, texts):
            # one sequence; a window that runs into the next text may pass here and is refused when texts are compared
            words, starts = sequences(texts)
            for _, begin, h in window_hashes(words, masks):
                at = np.flatnonzero(in_map(table, h & most))
                at = at[in_map(table, (h[at] >> np.uint64(32)) & most) > 0]
                text = np.searchsorted(starts, begin + at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][text]), pa.array(keys[1][text]), pa.array(h[at].view(np.int64)), pa.array((begin + at - starts[text]).astype(np.int32))],
                                                 ["k1", "k2", "hash", "at"])

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            held, first, n = [], 0, 0
            for i, x in enumerate(batch.column(2)):
                held.append(x.as_py())
                n += len(held[-1])
                if n >= 1_500_000 or i == batch.num_rows - 1:
                    yield from found([k[first : i + 1] for k in keys], held)
                    held, first, n = [], i + 1, 0

    return texts.mapInArrow(common.tidy(search), "k1 long, k2 long, hash long, at int")


def compare(text: str, asked: list[dict], min_words: int, similarity: float) -> list[dict]:
    """The leaks of one text among the items and diagonals it was asked."""
    import numpy as np

    (words, _), out = sequences([text]), []
    for item in asked:
        seq = np.frombuffer(item["words"], np.uint64)
        for shift in sorted(item["shifts"]):
            first, last = max(0, -shift), min(len(seq), len(words) - shift)
            if last <= first:
                continue
            same = seq[first:last] == words[first + shift : last + shift]
            begin, end = longest_alike(same, similarity)
            matched = int(same[begin:end].sum())
            if end - begin >= min(min_words, len(seq)) and matched >= similarity * (end - begin):
                out += [{"item_id": x["name"], "start_word": begin + first + shift, "end_word": end + first + shift, "item_start": begin + first, "matched": matched}
                        for x in item["names"]]
    return sorted(out, key=lambda x: (x["item_id"] is not None, x["item_id"] or "", x["start_word"] - x["item_start"], x["end_word"]))


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", min_words: int = 13, similarity: float = 0.8,
               most_bits: int = MOST_BITS, out: str = "leaks") -> DataFrame:
    """Add ``out``: the benchmark passages in each text (item, word spans in text and item, words that agree)."""
    import pyarrow as pa

    if min_words < LEAST_WORDS:
        raise ValueError(f"min_words must be {LEAST_WORDS} at least")
    spark = df.sparkSession
    items = common.written(benchmark_items(benchmark, item_col, item_text_col, min_words), "benchmark")
    seeds = items.select("item", F.explode("seeds").alias("s")).select("item", "s.*")
    count = seeds.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()  # at most as many rows as masks
    none = F.array().cast(LEAK)
    if not count:
        return df.withColumn(out, none)
    bits = 1 << 15
    while bits < min(most_bits, SEED_BITS * sum(r.n for r in count)):
        bits *= 2
    sent = spark.sparkContext.broadcast(bit_map(seeds, bits))

    text = common.text_or_empty(text_col)
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(1), text, F.length(text))
    hits = possible_hits(df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")), sent, bits, sorted(r.mask for r in count)).distinct()
    met = hits.join(seeds.select("hash", "item", F.col("at").alias("item_at")), "hash")
    met = met.groupBy("k1", "k2", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))  # bounded by text and item
    asked = met.join(items.select("item", "words", "names"), "item").groupBy("k1", "k2").agg(F.collect_list(F.struct("names", "words", "shifts")).alias("__asked"))
    asked = common.written(asked.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), "asked")
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("item_start", pa.int32()), ("matched", pa.int32())]))

    @F.arrow_udf(LEAK)
    def leaks(texts: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.array([compare(x.as_py(), a.as_py(), min_words, similarity) if a.is_valid else None for x, a in zip(texts, asked, strict=True)], kind)

    rows = df.withColumns({"__k1": k1, "__k2": k2}).join(asked, ["__k1", "__k2"], "left")
    found = leaks(F.when(F.col("__asked").isNotNull(), F.col(text_col).cast("string")), F.col("__asked"))  # other texts stay in the JVM
    return rows.withColumn(out, F.coalesce(found, none)).drop("__k1", "__k2", "__asked")


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` without a benchmark passage, with the columns of ``df``."""
    return find_leaks(df, benchmark, out="__leaks", **options).where(F.size("__leaks") == 0).drop("__leaks")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, whether it is kept (no benchmark passage), and the items found in it."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    return found.select(
        "doc_id", (F.size("leaks") == 0).alias("kept"), F.size("leaks").cast("long").alias("n_leaks"),
        F.array_distinct(F.transform("leaks", lambda x: x["item_id"].cast("long"))).alias("item_ids"),
        F.aggregate("leaks", F.lit(0), lambda n, x: n + x["matched"]).cast("long").alias("matched_words"))
