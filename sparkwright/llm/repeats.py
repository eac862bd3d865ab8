"""Operator 6: exact removal of long repeats by run-compressed Burrows-Wheeler indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus. The corpus is dealt
into shards that can be judged alone:

1. every window of ``length`` bytes has an anchor, the least hash of its k-mers, so equal windows have equal anchors.
   Consecutive windows of one anchor form a context; each window of the corpus lies in exactly one context;
2. contexts are dealt by anchor. A context that occurs twice is repeated as a whole; one that shares its anchor with
   other contexts, or may repeat itself, is unresolved, and one of each goes to the index; all others are unique;
3. the unresolved contexts of a set of anchors are a shard of some ``shard_bytes``. Its run-length index holds the
   Burrows-Wheeler transform as runs with the text positions of the run ends. Streaming through the text, the match
   length at a position is one less than at the position before, except at run starts, where the texts at the sampled
   run ends are compared; a match of ``length`` bytes marks a repeated window. So only as many comparisons are made as
   there are runs, which repetitive text keeps few;
4. anchors with more than ``crowd`` unresolved contexts (a line that a third of all documents share) would make one
   shard too large: their windows are counted by hash instead, which splits such a group evenly.

The contexts of a document and its marks come back by a key of the row, and the text is shuffled by that key once.

Defined results: null text counts as empty; texts shorter than ``length`` keep all bytes; of repeated rows all bytes in
windows go, also from the first; an empty table gives an empty table; other columns are not read.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

common.ship(__name__)

KMER = 32
#: Longer runs of windows with one anchor are cut into contexts of so many windows.
MOST_WINDOWS = 512
CONTEXT = "array<struct<anchor: long, context: long, start: int, n: int, own: boolean>>"


def sliding(x, width: int, best):
    """best (np.minimum or np.maximum) over each stretch of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[:-rest], x[rest:]) if rest else x


def contexts(raw: bytes, length: int):
    """anchor, context hash, first window, number of windows, whether windows may repeat within, of each context."""
    import numpy as np
    import xxhash

    n = len(raw) - length + 1
    if n <= 0:
        return None
    h, have = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1
    while have < KMER:  # hashes of strings of twice the length
        h = h[:-have] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    h = common.mix64(h)
    width = length - KMER + 1
    low = sliding(h, width, np.minimum)
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    size = np.diff(np.concatenate([start, [n]]))
    if size.max() > MOST_WINDOWS:
        pieces = -(-size // MOST_WINDOWS)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, rest = np.repeat(start, pieces) + at * MOST_WINDOWS, np.repeat(size, pieces) - at * MOST_WINDOWS
        size = np.minimum(rest, MOST_WINDOWS)
    # anchors that stand at two near places can have equal windows in one context
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)
    values = h[places]
    near = (values[1:] == values[:-1]) & (np.diff(places) <= MOST_WINDOWS)
    anchor = low[start]
    own = np.isin(anchor, np.unique(values[1:][near]))
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(raw[a : a + m + length - 1]) for a, m in zip(start.tolist(), size.tolist(), strict=True)]
    return anchor, np.array(hashes, np.uint64), start, size, own


class RunIndex:
    """Run-length Burrows-Wheeler index of the joined texts (sign 0 after each), with text positions at the run ends."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        signs = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
        self.signs = np.zeros(len(signs) + len(texts), np.int64)
        place = np.arange(len(signs)) + np.repeat(np.arange(len(texts)), sizes)
        self.signs[place] = signs
        n = len(self.signs)
        left = np.flatnonzero(self.signs == 0)
        self.left = np.repeat(left, np.concatenate([sizes + 1])) - np.arange(n)  # signs before the next end
        packed, have = self.signs.copy(), 1
        for i in range(1, 7):
            packed = packed * 257 + np.concatenate([self.signs[i:], np.zeros(min(i, n), np.int64)])[:n]
        self.packed, have = packed, 7
        _, rank = np.unique(packed, return_inverse=True)
        while rank.max() + 1 < n and have <= int(sizes.max()) + 1:
            after = np.concatenate([rank[have:] + 1, np.zeros(min(have, n), np.int64)])[:n]
            _, rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)
            have *= 2
        self.order = np.argsort(rank, kind="stable")
        before = np.where(self.order > 0, self.signs[self.order - 1], 0)
        # a run ends where the sign before changes; text ends are runs of their own
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.run_signs = before[self.heads]
        self.head_at, self.tail_at = self.order[self.heads], self.order[self.heads - 1]  # samples: run start, end of the run before

    def common(self, a, b):
        """Length of the match of the texts at positions a and b, which ends with either text."""
        import numpy as np

        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < len(self.packed)
            live, x, y = live[inside], x[inside], y[inside]
            same = (self.packed[x] == self.packed[y]) & (out[live] < most[live])
            out[live[same]] += 7
            last = live[~same]
            for step in range(7):  # the rest sign by sign
                x, y = a[last] + out[last], b[last] + out[last]
                go = (out[last] < most[last]) & (np.maximum(x, y) < len(self.signs))
                last, x, y = last[go], x[go], y[go]
                last = last[self.signs[x] == self.signs[y]]
                out[last] += 1
            live = live[same]
        return np.minimum(out, most)

    def repeated(self, length: int):
        """Whether the string of ``length`` signs at each position also starts at another position."""
        import numpy as np

        n = len(self.signs)
        reach = np.zeros(n, np.int64)
        heads = self.heads > 0
        at = self.head_at[heads]
        reach[at] = self.common(at, self.tail_at[heads]) + at
        match = np.maximum.accumulate(reach) - np.arange(n)  # with the text before in index order
        match = np.minimum(np.maximum(match, 0), self.left)
        ordered = match[self.order] >= length
        ordered[:-1] |= ordered[1:]
        out = np.zeros(n, bool)
        out[self.order] = ordered
        return out


def stretches(flags):
    """Starts and ends of the runs of true values."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, shard_bytes: int = 1_500_000,
         crowd: int = 2000) -> DataFrame:
    """id, n_bytes, spans (removed byte ranges, maximal and in order) and kept (the remaining bytes) of each row."""
    import pyarrow as pa

    text = common.text_or_empty(text_col)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("own", pa.bool_())]))

    @F.arrow_udf(CONTEXT)
    def cut(texts: pa.Array) -> pa.Array:
        import numpy as np

        parts, ends = [], [0]
        for x in texts:
            got = contexts(x.as_py().encode("utf-8", "surrogatepass"), length)
            if got is not None:
                parts.append(got)
            ends.append(ends[-1] + (len(got[0]) if got is not None else 0))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2 + [np.empty(0, bool)]
        arrays = [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, ["anchor", "context", "start", "n", "own"])).cast(kind)

    from pyspark.sql import Window

    each = rows.select("key", F.explode(cut("text")).alias("c")).select("key", "c.*")
    same = Window.partitionBy("anchor", "context", "n")
    each = each.withColumns({"times": F.count(F.lit(1)).over(same), "rank": F.row_number().over(same.orderBy("key", "start"))})
    kinds = F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(Window.partitionBy("anchor"))
    each = each.withColumn("kinds", kinds).where("times > 1 OR kinds > 1 OR own")
    found = common.written(each.select("key", "anchor", "start", "n", (F.col("times") > 1).alias("whole"),
                                       ((F.col("rank") == 1) & ((F.col("kinds") > 1) | F.col("own"))).alias("open"),
                                       (F.col("kinds") > crowd).alias("crowded")), "contexts")
    open_bytes = found.where("open AND NOT crowded").agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, math.ceil(open_bytes / shard_bytes))

    wanted = found.where("open").groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n", "crowded")).alias("wanted"))  # bounded by the text
    keyed = rows.select("key", "id", "text")
    asked = keyed.join(wanted, "key")
    piece = lambda c: F.substring(F.encode(F.col("text"), "UTF-8"), c["start"] + 1, c["n"] + length - 1)
    plain = asked.select("key", F.explode(F.filter("wanted", lambda c: ~c["crowded"])).alias("c"), "text")
    plain = plain.select("key", F.pmod(F.xxhash64("c.anchor"), F.lit(shards)).alias("shard"), F.col("c.start").alias("start"), piece(F.col("c")).alias("bytes"))

    def mark(table: pa.Table) -> pa.Table:
        import numpy as np

        keys, start = table["key"].to_numpy(), table["start"].to_numpy()
        index = RunIndex([x.as_py() for x in table["bytes"]])
        a, b = stretches(index.repeated(length))
        of = np.searchsorted(index.starts, a, side="right") - 1
        low = start[of] + a - index.starts[of]
        return pa.table({"key": pa.array(keys[of]), "start": pa.array(low, pa.int64()), "end": pa.array(low + (b - a) + length - 1, pa.int64())})

    marks = plain.groupBy("shard").applyInArrow(mark, "key long, start long, end long")

    @F.arrow_udf("array<struct<hash: long, start: int>>")
    def windows(texts: pa.Array, asked_: pa.Array) -> pa.Array:
        import xxhash

        out = []
        for x, wanted_ in zip(texts, asked_, strict=True):
            raw, got = x.as_py().encode("utf-8", "surrogatepass"), []
            for c in wanted_.as_py():
                got += [{"hash": xxhash.xxh3_64_intdigest(raw[i : i + length]) - 2**63, "start": i} for i in range(c["start"], c["start"] + c["n"])]
            out.append(got)
        return pa.array(out, pa.list_(pa.struct([("hash", pa.int64()), ("start", pa.int32())])))

    many = asked.withColumn("wanted", F.filter("wanted", lambda c: c["crowded"])).where(F.size("wanted") > 0)
    many = many.select("key", F.explode(windows("text", "wanted")).alias("w")).select("key", "w.hash", "w.start")
    many = many.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where("times > 1")
    many = many.select("key", F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end"))

    whole = found.where("whole").select("key", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + length - 1).cast("long").alias("end"))
    spans = whole.unionByName(marks).unionByName(many).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("marks"))

    @F.arrow_udf("struct<spans: array<struct<start: long, end: long>>, kept: binary>")
    def removed(texts: pa.Array, marks_: pa.Array) -> pa.Array:
        out_spans, kept = [], []
        for x, m in zip(texts, marks_, strict=True):
            raw, merged = (x.as_py() or "").encode("utf-8", "surrogatepass"), []
            for s in m.as_py() or ():
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            cuts = [0, *(e for s in merged for e in (s["start"], s["end"])), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            out_spans.append(merged)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(out_spans, span), pa.array(kept, pa.binary())], ["spans", "kept"])

    got = keyed.join(spans, "key", "left").select("id", F.octet_length("text").cast("long").alias("n_bytes"), removed.asNondeterministic()("text", "marks").alias("r"))
    return got.select("id", "n_bytes", F.col("r.spans").alias("spans"), F.col("r.kept").alias("kept"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(common.documents(spark, sf_dir).select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
