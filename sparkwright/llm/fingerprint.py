"""Operator 5: document fingerprints by order min-hash, in DataFrame functions only.

A text's k-mers are its runs of ``K`` words (the last ones padded), each numbered by its occurrence in the text. Under
each of ``FUNCTIONS`` hash functions the ``TUPLE`` k-mer occurrences of the least hashes are selected, put into text
order and hashed as a tuple. The signature is the list of these hashes; the share of equal places estimates a likeness
that falls with every edit and with every exchange of order.

Only occurrences whose hash is among the least ``REACH / n`` of the hash range are carried into the selection (n: the
text's k-mers; all of them if n <= REACH). That is part of the definition: where a function has fewer than ``TUPLE`` of
them, which for long texts happens once in some 300 functions, its tuple holds what there is (eight zeros if nothing).

Plan. Rows are dealt once, by ranges of the id of about ``bucket_bytes`` of text; every bucket also gets a copy of the
row that follows its last one. All windows and aggregations then work within buckets, so the texts are shuffled once
and nothing else needs a shuffle.

Defined results: null or empty text counts as one empty word; a null id comes after all others in descending order;
rows of equal ids follow each other by text hash, then text; the last row is followed by the first, a single row by
itself; repeated rows have equal fingerprints; an empty table gives an empty table; other columns are not read.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.llm import common

K, TUPLE, FUNCTIONS, REACH = 2, 2, 48, 8
#: Ranges of the id; their bounds are one literal. Beyond it buckets grow, and their sorts spill.
MOST_BUCKETS = 100_000
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+")


def signatures(texts: DataFrame, group: list[str]) -> DataFrame:
    """group, signature (array of FUNCTIONS strings) of each row; texts: group columns (the first one deals them) and text."""
    texts = texts.select(*group, words(F.col("text")).alias("w"))
    w = F.col("w")
    padded = [F.slice(w, i + 1, F.size(w)) if i else w for i in range(K)]
    kmers = texts.select(*group, F.size(w).alias("n"), F.posexplode(F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(padded)])).alias("at", "kmer"))
    # narrow rows: n and at share a column
    both = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    kmers = kmers.select(*group, both.alias("n_at"), F.xxhash64(*[F.col(f"kmer.w{i}") for i in range(K)]).alias("kmer"))
    number = F.row_number().over(Window.partitionBy(*group, "kmer").orderBy("n_at"))
    kmers = kmers.select(*group, "n_at", F.xxhash64("kmer", number).alias("what"))
    limit = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(REACH)) / F.shiftright("n_at", 32))
    values = [F.xxhash64(F.col("what"), F.lit(j)) for j in range(FUNCTIONS)]
    near = kmers.withColumn("limit", limit).where(F.least(*values).cast("double") <= F.col("limit"))
    each = near.select(*group, F.col("n_at").bitwiseAND(0x7FFFFFFF).alias("at"), "what", "limit", F.posexplode(F.array(*values)).alias("j", "value"))
    each = each.where(F.col("value").cast("double") <= F.col("limit")).drop("limit")
    rank = F.row_number().over(Window.partitionBy(*group, "j").orderBy("value", "at"))
    least = each.withColumn("rank", rank).where(F.col("rank") <= TUPLE)
    tuples = least.groupBy(*group, "j").agg(F.min_by("what", "at").alias("first"), F.max_by("what", "at").alias("last"), F.count(F.lit(1)).alias("m"))
    code = F.lower(F.lpad(F.hex(F.xxhash64("first", "last", "m").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    sparse = tuples.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("j", code))).alias("of"))
    return sparse.select(*group, F.transform(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)), lambda j: F.coalesce(F.col("of")[j], F.lit("0" * 8))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(FUNCTIONS))


def cuts_below(cuts: Column, n: int, value: Column) -> Column:
    """How many of the n sorted cuts are below the value, by bisection."""
    def halve(state, _):
        middle = F.shiftright(state["low"] + state["high"], 1)
        below = (state["low"] < state["high"]) & (F.get(cuts, middle) < value)
        return F.struct(F.when(below, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(below | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda s: s["low"])


def in_ranges(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """bucket, copy (0, or 1 for a row that also stands after another bucket's last), id, mark, text."""
    rows = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    n = max(1, min(MOST_BUCKETS, math.ceil(size / bucket_bytes)))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n).alias("c")).first().c if n > 1 else None
    cuts = sorted(set(cuts or []))  # as many as buckets
    bucket = cuts_below(F.lit(cuts), len(cuts), F.col("id")) if cuts else F.lit(0)
    # a null id: before the bucket of the least ids
    rows = rows.withColumns({"bucket": F.coalesce(F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bucket), F.lit(0)), "mark": F.xxhash64("text")})
    tops = sorted(rows.groupBy("bucket").agg(F.max(F.struct("id", "mark")).alias("top")).collect())  # one row a bucket
    edges = [(tops[k].top.id, tops[k].top.mark, tops[(k + 1) % len(tops)].bucket) for k in range(len(tops))]
    if not edges:
        return rows.withColumn("copy", F.lit(0))
    kind = dict(rows.dtypes)["id"]
    first = docs.sparkSession.createDataFrame(edges, f"__id {kind}, __mark long, __after int")
    hits = rows.join(F.broadcast(first), rows["id"].eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    copies = hits.select("id", "text", F.col("__after").alias("bucket"), "mark").dropDuplicates(["bucket"]).withColumn("copy", F.lit(1))
    copies = common.written(copies, "next_rows")  # one row a bucket
    # as many partitions as buckets, so that sorts of the k-mers stay small
    return rows.withColumn("copy", F.lit(0)).unionByName(copies).repartition(n, "bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 2_000_000,
                 keep: dict[str, Column] | None = None) -> DataFrame:
    """id, fingerprint and edited_fingerprint (hex), near_edited, near_next of each row, and the columns of ``keep``:
    expressions over text and edited (by default the edited text)."""
    rows = in_ranges(docs, id_col, text_col, bucket_bytes)
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("id"), F.desc("mark"), "text")
    rows = rows.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("copy") == 0, edited))
    both = rows.select("bucket", "place", F.posexplode(F.array("text", "edited")).alias("edit", "text")).where("text IS NOT NULL")
    signed = signatures(both, ["bucket", "place", "edit"])
    pick = lambda k: F.max(F.when(F.col("edit") == k, F.col("signature")))
    signed = signed.groupBy("bucket", "place").agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"))
    follows = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    signed = signed.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
                                 "near_next": likeness(F.col("fingerprint"), follows)})
    packed = ("fingerprint", "edited_fingerprint")
    signed = signed.withColumns({c: F.unhex(F.array_join(c, "")) for c in packed})
    own = rows.where("copy = 0").select("bucket", "place", "id", *[c.alias(n) for n, c in (keep or {"edited": F.col("edited")}).items()])
    got = own.join(signed, ["bucket", "place"]).drop("bucket", "place")
    return got.withColumns({c: F.lower(F.hex(c)) for c in packed})


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints(common.documents(spark, sf_dir).select("doc_id", "text"), keep={
        "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    return got.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
