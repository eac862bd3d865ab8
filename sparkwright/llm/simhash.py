"""Operator 12: near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A bit of a document's fingerprint is 1 if it is set in over half of the hashes of its word shingles, repeats included.
Fingerprints that differ in at most ``radius`` bits are linked.

Covering masks: every bit position has a vector of ``radius + 1`` bits that is not zero; the mask of a vector v keeps
the positions whose vector has an odd product with v. The vectors of ``radius`` positions span too little for no v to be
orthogonal to them all, so any two fingerprints within the radius agree on the whole of some mask: with radius 4 they
meet in one of 31 tables for certain. About half of the bits are kept.

Equal fingerprints are one class from the start. Classes that agree on a mask are a bucket:
1. buckets of up to ``SMALL`` classes compare all of them, at most ``SMALL`` each; in a larger one each class is
   compared with the bucket's least class;
2. components of these links. Larger buckets that still hold several are taken further: their classes get a second
   family of masks on top of the bucket's own, with the same guarantee, and so on until buckets are small. Groups that
   are one component are left alone, nothing is sampled or capped.
Every link is confirmed by the bits that differ. All of this is joins and aggregations of longs in Spark. Joins with what
masks make of the classes, and by fingerprint with the roots, are shuffled (hint ``merge``): Spark's estimate counts neither
the 31 rows of a class nor how well their files are compressed, so it would broadcast many times its threshold.

Defined results: null or empty text, or one without words, has the fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; copies and repeated rows share a component; rows with a null id take part, and a
component without any id has the id null; an empty table gives an empty table; other columns do not take part.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common
from sparkwright.llm.components import components

common.ship(__name__)

BITS = 64
SMALL = 64
#: Multiplier and step of each family of vectors: position i has 1 + (multiplier * i + step * (i // period)) % period.
FAMILIES = ((1, 0), (27, 9), (3, 14), (7, 10), (18, 23), (22, 16))


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of a family, as signed 64-bit numbers."""
    period = 2 ** (radius + 1) - 1
    by, step = FAMILIES[family]
    vectors = [1 + (by * i + step * (i // period)) % period for i in range(BITS)]
    masks = []
    for v in range(1, period + 1):
        mask = sum(1 << i for i, a in enumerate(vectors) if (v & a).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def fingerprint_of(text: str, shingle: int) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; 0 without words."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n, counts = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + 65536))]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """__id and fp (long), one row for each row of ``docs``."""
    import pyarrow as pa

    @F.arrow_udf("long")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py() or "", shingle) for x in texts], pa.int64())

    return docs.select(F.col(id_col).alias("__id"), sign(F.col(text_col).cast("string")).alias("fp"))


def near(classes: DataFrame, radius: int = 4, small: int = SMALL) -> DataFrame:
    """fp, root (the least fingerprint reachable by links) for every fingerprint that has a link; classes: distinct fp."""
    rows, roots = classes.select("fp", F.lit(0).cast("long").alias("mask"), F.col("fp").alias("root")), None
    alike = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    for depth in range(len(FAMILIES)):
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, depth)])
        rows = rows.withColumn("mask", F.explode(F.transform(masks, lambda m: m.bitwiseOR(F.col("mask")))))
        rows = rows.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        # only buckets that several components share
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("fp", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
        rows = common.written(rows.join(sizes.where("low < high").drop("low", "high").hint("merge"), "bucket"), "buckets")
        last = depth + 1 == len(FAMILIES)  # so few bits are free there that buckets are small in any case
        few = rows if last else rows.where(F.col("m") <= small)
        left, right = few.select("bucket", F.col("fp").alias("x"), F.col("root").alias("a")), few.select("bucket", F.col("fp").alias("y"), F.col("root").alias("b"))
        links = left.join(right.hint("merge"), "bucket").where((F.col("x") < F.col("y")) & (F.col("a") != F.col("b")) & alike("x", "y")).select("a", "b")
        large = rows.where(F.col("m") > small)
        if not last:
            links = links.unionByName(large.where((F.col("hub.root") != F.col("root")) & alike("fp", "hub.fp")).select(F.col("hub.root").alias("a"), F.col("root").alias("b")))
        merged = components(links)  # of the components so far
        if roots is None:
            roots = common.written(merged, "roots")
        else:
            newer = merged.select(F.col("node").alias("root"), F.col("root").alias("new"))
            joined = roots.join(newer, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            roots = common.written(joined.unionByName(merged.join(roots.hint("merge"), "node", "left_anti").select("node", "root")), "roots")
        if last or large.limit(1).count() == 0:
            return roots
        # the larger buckets that still hold several components
        large = large.select("bucket", "fp", "mask").join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
        large = large.select("bucket", "fp", "mask", F.coalesce("root", "fp").alias("root"))
        several = large.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("torn")).where("torn").select("bucket")
        rows = common.written(large.join(several, "bucket").select("fp", "mask", "root").distinct(), "torn")
        if rows.limit(1).count() == 0:
            return roots
    return roots


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, small: int = SMALL) -> DataFrame:
    """__id, fp, component (the smallest id reachable), one row for each row of ``docs``."""
    signed = common.written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = common.written(signed.groupBy("fp").agg(F.min("__id").alias("rep")), "classes")
    roots = near(classes, radius, small)
    rooted = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return signed.join(rooted.join(least, "root").select("fp", "component"), "fp").select("__id", "fp", "component")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; results of nulls, ties and repeated rows as in the module."""
    found = link(common.documents(spark, sf_dir))
    return found.select(F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
