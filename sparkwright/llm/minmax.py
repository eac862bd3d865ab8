"""Operator 3: near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Each of the permutations gives two signature values,
the least and the greatest hash, so half as many permutations are evaluated as the signature has values; both are
unbiased. Bands of ``ROWS`` values make bucket keys. With 28 bands of 6 values two sets of likeness 0.85 miss each
other in all bands with a chance of 2 in a million, two of likeness 0.8 (the pipeline's bound) with one of 2 in 10,000.

Equal sets are one class from the start, so copies cost nothing further. Within buckets:
1. buckets of up to ``SMALL`` classes compare all their classes; larger ones compare each class with about ``HUBS``
   classes of the bucket, so the comparisons grow with the classes, not with their square;
2. the confirmed links give components; of a class's links to its hubs one stays, and its hubs are linked to one another,
   which is the same for all classes of a group. In larger buckets that still hold several components, classes of different
   components are compared where they can still be alike: a prefix and position filter over their full sets (rarest
   shingles first) leaves no linked pair out and keeps apart what differs in too many rare shingles. Groups of documents
   that are all somewhat alike share their rarest shingles, too. So the join also compares one-bit signatures of
   ``SIGN`` min-max values, made for these classes alone, and makes a row only for pairs that agree in as many bits as
   linked ones do, less five standard deviations (a linked pair fails with a chance of 3 in 10 million).
Every link is confirmed on the full sets. Nothing is dropped or sampled, and no bucket's rows meet in one task as a
group: buckets are counted by aggregation and paired by joins that AQE splits.

Defined results: null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; fewer words than a shingle are one shingle; copies and repeated rows share a component; rows with a null id
take part, and a component without any id has the id null; an empty table gives an empty table; other columns do not
take part and clash with nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common
from sparkwright.llm.components import components

common.ship(__name__)

BANDS, ROWS = 28, 6
SMALL, HUBS = 8, 4
#: Bits of the signatures that torn buckets compare, in longs of 64.
SIGN = 2048
#: Classes whose texts are sought by broadcast (some 40 bytes each); a shuffled join beyond it.
MOST_BROADCAST = 100_000


def shingle_set(text: str, words_of, size: int):
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(words_of.__getitem__, words)), np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out = common.mix64(out)
    return np.unique(out)


def permutations(n: int):
    import numpy as np

    seeds = common.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n, None] | np.uint64(1), seeds[n:, None]


def band_keys(values, factors, offsets):
    """Keys of the bands of one set, from the least and the greatest value under each permutation."""
    import numpy as np

    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(values), 2048):
        hashed = (values[None, at : at + 2048] ^ offsets) * factors
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    rows = np.stack([low, high], 1).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def sign_bits(values):
    """One bit of the least and of the greatest value under each of SIGN / 2 permutations, as longs."""
    import numpy as np

    factors, offsets = permutations(SIGN // 2)
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(values), 256):
        hashed = (values[None, at : at + 256] ^ offsets) * factors
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    bits = (common.mix64(np.concatenate([low, high])) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def node_of(values) -> bytes:
    import hashlib

    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """__id, __key (of the row, by id and text), n_shingles, node (digest of the set, null if empty), bands."""
    import pyarrow as pa

    def signed(texts):
        words = common.per_process("words", common.WordHashes)
        factors, offsets = permutations(BANDS * ROWS // 2)
        n, nodes, bands = [], [], []
        for x in texts:
            values = shingle_set(x.as_py() or "", words, shingle)
            n.append(len(values))
            nodes.append(node_of(values) if len(values) else None)
            bands.append(band_keys(values, factors, offsets) if len(values) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["n", "node", "bands"])

    @F.arrow_udf("struct<n: long, node: binary, bands: array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        return common.trimmed(signed, texts)

    rows = docs.select(F.col(id_col).alias("__id"), common.row_key(id_col, text_col).alias("__key"), sign.asNondeterministic()(F.col(text_col).cast("string")).alias("s"))
    return rows.select("__id", "__key", F.col("s.n").alias("n_shingles"), F.col("s.node").alias("node"), F.col("s.bands").alias("bands"))


def set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, items (the sorted set as bytes) for the wanted classes; wanted: node and the id of one of its rows."""
    import pyarrow as pa

    def made(texts):
        words = common.per_process("words", common.WordHashes)
        values = [shingle_set(x.as_py() or "", words, shingle) for x in texts]
        return pa.StructArray.from_arrays([pa.array([node_of(v) for v in values], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], ["node", "items"])

    @F.arrow_udf("struct<node: binary, items: binary>")
    def sets(texts: pa.Array) -> pa.Array:
        return common.trimmed(made, texts)

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t"))
    wanted = common.written(wanted, "wanted")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = rows.join(wanted, rows["__id"].eqNullSafe(wanted["rep"])).select("node", sets.asNondeterministic()("t").alias("s"))
    # a repeated id brings rows of other classes, which are left out here
    rows = rows.where(F.col("node") == F.col("s.node")).select("node", F.col("s.items").alias("items"))
    return common.written(rows.dropDuplicates(["node"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    import pyarrow as pa

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                out.append(False)
                continue
            at = np.searchsorted(a, b)
            both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("left_items")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right_items")), "b")
    return pairs.where(alike(F.col("left_items"), F.col("right_items"))).select("a", "b")


def bundled(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the components of these: of each a, one to its least b, and one from there to each other b.

    Classes of one group share their hubs, so the links between hubs come once for all of them. Only the b of one a meet,
    the hubs of a class, which the buckets of a class bound."""
    of = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("hubs"))
    ends = F.concat(F.array("a"), F.expr("slice(hubs, 2, size(hubs))"))
    return of.select(F.explode(ends).alias("a"), F.col("hubs")[0].alias("b")).distinct()


def prefix_pairs(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components (nodes: node, root) that a prefix and position filter and the bits of
    their signatures let through."""
    import math

    import pyarrow as pa

    @F.arrow_udf("struct<items: array<long>, bits: array<long>>")
    def unpacked(x: pa.Array) -> pa.Array:
        import numpy as np

        sets = [np.frombuffer(y.as_buffer(), np.uint64) for y in x]
        return pa.StructArray.from_arrays([pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64())), pa.array([sign_bits(v) for v in sets], pa.list_(pa.int64()))], ["items", "bits"])

    known = sets.join(nodes, "node").select("node", "root", unpacked(F.col("items")).alias("u"))
    known = common.written(known.select("node", "root", F.col("u.items").alias("items"), F.col("u.bits").alias("bits")), "torn_sets")
    rows = known.select("node", "root", F.explode("items").alias("item"))
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    # a set's shingles, rarest first: bounded by its document
    ranked = rows.join(often, "item").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("order"))
    n = F.size("order")
    first = n - F.ceil(n * percent / F.lit(100)) + 1
    tokens = ranked.select("node", "root", n.alias("n"), F.posexplode(F.expr("slice(order, 1, size(order))")).alias("at", "x"), first.alias("first"))
    tokens = tokens.where("at < first AND x.often > 1").select("node", "root", "n", "at", F.col("x.item").alias("item"))
    tokens = common.written(tokens.join(known.select("node", "bits"), "node"), "prefixes")
    # the smaller set of a pair shares at least 2 * percent / (100 + percent) of its own shingles, so a shorter prefix of it will do
    short = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)) + 1
    a, b = tokens.where(F.col("at") < short).alias("a"), tokens.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    # what can still be shared from here on must reach percent / (100 + percent) of both sizes
    can = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1
    # bits of a pair of likeness s agree with a chance of (1 + s) / 2
    chance = (1 + percent / 100) / 2
    most = SIGN - math.floor(SIGN * chance - 5 * math.sqrt(SIGN * chance * (1 - chance)))
    differ = F.lit(0)
    for i in range(SIGN // 64):
        differ = differ + F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i]))
    return (a.join(b, (F.col("a.item") == F.col("b.item")) & smaller & (F.col("a.root") != F.col("b.root"))
                   & ((can + F.least("a.at", "b.at")) * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent) & (differ <= most))
            .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5) -> DataFrame:
    """__id, __key, n_shingles, node, root and component (the smallest id reachable), one row for each row of ``docs``.

    ``root`` tells components apart even where ids repeat; node and root are null for an empty set."""
    signed = common.written(signatures(docs, id_col, text_col, shingle), "signatures")
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("__id").alias("rep"), F.first("bands").alias("bands"))
    classes = common.written(classes, "classes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = common.written(entries.join(sizes, "bucket"), "buckets")  # only buckets that classes share

    # a hash of class and bucket picks about HUBS of a larger bucket, and always the one of the least hash
    entries = entries.withColumn("mark", F.xxhash64("node", "bucket"))
    large = entries.where(F.col("m") > SMALL)
    least = large.groupBy("bucket").agg(F.min("mark").alias("least"))
    chosen = (F.pmod("mark", F.lit(1_000_003)) * F.col("m") < HUBS * 1_000_003) | (F.col("mark") == F.col("least"))
    hubs = large.join(least, "bucket").where(chosen).select("bucket", F.col("node").alias("hub"))
    few = entries.where(F.col("m") <= SMALL).select("bucket", F.col("node").alias("hub"))
    pairs = entries.select("bucket", "node").join(hubs.unionByName(few), "bucket").where("node <> hub")
    # a pair once, b being the hub: a class has the hubs of its buckets alone, a hub any number of classes
    pairs = pairs.groupBy(F.least("node", "hub").alias("low"), F.greatest("node", "hub").alias("high")).agg(F.min(F.col("node") < F.col("hub")).alias("up"))
    pairs = pairs.select(F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("up"), F.col("high")).otherwise(F.col("low")).alias("b"))
    pairs = common.written(pairs, "pairs")
    wanted = entries.select("node").distinct().join(classes.select("node", "rep"), "node")
    sets = set_table(docs, wanted, id_col, text_col, shingle)
    links = common.written(bundled(confirm(pairs, sets, percent)), "links")
    roots = components(links)

    # larger buckets with more than one component
    placed = large.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    torn = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = common.written(placed.join(torn, "bucket").select("node", "root").distinct(), "torn")
    more = confirm(prefix_pairs(sets, rest, percent), sets, percent)
    roots = common.written(components(links.unionByName(more)), "components")

    rooted = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    of_node = rooted.join(smallest, "root").select("node", "root", "component")
    found = signed.drop("bands").join(of_node, "node", "left")
    return found.select("__id", "__key", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component")).alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of the smallest id (a null id is the largest; of equal ids the one of the least
    key); columns as in ``docs``. A document without words is its own component; a repeated row stays once."""
    found = link(docs, id_col, text_col, **options)
    chosen = found.groupBy(F.coalesce("root", F.col("__key").cast("binary"))).agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key"))).alias("least"))
    kept = chosen.select(F.col("least.__key").alias("__key"))
    # the join and the removal of repeated rows share one shuffle of the texts
    return docs.withColumn("__key", common.row_key(id_col, text_col)).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of ``documents``; results of nulls, ties and repeated rows as in the module."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return link(docs).select(
        F.col("__id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("__id").eqNullSafe(F.col("component")).alias("kept"))
