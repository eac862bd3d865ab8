"""Operator 11: Merkle manifest of a dataset, its trees kept in van Emde Boas layout.

Every row is a leaf: the SHA-256 of its columns, each as byte count, ``:`` and value, or ``-`` for null. The leaves of
a group (a source) in the order of their ids are the base of a tree of ``WIDTH`` children a node; the groups' roots, in
the order of their names, are the base of one more tree, whose root stands for the dataset.

A tree is kept as aligned blocks of ``HEIGHT`` levels above their base, one row each. The roots of a stage's blocks are
the base of the next stage, until one is left. Within a block the nodes lie in van Emde Boas order: the upper half of
the levels first, then the subtrees below it one after the other, each laid out alike. ``address`` gives the place of a
node by arithmetic alone; it serves the construction and the retrieval of siblings.

Plan: the leaves (hashes, no texts) are dealt by ranges of (group, id, hash) and numbered within the group by the range's
first place; blocks of at most ``WIDTH ** HEIGHT`` leaves are built and proved in groups of their own, so a group
that holds most rows is many tasks. The driver sees the number of stages and the dataset's root alone.

Defined results: a null id comes before all others and is never tampered with by the query; rows of equal ids are put
in the order of their leaves, repeated rows are leaves of their own with equal hashes; a null group is a group of its
own before all others; null and empty texts are leaves like any other (``-`` and ``0:``); an empty table has no rows
and the root null; other columns, whatever their names, are not hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkwright.llm import common

common.ship(__name__)

WIDTH = 16
#: Levels above a block's base: 16 ** 3 leaves and 140 KB a block.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left: string, right: string>>"


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (WIDTH**levels - 1) // (WIDTH - 1)


def address(depth: int, index, levels: int):
    """Place in van Emde Boas order of the nodes ``index`` (an array) at ``depth`` below the root, of a tree of ``levels``."""
    if levels == 1:
        return index * 0
    top = levels // 2
    bottom = levels - top
    if depth < top:
        return address(depth, index, top)
    below = depth - top
    inside = WIDTH**below
    return size(top) + index // inside * size(bottom) + address(below, index % inside, bottom)


def height_of(total: int, height: int) -> int:
    """Levels above the base of a block of a stage with ``total`` nodes: fewer if one block holds the whole stage."""
    h = 0
    while h < height and WIDTH**h < total:
        h += 1
    return h


def build_block(base: list[bytes], height: int):
    """Nodes of a block in layout order, cut after the last node there is, and the block's root."""
    import hashlib

    import numpy as np

    levels = height + 1
    nodes = np.zeros((size(levels), 32), np.uint8)
    row, last = np.frombuffer(b"".join(base), np.uint8).reshape(-1, 32), 0
    for depth in range(height, -1, -1):
        at = address(depth, np.arange(len(row)), levels)
        nodes[at] = row
        last = max(last, int(at.max()))
        if depth:
            text = row.tobytes().hex().encode()
            step = 64 * WIDTH
            row = np.frombuffer(b"".join(hashlib.sha256(text[i : i + step]).digest() for i in range(0, len(text), step)), np.uint8).reshape(-1, 32)
    return nodes[: last + 1].tobytes(), row.tobytes()


def level_texts(nodes: bytes, height: int, width: int) -> list[str]:
    """The hex text of each level of a block below its root, the base first, fetched by address arithmetic."""
    import numpy as np

    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    out = []
    for depth in range(height, 0, -1):
        out.append(table[address(depth, np.arange(width), height + 1)].tobytes().hex())
        width = -(-width // WIDTH)
    return out


def siblings(levels: list[str], index: int) -> list[tuple[str, str]]:
    """Hex texts left and right of a base node within its run, level by level."""
    out = []
    for text in levels:
        run = index // WIDTH * WIDTH * 64
        at = index * 64
        out.append((text[run:at], text[at + 64 : run + WIDTH * 64]))
        index //= WIDTH
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    import hashlib

    for left, right in path:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def leaf(columns: list[Column]) -> Column:
    """32 bytes: the SHA-256 of the columns, each ``-`` if null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def place(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column tree) with pos, the place from 0 within the tree in ``order``, and total, the tree's rows.

    Rows are dealt by ranges; equal rows may be dealt apart, any order of them is the same. Places are counted over
    the written rows, so a task that runs again counts as before.
    """
    rows = rows.withColumn("__spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    dealt = rows.repartitionByRange("tree", *order, "__spread").sortWithinPartitions("tree", *order).drop("__spread")
    dealt = common.written(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    parts = dealt.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("tree").alias("__tree"), F.col("__part").alias("__of"), (before - F.col("__first")).alias("__shift"),
                         F.sum("__n").over(tree).alias("total"))
    placed = dealt.join(parts, (F.col("tree") == F.col("__tree")) & (F.col("__part") == F.col("__of")))
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__tree", "__of", "__shift")


def build(rows: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The stages of blocks (tree, block, total, height, width, nodes, digest) over rows (tree, pos, total, digest).

    ``total`` is the number of the stage's nodes in the tree. A tree's last stage is the one where one block holds all.
    """
    cap = WIDTH**height

    def block(table):
        import pyarrow as pa

        table = table.sort_by("pos")
        total = table["total"][0].as_py()
        h = height_of(total, height)
        nodes, root = build_block(table["digest"].to_pylist(), h)
        return pa.table({"tree": table["tree"][:1], "block": table["block"][:1], "total": table["total"][:1], "height": pa.array([h], pa.int32()),
                         "width": pa.array([table.num_rows], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "digest": pa.array([root], pa.binary())})

    stages = []
    while True:
        grouped = rows.select("tree", F.expr(f"pos div {cap}").alias("block"), "pos", "total", "digest").groupBy("tree", "block")
        blocks = common.written(grouped.applyInArrow(block, "tree string, block long, total long, height int, width int, nodes binary, digest binary"), "blocks")
        stages.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= cap:
            return stages
        rows = blocks.where(F.col("total") > cap).select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / F.lit(cap)).alias("total"), "digest")


def finished(stages: list[DataFrame], height: int) -> DataFrame:
    """tree, stage, digest: the root of each tree and the stage of its last block."""
    cap = WIDTH**height
    out = [s.where(F.col("total") <= cap).select("tree", F.lit(i).alias("stage"), "digest") for i, s in enumerate(stages)]
    roots = out[0]
    for more in out[1:]:
        roots = roots.unionByName(more)
    return roots


def base_paths(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """tree, pos, path for every base node of ``blocks``; ``above`` has the path (tree, pos, path) above each block."""
    cap = WIDTH**height

    def expand(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                levels, rest = level_texts(r["nodes"], r["height"], r["width"]), [(x["left"], x["right"]) for x in r["path"]]
                for at in range(0, r["width"], 256):
                    index = range(at, min(at + 256, r["width"]))
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([r["tree"]] * len(index), pa.string()), "pos": pa.array([r["block"] * cap + i for i in index], pa.int64()),
                        "path": pa.array([[{"left": x, "right": y} for x, y in siblings(levels, i) + rest] for i in index], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    joined = blocks.select("tree", F.col("block").alias("pos"), "block", "height", "width", "nodes").join(above, ["tree", "pos"])
    return joined.select("tree", "block", "height", "width", "nodes", "path").mapInArrow(expand, f"tree string, pos long, path {PATH}")


def above_blocks(stages: list[DataFrame], tops: DataFrame, height: int, stage: int = 0) -> DataFrame:
    """tree, pos, path above each block of a stage; tops: tree, stage, path, what stands above each tree."""
    own = tops.where(F.col("stage") == stage).select("tree", F.lit(0).cast("long").alias("pos"), "path")
    if stage + 1 == len(stages):
        return own
    return own.unionByName(base_paths(stages[stage + 1], above_blocks(stages, tops, height, stage + 1), height))


@dataclass
class Manifest:
    """The trees of a dataset: ``leaves`` (tree, pos, total, digest and the columns kept), the stored blocks of the
    groups' trees by stage, and of the tree over the groups (``groups``: tree, pos, subroot); the dataset's root in hex."""

    leaves: DataFrame
    stages: list[DataFrame]
    groups: DataFrame
    group_stages: list[DataFrame]
    root: str | None
    height: int


def manifest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """Trees over rows (tree, digest, the ``order`` columns and any to be kept)."""
    rows = common.written(rows, "hashed")  # finding the ranges and dealing by them read the hashes, not the texts
    leaves = common.written(place(rows, [*order, "digest"]), "leaves")
    stages = build(leaves.select("tree", "pos", "total", "digest"), height)
    roots = finished(stages, height)
    groups = place(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "stage", "digest"), ["group"])
    groups = common.written(groups, "groups")
    group_stages = build(groups.select("tree", "pos", "total", "digest"), height)
    top = finished(group_stages, height).first()
    return Manifest(leaves, stages, groups, group_stages, bytes(top["digest"]).hex() if top else None, height)


def prove(found: Manifest, claimed: str = "digest") -> DataFrame:
    """The leaves' kept columns with leaf, subroot, root, proof_sha256 (of the siblings) and folded_root, the root that
    the hash in ``claimed`` gives with the siblings of the untampered trees."""
    none = F.array().cast(PATH)
    tops = finished(found.group_stages, found.height).select("tree", "stage", none.alias("path"))
    # the tree over the groups: the path above each group's own root
    of_group = base_paths(found.group_stages[0], above_blocks(found.group_stages, tops, found.height), found.height)
    groups = found.groups.select("pos", "group", "stage", F.col("digest").alias("subroot"))
    groups = common.written(groups.join(of_group.select("pos", "path"), "pos").select(F.col("group").alias("tree"), "stage", "path", "subroot"), "groups")
    blocks = found.stages[0].select("tree", F.col("block").alias("pos"), "height", "width", "nodes")
    blocks = blocks.join(above_blocks(found.stages, groups, found.height), ["tree", "pos"]).join(groups.select("tree", "subroot"), "tree")
    blocks = common.written(blocks.withColumnRenamed("pos", "block"), "proofs")

    kept = [c for c in found.leaves.columns if c not in ("tree", "pos", "total", "digest", claimed)]
    cap = WIDTH**found.height
    rows = found.leaves.select(F.col("tree"), F.expr(f"pos div {cap}").alias("block"), "pos", "digest", F.col(claimed).alias("__claimed"), *kept)
    types = {f.name: f.dataType for f in found.leaves.schema}
    out = T.StructType([T.StructField(c, types[c]) for c in kept] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")])

    def prove_block(left, right):
        import hashlib

        import pyarrow as pa

        b = right.to_pylist()[0]
        levels, rest = level_texts(b["nodes"], b["height"], b["width"]), [(x["left"], x["right"]) for x in b["path"]]
        tail = "".join(x + y for x, y in rest)
        proofs, folded = [], []
        for pos, digest in zip(left["pos"].to_pylist(), left["__claimed"].to_pylist(), strict=True):
            path = siblings(levels, pos % cap)
            proofs.append(hashlib.sha256(("".join(x + y for x, y in path) + tail).encode()).hexdigest())
            folded.append(fold(digest.hex(), path + rest))
        n = left.num_rows
        columns = {c: left[c] for c in kept}
        columns |= {"leaf": pa.array([x.hex() for x in left["digest"].to_pylist()], pa.string()), "subroot": pa.array([b["subroot"].hex()] * n, pa.string()),
                    "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())}
        return pa.table(columns)

    proved = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove_block, out)
    return proved.withColumn("root", F.lit(found.root).cast("string"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and tampered (the leaf with its text's A-Z lower-cased, null where nothing is tampered)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    plain = [F.col(c) for c in COLUMNS]
    changed = [lower if c == "text" else F.col(c) for c in COLUMNS]
    # "=" before a name keeps the order and leaves "" to null
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf(plain).alias("digest"), F.when(chosen, leaf(changed)).alias("tampered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and verification of every row of ``documents`` after the contract's tampering.

    Results of nulls, ties, repeated rows and an empty table are those of the module.
    """
    rows = document_leaves(common.documents(spark, sf_dir)).withColumn("tampered", F.coalesce("tampered", "digest"))
    proved = prove(manifest(rows, ["doc_id"]), "tampered")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _piece(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _hash(text: str) -> str:
    return "sha256(" + " || ".join(_piece(text if c == "text" else c) for c in COLUMNS) + ")"


# crc32 of the id's characters, bit by bit: eight steps for a character, the first of which takes it in
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"""

SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_hash('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_hash("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_hash('text')} END AS claimed
  FROM documents),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER () AS id FROM base),
lv AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM rows
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subs AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
nodes AS (
  SELECT tree, level, pos, h FROM lv WHERE n > 1
  UNION ALL
  SELECT NULL, level, pos, h FROM top WHERE n > 1),
sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY ALL),
folds AS (
  SELECT r.id, r.tree AS src, r.tree AS tree, 0 AS level, r.pos, r.claimed AS h, '' AS proof FROM rows r
  UNION ALL
  SELECT f.id, f.src, CASE WHEN s.height = f.level AND f.tree IS NOT NULL THEN NULL ELSE f.tree END,
    CASE WHEN s.height = f.level AND f.tree IS NOT NULL THEN 0 ELSE f.level + 1 END,
    CASE WHEN s.height = f.level AND f.tree IS NOT NULL THEN s.pos ELSE f.pos // 16 END,
    CASE WHEN s.height = f.level AND f.tree IS NOT NULL THEN f.h ELSE sha256(d.l || f.h || d.r) END,
    CASE WHEN s.height = f.level AND f.tree IS NOT NULL THEN f.proof ELSE f.proof || d.l || d.r END
  FROM folds f JOIN subs s ON f.src = s.tree
  LEFT JOIN sides d ON f.tree IS NOT DISTINCT FROM d.tree AND f.level = d.level AND f.pos = d.pos
  WHERE f.tree IS NOT NULL OR f.level < (SELECT max(level) FROM top)),
done AS (SELECT id, h, proof FROM folds WHERE tree IS NULL AND level = (SELECT max(level) FROM top))
SELECT r.doc_id, r.leaf, s.subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = t.h AS verified
FROM rows r JOIN subs s USING (tree) JOIN done d USING (id) JOIN top t ON t.n = 1
"""
