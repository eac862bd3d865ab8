"""Operator 4: quality classifier, an interpolated modified Kneser-Ney character trigram model of trusted text.

Training. All trusted rows (quality 1, not toxic) count, with their whole texts: a bitmap of hashed ids, of a fixed size,
keeps most other documents out of the shuffle in which documents and trusted ids are joined. (A caller may ask for a
sample instead: ``sample_labels`` labelled rows, dealt evenly to the languages and chosen by a hash of the id.)
Spark counts n-grams per model, and joins between the count tables, dealt by context, give the adjusted counts, the
discounts (one, two, three or more), the back-off masses and the interpolated probabilities. Models are numbered: 0 is
that of all trusted text, the others are the languages with at least ``least_docs`` trusted documents. An n-gram is one
number of 21 bits a character, so no alphabet is cut; all characters that a model hasn't seen share one more sign.

Scoring. The documents are dealt in blocks of ``BLOCK`` rows. The distinct n-grams that a block asks for are joined to the
tables of probabilities and masses, dealt by n-gram, and the answers go back to the block, where each document's
counts give its perplexity per character. No task holds a model, only its block's answers; texts are shuffled once,
compressed by runs of rows.
Short texts say little, so the decision uses the perplexity after adding ``prior_chars`` characters at the language's
median. A document is kept unless that exceeds its language's threshold: the ``quantile`` of the held-out trusted
documents (a fifth of them, not trained on).

Defined results: null or empty text has the end sign alone and is kept or not like any other; a null language and an
empty one are languages of their own, and have a model, a median and a threshold like any other if they have enough
trusted documents, else those of all text; without trusted rows everything is kept and perplexity is null; repeated rows
get equal results; labels of unknown documents have no effect, repeated labels count once; an empty table gives an empty
table; columns with an output's name are replaced, other columns are kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import common

common.ship(__name__)

#: Bits of a character in an n-gram's number: its code point and one, 0 for the text's edges.
BITS = 21
SIGN, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Documents of a block.
BLOCK = 4096
#: Bits of the bitmap of trusted ids (4 MB).
MARKS = 1 << 25


def language(column: str):
    """Name of a row's language, the same for training, scoring and thresholds: a null is none of the texts."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def even_quota(sizes: list[int], total: int) -> float:
    """The number that, taken from each size or the size if less, adds up to ``total``; at least the largest if all fit."""
    for i, n in enumerate(sorted(sizes)):
        quota = total / (len(sizes) - i)
        if n > quota:
            return quota
        total -= n
    return max(sizes, default=0)


def trusted_ids(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()


def is_held():
    """A fifth of the trusted documents, by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit("held"), F.col("__id").cast("string")), F.lit(5)) == 0


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text, held of all trusted documents; not written, as the rows are filtered before they are shuffled."""
    good = common.written(trusted_ids(labels, id_col), "trusted_ids")
    docs = docs.select(F.col(id_col).alias("__id"), common.text_or_empty(text_col).alias("text"), language(lang_col).alias("lang"))
    if docs.schema["__id"].dataType == good.schema["__id"].dataType:  # else equal ids may have other hashes
        mark = F.pmod(F.xxhash64("__id"), F.lit(MARKS)) + 1
        marks = good.groupBy(F.bitmap_bucket_number(mark).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("__bits"))
        marks = F.broadcast(common.written(marks, "marks"))  # MARKS bits
        at = F.bitmap_bit_position(mark)
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        docs = docs.join(marks, F.bitmap_bucket_number(mark) == F.col("__part")).where(F.getbit(byte, at % 8) == 1).drop("__part", "__bits")
    # ids are distinct; a semi join would be pushed below the bitmap's, and shuffle every text
    return docs.join(good.hint("merge"), "__id").select("lang", "text", is_held().alias("held"))


def trusted_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, sample_labels: int) -> DataFrame:
    """lang, text, held of the trusted documents of a sample."""
    good = trusted_ids(labels, id_col)
    docs = docs.select(F.col(id_col).alias("__id"), common.text_or_empty(text_col).alias("text"), language(lang_col).alias("lang"))
    told = common.written(docs.select("__id", "lang").join(good, "__id").distinct(), "labelled")
    each = {r.lang: r["count"] for r in told.groupBy("lang").count().collect()}  # one row a language
    quota = even_quota(list(each.values()), sample_labels)
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, quota / n) * 1_000_000)) for k, n in each.items()], "lang string, share long")
    chosen = told.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), F.col("__id").cast("string")), F.lit(1_000_000)) < F.col("share")).select("__id", "lang")
    # the sample is bounded, so it goes to the documents rather than the documents to it
    rows = docs.join(F.broadcast(chosen), ["__id", "lang"]).select(
        "lang", "text", is_held().alias("held"))
    return common.written(rows, "trusted")


def grams_of(text: str):
    """Numbers of a text's trigrams, with two edges before it and one after, and how often each occurs."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    s = np.concatenate([np.zeros(2, np.int64), points, np.zeros(1, np.int64)])
    return np.unique((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:], return_counts=True)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """model, gram, n over the texts of rows (model, text)."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        common.release()
        def summed(model, held):
            grams, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(grams), model, np.int32)), "gram": pa.array(grams), "n": pa.array(n)})

        held, many = {}, 0
        for batch in batches:
            for model, text in zip(batch.column("model").to_pylist(), batch.column("text"), strict=True):
                found = grams_of(text.as_py())
                held.setdefault(model, []).append(found)
                many += len(found[0])
                if many > 400_000:
                    yield from (summed(m, h) for m, h in held.items())
                    held, many = {}, 0
        yield from (summed(m, h) for m, h in held.items())

    return rows.select("model", "text").mapInArrow(common.tidy(counted), "model int, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """Per model the discounts of counts 1, 2 and 3 or more (modified Kneser-Ney), from the counts of counts."""
    seen = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    part = lambda k: F.coalesce(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)), F.lit(0.5 * k))
    bound = lambda k: F.greatest(F.lit(0.1), F.least(part(k), F.lit(k - 0.05)))
    found = counts.groupBy("model").agg(*seen)
    return found.withColumn("n1", F.greatest("n1", F.lit(1))).select("model", *[bound(k).alias(f"d{k}") for k in (1, 2, 3)])


def interpolated(counts: DataFrame, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(model, gram, p) and (model, context, mass): (n - D(n)) / n(context) + back-off mass * p of the lower order.

    ``counts``: model, gram, n. ``lower``: model, gram, p of the grams one character shorter; None for single
    characters, whose mass is spread over the characters seen and one that stands for all others.
    """
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = counts.withColumn("context", F.shiftright("gram", BITS))
    cut = counts.join(F.broadcast(discounts(counts)), "model").withColumn("cut", F.least(cut, F.col("n").cast("double")))  # one row a model
    mass = cut.groupBy("model", "context").agg(F.sum("n").alias("all"), (F.sum("cut") / F.sum("n")).alias("mass"), F.count(F.lit(1)).alias("kinds"))
    rows = cut.join(mass, ["model", "context"])
    own = (F.col("n") - F.col("cut")) / F.col("all")
    if lower is None:
        p = rows.select("model", "gram", (own + F.col("mass") / (F.col("kinds") + 1)).alias("p"))
        return p, mass.select("model", "context", (F.col("mass") / (F.col("kinds") + 1)).alias("mass"))
    lower = lower.select("model", F.col("gram").alias("low"), F.col("p").alias("low_p"))
    rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(PAIR)) if "wide" in counts.columns else F.col("gram").bitwiseAND(F.lit(SIGN)))
    p = rows.join(lower, ["model", "low"]).select("model", "gram", (own + F.col("mass") * F.col("low_p")).alias("p"))
    return p, mass.select("model", "context", "mass")


class Tables:
    """Probabilities of the grams seen, by order, and the masses of their contexts; all written under the shared folder."""

    def __init__(self, rows: DataFrame):
        three = common.written(count_trigrams(rows), "trigrams")
        two = three.groupBy("model", F.col("gram").bitwiseAND(F.lit(PAIR)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))  # in how many contexts
        one = two.groupBy("model", F.col("gram").bitwiseAND(F.lit(SIGN)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        save = lambda pair, label: [common.written(x, label) for x in pair]
        self.p1, self.base = save(interpolated(one, None), "single")
        self.p2, self.mass2 = save(interpolated(two, self.p1), "pairs")
        self.p3, self.mass3 = save(interpolated(three.withColumn("wide", F.lit(True)), self.p2), "triples")

    def answers(self, asked: DataFrame) -> DataFrame:
        """model, gram, logp for the distinct (model, gram) of ``asked``: the longest gram seen, by the masses above it."""
        found = asked.select("model", "gram").distinct()
        found = found.withColumns({"c3": F.shiftright("gram", BITS), "g2": F.col("gram").bitwiseAND(F.lit(PAIR)), "g1": F.col("gram").bitwiseAND(F.lit(SIGN))})
        found = found.withColumn("c2", F.shiftright("g2", BITS))
        for table, key, value, name in ((self.p3, "gram", "p", "p3"), (self.mass3, "c3", "mass", "m3"), (self.p2, "g2", "p", "p2"),
                                        (self.mass2, "c2", "mass", "m2"), (self.p1, "g1", "p", "p1")):
            table = table.select("model", F.col("gram" if value == "p" else "context").alias(key), F.col(value).alias(name))
            found = found.join(table, ["model", key], "left")
        found = found.join(F.broadcast(self.base.select("model", F.col("mass").alias("base"))), "model")  # one row a model
        one = F.lit(1.0)
        p = F.coalesce("p3", F.coalesce("m3", one) * F.coalesce("p2", F.coalesce("m2", one) * F.coalesce("p1", "base")))
        return found.select("model", "gram", F.log(p).alias("logp"))


def score(rows: DataFrame, tables: Tables, text: str) -> DataFrame:
    """rows (with __model) with __nll (negative natural log probability) and __n (characters and the end) of the texts.

    Blocks are runs of rows within a partition. The rows are read twice, so they must come from files or another source
    that gives them in the same partitions and order again; an error tells where it doesn't, and they have to be written
    first.
    """
    dealt = rows.withColumn("__block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        common.release()
        block, held = None, {}

        def answer():
            for model, parts in held.items():
                grams = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_pydict({"__block": pa.array(np.full(len(grams), block, np.int64)), "model": pa.array(np.full(len(grams), model, np.int32)),
                                                  "gram": pa.array(grams)})

        for batch in batches:
            for at, model, x in zip(batch.column("__block").to_pylist(), batch.column("__model").to_pylist(), batch.column(text), strict=True):
                if at != block:
                    yield from answer()
                    block, held = at, {}
                parts = held.setdefault(model, [])
                parts.append(grams_of(x.as_py() or "")[0])
                if len(parts) == 256:
                    parts[:] = [np.unique(np.concatenate(parts))]
        yield from answer()

    asked = dealt.select("__block", "__model", text).mapInArrow(common.tidy(ask), "__block long, model int, gram long")
    asked = common.written(asked, "asked")
    told = asked.join(common.written(tables.answers(asked), "answers"), ["model", "gram"]).select("__block", "model", "gram", "logp")

    moved = "the documents came in other partitions when read again; write them to a table first"

    def apply(left, right):
        import numpy as np
        import pyarrow as pa

        common.release()
        if not left.num_rows:
            raise ValueError(moved)
        left = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in left["__rows"]])
        models, grams, logp = (right[c].to_numpy() for c in ("model", "gram", "logp"))
        known = {}
        for model in np.unique(models):
            own = models == model
            order = np.argsort(grams[own])
            known[int(model)] = grams[own][order], logp[own][order]
        nll, n = [], []
        for model, x in zip(left["__model"].to_pylist(), left[text], strict=True):
            own, times = grams_of(x.as_py() or "")
            keys, values = known.get(model, (own[:0], own[:0]))
            at = np.searchsorted(keys, own)
            if not len(keys) or (keys[np.minimum(at, len(keys) - 1)] != own).any():
                raise ValueError(moved)
            nll.append(-float((values[at] * times).sum()))
            n.append(int(times.sum()))
        return left.append_column("__nll", pa.array(nll, pa.float64())).append_column("__n", pa.array(n, pa.int64()))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        common.release()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            blocks = batch.column("__block").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            batch = batch.drop_columns(["__block"])
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                if i < j:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                        out.write_batch(batch.slice(i, j - i))
                    yield pa.RecordBatch.from_pydict({"__block": pa.array(blocks[i : i + 1]), "__rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    schema = T.StructType([*rows.schema.fields, T.StructField("__nll", T.DoubleType()), T.StructField("__n", T.LongType())])
    return dealt.mapInArrow(common.tidy(pack), "__block long, __rows binary").groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(lambda left, right: common.trimmed(apply, left, right), schema)


def train(sample: DataFrame, least_docs: int) -> tuple[DataFrame, Tables | None]:
    """lang, model (a number above 0) of the languages that have one, and the tables of all models; None without text."""
    fit = sample.where("NOT held")
    each = common.written(fit.groupBy("lang").count(), "languages")
    own = each.where(F.col("count") >= least_docs).select("lang").collect()  # one row a language with so many documents
    models = sample.sparkSession.createDataFrame([(r.lang, i) for i, r in enumerate(sorted(own), 1)], "lang string, model int")
    rows = fit.join(F.broadcast(models), "lang", "left").select(F.explode(F.array_compact(F.array(F.lit(0), "model"))).alias("model"), "text")
    return models, Tables(rows) if each.limit(1).count() else None


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_labels: int | None = None, least_docs: int = 50, quantile: float = 0.99,
             prior_chars: int = 40) -> DataFrame:
    """Add perplexity, threshold (of the smoothed perplexity) and kept to each document; trained on all trusted documents,
    or on a sample of ``sample_labels`` if a number is given."""
    columns = [c for c in docs.columns if c not in ("perplexity", "threshold", "kept")]
    names = (id_col, text_col, lang_col)
    sample = trusted(docs, labels, *names) if sample_labels is None else trusted_sample(docs, labels, *names, sample_labels)
    models, tables = train(sample, least_docs)
    if tables is None:
        return docs.select(*columns, F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    own = lambda df, lang: df.withColumn("__lang", lang).join(F.broadcast(models.select(F.col("lang").alias("__lang"), "model")), "__lang", "left").withColumn("__model", F.coalesce("model", F.lit(0))).drop("__lang", "model")
    smooth = lambda center: F.exp((F.col("__nll") + prior_chars * F.log(center)) / (F.col("__n") + prior_chars))
    held = common.written(own(sample.where("held"), F.col("lang")).select("__model", "text"), "held")
    held = common.written(score(held, tables, "text").select("__model", "__nll", "__n"), "held_out")
    # a language's document counts for its own threshold and, by its own model, for that of all
    held = held.unionByName(held.where("__model <> 0").withColumn("__model", F.lit(0)))
    centers = held.groupBy("__model").agg(F.percentile(F.exp(F.col("__nll") / F.col("__n")), 0.5).alias("center"))
    bounds = held.join(F.broadcast(centers), "__model").groupBy("__model", "center").agg(F.percentile(smooth(F.col("center")), quantile).alias("bound"))
    bounds = common.written(bounds, "bounds")  # one row a model
    whole = bounds.where("__model = 0").first() or {"center": float(SIGN), "bound": float("inf")}  # nothing held out: all is kept
    rows = own(docs.withColumn(text_col, F.col(text_col).cast("string")), language(lang_col)).select(*columns, "__model")
    got = score(rows, tables, text_col).join(F.broadcast(bounds), "__model", "left")
    center, bound = F.coalesce("center", F.lit(float(whole["center"]))), F.coalesce("bound", F.lit(float(whole["bound"])))
    kept = smooth(center) <= bound
    return got.withColumns({"__perplexity": F.exp(F.col("__nll") / F.col("__n")), "__threshold": bound, "__kept": kept}).select(
        *columns, F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``."""
    columns = docs.columns
    marked = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    names = {f"{k}_col": f"__c{columns.index(options.pop(f'{k}_col', d))}" for k, d in (("id", "doc_id"), ("text", "text"), ("lang", "lang"))}
    labels = labels.withColumnRenamed("doc_id", names["id_col"])
    return classify(marked, labels, **names, **options).where("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision for every row of ``documents``; results of nulls and ties as in the module."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "lang", "perplexity", "threshold", "kept")
