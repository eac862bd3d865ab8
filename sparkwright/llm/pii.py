"""Operator 2: personal data by patterns and bootstrapped contexts, in DataFrame functions only.

Base spans come from fixed patterns with checks (addresses of mail and network, payment cards, telephone numbers). They
are the seeds of a bootstrap over the whole corpus:

1. the one to three tokens before a mention and the one or two after it (lower case, digits as 0, whatever signs they
   hold) are its cues, each a lexical pattern; identifier-like tokens outside the seeds are candidates with cues too;
2. patterns and instances form a graph, counted by aggregation. A pattern's support is the summed confidence of its
   distinct instances, known and discovered, and its confidence is the support over their number plus ``doubt``.
   Patterns with the support ``support`` and the confidence ``accept`` are accepted, which keeps vague cues out; an
   unknown instance gets the confidence of its best accepted pattern, seeds stay at 1;
3. this is repeated until no pattern is added and the confidences stand still (they never fall, so accepted patterns
   stay so and the rounds end); the accepted patterns mark the candidates beside them.

The graph holds only mentions, each round's tables are written under the shared folder, and hot patterns are
pre-aggregated (their joins are ones that AQE splits). Offsets are code points, ends exclusive.

Defined results: null text counts as empty and has no spans; repeated rows get equal results (and count as mentions
each); a match that fails its check is dropped without retry; an empty table gives an empty table; other columns are
not read, columns with an output's name are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

#: The patterns, made linear: a possessive run is never entered in its middle, except right after a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Identifier-like: at least six signs, four of them digits.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])(?=(?:[A-Za-z@._%+-]*+[0-9]){4})[A-Za-z0-9@._%+-]{6,}+"
#: So many characters beside a mention are looked at; the tokens that are cues before and after it.
CUE_CHARS = 48
BEFORE = [r"\S+\s*$"] + [rf"(?<!\S)(?:\S+\s+){{{n}}}\S+\s*$" for n in (1, 2)]
AFTER = [r"^\s*\S+", r"^\s*\S+\s+\S+"]
#: The rounds end when all confidences together rise by less.
SETTLED = 0.001
SPANS = "array<struct<kind:string,start:int,end:int>>"


def luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, r"[\x20-]", "")
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def digits_between(match: Column, low: int, high: int) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(low, high)


def ip_parts(match: Column) -> Column:
    # leading zeros aside, a part of more than three digits is above 255
    return F.forall(F.split(F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", ""), r"\."),
                    lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


CHECKS = {"email": lambda m: F.lit(True), "ip": ip_parts, "card": luhn, "phone": lambda m: digits_between(m, 9, 15)}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "candidate": CANDIDATE}
#: A text without this has no match.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+"))}


def spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of the matches that pass their check, in order."""
    pattern, check = PATTERNS[kind], CHECKS.get(kind, lambda m: F.lit(True))
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("skip"), F.coalesce(F.length(hit), F.lit(0)).alias("size"),
                                  (hit.isNotNull() & check(hit)).alias("ok")))
    none = F.lit(None).cast(SPANS)
    empty = F.array().cast(SPANS)

    def step(state, piece):
        begin = state["at"] + piece["skip"]
        end = begin + piece["size"]
        hit = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(piece["ok"], F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.coalesce(none, empty).alias("found")), step, lambda s: s["found"])
    has = NEEDS[kind](text) & F.rlike(text, F.lit(pattern)) if kind in NEEDS else F.rlike(text, F.lit(pattern))
    return F.when(has, found).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.concat(*[spans(text, k) for k in KINDS])


def cues(text: Column, start: Column, end: Column) -> Column:
    """array<string>: the tokens before and after a mention, the mention's place as a tilde."""
    left = F.lower(F.substring(text, F.greatest(start - CUE_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CUE_CHARS))))
    right = F.lower(F.substring(text, end + 1, F.lit(CUE_CHARS)))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), "[0-9]", "0")
    found = [F.concat(F.nullif(plain(F.regexp_extract(left, p, 0)), F.lit("")), F.lit(" ~")) for p in BEFORE]
    found += [F.concat(F.lit("~ "), F.nullif(plain(F.regexp_extract(right, p, 0)), F.lit(""))) for p in AFTER]
    return F.array_distinct(F.array_compact(F.array(*found)))


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, id, base, seen: all base spans, and every mention with its instance and cues (kind null: a candidate)."""
    rows = docs.select(common.row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    inside = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    rows = rows.withColumn("other", F.filter(spans(F.col("t"), "candidate"), lambda c: ~inside(c)))
    name = lambda s: F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"])
    told = lambda spans_, kind: F.transform(spans_, lambda s: F.struct(
        kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(name(s)).alias("instance"), cues(F.col("t"), s["start"], s["end"]).alias("cues")))
    seen = F.concat(told("base", lambda s: s["kind"]), told("other", lambda s: F.lit(None).cast("string")))
    return rows.select("key", "id", "base", F.filter(seen, lambda m: F.size(m["cues"]) > 0).alias("seen"))


def learned_patterns(found: DataFrame, accept: float, support: int, doubt: float) -> DataFrame:
    """cue, confidence of the accepted patterns."""
    each = found.select(F.explode("seen").alias("m")).select(F.explode("m.cues").alias("cue"), "m.instance", "m.kind")
    edges = common.written(each.groupBy("cue", "instance").agg(F.max("kind").alias("kind")), "pii_edges")
    # an instance that is a seed anywhere is one everywhere
    nodes = edges.groupBy("instance").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("seed"))
    scores, total = nodes.withColumn("conf", F.col("seed")), 0.0
    while True:
        told = edges.join(scores, "instance")
        patterns = told.groupBy("cue").agg(F.sum("conf").alias("support"), F.count(F.lit(1)).alias("n"))
        patterns = patterns.select("cue", "support", (F.col("support") / (F.col("n") + doubt)).alias("confidence"))
        patterns = common.written(patterns.where((F.col("support") >= support) & (F.col("confidence") >= accept)), "pii_patterns")
        # a new pattern adds at least ``accept`` to the sum
        before, total = total, patterns.agg(F.sum("confidence")).first()[0] or 0.0
        if total - before < SETTLED:
            return patterns.select("cue", "confidence")
        best = edges.join(patterns, "cue").groupBy("instance").agg(F.max("confidence").alias("best"))
        scores = common.written(nodes.join(best, "instance", "left").select(
            "instance", "seed", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("conf")), "pii_instances")


def discover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.8,
             support: int = 5, doubt: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(key, id, base spans of each row; key, more spans of the rows where the bootstrap found some)."""
    found = common.written(mentions(docs, id_col, text_col), "pii_mentions")
    patterns = learned_patterns(found, accept, support, doubt)
    told = found.select("key", F.explode("seen").alias("m")).where("m.kind IS NULL")
    hits = told.select("key", F.explode("m.cues").alias("cue"), "m.start", "m.end").join(patterns, "cue")
    # a row's spans, which its text bounds; rows of one key repeat the same spans
    more = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("more"))
    return found.drop("seen"), more


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, base, spans (all, by kind and start) of each row of ``docs``."""
    base, more = discover(docs, id_col, text_col, **options)
    return base.join(more, "key", "left").select("id", "base", F.concat("base", F.coalesce("more", F.array().cast(SPANS))).alias("spans"))


def masked(text: Column, all_spans: Column) -> Column:
    """The text with each span, and each run of overlapping spans, replaced by its first kind in angle brackets."""
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["out"]).alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(all_spans) == 0, text).otherwise(F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the personal data in its texts masked; null texts stay null."""
    columns = docs.columns
    _, more = discover(docs, id_col, text_col, **options)
    rows = docs.withColumn("__key", common.row_key(id_col, text_col)).join(more.withColumnsRenamed({"key": "__key", "more": "__more"}), "__key", "left")
    rows = rows.withColumn("__spans", F.concat(base_spans(common.text_or_empty(text_col)), F.coalesce("__more", F.array().cast(SPANS))))
    return rows.withColumn(text_col, masked(F.col(text_col).cast("string"), F.col("__spans"))).select(*columns)


def listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base spans, their digest, and all spans of each document."""
    found = find(common.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
