"""Five stages over ``documents``, each one operator; every stage's rows are written and read again as the next's input.

Each stage function takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of ``documents``; the last adds the token ids, their number and the text decoded from them. Nulls, empty
and very long texts, repeated rows and empty tables have the results that each operator's docstring states.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import bpe, common, decontaminate, minmax, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (likeness 0.8 of their word shingles) the document of the smallest id stays."""
    return minmax.drop_near_duplicates(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text decoded from them."""
    both = bpe.encode(docs, bpe.default_path(), decoded="decoded")
    return both.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: The stages train and iterate, which SQL can't express; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after all stages; each stage's rows are written as Parquet under the shared folder and read again."""
    docs = common.documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
