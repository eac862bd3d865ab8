"""An append that can be repeated (S7): every batch of rows has an id, and a table holds each committed batch once.

A plain append that is run again, after a lost driver or by a scheduler that retries, doubles its rows, and one that
breaks off half-way may leave some. Here a batch is written to a folder of its own attempt, which no reader looks at. It
becomes part of the table in one step: a small marker file that names the folder is renamed into place, which fails if
the batch's marker is there already. Then:

* a batch that is committed is not written again, whatever rows the second run has;
* of two runs of a batch at the same time one commits, the other's folder is left behind unread;
* a run that breaks off leaves a folder without a marker, and the next run starts afresh.

The rename must be atomic and refuse to replace, as on HDFS and local file systems; object stores without such a rename
need their committer's equivalent. Readers list the markers, one small file a batch, and read the folders they name.
``foreach_batch`` makes the same of a stream's micro-batches, whose ids survive a restart.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COMMITS, DATA = "_commits", "data"


def _name(batch_id: object) -> str:
    name = str(batch_id)
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", name):
        raise ValueError(f"a batch id takes letters, digits and _ . = -, not {name!r}")
    return name


class _Files:
    """The few file operations, by Hadoop's own file system classes, so any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.base = self.path(path)
        self.fs = self.base.getFileSystem(self.conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, text: str) -> bool:
        return self.fs.exists(self.path(text))

    def put(self, text: str, content: str) -> None:
        out = self.fs.create(self.path(text), False)
        try:
            out.write(content.encode())
        finally:
            out.close()

    def rename_new(self, old: str, new: str) -> bool:
        """Rename without replacing; False if ``new`` is there already."""
        options = self.jvm.org.apache.hadoop.fs.Options
        none = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(old)), self.fs.makeQualified(self.path(new)), none)
            return True
        except Exception as e:  # noqa: BLE001 - told apart by the Java class
            if options is not None and "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise


def is_committed(spark: SparkSession, path: str, batch_id: object) -> bool:
    return _Files(spark, path).exists(f"{path}/{COMMITS}/{_name(batch_id)}.txt")


def stage_batch(df: DataFrame, path: str, batch_id: object, fmt: str = "parquet") -> str:
    """Write the rows to a new folder of this attempt; returns its name within the table. Readers don't see it."""
    folder = f"{DATA}/{_name(batch_id)}-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).save(f"{path}/{folder}")
    return folder


def commit_batch(spark: SparkSession, path: str, batch_id: object, folder: str) -> bool:
    """Make a staged folder the batch's rows; False if the batch is committed already."""
    files, name = _Files(spark, path), _name(batch_id)
    files.fs.mkdirs(files.path(f"{path}/{COMMITS}"))
    draft = f"{path}/{COMMITS}/.{name}-{uuid.uuid4().hex[:12]}"  # names that begin with a dot are no markers
    files.put(draft, folder)
    try:
        return files.rename_new(draft, f"{path}/{COMMITS}/{name}.txt")
    finally:
        if files.exists(draft):
            files.fs.delete(files.path(draft), False)


def append_batch(df: DataFrame, path: str, batch_id: object, fmt: str = "parquet") -> bool:
    """Append the rows as a batch, once: False, with nothing changed, if the batch is in the table already."""
    spark = df.sparkSession
    if is_committed(spark, path, batch_id):
        return False
    return commit_batch(spark, path, batch_id, stage_batch(df, path, batch_id, fmt))


def committed_batches(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each committed batch, by its id."""
    files = _Files(spark, path)
    if not files.exists(f"{path}/{COMMITS}"):
        return {}
    found = {}
    for status in files.fs.listStatus(files.path(f"{path}/{COMMITS}")):
        name = status.getPath().getName()
        if name.endswith(".txt") and not name.startswith("."):
            stream = files.fs.open(status.getPath())
            try:
                text = files.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found[name.removesuffix(".txt")] = text.strip()
    return found


def read_batches(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The rows of all committed batches. Without any batch the table is empty, and ``schema`` must tell its columns."""
    folders = sorted(committed_batches(spark, path).values())
    if not folders:
        if not schema:
            raise ValueError(f"no committed batch in {path} and no schema given")
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return reader.load([f"{path}/{f}" for f in folders])


def foreach_batch(path: str, prefix: str = "epoch-") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: micro-batches replayed after a restart are in the table once."""

    def write(df: DataFrame, batch_id: int) -> None:
        append_batch(df, path, f"{prefix}{batch_id}")

    return write
