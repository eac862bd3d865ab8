"""Operator 7: write pages as WARC archives and read archives back, salvaging what damaged files still hold.

Writing. One record a page; Spark's text sink writes the records (the record separator CRLF CRLF is the sink's line
separator), so its commit protocol covers lost tasks and executors. Of records with equal payloads of at least
``min_bytes`` bytes the one with the smallest id is the response, the others are revisits of it.

Archives have at most ``records_per_file`` records and some ``archive_bytes`` bytes (a larger record has an archive of its
own): records of about equal size are written together, with as few to an archive as their size allows.

Reading. Each archive is one row of Spark's binary source, which takes up to 2 GB. A record must have a version line, a full header, a right length, its closing CRLF CRLF and, if it
states one, a right SHA-256 digest. Compressed archives hold one gzip member a record. After a failed check the reader
looks for the next version line or member that passes every check, goes on there, and returns the bytes in between as
a quarantined gap; no other record is lost. Within a readable member that holds several records a bad one is passed over in
the same way; a damaged member is lost as a whole.

Defined results: null payload counts as empty; a null id or URL is written without value and read back as null; of
repeated rows with the smallest id every one is a response; line breaks in a URL are percent-coded; an empty table
makes archives without records; further input columns are ignored.
"""

import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import common

common.ship(__name__)

ENDS = b"\r\n\r\n"
#: Digests with copies are broadcast up to so many (some 100 bytes each); a shuffled join beyond it.
MOST_BROADCAST = 100_000
#: The version line that a record begins with.
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r\n")
#: Record sizes are told apart by this factor; what a header has at most besides id and URL.
SIZE_STEP, HEADER_REST = 16, 1_000

READ_SCHEMA = ("file string, start long, end long, gap string, record_type string, record_id string, url string, "
               "refers_to string, payload_digest string, payload_length long, payload binary")


def classify(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             min_bytes: int = 100) -> DataFrame:
    """id, url, payload, digest, n_bytes, refers_to (null for a response) of each row."""
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     common.text_or_empty(payload_col).alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    firsts = (base.where(F.col("n_bytes") >= min_bytes).groupBy("digest")
              .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    firsts = common.written(firsts, "warc_firsts")  # small beside the payloads; its row count is in the file footers
    side = F.broadcast(firsts) if firsts.count() <= MOST_BROADCAST else firsts
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return base.join(side, "digest", "left").select("id", "url", "payload", "digest", "n_bytes", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(df: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000,
                   archive_bytes: int = 1 << 30) -> None:
    """Write a WARC record for each row of ``df`` to archives under ``where`` (any path that Spark can write)."""
    # a bound of the record's bytes (line breaks in a URL take three); the first class is whatever fits records_per_file
    bound = (F.coalesce(F.octet_length(F.col(payload_col).cast("string")), F.lit(0)).cast("long") + HEADER_REST
             + 3 * F.coalesce(F.octet_length(F.col(url_col).cast("string")), F.lit(0)).cast("long")
             + 2 * F.coalesce(F.octet_length(F.col(id_col).cast("string")), F.lit(0)).cast("long"))
    largest = df.select(F.max(bound)).first()[0] or 0
    tops = [max(1, archive_bytes // records_per_file)]
    while tops[-1] < largest:
        tops.append(tops[-1] * SIZE_STEP)
    rows = classify(df, id_col, url_col, payload_col, min_bytes)
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))  # noqa: E731  null: no line
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    record = F.concat_ws(
        "", F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", named(F.col("id"))), line("WARC-Target-URI", url), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", named(F.col("refers_to")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n"),
        F.when(~revisit, F.col("payload")))
    made = F.octet_length("value")
    for low, top in zip([-1, *tops[:-1]], tops, strict=True):
        part = rows.select(record.alias("value"))
        part = part.where(made + 4 > low) if low >= 0 else part  # with the separator
        part = part.where(made + 4 <= top) if top < tops[-1] else part
        (part.write.mode("append" if low >= 0 else "errorifexists").option("lineSep", ENDS.decode())
         .option("maxRecordsPerFile", max(1, min(records_per_file, archive_bytes // top))).text(where))


def parse_record(buf, at: int) -> tuple[dict | None, str, int]:
    """The record that starts at ``at`` (None if a check fails), why it failed, and where it ends."""
    version = VERSION.match(buf, at)
    if not version:
        return None, "no record header", at
    head, pos = {}, version.end()
    while not buf.startswith(b"\r\n", pos):  # however long the header is; a line that is none, as another version line, ends it
        line_end = buf.find(b"\r\n", pos)
        if line_end < 0:
            return None, "no record header", at
        name, colon, value = bytes(buf[pos:line_end]).decode("utf-8", "replace").partition(":")
        if not colon:
            return None, "bad header line", at
        head[name.strip().lower()] = value.strip()
        pos = line_end + 2
    size = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return None, "no length", at
    begin = pos + 2
    end = begin + int(size)
    if end > len(buf):
        return None, "truncated", at
    if buf[end : end + 4] != ENDS:
        return None, "wrong length", at
    body, digest = bytes(buf[begin:end]), head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and digest.startswith("sha256:") and hashlib.sha256(body).hexdigest() != digest[7:]:
        return None, "wrong digest", at
    head["body"] = body
    return head, "", end + 4


def member(buf, at: int) -> tuple[bytes | None, int]:
    """The content of the gzip member at ``at`` (None if it is damaged) and where it ends."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and pos < len(buf):
            out.append(inflate.decompress(buf[pos : pos + 65_536]))
            pos += 65_536
    except zlib.error:
        return None, at
    if not inflate.eof:
        return None, at
    return b"".join(out), min(pos, len(buf)) - len(inflate.unused_data)


def parse_archive(buf: bytes, packed: bool = True):
    """(start, end, record or None, reason) for each record and each gap, in file order; they cover the whole file.
    What a gzip member (looked for if ``packed``) holds has the member's place."""
    at, gap, why, magic = 0, None, "", re.compile(rb"WARC/[0-9]|\x1f\x8b\x08" if packed else rb"WARC/[0-9]")  # a cut record may end anywhere
    while at < len(buf):
        found, end, reason = [], at, "no record header"
        if packed and buf.startswith(b"\x1f\x8b\x08", at):
            inner, end = member(buf, at)
            reason = "damaged member"
            found = [(head, said) for _, _, head, said in parse_archive(inner, False)] if inner is not None else []
            if not any(head for head, _ in found):
                reason, found = found[0][1] if found else reason, []
        elif buf.startswith(b"WARC/", at):
            head, reason, end = parse_record(buf, at)
            found = [(head, "")] if head else []
        if found:
            if gap is not None:
                yield gap, at, None, why
                gap = None
            for head, said in found:
                yield at, end, head, said
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        ahead = magic.search(buf, at + 1)
        at = ahead.start() if ahead else len(buf)
    if gap is not None:
        yield gap, len(buf), None, why


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """Every record of the archives under ``where``, and every quarantined gap (``gap`` says why; null for records)."""
    import pyarrow as pa

    def rows(batches):
        name = lambda x: (m[1] or None) if x and (m := re.fullmatch(r"<urn:page:(.*)>", x)) else x
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                out, held = [], 0
                for start, end, head, why in parse_archive(content.as_buffer().to_pybytes()):
                    h = head or {}
                    length = h.get("x-payload-length", "")
                    out.append({"file": path.as_py(), "start": start, "end": end, "gap": None if head else why, "record_type": h.get("warc-type"), "record_id": name(h.get("warc-record-id")),
                                "url": h.get("warc-target-uri"), "refers_to": name(h.get("warc-refers-to")), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                "payload_length": int(length) if length.isdecimal() else None, "payload": h.get("body")})
                    held += len(h.get("body", b""))
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return spark.read.format("binaryFile").load(where).select("path", "content").mapInArrow(rows, READ_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back; lengths and digests of responses are those of the bytes read."""
    from sparkwright.session import fresh_location  # for the driver alone, as in common

    where = fresh_location(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), where)
    records = read_archives(spark, where).where("gap IS NULL")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
