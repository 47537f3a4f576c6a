"""WARC archives written and read with Spark's text files, records found by boundary chains.

Writing: one record a row; of rows with equal payloads that with the largest identifier is the response
and the others revisit it, without payload. Payloads are equal if their SHA-256 is; the archive names their
SHA-1. A record's block is an HTTP response: its status line and headers, then the payload. A record is one
string and the line separator ends it, so that any file system that Spark writes to can hold the archives.
Gzip runs over whole files, not record by record.

Reading: the version line is the separator of a text scan, which splits plain files over tasks, whatever
the payloads. Each chunk is a candidate record: its offset, and the offset of its successor by its own
Content-Length. Pointers are doubled from the start of each file, and only candidates that the chain
reaches are records; version lines inside payloads, even of whole fake records, are not reached and go
back into the payload around them. The archives are scanned once: candidates and their text are written to
the shared folder, so that nothing depends on how a second scan would be split. What travels by file is two
offsets a candidate; a file has at most ``records_per_file`` records.

Cases: a null payload is empty; a null URL gives no target header; line ends in a URL become spaces, and
the W of a version string at its end %57; a chain that breaks before its last candidate is an error; a
null identifier comes back as null and, among equal payloads, revisits the largest identifier, or is a
response where none has one; identifiers are percent-encoded, so that any string comes back as it was, an
empty one too; rows that repeat identifier and payload are all responses; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm.session import shared_dir, shipped, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n"
#: What stands before the payload in a block.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# The digits of base 32 as conv() writes them, and those of RFC 4648.
_CONV, _RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a column in upper-case base 32: each 5 hexadecimal digits are 4 of base 32."""
    text = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(text, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _RFC4648)


def write_warc(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
    records_per_file: int = 200_000,
) -> None:
    """Write one record a row into WARC files in the folder ``path``."""
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]+", " "), r"WARC/1\.0\z", "%57ARC/1.0").alias("_url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_payload"),
    )
    rows = rows.withColumn("_same", F.unhex(F.sha2("_payload", 256)))
    keep = rows.groupBy("_same").agg(F.max("_id").alias("_keep"))
    rows = rows.join(keep, "_same").withColumn("_digest", base32_sha1("_payload"))
    again = (F.octet_length("_payload") >= min_revisit_bytes) & ~F.col("_id").eqNullSafe(F.col("_keep"))
    # Percent signs stand for what could end a line or the URN.
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:page>"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    body = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("_payload")))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("_id")),
        line("WARC-Target-URI", F.col("_url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Refers-To", F.when(again, urn("_keep"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END),
        body,
        F.lit(END),
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", END)
    writer.option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text between version lines in file order: _file, _block, _nr, value."""
    raw = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "*.txt*").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_nr"),
        "value",
    )


def _header(name: str) -> Column:
    found = F.regexp_extract("_header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which candidates of one file the chain from its start reaches, by doubling the pointers."""
    pdf = pdf.sort_values("_at", ignore_index=True)
    at, to = pdf["_at"].to_numpy(), pdf["_next"].to_numpy()
    n = len(at)
    jump = np.searchsorted(at, to)
    jump[(jump < n) & (at[np.minimum(jump, n - 1)] != to)] = n
    lost = (to < 0) | ((jump == n) & (to <= at.max(initial=-1)))
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and at[0] == 0
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    if (reached[:n] & lost).any():
        raise ValueError(f"{pdf['_file'].iloc[0]}: no record where the one at {at[reached[:n] & lost][0]} ends")
    pdf["_reached"] = reached[:n]
    return pdf[["_file", "_nr", "_at", "_reached"]]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``: record_type, record_id, target_uri, refers_to, digest, payload_bytes, payload_digest.

    ``digest`` is that of the header, ``payload_digest`` that of the bytes read. ``payload`` adds the bytes
    themselves in a column of that name.
    """
    header = F.substring_index("value", END + END, 1)
    size = F.octet_length("value").cast("long")
    cl = F.regexp_extract("_header", r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d{1,15})", 1)
    with_http = F.octet_length(F.substring_index("value", END + END, 2)).cast("long")
    found = (
        _chunks(spark, path)
        .withColumn("_header", header)
        .withColumn("_size", size)
        .withColumn("_cl", F.when((cl != "") & (F.octet_length("_header") < F.col("_size")), cl.cast("long")))
        .withColumn("_head", F.octet_length("_header").cast("long") + 4)
        .withColumn("_own", F.col("_head") + F.col("_cl") + 4)
        # A block that is an HTTP message has its payload after the headers.
        .withColumn("_http", F.lower(_header("Content-Type")).startswith("application/http") & (with_http + 4 <= F.col("_head") + F.col("_cl")))
        .withColumn("_skip", F.when(F.col("_http"), with_http + 4).otherwise(F.col("_head")))
        .withColumn("_bytes", F.col("_head") + F.col("_cl") - F.col("_skip"))
    )
    meta = found.select(
        "_file", "_block", "_nr", "_size", "_own", "_skip", "_bytes", "value",
        _header("WARC-Type").alias("record_type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Refers-To").alias("refers_to"),
        _header("WARC-Payload-Digest").alias("digest"),
        F.when(F.col("_own") <= F.col("_size"), base32_sha1(_payload("value"))).alias("payload_digest"),
    )
    meta = written(meta, "warc-candidates", compression="zstd")
    order = _in_order()
    placed = meta.select(
        "_file", "_nr", "_own",
        (F.coalesce(F.sum(F.col("_size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC)).alias("_at"),
    )
    pointers = placed.where("_at >= 0").select(
        "_file", "_nr", "_at", F.coalesce(F.col("_at") + len(MAGIC) + F.col("_own"), F.lit(-1)).alias("_next")
    )
    reached = shipped(pointers).groupBy("_file").applyInPandas(_chain, "_file string, _nr long, _at long, _reached boolean")
    reached = written(reached.where("_reached").select("_file", "_nr", "_at"), "warc-chain")
    records = meta.join(reached, ["_file", "_nr"])
    fields = ["record_type", "record_id", "target_uri", "refers_to", "digest", F.col("_bytes").alias("payload_bytes"), "payload_digest"]
    more = ["payload"] if payload else []
    whole = records.where("_own <= _size")
    whole = (whole.withColumn("payload", _payload("value")) if payload else whole).select(*fields, *more)
    broken = records.where("_own > _size OR _own IS NULL").drop("value")
    if broken.isEmpty():
        return whole
    # Payloads with version lines inside: each chunk goes to the last record before it.
    owner = (
        meta.select("_file", "_block", "_nr")
        .join(reached.select("_file", "_nr", F.col("_nr").alias("_hit")), ["_file", "_nr"], "left")
        .withColumn("_owner", F.last("_hit", ignorenulls=True).over(order))
        .join(broken.select("_file", F.col("_nr").alias("_owner")), ["_file", "_owner"], "left_semi")
        .select("_file", "_nr", "_owner")
    )
    parts = meta.select("_file", "_nr", "value").join(owner, ["_file", "_nr"]).groupBy("_file", F.col("_owner").alias("_nr"))
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("_nr", "value"))).alias("_parts")).select(
        "_file", "_nr", F.array_join("_parts.value", MAGIC).alias("_text")
    )
    mended = broken.where("_own IS NOT NULL").join(joined, ["_file", "_nr"]).withColumn("payload", _payload("_text"))
    mended = mended.withColumn("payload_digest", base32_sha1("payload"))
    return whole.unionByName(mended.select(*fields, *more))


def _payload(text: str) -> Column:
    return F.substring(F.col(text).cast("binary"), (F.col("_skip") + 1).cast("int"), F.col("_bytes").cast("int"))


def _in_order():
    return Window.partitionBy("_file").orderBy("_block", "_nr")


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Write the rows as archives in the shared folder and read them back.

    Columns: id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "warc")
    write_warc(df, path, id_col, url_col, payload_col, **options)
    kind = df.schema[id_col].dataType.simpleString()
    named = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, r"<urn:page:(.*)>", 1))).cast(kind)
    found = read_warc(spark, path, payload=False).select(
        named("record_id").alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        named("refers_to").alias("refers_to"),
        F.substring_index("digest", ":", -1).alias("_digest"),
    )
    found = written(found, "warc-records")
    full = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    first = found.where("record_type <> 'revisit'").drop("_digest")
    again = found.where("record_type = 'revisit'").select(id_col, F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return first.unionByName(again.join(full, "payload_digest"))
