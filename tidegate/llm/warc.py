"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest; of records with equal payloads that are
long enough, the smallest id keeps its payload as ``response`` and the others become ``revisit``
records that name it. Archives are written by Spark's text sink with two line ends as the line
separator, which is how WARC ends a record, and are read back file by file and cut by Content-Length.
Reading takes the digest of every payload anew and resolves the revisits: their headers are joined to
the original responses by the record they refer to and that digest, so payload and length come from there.

Payloads never pass a shuffle when records are typed: digests are computed by the scan, and only
headers meet. They pass one when they are written, where each is joined to what it refers to, if that side is too
large to broadcast. A digest that a third of all records share is pre-aggregated per task, and its join is
one that Spark splits.

Cases: a null payload counts as empty; payloads under ``SHORTEST`` bytes are always responses; a null
url is left out of the header; line ends inside a url are dropped; rows with a null id are left out of
the archives and of the result; rows that repeat an id are records of their own, and those with the payload of the first
response of their id refer to nothing, being that response, and are one original to those that refer to it. A response
whose bytes do not have the digest of its header is not ``intact``: it shows the digest of its bytes, and so is no original, and
revisits without an original are not ``intact`` either and have no length. Empty tables
give an empty archive. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import start
from tidegate.session import shared_dir

SHORTEST = 100
RECORDS_PER_FILE = 2_000
PREFIX = "urn:page:"
END = "\r\n"

RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, length long, intact boolean, payload binary"


def headers(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload binary, payload_digest, length) of every page."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return (
        pages.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
        .withColumn("payload_digest", F.sha2("payload", 256))
        .withColumn("length", F.octet_length("payload").cast("long"))
    )


def typed(records: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(page_id, payload_digest, length, record_type, refers_to): one row for each header."""
    slim = records.select("page_id", "payload_digest", "length").distinct()
    first = (
        slim.where(F.col("length") >= shortest)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.lit(False)) & (F.col("length") >= shortest)
    return slim.join(first, "payload_digest", "left").select(
        "page_id",
        "payload_digest",
        "length",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(payload: Column) -> Column:
    """One record as bytes in a string column: header lines, an empty line and the payload."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    text = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{PREFIX}"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit(f"<{PREFIX}"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
        F.lit(END),
    )
    return F.concat(text.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(payload)).cast("string").alias("value")


def write(records: DataFrame, path: str) -> None:
    """``records`` (page_id, url, payload, payload_digest, length) as deduplicated gzipped archives."""
    types = typed(records).select("page_id", "payload_digest", "record_type", "refers_to")
    # Only what is a revisit is joined: everything else keeps its payload where it is.
    gone = types.where("record_type = 'revisit'").drop("record_type")
    out = records.join(gone, ["page_id", "payload_digest"], "left")
    out = out.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    (
        out.select(_record(F.col("payload")))
        .write.option("lineSep", END + END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .option("compression", "gzip")
        .text(path)
    )


def parse(data: bytes):
    """(header fields, payload) of every record of one archive, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:body].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:] if line)
        end = body + int(fields["Content-Length"])
        yield fields, data[body:end]
        at = end + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; without ``payloads``, only their headers and lengths."""
    start(spark)

    def cut(batches):
        number = lambda text: int(text.strip("<>").removeprefix(PREFIX)) if text else None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for f, body in parse(data):
                    said = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    plain = f["WARC-Type"] != "revisit"
                    digest = hashlib.sha256(body).hexdigest() if plain else said
                    rows.append(
                        (
                            number(f["WARC-Record-ID"]),
                            f.get("WARC-Target-URI"),
                            f["WARC-Type"],
                            number(f.get("WARC-Refers-To")),
                            digest,
                            len(body),
                            digest == said if plain else None,
                            body if payloads else None,
                        )
                    )
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "length", "intact", "payload"]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    return files.option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(cut, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Revisit records with length and payload of the response that they refer to."""
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.min("length").alias("length"), F.first("payload").alias("payload"))
        .withColumn("intact", F.lit(True))
    )
    plain = records.where("record_type <> 'revisit'")
    found = records.where("record_type = 'revisit'").drop("length", "payload", "intact")
    found = found.join(originals, ["refers_to", "payload_digest"], "left").fillna(False, ["intact"])
    return plain.unionByName(found)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives written."""
    spark = start(pages.sparkSession)
    path = shared_dir(spark, "warc")
    write(headers(pages), path)
    return resolved(read(spark, path, payloads=False)).select(
        "page_id", F.col("length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
