"""WARC archives with revisit records for repeated payloads.

Each page's header (digest, length, id) is shuffled by payload digest; of the records with equal payloads of at
least ``least_bytes`` the one with the largest id is the response and the rest become revisit records that name it.  The
headers' summary, a row for each repeated digest, is joined to the pages, and every record is written with fresh headers.

Records are put together by column expressions and written by Spark's text writer (whose row end is the last
byte of the record), gzip files of whole records.  Reading streams through each file by Content-Length.

Edge cases: a null or empty payload is a response of 0 bytes; a null id is below all others (its record has no page id
header and reads back as null); rows that repeat an id and a payload are all responses if that id is the largest; a null
or odd URL is percent-encoded as needed; payloads of any length are kept whole; other columns, whatever their names, are ignored; an empty
table gives no record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, stored, work_dir

LEAST_BYTES = 1000
#: One date for all records keeps archives byte-equal when a task is run again.
WHEN = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def resolved(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_uri for every page."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    long_ones = rows.where(F.col("payload_bytes") >= least_bytes)
    own = F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "url")
    first = long_ones.groupBy("payload_digest").agg(F.max(own).alias("first"), F.min(own).alias("least"))
    # a written table, so that the join may deal a hot digest's pages to many tasks
    first = stored(first.where("first.id > least.id").select(F.col("payload_digest").alias("d"), "first"), work_dir(pages.sparkSession) + "/responses")
    # short payloads meet nothing: dealt by id, so that equal ones (empty pages) do not meet in one task
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("d", F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(alone))
    joined = rows.join(first, "d", "left")
    revisit = F.col("first").isNotNull() & (F.coalesce("page_id", F.lit(NO_ID)) != F.col("first.id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_uri"))


def uri(column: str) -> F.Column:
    """A URL without white space, control or non-ASCII characters: those are percent-encoded."""
    c = F.coalesce(F.col(column), F.lit("urn:x-no-target"))
    return F.when(c.rlike(r"^[\x21-\x7e]+$"), c).otherwise(F.regexp_replace(F.url_encode(c), r"%3A%2F%2F", "://"))


def record_id(page: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]], F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One string a record of what ``resolved`` returns."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = F.col("record_type") == "response"
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(HTTP), line("Content-Length", size), F.lit("\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(WHEN)),
        line("WARC-Target-URI", uri("url")),
        line("WARC-Payload-Digest", digest),
        F.when(response, "").otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))),
                line("WARC-Refers-To-Target-URI", uri("refers_to_uri")),
                line("WARC-Refers-To-Date", F.lit(WHEN)),
                F.when(F.col("refers_to").isNull(), "").otherwise(line("X-Refers-To-Page", F.col("refers_to").cast("string"))),
            )
        ),
        F.when(F.col("page_id").isNull(), "").otherwise(line("X-Page-Id", F.col("page_id").cast("string"))),
        line("X-Payload-Length", size),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))  # the writer adds the last \n


def write_warc(pages: DataFrame, path: str, *, records_per_file: int = 20_000, **columns) -> None:
    records(resolved(pages, **columns)).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an archive."""
    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {version[:20]!r}")
        head: dict[str, str] = {}
        while (row := stream.readline()) != b"\r\n":
            name, _, value = row.decode("utf-8").partition(": ")
            head[name.lower()] = value.removesuffix("\r\n")
        block = stream.read(n := int(head["content-length"]))
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield head, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records; a response's length and digest are those of its payload as read, checked against its headers."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows: list[tuple] = []
                for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data.as_py()))):
                    said, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha1(payload).hexdigest() != said or len(payload) != size:
                            raise ValueError(f"{head['warc-record-id']}: the payload is not what its headers say")
                    number = lambda name, head=head: int(head[name]) if name in head else None
                    rows.append((number("x-page-id"), head["warc-target-uri"], size, said, head["warc-type"], number("x-refers-to-page")))
                    if len(rows) == 5000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, READ)


def warc_archives(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes the archives (below a new work folder unless ``path`` is given) and reads them back."""
    path = path or work_dir(pages.sparkSession) + "/warc"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
