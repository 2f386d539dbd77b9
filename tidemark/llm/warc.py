"""WARC archives whose repeated payloads are revisit records.

Headers (digest, id, uri, date) without payloads are shuffled by payload digest to find the first record of every payload and
who repeats it. Records then meet their own verdict by id and digest, a key that no two pages share, and are written once,
as response or as revisit with fresh headers. The archives go out through Spark's text sink, one record a row with the
record end as line separator, so that they land wherever spark.checkpoint.dir points, small and large payloads apart, so that a
file is bounded in bytes; they come back as binary files that are parsed by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir

VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are always stored whole.
LEAST_BYTES = 100
#: Payloads from this size on are large; records in one archive file of small and of large payloads.
LARGE_BYTES, SMALL_RECORDS, LARGE_RECORDS = 1 << 16, 1000, 16


def resolve(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record_id, target_uri, date, payload) of records with payload_bytes, payload_digest, record_type, refers_to,
    refers_to_uri and refers_to_date. Of equal payloads of at least least_bytes the smallest record_id is the response.

    A null payload is empty, long ones are digested whole. Records without an id never refer and are never referred to. If
    several rows share the smallest id, all of them are responses. Other columns are left out. An empty table gives an empty result.
    """
    payload = F.encode(F.coalesce(F.col("payload"), F.lit("")), "UTF-8")
    headed = records.select("record_id", "target_uri", "date", "payload", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    headers = headed.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull()).drop("payload", "payload_bytes")
    first = headers.groupBy("payload_digest").agg(F.min(F.struct("record_id", "target_uri", "date")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = headers.select("record_id", "payload_digest").join(first, "payload_digest").where("record_id > first.record_id").distinct()
    joined = headed.join(revisits, ["record_id", "payload_digest"], "left")
    revisit = F.col("first").isNotNull()
    return joined.select(
        "record_id", "target_uri", "date", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        *(F.when(revisit, F.col(f"first.{c}")).alias(to) for c, to in (("record_id", "refers_to"), ("target_uri", "refers_to_uri"), ("date", "refers_to_date"))),
    )


def archive(records: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Resolves and writes records under path. Equal payloads are equally long, so small and large ones are two jobs."""
    large = F.coalesce(F.octet_length("payload"), F.lit(0)) >= LARGE_BYTES
    write_archives(resolve(records.where(~large), least_bytes), f"{path}/small", SMALL_RECORDS)
    write_archives(resolve(records.where(large), least_bytes), f"{path}/large", LARGE_RECORDS)


def _urn(column: str):
    """A record's name: its id; without one, a random name."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.col(column).cast("string"), F.lit(">")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))


def _plain(column: str):
    """A header value: one line."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+", " ")


def write_archives(resolved: DataFrame, path: str, file_records: int = SMALL_RECORDS) -> None:
    """Writes gzipped WARC files under path, one gzip member a file. A revisit keeps the HTTP head, and drops the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, F.coalesce(F.col("payload"), F.lit(""))))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _urn("record_id"),
        F.lit("\r\nWARC-Target-URI: "), _plain("target_uri"),
        F.lit("\r\nWARC-Date: "), _plain("date"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(
            F.col("record_type") == "revisit",
            F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), _urn("refers_to"), F.lit("\r\nWARC-Refers-To-Target-URI: "), _plain("refers_to_uri"), F.lit("\r\nWARC-Refers-To-Date: "), _plain("refers_to_date")),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END),
    )
    records = resolved.select(F.concat(head, block).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record; lengths decide, never the payload's content."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        if not data.startswith(b"WARC/1.", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if len(block) < size or data[at : at + 4] != end:
            raise ValueError(f"record cut short at byte {at}")
        at += 4
        yield headers, block


FIELDS = "record_id long, target_uri string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path. Digests of responses are computed anew and must match the header;
    a revisit's length and digest are those of the payload it stands for; its payload is null."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(gzip.decompress(content.as_py())):
                    http, _, payload = block.partition(END.encode())
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    whole = h["warc-type"] == "response"
                    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{h['warc-record-id']}: the payload does not match its digest")
                    rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-date"], size, digest, h["warc-type"], number(h.get("warc-refers-to")), payload if whole and payloads else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: writes every page, reads the archives back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("html").alias("payload"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(records, path)
    back = read_archives(spark, path, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
