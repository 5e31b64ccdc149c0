"""Web archives (WARC 1.1) with revisit resolution.

Headers alone are shuffled by payload digest: of the records with equal payloads the one with the
smallest page id keeps its payload as a response, the others become revisits that name it. The
payloads are shuffled once, by page, into archives of bounded size with fresh headers, written
gzipped through Spark to any store. Reading goes by ``Content-Length`` alone, so payloads can hold anything;
revisits are joined to their originals again for size and digest.

Edge cases: a null html is an empty payload, a null url gives no target header, line ends in urls
become blanks. A null page id is never an original: where a payload has no other, each record is a
response. Rows that repeat the original's page id and payload are responses too. Empty tables give
an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import forget, keep, scratch, table, text_or_empty

ARCHIVE_BYTES = 16 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1; 40 hex digits are 8 groups of 20 bits, each 4 characters."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(F.substring(letters, F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of ``headers`` (page_id, digest, bytes) one row per page id and digest of those that revisit another page."""
    headers = headers.where(F.col("bytes") >= min_bytes)
    first = headers.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to")
    return headers.join(first, "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", text_or_empty("html").alias("payload"))
    # payloads are read once for the headers, and once to be written
    headers, at_headers = keep(rows.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("bytes")), "headers")
    total = headers.agg(F.sum(F.col("bytes") + F.lit(400))).first()[0] or 0
    revisits, at_revisits = keep(resolve(headers, min_bytes), "revisits", spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).repartition(max(1, -(-total // archive_bytes)), "page_id", "digest")
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("payload"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", name), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Page-ID", F.col("page_id").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    forget(spark, at_headers, at_revisits)


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, gzipped or not."""
    data = plain(data)
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should start")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, bytes(view[start:stop])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's block doesn't end where its length says")
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below ``path``: page_id, url, record_type, digest, refers_to and, of responses, the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for f, block in parse(content.as_py()):
                    page, to = f.get("page-id"), f.get("warc-refers-to")
                    kind = f["warc-type"]
                    rows.append((page and int(page), f.get("warc-target-uri"), kind, f["warc-payload-digest"].removeprefix("sha1:"), to and int(to.split(":")[2]), block if kind == "response" else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, url string, record_type string, digest string, refers_to bigint, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    # the archives are parsed once; of a payload its length and digest are kept
    found = read(spark, path).select("page_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    records, _ = keep(found, "records")
    forget(spark, path)
    responses = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "digest", "refers_to")
    asked = revisits.select(F.col("refers_to").alias("asked"), "digest").distinct()
    originals = responses.select(F.col("page_id").alias("original"), "payload_bytes", "payload_digest").distinct()
    originals = originals.join(asked, (F.col("original") == F.col("asked")) & (F.col("payload_digest") == F.col("digest")), "left_semi")
    resolved = revisits.join(originals, (F.col("refers_to") == F.col("original")) & (F.col("digest") == F.col("payload_digest"))).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(resolved)


_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g{g} >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS x FROM p),
d AS (SELECT page_id, n, {', '.join(f"('0x' || substr(x, {1 + 5 * g}, 5))::BIGINT AS g{g}" for g in range(8))} FROM h),
b AS (SELECT page_id, n, {_BASE32} AS digest FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM m
"""
