"""Records in binary: sizes and field lengths as variable-length integers, fields as text.

A record is its size, the number of fields, and each field's length and bytes, then eight zero bytes; the
first record holds the headings. The high bit marks an integer's last byte.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.flow import Flow
from millrace.session import child
from millrace.sources.files import expand
from millrace.types import from_text, split_heading, to_text

# Eight zero bytes end a record.
TAIL = bytes(8)


def pack_int(n: int) -> bytes:
    """Seven bits a byte, the lowest first."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F)
        n >>= 7
    out.append(n | 0x80)
    return bytes(out)


def unpack_int(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a record is incomplete")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if b & 0x80:
            return n, at


def pack(fields: list[bytes]) -> bytes:
    body = pack_int(len(fields)) + b"".join(pack_int(len(f)) + f for f in fields) + TAIL
    return pack_int(len(body)) + body


def unpack(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        size, at = unpack_int(data, at)
        stop = at + size
        if stop > len(data):
            raise ValueError("a record is incomplete")
        n, at = unpack_int(data, at)
        fields = []
        for _ in range(n):
            length, at = unpack_int(data, at)
            fields.append(data[at : at + length])
            at += length
        if at + len(TAIL) != stop:
            raise ValueError("a record's fields don't fill its size")
        yield fields
        at = stop


def read(spark: SparkSession, *paths: str) -> Flow:
    """Files with equal headings, one after the other, gzipped or not; each is read whole, so shards should have a few hundred MB at most."""
    spark = child(spark)
    files = [f for p in paths for f in expand(spark, p)]
    binary = spark.read.format("binaryFile").load(files)

    def plain(data: bytes) -> bytes:
        return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data

    def heads(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"h": ["\x1f".join(x.decode() for x in next(unpack(plain(c)), [])) for c in b["content"]]})

    found = [r.h for r in binary.select("content").mapInPandas(heads, "h string").distinct().limit(2).collect()]
    if len(found) != 1 or not found[0]:
        raise PipelineError("the files' headings differ" if found else "no file", "io.file.read")
    headings = [split_heading(h) for h in found[0].split("\x1f")]
    rank = {f: i for i, f in enumerate(files)}

    def records(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                every = unpack(plain(content))
                next(every, None)
                held: list = []
                for i, fields in enumerate(every):
                    held.append((rank[path], i, [x.decode() for x in fields]))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["f", "i", "x"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["f", "i", "x"])

    rows = binary.select("path", "content").mapInPandas(records, "f int, i long, x array<string>")
    cols = [from_text(F.get("x", F.lit(k)), t or "string").alias(n) for k, (t, n) in enumerate(headings)]
    return Flow(rows.select(*cols, F.col("f").alias("__o0"), F.col("i").alias("__o1")), {n: t or "string" for t, n in headings}, (("__o0", True), ("__o1", True)))


def to_bytes(flow: Flow) -> bytes:
    """The whole flow; for results that fit the driver, like those of tests."""
    texts = [to_text(F.col(f"`{c}`"), t).cast("string").alias(c) for c, t in flow.tags.items()]
    from millrace.operators.ordered import directed

    rows = flow.rows.orderBy(*directed(list(flow.order))) if flow.order else flow.rows
    return pack([h.encode() for h in flow.headings]) + b"".join(pack([x.encode() for x in r]) for r in rows.select(*texts).toLocalIterator())


def write(flow: Flow, path: str, mode: str = "overwrite") -> None:
    """Shards in the format itself, each with the headings, written by the tasks in the flow's order.

    Spark's text writer takes bytes as they are and ends each record with a separator: the last of a record's zero bytes.
    """
    texts = [to_text(F.col(f"`{c}`"), t).cast("string").alias(c) for c, t in flow.tags.items()]
    head = pack([h.encode() for h in flow.headings])[:-1]

    def run(batches):
        import pandas as pd

        first = True
        for b in batches:
            rows = [pack([x.encode() for x in row])[:-1] for row in b.itertuples(index=False)]
            yield pd.DataFrame({"value": [head, *rows] if first else rows})
            first = False
        if first:
            yield pd.DataFrame({"value": [head]})

    from millrace.operators.ordered import directed

    rows = flow.rows
    if flow.order:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *directed(list(flow.order))).sortWithinPartitions(*directed(list(flow.order)))
    binary = rows.select(*texts).mapInPandas(run, "value binary")
    binary.select(F.col("value").cast("string").alias("value")).write.mode(mode).option("lineSep", "\0").text(path)


def is_native(spark: SparkSession, path: str) -> bool:
    """Whether the first file begins with a record of headings that have types; only its first bytes are read."""
    from millrace.sources.files import start_and_end

    files = expand(spark, path)
    if not files:
        return False
    head = start_and_end(spark, files[0], 1 << 16)[0]
    if head[:2] == b"\x1f\x8b":
        import zlib

        try:
            head = zlib.decompressobj(31).decompress(head, 1 << 16)
        except zlib.error:
            return False
    try:
        found = [f.decode() for f in next(unpack(head), [])]
        return bool(found) and all(split_heading(h)[0] for h in found)
    except (ValueError, PipelineError):
        return False
