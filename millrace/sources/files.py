"""Files by Hadoop paths: bytes at their ends, listings, renames. All on the driver, over names alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.flow import Flow
from millrace.types import SPARK
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expand(spark: SparkSession, path: str) -> list[str]:
    """The data files that a path, a folder or a pattern stands for, in order of their names."""
    at, fs = _hadoop(spark, path)
    found = fs.globStatus(at) or []
    out = []
    for s in found:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [x.getPath().toString() for x in inner if not x.isDirectory() and x.getPath().getName()[0] not in "_."]
    return sorted(out)


def start_and_end(spark: SparkSession, path: str, n: int = 8) -> tuple[bytes, bytes]:
    """The first bytes of a file, and the last one."""
    at, fs = _hadoop(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        if not size:
            return b"", b""
        head = bytes(stream.readNBytes(min(n, size)))
        stream.seek(size - 1)
        return head, bytes([stream.read()])
    finally:
        stream.close()


def erase(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    (a, fs), (b, _) = _hadoop(spark, old), _hadoop(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{old} can't be renamed to {new}")


LISTING = {"directory_name": "string", "file_name": "string", "relative_path": "string", "size_bytes": "uint", "mtime_usec": "uint", "is_directory": "bool"}


def listing(spark: SparkSession, directory: str, recurse: bool = False) -> Flow:
    """A row per entry; with ``recurse`` a folder's row comes before what is in it."""
    rows: list[tuple] = []

    def walk(path: str) -> None:
        at, fs = _hadoop(spark, path)
        for s in sorted(fs.listStatus(at), key=lambda x: x.getPath().getName()):
            name = s.getPath().getName()
            relative = f"{path.rstrip('/')}/{name}"
            rows.append((path, name, relative, 0 if s.isDirectory() else s.getLen(), s.getModificationTime() // 1000 * 1_000_000, s.isDirectory(), len(rows)))
            if recurse and s.isDirectory():
                walk(relative)

    walk(directory)
    schema = T.StructType([*(T.StructField(c, SPARK[t]) for c, t in LISTING.items()), T.StructField("__o0", T.LongType())])
    return Flow(spark.createDataFrame(rows, schema), dict(LISTING), (("__o0", True),))
