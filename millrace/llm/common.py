"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own readers, so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and all of Spark is in one process (as in tests) a local one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/millrace/{what}-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at a time, more or less.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of whole texts for Python workers hold ``BATCH_BYTES``, unless the session has another size than Spark's own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


_owner = ""
_releases: list[Callable[[], None]] = []


def on_release(f: Callable[[], None]) -> None:
    """``f`` empties what a module keeps in a Python worker from task to task."""
    _releases.append(f)


def claim(owner: str) -> None:
    """In a Python worker: memory that other operators have kept there, which workers outlive, is given back."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for f in _releases:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep(df: DataFrame, what: str, width: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a written table in the shared folder, and its path for ``forget``.

    What is read again has its true size for the planner, and no lineage. The table has at most ``width`` files, two
    per core unless given: every file costs an executor some forked processes where the folder is on a local file
    system, and small files cost a store of objects as much as large ones.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.coalesce(width or 2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def public_vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; any other path can be given instead."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


#: A vocabulary is sent to the executors with each task's closure, so its file must be no larger.
MAX_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    """The driver reads the file; executors need no access to it."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {size} bytes; the bound is {MAX_VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return f.read()


#: Bits of a filter of hashes: a bound on what it takes, whatever the number of hashes; a full one lets all pass.
FILTER_BITS = 1 << 24


def maybe_in(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of bigint columns against the one column of ``hashes``: true for all that it has, seldom true for others."""
    sc = hashes.sparkSession.sparkContext
    at = lambda c, k: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = hashes.select(F.explode(F.array(*(at(F.col(hashes.columns[0]), k) for k in (1, 2)))).alias("at"))
    words = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    table_ = np.zeros(FILTER_BITS >> 6, np.uint64)
    table_[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    shared = sc.broadcast(table_)

    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        claim("filter")
        found = True
        for s in (x, y):
            i = s.to_numpy(np.int64)
            found = found & ((shared.value[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return lambda c: test(at(c, 1), at(c, 2))
