"""A child session with the semantics of flows: wrapping arithmetic, case-sensitive names, UTC."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import PipelineError

CONF = {"spark.sql.ansi.enabled": "false", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.legacy.timeParserPolicy": "CORRECTED"}


def child(spark: SparkSession) -> SparkSession:
    """A new session on the same context; the caller's own is never changed."""
    if spark.conf.get("spark.millrace.child", "") == "true":
        return spark
    out = spark.newSession()
    out.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in CONF.items():
        out.conf.set(k, v)
    out.conf.set("spark.millrace.child", "true")
    return out


def moved(df: DataFrame) -> DataFrame:
    """``df`` in the child session, so that what is added to it has the semantics of flows."""
    spark = child(df.sparkSession)
    if spark is df.sparkSession:
        return df
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and all is in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise PipelineError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-checkpoint-")
