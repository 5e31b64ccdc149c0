import pytest
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import claim, forget, keep, maybe_in, on_release, shared_dir


def test_filter_passes_all_that_it_has(spark):
    some = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    every = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    found = {r.id for r in every.where(maybe_in(some)(F.col("h"))).collect()}
    assert {*range(0, 3000, 3)} <= found and len(found) < 1100
    assert every.where(maybe_in(some.limit(0))(F.col("h"))).count() == 0


def test_a_full_filter_lets_all_pass(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    some = spark.range(5000).select(F.xxhash64("id").alias("h"))
    assert spark.range(9000, 9100).where(maybe_in(some)(F.xxhash64("id"))).count() == 100


def test_kept_tables(spark):
    df, path = keep(spark.range(100).repartition(40), "test", 3)
    assert df.count() == 100 and len([f for f in df.inputFiles() if "part-" in f]) <= 3
    empty, at = keep(df.where("id < 0"), "test")
    assert empty.count() == 0 and empty.columns == ["id"]
    forget(spark, path, at)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_claim_empties_what_others_keep():
    held = {1: 2}
    on_release(held.clear)
    claim("a")
    held[1] = 2
    claim("a")
    assert held
    claim("b")
    assert not held
    common._releases.remove(held.clear) if held.clear in common._releases else None
