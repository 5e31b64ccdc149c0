import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], (float, int)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in ("except_idiom", "join_anti")
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert shown(df.columns, rows) == shown(names, found.fetchall())


def test_split_files_are_one_scan(spark, monkeypatch):
    from millrace.sources import text

    scans, lines = [], text.lines
    monkeypatch.setattr(text, "lines", lambda *a, **b: scans.append(a) or lines(*a, **b))
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert orders > 10_000  # so two files at least
    assert QUERIES["record_split"](spark, "/root/testdata/sf0.01").first()[0] == orders and len(scans) == 1
