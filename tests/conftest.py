import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    yield SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{at}/shared").config("spark.sql.warehouse.dir", f"{at}/warehouse").getOrCreate()


@pytest.fixture
def flow_of(spark):
    """A flow from headings (type:name) and rows, in the order given."""
    from dataclasses import replace

    from pyspark.sql import types as T

    from millrace.flow import Flow
    from millrace.session import child
    from millrace.types import SPARK, split_heading

    def make(headings, rows, **more):
        found = [split_heading(h) for h in headings]
        schema = T.StructType([*(T.StructField(n, SPARK[t]) for t, n in found), T.StructField("__o0", T.LongType())])
        df = child(spark).createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
        return replace(Flow(df, {n: t for t, n in found}, (("__o0", True),)), **more)

    return make


def listed(flow):
    """Rows in order, as tuples."""
    from millrace.operators.ordered import directed

    rows = flow.rows.orderBy(*directed(list(flow.order))) if flow.order else flow.rows
    return [tuple(r[c] for c in flow.tags) for r in rows.collect()]
