"""Row numbers and what depends on the order of rows, without gathering all rows in one task.

Rows are dealt out by ranges of their order and sorted; each partition numbers its own, and what one
passes on to the next (a count, a sum, a last value: a row per partition) is gathered on the driver.
The sorted rows are written to the shared folder before they are numbered, so numbers can't move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import cut

PART, AT = "__part", "__at"


def directed(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def ranged(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Adds the partition's number, ascending with the order, and the row's position in it, from 1."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = directed(order)
    dealt = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()))
    return dealt.withColumn(AT, F.col(AT).bitwiseAND((1 << 33) - 1) + 1)


def one_task(df: DataFrame, order: list[tuple[str, bool]], columns: list[Column]) -> DataFrame:
    """``columns`` in the order, in one task that reads the sorted ranges one after the other: it neither sorts nor holds them. For ``in_turn``."""
    return ranged(df, order).select(*columns, PART).coalesce(1)


def dealt(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """What one task has written, by ranges: a sort that comes later would otherwise take place in one task too."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *directed(order))


def in_turn(batches):
    """The batches of ``one_task``, whose ranges have to come in their order."""
    before = 0
    for b in batches:
        parts = b.pop(PART)
        if len(parts) and not (parts.is_monotonic_increasing and parts.iloc[0] >= before):
            raise RuntimeError("ranges of rows came out of order")
        before = parts.iloc[-1] if len(parts) else before
        yield b


def carried(rows: DataFrame, values: dict[str, Column], step: Callable, start):
    """By partition number, what the partitions before it have left: ``step(carry, row)`` adds one partition's aggregated row."""
    out, carry = {}, start
    found = {r[PART]: r for r in rows.groupBy(PART).agg(*(c.alias(k) for k, c in values.items())).collect()}  # a row per partition
    for part in sorted(found):
        out[part] = carry
        carry = step(carry, found[part])
    return out


def offset(rows: DataFrame, by_part: dict[int, object], kind: str, name: str) -> DataFrame:
    """Adds ``name``, what belongs to the row's partition, null where nothing does; the table that is broadcast has a row per partition."""
    table = rows.sparkSession.createDataFrame([(k, v) for k, v in by_part.items()], f"{PART} int, {name} {kind}")
    return rows.join(F.broadcast(table), PART, "left")


def numbered(df: DataFrame, order: list[tuple[str, bool]], name: str) -> DataFrame:
    """Adds ``name``, the number of each row in the order, from 1."""
    rows = ranged(df, order)
    before = carried(rows, {"n": F.count(F.lit(1))}, lambda c, r: c + r.n, 0)
    return offset(rows, before, "long", "__before").withColumn(name, F.col(AT) + F.col("__before")).drop(PART, AT, "__before")


def within() -> W:
    return W.partitionBy(PART).orderBy(AT)


def lagged(rows: DataFrame, column: str, start: Column, name: str) -> DataFrame:
    """Adds ``name``, the value of ``column`` in the row before (of ``ranged`` rows), ``start`` for the first."""
    kind = rows.schema[column].dataType.simpleString()
    last = carried(rows, {"v": F.max_by(column, AT)}, lambda c, r: (r.v,), None)
    previous = F.lag(column).over(within())
    rows = offset(rows, {k: v[0] for k, v in last.items() if v is not None}, kind.split(" ")[0], "__passed")
    return rows.withColumn(name, F.when(F.col(AT) > 1, previous).otherwise(F.coalesce(F.col("__passed").cast(rows.schema[column].dataType), start))).drop("__passed")


def running(rows: DataFrame, column: str, how: str, start, name: str) -> DataFrame:
    """Adds ``name``, the running sum, greatest or least of ``column`` from ``start`` on."""
    kind = rows.schema[column].dataType.simpleString()
    aggregate = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    combine = {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    before = carried(rows, {"v": aggregate(column)}, lambda c, r: combine(c, r.v), start)
    if how == "sum" and kind == "bigint":
        before = {k: (v + (1 << 63)) % (1 << 64) - (1 << 63) for k, v in before.items()}
    own = aggregate(column).over(within().rowsBetween(W.unboundedPreceding, 0))
    rows = offset(rows, before, kind, "__base")
    base = F.coalesce("__base", F.lit(start).cast(kind))
    total = own + base if how == "sum" else F.greatest(own, base) if how == "max" else F.least(own, base)
    return rows.withColumn(name, total.cast(kind)).drop("__base")


def last_marked(rows: DataFrame, mark: Column, name: str, kind: str) -> DataFrame:
    """Adds ``name``: of ``ranged`` rows the last value of ``mark`` that isn't null, up to each row."""
    rows = rows.withColumn("__mark", mark)
    before = carried(rows, {"v": F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col(AT)))}, lambda c, r: c if r.v is None else (r.v,), None)
    own = F.last("__mark", ignorenulls=True).over(within().rowsBetween(W.unboundedPreceding, 0))
    rows = offset(rows, {k: v[0] for k, v in before.items() if v is not None}, kind, "__passed")
    return rows.withColumn(name, F.coalesce(own, "__passed")).drop("__mark", "__passed")
