"""Flows over Structured Streaming.

``where``, ``select``, ``str_split`` and joins to a static flow work on a streaming DataFrame as they stand.
What needs state does so here: first occurrences, and folds over rows in order of arrival.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError
from millrace.flow import Flow
from millrace.operators import prev
from millrace.plans.lexer import split_commas, tokens
from millrace.session import child
from millrace.types import DEFAULTS, SPARK, key

#: A fold's keys are dealt to so many groups: a group costs a call and a row of state per batch of files, which take far longer than a key.
BUCKETS = 1 << 10


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> Flow:
    """A folder's files as they come."""
    return Flow.of(child(spark).readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def unique(flow: Flow, event_time: str | None = None, delay: str = "1 hour") -> Flow:
    """First occurrences; with ``event_time`` (an int column of microseconds) state older than ``delay`` is let go."""
    if event_time is None:
        return replace(flow, rows=flow.rows.dropDuplicates(list(flow.tags)))
    timed = flow.rows.withColumn("__time", F.timestamp_micros(event_time)).withWatermark("__time", delay)
    return replace(flow, rows=timed.dropDuplicatesWithinWatermark(list(flow.tags)).drop("__time"))


def tumbling(flow: Flow, event_time: str, width: str, aggregate: str, heading: str | None = None, delay: str = "1 hour") -> Flow:
    """An aggregate by window of event time and all other columns; late rows beyond ``delay`` are dropped."""
    by = [F.window("__time", width).start.alias("w"), *(key(F.col(f"`{c}`"), t).alias(c) for c, t in flow.tags.items() if c not in (event_time, heading))]
    timed = flow.rows.withColumn("__time", F.timestamp_micros(event_time)).withWatermark("__time", delay)
    made = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(heading), "avg": lambda: F.avg(heading), "min": lambda: F.min(heading), "max": lambda: F.max(heading)}
    if aggregate not in made:
        raise PipelineError(f"unknown aggregate {aggregate!r}", "streaming")
    out = timed.groupBy(*by).agg(made[aggregate]().alias(f"_{aggregate}"))
    tags = {"_window": "int", **{c: t for c, t in flow.tags.items() if c not in (event_time, heading)}}
    tags[f"_{aggregate}"] = "uint" if aggregate == "count" else "double" if aggregate == "avg" else flow.tags[heading]
    names = [F.unix_micros("w").alias("_window"), *(F.col(f"`{c}`") for c in list(tags)[1:])]
    return Flow(out.select(*names), tags)


def fold(flow: Flow, by: list[str], outputs: str) -> Flow:
    """``select`` with ``_rownum`` and references to the previous row, per key, in order of arrival.

    The state is one row for each of ``BUCKETS`` groups of keys, with number and outputs of each key's last row; a task
    holds one group's keys at a time. Without keys it goes over all rows, one after the other, as numbering a whole stream has to.
    """
    parsed = [Flow._output(p) for p in split_commas(tokens(outputs))]
    if any(tag is None for _, tag, _ in parsed):
        raise PipelineError("each output needs a type, as in 'x + prev.s as int:s'", "streaming.fold")
    schema = T.StructType([*(T.StructField(c, SPARK[flow.tags[c]]) for c in by), *(T.StructField(n, SPARK[t]) for _, t, n in parsed)])
    start = {n: DEFAULTS[t] for _, t, n in parsed}
    made = [(n, prev.compiled(e, flow.tags, {n: t for _, t, n in parsed})[0]) for e, _, n in parsed]

    def run(_, batches, held):
        import pandas as pd

        known = {tuple(k): (number, dict(zip(start, values))) for k, number, *values in json.loads(held.get[0])} if held.exists else {}
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                keys = [row[c] for c in by]
                at = tuple(None if k != k else k for k in keys)  # NaNs are one key, and nulls there are none
                number, previous = known.get(at, (0, start))
                number += 1
                previous = {n: act(row, previous, number) for n, act in made}
                known[at] = number, previous
                out.append((*keys, *previous.values()))
            yield pd.DataFrame(out, columns=schema.names)
        held.update((json.dumps([[k, number, *values.values()] for k, (number, values) in known.items()]),))

    zeros = {c: F.when(F.col(f"`{c}`") == 0, 0.0).otherwise(F.col(f"`{c}`")) for c in by if flow.tags[c] == "double"}  # 0.0 and -0.0 are one key
    rows = flow.rows.withColumns(zeros) if zeros else flow.rows
    bucket = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by)), F.lit(BUCKETS)) if by else F.lit(0)
    rows = rows.withColumn("__bucket", bucket).groupBy("__bucket").applyInPandasWithState(run, schema, "known string", "append", "NoTimeout")
    return Flow(rows, {**{c: flow.tags[c] for c in by}, **{n: t for _, t, n in parsed}})
