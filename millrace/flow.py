"""Flow: an immutable, typed, lazily evaluated stream of records over a DataFrame.

A flow has its visible columns with type tags, and hidden columns that keep the order of its rows. The
order costs nothing until an operator asks for it: Catalyst prunes hidden columns that are never used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError
from millrace.functions import patterns
from millrace.functions.table import Env, Settings, Typed, lower
from millrace.operators import exact, hashing, ordered, prev
from millrace.plans.lexer import Token, split_commas, tokens
from millrace.plans.parser import Node, parse
from millrace.session import child, cut, moved
from millrace.types import SPARK, TEXTUAL, default, enter, from_text, key, split_heading, to_text

HIDDEN = "__o"


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Flow:
    rows: DataFrame
    tags: dict[str, str]
    order: tuple[tuple[str, bool], ...] = ()  # hidden columns, and whether each ascends
    sorted: bool = False
    settings: Settings = Settings()
    strict: bool = True

    # -- sources ---------------------------------------------------------------------------------
    @staticmethod
    def of(df: DataFrame, order_by: list[str] | None = None, settings: Settings | None = None) -> Flow:
        """Of any DataFrame: columns are widened to the seven types, others left out. ``order_by`` declares a unique key as the order of rows."""
        df = moved(df)
        cols, tags = enter(df)
        hidden = [F.col(f"`{c}`").alias(f"{HIDDEN}{i}") for i, c in enumerate(order_by or ())]
        return Flow(df.select(*cols, *hidden), tags, tuple((f"{HIDDEN}{i}", True) for i in range(len(hidden))), settings=settings or Settings())

    @staticmethod
    def parquet(spark: SparkSession, *paths: str, settings: Settings | None = None) -> Flow:
        """Files with equal schemas, one after the other; the order is that of files and of rows in them."""
        spark = child(spark)
        parts = []
        for i, path in enumerate(paths):
            df = spark.read.parquet(path)
            cols, tags = enter(df)
            if parts and tags != parts[0][1]:
                raise PipelineError(f"{path} has other headings than {paths[0]}", "io.file.read")
            parts.append((df.select(*cols, F.lit(i).alias(f"{HIDDEN}0"), F.col("_metadata.file_path").alias(f"{HIDDEN}1"), F.col("_metadata.row_index").alias(f"{HIDDEN}2")), tags))
        rows = parts[0][0]
        for p, _ in parts[1:]:
            rows = rows.unionByName(p)
        return Flow(rows, parts[0][1], tuple((f"{HIDDEN}{i}", True) for i in range(3)), settings=settings or Settings())

    @staticmethod
    def sequence(spark: SparkSession, start: int, end: int) -> Flow:
        rows = child(spark).range(start, end).select(F.col("id").alias("_seq"), F.col("id").alias(f"{HIDDEN}0"))
        return Flow(rows, {"_seq": "int"}, ((f"{HIDDEN}0", True),))

    # -- looking at it ---------------------------------------------------------------------------
    @property
    def headings(self) -> list[str]:
        return [f"{t}:{c}" for c, t in self.tags.items()]

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def df(self) -> DataFrame:
        """Visible columns, in order if the flow was sorted."""
        rows = self.rows.orderBy(*ordered.directed(list(self.order))) if self.sorted else self.rows
        return rows.select(*(_column(c).alias(c, metadata={"millrace.type": t}) for c, t in self.tags.items()))

    def plain(self) -> DataFrame:
        """As ``df``, with istrings as ordinary strings."""
        return self.df().select(*(_column(c).cast("string").alias(c) if t == "istring" else _column(c) for c, t in self.tags.items()))

    def pipe(self, step: Callable[[Flow], Flow]) -> Flow:
        return step(self)

    # -- helpers ---------------------------------------------------------------------------------
    def _find(self, heading: str, operator: str) -> str:
        tag, name = split_heading(heading)
        if name not in self.tags or tag is not None and self.tags[name] != tag:
            raise PipelineError(f"no heading {heading!r} among {', '.join(self.headings)}", operator)
        return name

    def _env(self, rownum: str | None = None) -> Env:
        number = (lambda: F.col(rownum)) if rownum else None
        return Env({c: Typed(_column(c), t) for c, t in self.tags.items()}, self.settings, number)

    def _ordered(self, operator: str) -> None:
        if not self.order:
            raise PipelineError("rows have no order here; sort them first", operator)

    def _numbered(self, nodes: list[Node], operator: str) -> tuple[Flow, str | None]:
        """With a hidden row number if any expression asks for it."""
        if not any(n.kind == "column" and n.name.rpartition(".")[2] == "_rownum" for e in nodes for n in e.walk()):
            return self, None
        self._ordered(operator)
        return replace(self, rows=ordered.numbered(self.rows, list(self.order), "__rownum")), "__rownum"

    def _keys(self, names: list[str], operator: str, doubles: bool = False) -> None:
        for c in names:
            if self.tags[c] == "double" and self.strict and not doubles:
                raise PipelineError(f"the double {c!r} can't be a key", operator)

    # -- projection, filter, assertion -------------------------------------------------------------
    def where(self, condition: str | list[Token]) -> Flow:
        node = parse(tokens(condition) if isinstance(condition, str) else condition)
        if (limit := self._top(node)) is not None:
            return replace(self, rows=self.rows.orderBy(*ordered.directed(list(self.order))).limit(limit))
        flow, number = self._numbered([node], "rel.where")
        found = lower(node, flow._env(number))
        if found.tag != "bool":
            raise PipelineError(f"the condition is {found.tag}, not bool", "rel.where")
        rows = flow.rows.where(found.col)
        return replace(flow, rows=rows.drop(number) if number else rows)

    def _top(self, node: Node) -> int | None:
        """k of ``_rownum <= kU`` on a sorted flow: the first k rows, without numbering any."""
        if not self.sorted or node.kind != "call" or node.name not in ("<", "<="):
            return None
        a, b = node.args
        if a.kind == "column" and a.name == "_rownum" and b.kind == "literal" and b.tag == "uint":
            return max(0, b.value - (node.name == "<"))
        return None

    def select(self, outputs: str | list[Token]) -> Flow:
        parsed = [self._output(p) for p in split_commas(tokens(outputs) if isinstance(outputs, str) else outputs)]
        if not parsed:
            raise PipelineError("nothing is selected", "rel.select")
        names = [n for _, _, n in parsed]
        if len(set(names)) < len(names):
            raise PipelineError("two outputs have one name", "rel.select")
        if any(prev.refers(e) for e, _, _ in parsed):
            return self._select_prev(parsed)
        flow, number = self._numbered([e for e, _, _ in parsed], "rel.select")
        cols, tags = [], {}
        for e, tag, name in parsed:
            c, tags[name] = self._labelled(lower(e, flow._env(number)), tag)
            cols.append(c.alias(name))
        return replace(flow, rows=flow.rows.select(*cols, *(F.col(o) for o, _ in self.order)), tags=tags)

    @staticmethod
    def _output(found: list[Token]) -> tuple[Node, str | None, str]:
        if len(found) > 2 and found[-2].kind == "name" and found[-2].text == "as":
            tag, name = split_heading(found[-1].text)
            return parse(found[:-2]), tag, name
        if len(found) == 1 and found[0].kind == "name":
            return parse(found), None, split_heading(found[0].text.removeprefix("this."))[1]
        raise PipelineError("'as' and a name are missing", "rel.select", found[0].line)

    @staticmethod
    def _labelled(found: Typed, tag: str | None) -> tuple[Column, str]:
        """Under another tag a value is what its text reads as."""
        if tag is None or tag == found.tag:
            return found.col, found.tag
        if tag in TEXTUAL and found.tag in TEXTUAL:
            return found.col.cast("string").cast(SPARK[tag]), tag
        if (found.tag, tag) in (("int", "uint"), ("uint", "int")):
            return found.col, tag
        return from_text(to_text(found.col, found.tag), tag), tag

    def _select_prev(self, parsed: list[tuple[Node, str | None, str]]) -> Flow:
        self._ordered("rel.select")
        tags: dict[str, str] = {}
        names = {n for _, _, n in parsed}
        for wanted in set().union(*(prev.refers(e) for e, _, _ in parsed)):
            if split_heading(wanted)[1] not in names:
                raise PipelineError(f"prev.{wanted} is no output", "rel.select")
        waiting = list(parsed)
        while waiting:  # a type may follow from one of the previous row's outputs
            rest, reason = [], None
            for e, tag, name in waiting:
                env = replace(self._env("__rownum"), previous=lambda h: Typed(F.lit(None).cast(SPARK[tags[split_heading(h)[1]]]), tags[split_heading(h)[1]]))
                try:
                    tags[name] = tag or self._typed(e, env, name)
                except KeyError as k:
                    rest.append((e, tag, name))
                    reason = k
            if len(rest) == len(waiting):
                raise PipelineError(f"the type of {reason} can't be found", "rel.select")
            waiting = rest
        rows = ordered.ranged(self.rows, list(self.order))
        before = ordered.carried(rows, {"n": F.count(F.lit(1))}, lambda c, r: c + r.n, 0)
        rows = ordered.offset(rows, before, "long", "__before").withColumn("__rownum", F.col(ordered.AT) + F.col("__before")).drop("__before")
        env, done = self._env("__rownum"), {}
        for e, tag, name in parsed:
            if not prev.refers(e):
                rows = rows.withColumn(f"__out_{name}", self._labelled(lower(e, env), tag)[0])
                done[name] = f"__out_{name}"
        left = [p for p in parsed if p[2] not in done]
        for e, tag, name in left:
            found = prev.recurrence(e, name)
            if found and tag in (None, tags[name]) and tags[name] in ("int", "uint", "double"):
                own = lower(found[1], env)
                if own.tag == tags[name]:
                    # the greatest and least of uints go by what they are compared by
                    turned = own.tag == "uint" and found[0] != "sum"
                    rows = rows.withColumn("__own", key(own.col, "uint") if turned else own.col)
                    rows = ordered.running(rows, "__own", found[0], 0.0 if own.tag == "double" else -(1 << 63) if turned else 0, f"__out_{name}").drop("__own")
                    if turned:
                        rows = rows.withColumn(f"__out_{name}", key(F.col(f"__out_{name}"), "uint"))
                    done[name] = f"__out_{name}"
        left = [p for p in parsed if p[2] not in done]
        if all({split_heading(h)[1] for h in prev.refers(e)} <= set(done) for e, _, _ in left):
            for wanted in sorted({split_heading(h)[1] for e, _, _ in left for h in prev.refers(e)}):
                rows = ordered.lagged(rows, done[wanted], default(tags[wanted]), f"__prev_{wanted}")
            env.previous = lambda h: Typed(F.col(f"__prev_{split_heading(h)[1]}"), tags[split_heading(h)[1]])
            for e, tag, name in left:
                rows = rows.withColumn(f"__out_{name}", self._labelled(lower(e, env), tag)[0])
        else:
            return self._fold(parsed, tags)
        keep = [F.col(f"`__out_{n}`").alias(n) for _, _, n in parsed]
        return replace(self, rows=rows.select(*keep, *(F.col(o) for o, _ in self.order)), tags={n: tags[n] for _, _, n in parsed})

    @staticmethod
    def _typed(node: Node, env: Env, name: str) -> str:
        found = prev.recurrence(node, name)
        return lower(found[1], env).tag if found else lower(node, env).tag

    def _fold(self, parsed: list[tuple[Node, str | None, str]], tags: dict[str, str]) -> Flow:
        """In order, in one task: a recurrence needs each row before the next. Other tasks sort; this one holds a batch."""
        from millrace.types import DEFAULTS

        # what was sorted goes on by the rows' numbers, which are far shorter than all that it was sorted by
        hidden, counted = ([], [T.StructField(f"{HIDDEN}0", T.LongType())]) if self.sorted else ([o for o, _ in self.order], [])
        schema = T.StructType([*(T.StructField(n, SPARK[tags[n]]) for _, _, n in parsed), *(self.rows.schema[o] for o in hidden), *counted])
        start = {n: DEFAULTS[tags[n]] for _, _, n in parsed}
        made = []  # types are known and functions found before a job runs
        for e, tag, name in parsed:
            act, found = prev.compiled(e, self.tags, tags)
            if tag not in (None, found) and not (tag in TEXTUAL and found in TEXTUAL or {tag, found} == {"int", "uint"}):
                raise PipelineError(f"{name!r} is {found}; with prev it can't become {tag}", "rel.select")
            made.append((name, act))
        named = {split_heading(n.name.removeprefix("this."))[1] for e, _, _ in parsed for n in e.walk() if n.kind == "column"}
        columns = [c for c in self.tags if c in named]

        def run(batches):
            import pandas as pd

            previous, number = dict(start), 0
            for batch in ordered.in_turn(batches):
                out: list[list] = [[] for _ in made]
                for values in zip(*(batch[c].tolist() for c in columns)) if columns else repeat((), len(batch)):
                    row = dict(zip(columns, values))
                    number += 1
                    previous = {n: act(row, previous, number) for n, act in made}
                    for held, v in zip(out, previous.values()):
                        held.append(v)
                places = {c.name: range(number - len(batch) + 1, number + 1) for c in counted}
                yield pd.DataFrame({**{n: pd.Series(v, dtype=object) for (n, _), v in zip(made, out)}, **{o: batch[o] for o in hidden}, **places}, columns=schema.names)

        keys = [o for o, _ in self.order]
        one = ordered.one_task(self.rows.select(*map(_column, (*columns, *keys))), list(self.order), list(map(_column, (*columns, *hidden))))
        order = tuple((c.name, True) for c in counted) or self.order
        return replace(self, rows=ordered.dealt(cut(one.mapInPandas(run, schema)), list(order)), tags={n: tags[n] for _, _, n in parsed}, order=order)

    def assert_empty(self) -> Flow:
        if not self.rows.isEmpty():
            raise PipelineError("there are records", "rel.assert.empty")
        return replace(self, rows=self.rows.limit(0))

    def assert_nonempty(self) -> Flow:
        if self.rows.isEmpty():
            raise PipelineError("there are no records", "rel.assert.nonempty")
        return self

    def str_split(self, heading: str, pattern: str) -> Flow:
        """A row per piece, with ``_counter`` from 0; empty pieces stay."""
        name = self._find(heading, "rel.str_split")
        if self.tags[name] not in TEXTUAL:
            raise PipelineError(f"{heading!r} is no string", "rel.str_split")
        import re as python_re

        try:
            empty = python_re.compile(pattern).match("") is not None
        except python_re.error:
            empty = False
        if empty:
            raise PipelineError(f"the pattern {pattern!r} matches nothing at all, which never ends", "rel.str_split")
        pieces = F.split(_column(name).cast("string"), patterns.regex(pattern, self.tags[name] == "istring"), -1)
        rows = self.rows.select("*", F.posexplode(pieces).alias("__at", "__piece"))
        cols = [F.col("__piece").cast(SPARK[self.tags[name]]).alias(c) if c == name else _column(c) for c in self.tags]
        deeper = f"{HIDDEN}{len(self.order)}"
        order = (*self.order, (deeper, True)) if self.order else ()
        hidden = [*(F.col(o) for o, _ in self.order), *([F.col("__at").alias(deeper)] if self.order else [])]
        return replace(self, rows=rows.select(*cols, F.col("__at").cast("long").alias("_counter"), *hidden), tags={**self.tags, "_counter": "uint"}, order=order)

    # -- joins -----------------------------------------------------------------------------------
    def _shared(self, other: Flow, operator: str) -> list[str]:
        shared = [c for c, t in self.tags.items() if other.tags.get(c) == t]
        self._keys(shared, operator)
        return shared

    def _joined(self, other: Flow, how: str) -> tuple[DataFrame, list[str], dict[str, str]]:
        """Rows of both, the shared keys, and the right side's own columns by their visible names."""
        shared = self._shared(other, f"rel.join.{how}")
        right, own = [], {}
        for c in other.tags:
            if c not in shared:
                name = c if c not in self.tags else f"{c}_{other.tags[c]}"
                own[name] = other.tags[c]
                right.append(_column(c).alias(name))
        on = [key(_column(c), other.tags[c]).alias(f"__k{i}") for i, c in enumerate(shared)]
        rows = other.rows.select(*right, *on, F.lit(True).alias("__match"))
        test = F.lit(True)
        for i, c in enumerate(shared):
            test = test & (key(_column(c), self.tags[c]) == F.col(f"__k{i}"))
        if how == "anti":
            return self.rows.join(rows, test, "left_anti"), shared, own
        # without keys each pair matches; that is what a natural join of unrelated headings is
        both = self.rows.join(rows, test, {"natural": "inner", "left": "left"}[how]) if shared else self.rows.crossJoin(rows) if how == "natural" else self.rows.join(rows, F.lit(True), "left")
        return both, shared, own

    def join_natural(self, other: Flow) -> Flow:
        rows, _, own = self._joined(other, "natural")
        return replace(self, rows=rows.select(*map(_column, self.tags), *map(_column, own), *(F.col(o) for o, _ in self.order)), tags={**self.tags, **own})

    def join_left(self, other: Flow) -> Flow:
        rows, _, own = self._joined(other, "left")
        filled = [F.when(F.col("__match"), _column(c)).otherwise(default(t)).alias(c) for c, t in own.items()]
        return replace(self, rows=rows.select(*map(_column, self.tags), *filled, *(F.col(o) for o, _ in self.order)), tags={**self.tags, **own})

    def join_anti(self, other: Flow) -> Flow:
        return replace(self, rows=self._joined(other, "anti")[0])

    def join_consistent_hash(self, other: Flow) -> Flow:
        """Each row with the row of ``other`` whose point on the 64-bit ring is the next at or after its own.

        Points of both sides are sorted by ranges and each row takes the last point of ``other`` before it in
        descending order, so neither side is broadcast.
        """
        if set(self.tags) & set(other.tags):
            raise PipelineError("the two have headings in common", "rel.join.consistent_hash")
        from pyspark.sql import Window as W

        def point(tags: dict[str, str], probe: Column | None = None) -> Column:
            """On the ring, in the order of signed numbers."""
            data = F.concat(*(to_text(_column(c), t).cast("string").cast("binary") for c, t in tags.items()))
            return hashing.fnv(data, F.lit(0).cast("long") if probe is None else probe).bitwiseXOR(F.lit(-(1 << 63)))

        # equal rows probe on: the n-th of them has the point of probe n
        by = W.partitionBy(*map(_column, other.tags)).orderBy(*(ordered.directed(list(other.order)) or [F.lit(0)]))
        right = other.rows.withColumn("__probe", (F.row_number().over(by) - 1).cast("long"))
        right = cut(right.select(point(other.tags, F.col("__probe")).alias("__point"), *map(_column, other.tags)).dropDuplicates(["__point"]))
        first = right.agg(F.min("__point")).first()[0]
        if first is None:
            raise PipelineError("the right side is empty", "rel.join.consistent_hash")
        hidden = [o for o, _ in self.order]
        left = self.rows.select(point(self.tags).alias("__at_point"), F.lit(1).alias("__turn"), F.struct(*map(_column, (*self.tags, *hidden))).alias("__left"))
        marks = right.select(F.col("__point").alias("__at_point"), F.lit(0).alias("__turn"), F.lit(None).cast(left.schema["__left"].dataType).alias("__left"))
        rows = ordered.ranged(marks.unionByName(left), [("__at_point", False), ("__turn", True)])
        # only points are handed on; the rows that they stand for are joined afterwards
        rows = ordered.last_marked(rows, F.when(F.col("__turn") == 0, F.col("__at_point")), "__found", "bigint").where("__turn = 1")
        found = rows.select("__left.*", F.coalesce("__found", F.lit(first)).alias("__point")).join(right, "__point")
        return replace(self, rows=found.select(*map(_column, self.tags), *map(_column, other.tags), *(F.col(o) for o in hidden)), tags={**self.tags, **other.tags})

    # -- aggregation -----------------------------------------------------------------------------
    def group(self, aggregate: str, heading: str | None = None) -> Flow:
        """One aggregate of a column by all others; ``count`` by all columns."""
        operator = f"rel.group({aggregate})"
        if aggregate == "count":
            if heading:
                raise PipelineError("count takes no heading", operator)
            self._keys(list(self.tags), operator)
            return self._grouped(list(self.tags), {"_count": (F.count(F.lit(1)), "uint")})
        if aggregate not in ("sum", "avg", "min", "max", "median", "sum_count"):
            raise PipelineError(f"unknown aggregate {aggregate!r}", operator)
        if not heading:
            raise PipelineError("a heading is missing", operator)
        name = self._find(heading, operator)
        tag, c = self.tags[name], _column(name)
        if aggregate != "median" and tag not in ("int", "uint", "double"):
            raise PipelineError(f"{name!r} is {tag}, not a number", operator)
        keys = [k for k in self.tags if k != name]
        self._keys(keys, operator)
        whole = tag != "double"
        if not whole and aggregate in ("sum", "sum_count", "avg"):
            total, n = self._totals(keys, name)
            return self._over(total, keys, {"sum": {"_sum": (F.col("__total"), tag)}, "sum_count": {"_sum": (F.col("__total"), tag), "_count": (n, "uint")}, "avg": {"_avg": (F.col("__total") / n, tag)}}[aggregate])
        if aggregate == "sum":
            return self._grouped(keys, {"_sum": (F.sum(c), tag)})
        if aggregate == "sum_count":
            return self._grouped(keys, {"_sum": (F.sum(c), tag), "_count": (F.count(F.lit(1)), "uint")})
        if aggregate == "avg":
            return self._grouped(keys, {"_avg": (F.call_function("div", F.sum(c), F.count(F.lit(1))), tag)})
        if aggregate == "median" and tag != "double":
            return self._counted_median(keys, name)
        if aggregate == "median":
            return self._grouped(keys, {"_median": (self._median(c, tag), tag)})
        extreme = (F.min if aggregate == "min" else F.max)(key(c, tag))
        out = self._grouped(keys, {name: (key(extreme, tag), tag)})
        return replace(out, rows=out.rows.select(*map(_column, self.tags)), tags=dict(self.tags))

    @staticmethod
    def _median(c: Column, tag: str) -> Column:
        """The lower one: of n values the one at half of n, rounded up."""
        if tag == "double":
            return F.expr(f"percentile_disc(0.5) within group (order by {c._jc.toString() if hasattr(c, '_jc') else c})")
        raise AssertionError(tag)  # whole values are counted

    def _counted_median(self, keys: list[str], name: str) -> Flow:
        """The lower median of whole values: distinct ones are counted, and the counts summed up in order, so no group's values are held."""
        from pyspark.sql import Window as W

        tag = self.tags[name]
        by = [key(_column(k), self.tags[k]).alias(f"__g{i}") for i, k in enumerate(keys)] or [F.lit(1).alias("__g0")]
        shown = [F.min(_column(k)).alias(f"__s{i}") for i, k in enumerate(keys) if self.tags[k] == "ipaddress"]
        groups = [f"__g{i}" for i in range(len(by))]
        counts = self.rows.groupBy(*by, key(_column(name), tag).alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.min(_column(name)).alias("__x"), *shown)
        order = W.partitionBy(*groups).orderBy("__v")
        upto = counts.withColumn("__upto", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        total = counts.groupBy(*groups).agg(F.sum("__n").alias("__all"))
        # the first value by which half of all, rounded up, is reached; groups are few beside values
        picked = upto.join(total, groups).where("__upto * 2 >= __all and (__upto - __n) * 2 < __all")
        cols = [(F.col(f"__s{i}") if self.tags[k] == "ipaddress" else key(F.col(f"__g{i}"), self.tags[k])).alias(k) for i, k in enumerate(keys)]
        value = F.col("__x") if tag in ("ipaddress", "istring") else key(F.col("__v"), tag)
        return replace(self, rows=picked.select(*cols, value.alias("_median")), tags={**{k: self.tags[k] for k in keys}, "_median": tag}, order=(), sorted=False)

    def _by(self, keys: list[str]) -> tuple[list[Column], list[Column]]:
        # uint keys turn back from their sortable form; addresses keep a spelling
        by = [key(_column(k), self.tags[k]).alias(f"__g{i}") for i, k in enumerate(keys)]
        return by or [F.lit(1).alias("__one")], [F.min(_column(k)).alias(f"__s{i}") for i, k in enumerate(keys) if self.tags[k] == "ipaddress"]  # no rows, no group

    def _over(self, aggregated: DataFrame, keys: list[str], out: dict[str, tuple[Column, str]]) -> Flow:
        cols = [(F.col(f"__s{i}") if self.tags[k] == "ipaddress" else key(F.col(f"__g{i}"), self.tags[k])).alias(k) for i, k in enumerate(keys)]
        tags = {**{k: self.tags[k] for k in keys}, **{n: t for n, (_, t) in out.items()}}
        return replace(self, rows=aggregated.select(*cols, *(c.alias(n) for n, (c, _) in out.items())), tags=tags, order=(), sorted=False)

    def _grouped(self, keys: list[str], out: dict[str, tuple[Column, str]]) -> Flow:
        by, shown = self._by(keys)
        aggregated = self.rows.groupBy(*by).agg(*(c.alias(n) for n, (c, _) in out.items()), *shown)
        return self._over(aggregated, keys, {n: (_column(n), t) for n, (_, t) in out.items()})

    def _totals(self, keys: list[str], name: str, counts: Column | None = None) -> tuple[DataFrame, Column]:
        """A row per group with ``__total``, the sum of doubles rounded once; and the number of its rows, or the sum of ``counts``."""
        by, shown = self._by(keys)
        n = F.count(F.lit(1)) if counts is None else F.sum(counts)
        if self.rows.isStreaming:  # there only one aggregation can be
            return self.rows.groupBy(*by).agg(F.sum(_column(name)).alias("__total"), n.alias("__n"), *shown), F.col("__n")
        groups, again = [f"__g{i}" for i in range(len(keys))] or ["__one"], [F.min(f"__s{i}").alias(f"__s{i}") for i, k in enumerate(keys) if self.tags[k] == "ipaddress"]
        rows = self.rows.withColumn("__level", exact.level(_column(name)))
        levels = rows.groupBy(*by, "__level").agg(*exact.partial(_column(name), F.col("__level")), n.alias("__n"), *shown)
        whole = levels.groupBy(*groups).agg(F.collect_list(F.struct("__level", *exact.PARTS)).alias("__parts"), F.sum("__odd").alias("__odd"), F.sum("__n").alias("__n"), *again)
        return whole.withColumn("__total", exact.total(F.col("__parts"), F.col("__odd"))), F.col("__n")

    def merge_avg(self) -> Flow:
        """From ``_sum`` and ``_count`` of parts the average of all."""
        keys = [k for k in self.tags if k not in ("_sum", "_count")]
        tag, n = self.tags[self._find("_sum", "merge_avg")], self._find("_count", "merge_avg")
        if tag == "double":
            rows, n = self._totals(keys, "_sum", _column(n))
            return self._over(rows, keys, {"_avg": (F.col("__total") / n, tag)})
        return self._grouped(keys, {"_avg": (F.call_function("div", F.sum("_sum"), F.sum(n)), tag)})

    def record_count(self) -> Flow:
        return replace(self, rows=self.rows.agg(F.count(F.lit(1)).alias("_count")), tags={"_count": "uint"}, order=(), sorted=False)

    # -- order -----------------------------------------------------------------------------------
    def order_by(self, *headings: str, desc: bool = False) -> Flow:
        """Stable; descending is the exact reverse, ties included."""
        operator = "rel.order_by"
        if not headings:
            raise PipelineError("no heading to sort by", operator)
        names = [self._find(h, operator) for h in headings]
        n = len(self.order)
        old = [F.col(o).alias(f"{HIDDEN}{len(names) + i}") for i, (o, _) in enumerate(self.order)]
        new = [key(_column(c), self.tags[c]).alias(f"{HIDDEN}{i}") for i, c in enumerate(names)]
        order = [(f"{HIDDEN}{i}", not desc) for i in range(len(names))] + [(f"{HIDDEN}{len(names) + i}", up != desc) for i, (_, up) in enumerate(self.order)]
        del n
        return replace(self, rows=self.rows.select(*map(_column, self.tags), *new, *old), order=tuple(order), sorted=True)

    def unique(self) -> Flow:
        """Of equal rows the first; without an order any spelling of an istring may stay."""
        self._keys(list(self.tags), "rel.unique")
        by = [key(_column(c), t).alias(f"__g{i}") for i, (c, t) in enumerate(self.tags.items())]
        cols = [*self.tags, *(o for o, _ in self.order)]
        if not self.order:
            if not any(t in ("ipaddress",) for t in self.tags.values()):
                return replace(self, rows=self.rows.dropDuplicates(list(self.tags)))
            first = self.rows.groupBy(*by).agg(F.first(F.struct(*map(_column, cols))).alias("x"))
            return replace(self, rows=first.select("x.*"))
        if len({up for _, up in self.order}) == 1:  # a partial aggregate does, however often a row occurs
            pick = F.min_by if self.order[0][1] else F.max_by
            first = self.rows.groupBy(*by).agg(pick(F.struct(*map(_column, cols)), F.struct(*(F.col(o) for o, _ in self.order))).alias("x"))
            return replace(self, rows=first.select("x.*"))
        rows = ordered.numbered(self.rows, list(self.order), "__rownum")
        first = rows.groupBy(*by).agg(F.min_by(F.struct(*map(_column, cols)), "__rownum").alias("x"))
        return replace(self, rows=first.select("x.*"))

    def followed_by(self, *others: Flow) -> Flow:
        """All rows of this flow, then those of the others, each in its own order; an order that one of them lacks, none has."""
        flows = [self, *others]
        if any(f.tags != self.tags for f in flows):
            raise PipelineError("the headings differ", "io.file.read")
        if not all(f.order for f in flows) or any(not up for f in flows for _, up in f.order) or any([f.rows.schema[o].dataType for o, _ in f.order] != [self.rows.schema[o].dataType for o, _ in self.order] for f in flows):
            out = self
            for f in others:
                out = out.union(f)
            return out
        parts = [f.rows.select(*map(_column, self.tags), F.lit(i).alias(f"{HIDDEN}0"), *(F.col(o).alias(f"{HIDDEN}{k + 1}") for k, (o, _) in enumerate(f.order))) for i, f in enumerate(flows)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return replace(self, rows=rows, order=tuple((f"{HIDDEN}{k}", True) for k in range(len(self.order) + 1)), sorted=False)

    def union(self, other: Flow) -> Flow:
        if self.tags != other.tags:
            raise PipelineError("the headings differ", "union")
        return replace(self, rows=self.rows.select(*map(_column, self.tags)).unionByName(other.rows.select(*map(_column, other.tags))), order=(), sorted=False)
