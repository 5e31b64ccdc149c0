"""Delimited text and free text, read and written as the pipeline language has it.

Lines keep their order by file and place in it. A last line without its line end is ignored, as long as
the file isn't compressed (where the end can't be looked at).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.flow import Flow
from millrace.functions import patterns
from millrace.session import child
from millrace.sources.files import expand, start_and_end
from millrace.types import from_text as typed
from millrace.types import import_heading, split_heading, to_text

ORDER = (("__o0", True), ("__o1", True), ("__o2", True))


def lines(spark: SparkSession, *paths: str, end: str = "\n", strict: bool = True) -> DataFrame:
    """value, and hidden columns of order: file, start of the block, place."""
    spark = child(spark)
    files = [f for p in paths for f in expand(spark, p)]
    if not files:
        raise PipelineError(f"no file at {', '.join(paths)}", "io.file.read")
    # one scan of all files; each has a row here, by what Spark calls it and by its place
    open_ended = [strict and not f.endswith((".gz", ".bz2", ".zst")) and start_and_end(spark, f, 1)[1] not in (b"", end.encode()) for f in files]
    named = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    known = spark.createDataFrame([(f, i, o) for i, (f, o) in enumerate(zip(files, open_ended))], "f string, __o0 int, __open boolean")
    rows = spark.read.option("lineSep", end).text(list(dict.fromkeys(files))).select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("f"), F.col("_metadata.file_block_start").alias("__o1"))
    # numbered after the join: numbers keep conditions on fields from being tried on lines that go first, like headings
    rows = rows.withColumn("f", named("f")).join(F.broadcast(known.withColumn("f", named("f"))), "f").select("value", "__o0", "__o1", F.monotonically_increasing_id().alias("__o2"), "__open")
    if any(open_ended):
        last = rows.where("__open").groupBy("__o0").agg(F.max(F.struct("__o1", "__o2")).alias("last"))
        rows = rows.join(F.broadcast(last), "__o0", "left").where("last is null or __o1 <> last.__o1 or __o2 <> last.__o2")
        rows = rows.withColumn("value", F.when(F.monotonically_increasing_id() >= 0, F.col("value")))
    return rows.select("value", "__o0", "__o1", "__o2")


def _in_order(rows: DataFrame) -> DataFrame:
    """Lines that come from no file, like those of a listing or of ``to_tsv``, have the order in which they stand."""
    if "__o0" in rows.columns:
        return rows
    return rows.select("value", F.lit(0).alias("__o0"), F.lit(0).cast("long").alias("__o1"), F.monotonically_increasing_id().alias("__o2"))


def _first(rows: DataFrame):
    return rows.where("__o0 = 0 and __o1 = 0").orderBy("__o2").limit(1).first()


def _table(rows: DataFrame, cut, operator: str, headings: list[str] | None, strict: bool = True, head: str | None = None) -> Flow:
    """``head`` is a line of headings that isn't among the rows."""
    rows = _in_order(rows)
    if headings is None:
        if head is None:
            first = _first(rows)
            if first is None:
                raise PipelineError("there is no line of headings", operator)
            head = first.value
            rows = rows.where((F.col("__o0") != 0) | (F.col("__o1") != first["__o1"]) | (F.col("__o2") != first["__o2"]))
        names = rows.sparkSession.createDataFrame([(head,)], "value string").select(cut(F.col("value")).alias("x")).first().x
        found = [import_heading(h) for h in names]
    else:
        found = [(t or "string", n) for t, n in map(split_heading, headings)]
    tags = {n: t for t, n in found}
    if len(tags) < len(found):
        raise PipelineError("a heading occurs twice", operator)
    split = rows.withColumn("__f", cut(F.col("value")))
    checked = F.when(F.size("__f") == len(found), F.col("__f")).otherwise(F.raise_error(F.concat(F.lit(f"{operator}: not {len(found)} fields: "), F.col("value"))))
    split = split.withColumn("__f", checked)
    cols = [typed(F.get("__f", F.lit(i)), t).alias(n) for i, (t, n) in enumerate(found)]
    return Flow(split.select(*cols, *(F.col(o) for o, _ in ORDER)), tags, ORDER)


def _unescaped(c: Column, letters: str = "nrt\\") -> Column:
    """Escapes of ``letters``; any other stays as it is."""
    stands = {"n": "\n", "r": "\r", "t": "\t"}

    def plain(x: Column) -> Column:
        for k in letters.replace("\\", ""):
            x = F.replace(x, F.lit("\\" + k), F.lit(stands[k]))
        return x

    if "\\" not in letters:
        return plain(c)
    # what stands between doubled backslashes, which are parted from the left, has none of them
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def from_tsv(rows: DataFrame, headings: list[str] | None = None, head: str | None = None) -> Flow:
    return _table(rows, lambda v: F.transform(F.split(v, "\t", -1), lambda x: _unescaped(x)), "rel.from_tsv", headings, head=head)


def tsv_tables(spark: SparkSession, *paths: str) -> list[Flow]:
    """What each path's own ``from_tsv`` gives, by one scan for all paths with the same line of headings: a flow for each such line."""
    spark = child(spark)
    each = [expand(spark, p) for p in paths]
    files = [f for found in each for f in found]
    if not all(each) or len(set(files)) < len(files):
        return [from_tsv(lines(spark, p)) for p in paths]
    starts = [0, *accumulate(map(len, each))]
    path_of = dict(zip(starts, range(len(paths))))  # by the place of the file with the headings
    rows = lines(spark, *paths)

    def parted(heads: bool):
        """The lines of headings, or all others. A task has a file's first block in one piece, as the scan gives it."""
        leading = np.fromiter(path_of, np.int64, len(path_of))

        def run(batches):
            before = -1
            for b in batches:
                at = b["__o0"].to_numpy()
                if not len(at):
                    continue
                new = at != np.concatenate([[before], at[:-1]])
                before = at[-1]
                is_head = new & (b["__o1"].to_numpy() == 0) & np.isin(at, leading)
                yield b[is_head if heads else ~is_head]

        return rows.mapInPandas(run, rows.schema)

    by_head: dict[str, list[int]] = {}
    for r in parted(True).select("__o0", "value").collect():  # a row per path
        by_head.setdefault(r.value, []).append(path_of[r["__o0"]])
    if sum(map(len, by_head.values())) < len(paths):
        raise PipelineError("there is no line of headings", "rel.from_tsv")
    if len(by_head) > 1:
        return [x for found in by_head.values() for x in tsv_tables(spark, *(paths[i] for i in sorted(found)))]
    return [from_tsv(parted(False), head=next(iter(by_head)))]


def csv_fields(line: str) -> list[str]:
    """A quote opens a field only as its first character, and a doubled one stands for itself."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            field = []
            while True:
                end = line.find('"', i)
                if end < 0:
                    raise ValueError(f"a quote has no end: {line}")
                field.append(line[i:end])
                if line[end + 1 : end + 2] == '"':
                    field.append('"')
                    i = end + 2
                else:
                    i = end + 1
                    break
            if i < n and line[i] != ",":
                raise ValueError(f"a quote ends within a field: {line}")
            out.append("".join(field))
        else:
            end = line.find(",", i)
            out.append(line[i : end if end >= 0 else n])
            i = end if end >= 0 else n
        if i >= n:
            return out
        i += 1


def from_csv(rows: DataFrame, headings: list[str] | None = None) -> Flow:
    @F.pandas_udf("array<string>")
    def quoted(values):
        import pandas as pd

        return pd.Series([csv_fields(v) if v is not None else None for v in values], dtype=object)

    def cut(v: Column) -> Column:
        # only lines with quotes leave the JVM
        return F.transform(F.coalesce(quoted(F.when(v.contains('"'), v)), F.split(v, ",", -1)), lambda x: _unescaped(x, "nrt"))

    return _table(rows, cut, "rel.from_csv", headings)


def from_usv(spark: SparkSession, *paths: str) -> Flow:
    """Fields end by byte 31, records by byte 0; headings must have types. A trailing empty field is dropped."""

    def cut(v: Column) -> Column:
        parts = F.split(v, "\x1f", -1)
        return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    rows = lines(spark, *paths, end="\0", strict=False)
    first = _first(rows)
    if first is None or any(":" not in h for h in first.value.rstrip("\x1f").split("\x1f")):
        raise PipelineError("headings must have types", "rel.from_usv")
    return _table(rows, cut, "rel.from_usv", None)


def from_text(rows: DataFrame, pattern: str, headings: list[str], ignore_non_matching: bool = False) -> Flow:
    """Captures of the first match in each line."""
    operator = "rel.from_text"
    if patterns.groups(pattern) != len(headings) or not 1 <= len(headings) <= 9:
        raise PipelineError("from one to nine captures, and a heading for each, are needed", operator)
    java, rows = patterns.regex(pattern), _in_order(rows)
    if ignore_non_matching:
        rows = rows.where(F.col("value").rlike(java))
        value = F.col("value")
    else:
        value = F.when(F.col("value").rlike(java), F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"{operator}: no match: "), F.col("value"))))
    found = [(t or "string", n) for t, n in map(split_heading, headings)]
    cols = [typed(F.regexp_extract(value, java, i + 1), t).alias(n) for i, (t, n) in enumerate(found)]
    return Flow(rows.select(*cols, *(F.col(o) for o, _ in ORDER)), {n: t for t, n in found}, ORDER)




def utf16_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of UTF-16 files, each read whole; the byte order mark is needed, and odd surrogates are an error."""
    spark = child(spark)
    parts = None
    for i, path in enumerate(f for p in paths for f in expand(spark, p)):
        if start_and_end(spark, path)[0][:2] not in (b"\xff\xfe", b"\xfe\xff"):
            raise PipelineError(f"{path} has no byte order mark", "text.utf16_to_utf8")
        text = F.decode("content", "UTF-16")
        one = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(text, "\n", -1)).alias("__o2", "value"))
        one = one.select("value", F.lit(i).alias("__o0"), F.lit(0).cast("long").alias("__o1"), F.col("__o2").cast("long").alias("__o2"))
        parts = one.where("value <> ''") if parts is None else parts.unionByName(one.where("value <> ''"))
    if parts is None:
        raise PipelineError("no file", "text.utf16_to_utf8")
    return parts


def strip_cr(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))


# -- writing -----------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    for real, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        c = F.replace(c, F.lit(real), F.lit("\\" + letter))
    return c


def _with_headings(flow: Flow, value: Column, head: str) -> DataFrame:
    """The line of headings, then the rows in the flow's order: a partition after the other, so a file after the other when written."""
    from millrace.operators.ordered import directed

    rows = flow.rows.select(value.alias("value"), *(F.col(o) for o, _ in flow.order))
    first = flow.spark.createDataFrame([(head,)], "value string").coalesce(1)
    if not flow.order:
        return first.unionAll(rows)
    nothing = [F.lit(None).cast(rows.schema[o].dataType).alias(o) for o, _ in flow.order]
    both = first.select("value", *nothing, F.lit(0).alias("__turn")).unionByName(rows.withColumn("__turn", F.lit(1)))
    return both.orderBy("__turn", *directed(list(flow.order))).select("value")


def _texts(flow: Flow) -> list[Column]:
    return [to_text(F.col(f"`{c}`"), t).cast("string") for c, t in flow.tags.items()]


def tsv_lines(flow: Flow) -> DataFrame:
    return _with_headings(flow, F.concat_ws("\t", *map(_escaped, _texts(flow))), "\t".join(flow.headings))


def csv_lines(flow: Flow) -> DataFrame:
    def quoted(c: Column) -> Column:
        shown = F.replace(c, F.lit('"'), F.lit('""'))
        return _escaped(F.when(c.rlike('[,"]'), F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(c))

    return _with_headings(flow, F.concat_ws(",", *map(quoted, _texts(flow))), ",".join(flow.headings))


def usv_lines(flow: Flow) -> DataFrame:
    def checked(c: Column) -> Column:
        return F.when(c.rlike("[\x1f\\x00]"), F.raise_error(F.lit("rel.to_usv: a field has a separator"))).otherwise(c)

    return _with_headings(flow, F.concat(F.concat_ws("\x1f", *map(checked, _texts(flow))), F.lit("\x1f")), "".join(h + "\x1f" for h in flow.headings))


def save(rows: DataFrame, path: str, mode: str = "overwrite", end: str = "\n") -> None:
    rows.write.mode(mode).option("lineSep", end).text(path)


def record_split(flow: Flow, n: int, stub: str) -> list[str]:
    """Files of ``n`` records at most, each with headings, gzipped, named by the stub and a number in 16 hex digits."""
    import uuid

    from millrace.operators.ordered import numbered
    from millrace.sources.files import erase, rename

    if n < 1:
        raise PipelineError("files need one record at least", "rel.record_split")
    flow._ordered("rel.record_split")
    rows = numbered(flow.rows, list(flow.order), "__n").select(F.expr(f"(__n - 1) div {n}").alias("file"), F.col("__n"), F.concat_ws("\t", *map(_escaped, _texts(flow))).alias("value"))
    files = rows.groupBy("file").agg(F.lit(0).cast("long").alias("__n")).withColumn("value", F.lit("\t".join(flow.headings)))
    both = files.select("file", "__n", "value").unionByName(rows)
    target = f"{stub}-{uuid.uuid4().hex}.tmp"
    both.repartition("file").sortWithinPartitions("file", "__n").select("file", "value").write.partitionBy("file").option("compression", "gzip").text(target)
    out = []
    for part in expand(flow.spark, f"{target}/file=*/part-*"):
        number = int(part.split("/file=")[1].split("/")[0])
        out.append(f"{stub}{number:016x}.gz")
        rename(flow.spark, part, out[-1])
    erase(flow.spark, target)
    return sorted(out)
