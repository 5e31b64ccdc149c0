"""Scripts: pipelines of operators joined by ``|``, each ended by ``;``.

A pipeline is checked as a whole before anything runs: each operator takes a kind of stream (records,
lines, nothing) and gives one. An unknown operator is a file of that name with a script for ``$1`` to
``$n``, looked for beside the calling script and along ``search``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from millrace import __version__
from millrace.errors import PipelineError
from millrace.flow import Flow
from millrace.functions.table import FUNCTIONS, TABLE, Settings, lower, Env
from millrace.plans.lexer import Token, split_commas, tokens
from millrace.plans.parser import parse
from millrace.session import child


@dataclass
class Call:
    name: str
    args: list[Token]
    line: int


@dataclass
class Context:
    spark: SparkSession
    settings: Settings
    tables: dict[str, Flow | DataFrame | str]
    search: list[str]
    depth: int = 0

    def flow(self, name: str) -> Flow:
        """A table by its registered name, or files by path; the suffix says how they are read."""
        found = self.tables.get(name, name)
        if isinstance(found, Flow):
            return replace(found, settings=self.settings)
        if isinstance(found, DataFrame):
            return Flow.of(found, settings=self.settings)
        return self.read([found])

    def read(self, paths: list[str]) -> Flow:
        from millrace.sources import native

        if all(p.rstrip("/").endswith(".parquet") for p in paths):
            return Flow.parquet(self.spark, *paths, settings=self.settings)
        return replace(native.read(self.spark, *paths), settings=self.settings)


def pipelines(found: list[Token]) -> list[list[Call]]:
    out: list[list[Call]] = []
    current: list[Call] = []
    i = 0
    while i < len(found):
        name = found[i]
        if name.kind != "name":
            raise PipelineError(f"an operator's name should stand here, not {name.text!r}", line=name.line)
        if i + 1 >= len(found) or found[i + 1].text != "(" or found[i + 1].kind != "symbol":
            raise PipelineError("'(' is missing", name.text, name.line)
        depth, j = 1, i + 2
        while j < len(found) and depth:
            if found[j].kind == "symbol":
                depth += (found[j].text == "(") - (found[j].text == ")")
            j += 1
        if depth:
            raise PipelineError("')' is missing", name.text, name.line)
        current.append(Call(name.text, found[i + 2 : j - 1], name.line))
        if j >= len(found):
            raise PipelineError("';' is missing at the end", name.text, name.line)
        if found[j].kind != "symbol" or found[j].text not in (";", "|"):
            raise PipelineError(f"only ';' or '|' can follow, not {found[j].text!r}", name.text, found[j].line)
        if found[j].text == ";":
            out.append(current)
            current = []
        i = j + 1
    if current:
        raise PipelineError("a pipeline ends with '|'", current[-1].name, current[-1].line)
    return out


# -- operators ---------------------------------------------------------------------------------------


@dataclass
class Operator:
    takes: str  # records, lines, none, any
    gives: str
    run: Callable
    text: str = ""


OPERATORS: dict[str, Operator] = {}


def operator(names: str, takes: str, gives: str, text: str):
    def add(f):
        for n in names.split():
            OPERATORS[n] = Operator(takes, gives, f, text)
        return f

    return add


def literal(found: list[Token], context: Context, tag: str = "string"):
    """The value of a constant argument; arithmetic is worked out."""
    if len(found) == 1 and found[0].kind == tag:
        return found[0].text if tag == "string" else int(found[0].text)
    typed = lower(parse(found), Env({}, context.settings))
    if typed.tag != tag:
        raise PipelineError(f"a {tag} is needed, not {typed.tag}")
    return context.spark.range(1).select(typed.col.alias("x")).first().x


def strings(call: Call, context: Context) -> list[str]:
    return [literal(p, context) for p in split_commas(call.args)]


def headings(call: Call) -> list[str]:
    parts = split_commas(call.args)
    if any(len(p) != 1 or p[0].kind != "name" for p in parts):
        raise PipelineError("only bare names of headings are taken")
    return [p[0].text for p in parts]


@operator("rel.where", "records", "records", "rows for which a condition holds")
def _where(flow, call, context):
    return flow.where(call.args)


@operator("rel.select", "records", "records", "expressions as new columns")
def _select(flow, call, context):
    return flow.select(call.args)


@operator("rel.group", "records", "records", "count, sum, avg, min, max, median or sum_count of a column by all others")
def _group(flow, call, context):
    if not 1 <= len(call.args) <= 2 or any(t.kind != "name" for t in call.args):
        raise PipelineError("an aggregate and a heading are needed")
    return flow.group(*(t.text for t in call.args))


def _sort(desc):
    def run(flow, call, context):
        return flow.order_by(*headings(call), desc=desc)

    return run


operator("rel.order_by rel.order_by.mergesort rel.order_by.quicksort", "records", "records", "a stable ascending sort")(_sort(False))
operator("rel.order_by.desc rel.order_by.mergesort.desc rel.order_by.quicksort.desc", "records", "records", "the exact reverse of the ascending sort")(_sort(True))


def _join(kind):
    def run(flow, call, context):
        files = strings(call, context)
        if len(files) != 1:
            raise PipelineError("one file is needed")
        return getattr(flow, f"join_{kind}")(context.flow(files[0]))

    return run


for _kind, _text in (("natural", "rows of both sides that agree in all common headings"), ("left", "all rows, with defaults where the file has no match"), ("anti", "rows without a match"), ("consistent_hash", "each row with one of the file's, by a hash ring")):
    operator(f"rel.join.{_kind}", "records", "records", _text)(_join(_kind))


@operator("rel.unique", "records", "records", "the first of equal rows")
def _unique(flow, call, context):
    return flow.unique()


@operator("rel.str_split", "records", "records", "a row per piece of a string")
def _str_split(flow, call, context):
    parts = split_commas(call.args)
    if len(parts) != 2:
        raise PipelineError("a heading and a pattern are needed")
    return flow.str_split(parts[0][0].text, literal(parts[1], context))


@operator("rel.assert.empty", "records", "records", "fails if there is a row")
def _assert_empty(flow, call, context):
    return flow.assert_empty()


@operator("rel.assert.nonempty", "records", "records", "fails if there is no row")
def _assert_nonempty(flow, call, context):
    return flow.assert_nonempty()


@operator("rel.record_count", "records", "records", "the number of rows")
def _record_count(flow, call, context):
    return flow.record_count()


@operator("rel.record_split", "records", "none", "numbered files with headings")
def _record_split(flow, call, context):
    from millrace.sources.text import record_split

    n, stub = split_commas(call.args)
    record_split(flow, literal(n, context, "int"), literal(stub, context))


@operator("rel.generate_sequence", "any", "records", "integers from a start to before an end")
def _generate(flow, call, context):
    start, end = (literal(p, context, "int") for p in split_commas(call.args))
    return replace(Flow.sequence(context.spark, start, end), settings=context.settings)


@operator("io.file.read", "any", "any", "records or lines of files, one after the other")
def _read(flow, call, context):
    from millrace.sources import native
    from millrace.sources.text import lines

    names = strings(call, context)
    if all(n in context.tables or n.rstrip("/").endswith(".parquet") for n in names):
        first, *rest = [context.flow(n) for n in names] if any(n in context.tables for n in names) else [context.read(names)]
        return first.followed_by(*rest) if rest else first
    if all(native.is_native(context.spark, n) for n in names):
        return context.read(names)
    return lines(context.spark, *names)


def _write(mode):
    def run(stream, call, context):
        (path,) = strings(call, context)
        if isinstance(stream, Flow) and path.rstrip("/").endswith(".parquet"):
            stream.df().write.mode(mode).parquet(path)
        elif isinstance(stream, Flow):
            from millrace.sources import native

            native.write(stream, path, mode)
        else:
            stream.select("value").write.mode(mode).option("lineSep", getattr(stream, "_line_end", "\n")).text(path)

    return run


operator("io.file.append", "any", "none", "adds to a file")(_write("append"))
operator("io.file.overwrite", "any", "none", "writes a file anew")(_write("overwrite"))


def _parse(kind):
    def run(rows, call, context):
        from millrace.sources import text

        flow = getattr(text, f"from_{kind}")(rows, strings(call, context) or None)
        return replace(flow, settings=context.settings)

    return run


operator("rel.from_tsv", "lines", "records", "fields between tabs")(_parse("tsv"))
operator("rel.from_csv", "lines", "records", "fields between commas")(_parse("csv"))


@operator("rel.from_usv", "any", "records", "fields that end with byte 31, records with byte 0")
def _from_usv(rows, call, context):
    from millrace.sources.text import from_usv

    paths = strings(call, context)
    if not paths:
        raise PipelineError("name the files here: the bytes are no lines")
    return replace(from_usv(context.spark, *paths), settings=context.settings)


def _from_text(ignore):
    def run(rows, call, context):
        from millrace.sources.text import from_text

        pattern, *names = strings(call, context)
        return replace(from_text(rows, pattern, names, ignore), settings=context.settings)

    return run


operator("rel.from_text", "lines", "records", "captures of a pattern in each line")(_from_text(False))
operator("rel.from_text_ignore_non_matching", "lines", "records", "the same, without lines that don't match")(_from_text(True))


def _print(kind):
    def run(flow, call, context):
        from millrace.sources import text

        return getattr(text, f"{kind}_lines")(flow)

    return run


for _kind in ("tsv", "csv", "usv"):
    operator(f"rel.to_{_kind}", "records", "lines", f"rows as {_kind.upper()}")(_print(_kind))


@operator("rel.from_shapefile", "any", "records", "geometries as text")
def _shapefile(flow, call, context):
    from millrace.sources.shapefile import read

    return replace(read(context.spark, *strings(call, context)), settings=context.settings)


def _list(recurse):
    def run(flow, call, context):
        from millrace.sources.files import listing

        (path,) = strings(call, context)
        return replace(listing(context.spark, path, recurse), settings=context.settings)

    return run


operator("io.directory.list io.ls", "any", "records", "a folder's entries")(_list(False))
operator("io.directory.list_recurse io.ls_r", "any", "records", "a folder's entries and theirs")(_list(True))


@operator("text.utf16_to_utf8", "any", "lines", "lines of UTF-16 files")
def _utf16(rows, call, context):
    from millrace.sources.text import utf16_lines

    return utf16_lines(context.spark, *strings(call, context))


@operator("text.strip_cr", "lines", "lines", "lines without carriage returns")
def _strip_cr(rows, call, context):
    from millrace.sources.text import strip_cr

    return strip_cr(rows)


@operator("lang.python", "records", "records", "Python code over all rows in order")
def _python(flow, call, context):
    from millrace.operators.scripting import python

    return python(flow, call.args[0].text)


@operator("lang.R", "records", "records", "R code over a data frame")
def _r(flow, call, context):
    from millrace.operators.scripting import r

    return r(flow, call.args[0].text, {c: t for c, t in flow.tags.items()})


@operator("meta.shell", "records", "records", "a command over the rows as TSV")
def _shell(flow, call, context):
    from millrace.operators.scripting import shell

    return shell(flow, *strings(call, context))


@operator("meta.script", "any", "any", "another script")
def _script(stream, call, context):
    (path,) = strings(call, context)
    with open(path) as f:
        return execute(tokens(f.read()), replace(context, search=[os.path.dirname(os.path.abspath(path)), *context.search], depth=context.depth + 1), stream)


@operator("meta.remote", "any", "any", "a pipeline, which the cluster runs like any other")
def _remote(stream, call, context):
    comma = next((i for i, t in enumerate(call.args) if t.kind == "symbol" and t.text == ","), None)
    if comma is None:
        raise PipelineError("a host and a pipeline are needed")
    return execute([*call.args[comma + 1 :], Token("symbol", ";", call.line)], context, stream)


@operator("meta.parallel_explicit_mapping", "records", "records", "a pipeline over each of the files that the rows name")
def _mapping(flow, call, context):
    from millrace.operators.scripting import per_file

    code = [*call.args, Token("symbol", ";", call.line)]
    return per_file(flow, lambda one: execute(code, context, one), context.flow)


@operator("help.version", "any", "lines", "the version")
def _version(stream, call, context):
    return context.spark.createDataFrame([(__version__,)], "value string")


@operator("help.markdown", "any", "lines", "this manual")
def _markdown(stream, call, context):
    return context.spark.createDataFrame([(x,) for x in manual().splitlines()], "value string").coalesce(1)


def manual() -> str:
    out = ["# Operators", ""]
    out += [f"- `{n}` ({o.takes} to {o.gives}): {o.text}" for n, o in sorted(OPERATORS.items())]
    out += ["", "# Functions", ""]
    out += [f"- `{n}`: " + "; ".join(f"({', '.join(k)}) -> {t}" for k, t, _ in TABLE[n]) for n in FUNCTIONS]
    return "\n".join(out)


# -- running -----------------------------------------------------------------------------------------


def check(line: list[Call], given: str) -> None:
    """The kinds of streams fit, before anything runs."""
    for call in line:
        known = OPERATORS.get(call.name)
        if known is None:
            given = "any"
            continue
        if given == "nothing" and known.takes not in ("any", "none"):
            raise PipelineError(f"it needs {known.takes}, and nothing comes before it", call.name, call.line)
        if given not in ("any", "nothing") and known.takes not in ("any", given):
            raise PipelineError(f"it takes {known.takes}, but {given} come", call.name, call.line)
        given = "nothing" if known.gives == "none" else known.gives


def _macro(call: Call, context: Context) -> tuple[list[Token], str]:
    for folder in context.search:
        path = os.path.join(folder, call.name)
        if os.path.isfile(path):
            break
    else:
        raise PipelineError("no such operator, and no script of that name", call.name, call.line)
    args, out = split_commas(call.args), []
    with open(path) as f:
        for t in tokens(f.read()):
            if t.kind != "argument":
                out.append(t)
            elif not 1 <= int(t.text) <= len(args):
                raise PipelineError(f"${t.text} has no argument", call.name, call.line)
            else:
                out += args[int(t.text) - 1]
    return out, os.path.dirname(os.path.abspath(path))


def execute(found: list[Token], context: Context, stream=None):
    """The last pipeline's stream; each is a lazy plan until a sink, an assertion or a count runs it."""
    if context.depth > 100:
        raise PipelineError("scripts call each other without end")
    lines = pipelines(found)
    for line in lines:
        check(line, "nothing" if stream is None else "any")
    out = None
    for line in lines:
        out = stream
        for call in line:
            known = OPERATORS.get(call.name)
            try:
                if known is None:
                    code, folder = _macro(call, context)
                    out = execute(code, replace(context, search=[folder, *context.search], depth=context.depth + 1), out)
                else:
                    if known.takes == "records" and not isinstance(out, Flow) or known.takes == "lines" and not isinstance(out, DataFrame):
                        raise PipelineError(f"it takes {known.takes}")
                    out = known.run(out, call, context)
            except PipelineError as e:
                if e.line:
                    raise
                raise PipelineError(str(e), None if str(e).startswith(call.name) else call.name, call.line) from e
    return out


def run_script(spark: SparkSession, script: str, tables: dict | None = None, stream: Flow | None = None, search: list[str] | None = None, allow_side_effects: bool = False, zone: str = "UTC"):
    """Runs a script, given as text or as a file's path, over named tables; gives the last pipeline's flow or lines, or None after a sink."""
    folders = list(search or ())
    if "\n" not in script and os.path.isfile(script):
        folders.insert(0, os.path.dirname(os.path.abspath(script)))
        with open(script) as f:
            script = f.read()
    context = Context(child(spark), Settings(allow_side_effects, zone), {} if tables is None else tables, folders)
    return execute(tokens(script), context, stream)
