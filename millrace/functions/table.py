"""Overloads of operators and functions, as data, and the lowering of typed expressions to columns."""

from __future__ import annotations

import re
import subprocess
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.functions import patterns
from millrace.plans.parser import Node
from millrace.types import DEFAULTS, SPARK, key, split_heading, to_text, unsigned

MIN = -(1 << 63)


@dataclass
class Typed:
    col: Column
    tag: str
    literal: object = None


@dataclass(frozen=True)
class Settings:
    """Of a whole script or flow: side effects are off by default, local times are those of ``zone``."""

    allow_side_effects: bool = False
    zone: str = "UTC"


Overload = tuple[tuple[str, ...], str, Callable]
TABLE: dict[str, list[Overload]] = {}


def define(name: str, *overloads: Overload) -> None:
    TABLE.setdefault(name, []).extend(overloads)


S, I = "string", "istring"
TEXT2 = [(a, b) for a in (S, I) for b in (S, I)]


def caseless(*tags: str) -> bool:
    return I in tags


def folded(x: Typed, y: Typed) -> tuple[Column, Column]:
    """Both sides in one collation."""
    if caseless(x.tag, y.tag):
        return F.collate(x.col.cast("string"), "UTF8_LCASE"), F.collate(y.col.cast("string"), "UTF8_LCASE")
    return x.col, y.col


def _compare(op: Callable) -> Callable:
    def lower(s, x, y):
        if "ipaddress" in (x.tag, y.tag):
            return op(key(x.col, "ipaddress"), key(y.col, "ipaddress"))
        if x.tag == "uint":
            return op(key(x.col, "uint"), key(y.col, "uint"))
        return op(*folded(x, y))

    return lower


_SIMPLE = [("int", "int"), ("uint", "uint"), ("bool", "bool"), *TEXT2, ("ipaddress", "ipaddress"), *((a, "ipaddress") for a in (S, I)), *(("ipaddress", a) for a in (S, I))]
for _name, _op in (("=", lambda a, b: a == b), ("!=", lambda a, b: a != b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b)):
    _kinds = _SIMPLE + ([("double", "double")] if _name[0] in "<>" else [])
    define(_name, *((k, "bool", _compare(_op)) for k in _kinds))


def _checked(y: Column) -> Column:
    """The divisor, or an error where it is zero."""
    return F.when(y == 0, F.raise_error(F.lit("integer division by zero")).cast("long")).otherwise(y)


def _divide(op: str) -> Callable:
    def lower(s, x, y):
        if x.tag == "double":
            return x.col / y.col
        small = F.call_function(op, x.col, _checked(y.col)) if op == "div" else x.col % _checked(y.col)
        if x.tag == "int":
            return small
        # the sign bit of either may be set: as decimals, and back to the 64 bits
        a, b = unsigned(x.col), unsigned(_checked(y.col))
        quotient = F.floor(a / b)
        quotient = F.when(quotient * b > a, quotient - 1).otherwise(quotient)
        wide = quotient if op == "div" else a - quotient * b
        back = F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("long")
        return F.when((x.col >= 0) & (y.col >= 0), small).otherwise(back)

    return lower


def _same(op: Callable, *tags: str) -> list[Overload]:
    return [((t, t), t, lambda s, x, y: op(x.col, y.col)) for t in tags]


def _concat(s, x, y):
    c = F.concat(x.col.cast("string"), y.col.cast("string"))
    return c.cast(SPARK[I]) if caseless(x.tag, y.tag) else c


NUMBERS = ("int", "uint", "double")
define("+", *((k, I if caseless(*k) else S, _concat) for k in TEXT2), *_same(lambda a, b: a + b, *NUMBERS))
define("-", *_same(lambda a, b: a - b, *NUMBERS))
define("*", *_same(lambda a, b: a * b, *NUMBERS))
define("/", *(((t, t), t, _divide("div")) for t in NUMBERS))
define("%", *(((t, t), t, _divide("%")) for t in ("int", "uint")))
define("&", *_same(lambda a, b: a.bitwiseAND(b), "int", "uint"))
define("|", *_same(lambda a, b: a.bitwiseOR(b), "int", "uint"))
define("negate", *(((t,), t, lambda s, x: -x.col) for t in ("int", "double")))
define("~", *(((t,), t, lambda s, x: F.bitwise_not(x.col)) for t in ("int", "uint")))
define("&&", (("bool", "bool"), "bool", lambda s, x, y: x.col & y.col))
define("||", (("bool", "bool"), "bool", lambda s, x, y: x.col | y.col))
define("!", (("bool",), "bool", lambda s, x: ~x.col))

define("to_string", *(((t,), S, lambda s, x: to_text(x.col, x.tag)) for t in DEFAULTS))
define("to_istring", *(((t,), I, lambda s, x: to_text(x.col, x.tag).cast(SPARK[I])) for t in DEFAULTS))
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(a: str, b: str) -> Callable:
    return lambda s, x: F.translate(x.col.cast("string"), a, b).cast(SPARK[x.tag])


define("str.to_upper_case", *(((t,), t, _letters(_LOW, _UP)) for t in (S, I)))
define("str.to_lower_case", *(((t,), t, _letters(_UP, _LOW)) for t in (S, I)))


def _pattern(p: Typed, *others: str) -> str:
    if p.literal is None:
        raise PipelineError("a pattern must be a literal")
    return patterns.regex(p.literal, caseless(p.tag, *others))


def _match(s, p, h):
    return h.col.cast("string").rlike(_pattern(p, h.tag))


def _expanded(p: Typed, h: Typed, r: Typed) -> Column:
    if r.literal is None:
        raise PipelineError("a replacement must be a literal")
    java, n, text = _pattern(p, h.tag), patterns.groups(p.literal), h.col.cast("string")
    parts = [F.lit(x) if isinstance(x, str) else F.regexp_extract(text, java, x) if x <= n else F.lit("") for x in patterns.template(r.literal)]
    return F.concat(*parts) if parts else F.lit("")


def _replace(otherwise: Callable) -> Callable:
    return lambda s, p, h, r: F.when(_match(s, p, h), _expanded(p, h, r)).otherwise(otherwise(h)).cast(SPARK[h.tag])


def _replace_all(s, p, h, r):
    if r.literal is None:
        raise PipelineError("a replacement must be a literal")
    n = patterns.groups(p.literal) if p.literal is not None else 0
    java = "".join(x.replace("\\", "\\\\").replace("$", "\\$") if isinstance(x, str) else f"${x}" if x <= n else "" for x in patterns.template(r.literal))
    return F.regexp_replace(h.col.cast("string"), F.lit(_pattern(p, h.tag)), F.lit(java)).cast(SPARK[h.tag])


_THREE = [((S, h, r), h) for h in (S, I) for r in (S, I)]
define("str.regex_match", *((k, "bool", _match) for k in TEXT2))
define("str.regex_replace", *((k, t, _replace(lambda h: h.col.cast("string"))) for k, t in _THREE))
define("str.regex_replace_empty_on_no_match", *((k, t, _replace(lambda h: F.lit(""))) for k, t in _THREE))
define("str.regex_replace_all", *((k, t, _replace_all) for k, t in _THREE))


def _test(name: str) -> Callable:
    def lower(s, h, n):
        a, b = folded(h, n)
        return getattr(a, name)(b)

    return lower


for _name, _method in (("str.starts_with", "startswith"), ("str.ends_with", "endswith"), ("str.contains", "contains")):
    define(_name, *((k, "bool", _test(_method)) for k in TEXT2))

define("str.uuidgen", ((), S, lambda s: F.expr("uuid()")))
define("math.rand64", ((), "uint", lambda s: F.expr("xxhash64(uuid())")))


def _sha256(s, x):
    if x.tag in ("int", "uint"):
        return F.sha2(F.unhex(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substring(F.lpad(F.hex(x.col), 16, "0"), i * 2 + 1, F.lit(2))), "")), 256)
    if x.tag == "bool":
        return F.sha2(F.when(x.col, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), 256)
    return F.sha2(x.col.cast("string").cast("binary"), 256)


define("str.sha256", *(((t,), S, _sha256) for t in DEFAULTS if t != "double"))

_JSON = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[-+0-9.eE]+|true|false|null|[{}\[\],:])\s*', re.S)


def json_member(text: str, name: str) -> str:
    """A top-level member as it stands, without white space; a name that occurs twice gives both, one after the other."""
    found, at = [], 0
    while at < len(text):
        m = _JSON.match(text, at)
        if m is None:
            raise ValueError(f"invalid JSON at {at}")
        found.append(m[1])
        at = m.end()
    if not found or found[0] != "{":
        return ""
    out, i, depth = [], 1, 1
    while i < len(found) and found[i] != "}":
        label = found[i]
        if label[0] != '"' or "\\" in label or i + 1 >= len(found) or found[i + 1] != ":":
            raise ValueError("an object's member has no plain name")
        i += 2
        start = i
        while i < len(found):
            depth += (found[i] in "{[") - (found[i] in "}]")
            if depth > 100:
                raise ValueError("JSON nested more than 100 deep")
            if depth == 0 or depth == 1 and found[i] == ",":
                break
            i += 1
        if label[1:-1] == name:
            out += found[start:i]
        if depth == 0:
            break
        i += 1
    return "".join(out)


#: Flat objects without escapes, which most are: a member's text is what stands there.
_PLAIN = r'(?:"[^"\\]*"|-?[0-9][-+0-9.eE]*|true|false|null)'
_FLAT = rf'^\s*\{{\s*(?:"[^"\\]*"\s*:\s*{_PLAIN}\s*(?:,\s*"[^"\\]*"\s*:\s*{_PLAIN}\s*)*)?\}}\s*$'


def _json_get(s, j, n):
    @F.pandas_udf("string")
    def member(texts, names):
        import pandas as pd

        return pd.Series([None if t is None else json_member(t, k) for t, k in zip(texts, names)], dtype=object)

    text = j.col.cast("string")
    if not n.literal or not re.fullmatch(r"\w+", n.literal):
        return member(text, n.col.cast("string"))
    # only what isn't flat leaves the JVM
    flat = text.rlike(_FLAT)
    found = F.array_join(F.regexp_extract_all(text, F.lit(rf'[{{,]\s*"{n.literal}"\s*:\s*({_PLAIN})'), 1), "")
    return F.when(flat, found).otherwise(member(F.when(~flat, text), n.col.cast("string")))


define("str.json.get", ((S, S), S, _json_get))


def _now(s):
    # of each row, as it is made; current_timestamp() would be one for all
    return F.expr("cast(java_method('java.lang.System', 'currentTimeMillis') as bigint) * 1000L")


define("time.now_epoch_usec", ((), "uint", _now))
for _name, _factor, _up in (("usec_to_msec", 1000, False), ("msec_to_usec", 1000, True), ("usec_to_sec", 1_000_000, False), ("sec_to_usec", 1_000_000, True)):
    _lower = (lambda f: lambda s, x: x.col * f)(_factor) if _up else (lambda f: lambda s, x: F.call_function("div", x.col, F.lit(f).cast("long")))(_factor)
    define(f"time.{_name}", *(((t,), t, _lower) for t in ("int", "uint")))
for _part, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    define(f"time.extract_{_part}", *(((t,), t, (lambda f: lambda s, x: f(F.timestamp_micros(x.col)).cast("long"))(_f)) for t in ("int", "uint")))


def _time_parse(s, text, form):
    if form.literal is None:
        raise PipelineError("a time format must be a literal")
    java, shape = patterns.time_format(form.literal)
    start = F.regexp_extract(text.col.cast("string"), rf"^\s*({shape})", 1)
    value = F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(start, F.lit(java)), s.zone))
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("no time of this format: "), text.col.cast("string"))).cast("long")).otherwise(value)


def _time_format(s, t, form):
    if form.literal is None:
        raise PipelineError("a time format must be a literal")
    if not form.literal:
        raise PipelineError("a time format is empty")
    at = F.from_utc_timestamp(F.timestamp_micros(t.col), s.zone)
    return F.concat(*(F.lit(x) if k == "text" else F.date_format(at, x) if k == "java" else _time_number(at, t.col, x) for k, x in patterns.time_parts(form.literal)))


def _time_number(at: Column, usec: Column, directive: str) -> Column:
    """Directives that Java's patterns lack."""
    day, week_day = F.dayofyear(at), F.dayofweek(at) - 1  # from Sunday
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    padded = lambda c: F.lpad(c.cast("string"), 2, " ")
    hour = F.hour(at)
    return {
        "U": lambda: two(F.floor((day + 6 - week_day) / 7)), "W": lambda: two(F.floor((day + 6 - (week_day + 6) % 7) / 7)),
        "V": lambda: two(F.weekofyear(at)), "G": lambda: F.extract(F.lit("YEAROFWEEK"), at).cast("string"), "g": lambda: two(F.extract(F.lit("YEAROFWEEK"), at) % 100),
        "u": lambda: ((week_day + 6) % 7 + 1).cast("string"), "w": lambda: week_day.cast("string"), "C": lambda: two(F.floor(F.year(at) / 100)),
        "e": lambda: padded(F.dayofmonth(at)), "k": lambda: padded(hour), "l": lambda: padded((hour + 11) % 12 + 1), "s": lambda: F.call_function("div", usec, F.lit(1_000_000).cast("long")).cast("string"),
        "P": lambda: F.when(hour < 12, "am").otherwise("pm"),
    }[directive]()


define("time.parse", *((k, "uint", _time_parse) for k in TEXT2))
define("time.format", *((("uint", t), S, _time_format) for t in (S, I)))


def _effect(name: str, kind: str, act: Callable) -> Callable:
    def lower(s, x):
        if not s.allow_side_effects:
            raise PipelineError(f"{name} has side effects; they are off unless allow_side_effects is set")
        return F.udf(act, kind).asNondeterministic()(x.col)

    return lower


def _get_url(url: str) -> str:
    try:
        with urllib.request.urlopen(url, timeout=60) as r:
            return f"{r.headers}{r.read().decode(errors='replace')}"
    except OSError:
        return ""


def _read_file(path: str) -> str:
    import gzip

    try:
        data = open(path, "rb").read()
    except OSError:
        return ""
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode(errors="replace").replace("�", "?")


def _erase(path: str) -> bool:
    import os

    try:
        os.unlink(path)
        return True
    except OSError:
        return False


def _shell(command: str) -> str:
    return subprocess.run(command, shell=True, capture_output=True, text=True).stdout


for _name, _kind, _act in (("io.net.url.get", S, _get_url), ("io.file.read", S, _read_file), ("io.file.erase", "bool", _erase), ("meta.shell", S, _shell)):
    define(_name, ((S,), _kind, _effect(_name, {"bool": "boolean"}.get(_kind, _kind), _act)))

FUNCTIONS = sorted(n for n in TABLE if n[0].isalpha() and n != "negate")
OPERATORS = sorted(n for n in TABLE if n not in FUNCTIONS)


@dataclass
class Env:
    """What names mean: columns by name with tags, the row number, and the previous row's outputs where there is one."""

    columns: dict[str, Typed]
    settings: Settings
    rownum: Callable[[], Column] | None = None
    previous: Callable[[str], Typed] | None = None

    def column(self, node: Node) -> Typed:
        prefix, dot, rest = node.name.partition(".")
        name = node.name
        if dot and prefix in ("this", "prev", "other"):
            name = rest
        elif dot:
            raise PipelineError(f"{node.name!r} has an unknown prefix", line=node.line)
        else:
            prefix = "this"
        if name == "_rownum" and self.rownum is not None:
            return Typed(self.rownum() - (1 if prefix != "this" else 0), "uint")
        if prefix != "this":
            if self.previous is None:
                raise PipelineError(f"{node.name!r}: there is no previous record here", line=node.line)
            return self.previous(name)
        tag, bare = split_heading(name)
        found = self.columns.get(bare)
        if found is None or tag is not None and tag != found.tag:
            raise PipelineError(f"unknown name {node.name!r}; there are {', '.join(self.columns) or 'none'}", line=node.line)
        return found


def resolve(name: str, tags: tuple[str, ...], line: int | None = None) -> Overload:
    if name not in TABLE:
        raise PipelineError(f"unknown function {name!r}", line=line)
    for overload in TABLE[name]:
        if overload[0] == tags:
            return overload
    legal = "; ".join(f"({', '.join(k)}) -> {t}" for k, t, _ in TABLE[name])
    raise PipelineError(f"{name!r} doesn't take ({', '.join(tags)}), but {legal}", line=line)


def lower(node: Node, env: Env) -> Typed:
    if node.kind == "literal":
        return Typed(F.lit(node.value).cast(SPARK[node.tag]), node.tag, node.value if node.tag in (S, I) else None)
    if node.kind == "column":
        return env.column(node)
    args = [lower(a, env) for a in node.args]
    if node.kind == "if":
        condition, a, b = args
        if condition.tag != "bool":
            raise PipelineError("the condition of an if isn't bool", line=node.line)
        if a.tag != b.tag:
            raise PipelineError(f"the branches of an if are {a.tag} and {b.tag}", line=node.line)
        return Typed(F.when(condition.col, a.col).otherwise(b.col), a.tag)
    if node.name == "to_istring" and len(args) == 1 and args[0].literal is not None:
        return Typed(args[0].col.cast(SPARK[I]), I, args[0].literal)
    _, tag, how = resolve(node.name, tuple(a.tag for a in args), node.line)
    return Typed(how(env.settings, *args), tag)
