"""Select with references to the row written before.

An output whose own expression has no such reference is lagged; a running sum, greatest or least is
taken partition by partition; everything else is a fold over the rows in order, in one task.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from millrace.errors import PipelineError
from millrace.functions.table import json_member, resolve
from millrace.plans.parser import Node
from millrace.types import split_heading


def refers(node: Node) -> set[str]:
    """Headings of the previous row that an expression names."""
    return {n.name.partition(".")[2] for n in node.walk() if n.kind == "column" and n.name.startswith(("prev.", "other.")) and not n.name.endswith("._rownum")}


def _is(node: Node, heading: str) -> bool:
    return node.kind == "column" and node.name in (f"prev.{heading}", f"other.{heading}")


def _key(node: Node):
    return (node.kind, node.name, node.tag, node.value, tuple(map(_key, node.args)))


def recurrence(node: Node, heading: str) -> tuple[str, Node] | None:
    """('sum' | 'max' | 'min', the row's own part) of an output that accumulates itself."""
    if node.kind == "call" and node.name == "+":
        for mine, other in (node.args, node.args[::-1]):
            if _is(mine, heading) and not refers(other):
                return "sum", other
    if node.kind == "if" and node.args[0].kind == "call" and node.args[0].name in ("<", ">", "<=", ">="):
        test, yes, no = node.args
        a, b = test.args
        greater = test.name[0] == ">"
        if _is(b, heading):
            own = a
        elif _is(a, heading):
            own, greater = b, not greater
        else:
            return None
        if refers(own):
            return None
        if _key(yes) == _key(own) and _is(no, heading):
            return ("max" if greater else "min"), own
        if _is(yes, heading) and _key(no) == _key(own):
            return ("min" if greater else "max"), own
    return None


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _unsigned(x: int) -> int:
    return x % (1 << 64)


def _ip(x: str) -> int:
    parts = x.split(".")
    return sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)) if len(parts) == 4 else int(x)


def _quotient(a: int, b: int) -> int:
    if not b:
        raise ZeroDivisionError("integer division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def _compared(tags: tuple[str, ...]) -> Callable:
    """What values of these types are compared by."""
    if "ipaddress" in tags:
        return _ip
    if "istring" in tags:
        return str.lower
    return _unsigned if tags[0] == "uint" else lambda x: x


def _text(tag: str) -> Callable:
    return {"double": lambda x: f"{x:.6f}", "bool": lambda x: "true" if x else "false", "uint": lambda x: str(_unsigned(x))}.get(tag, str)


_LETTERS = {"str.to_upper_case": (97, -32), "str.to_lower_case": (65, 32)}


def _moment(x: int):
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=x)


def _python(name: str, tags: tuple[str, ...], nodes: list[Node]) -> Callable | None:
    """The function over Python values; None where there is none."""
    first = tags[0] if tags else ""
    if name in ("=", "!=", "<", ">", "<=", ">="):
        by, test = _compared(tags), {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}[name]
        return lambda a, b: test(by(a), by(b))
    if name in ("+", "-", "*"):
        act = {"+": operator.add, "-": operator.sub, "*": operator.mul}[name]
        return (lambda a, b: _signed(act(a, b))) if first in ("int", "uint") else act
    if name in ("/", "%"):
        if first == "double":
            return _ratio
        both = _unsigned if first == "uint" else lambda x: x
        if name == "/":
            return lambda a, b: _signed(_quotient(both(a), both(b)))
        return lambda a, b: _signed(both(a) - both(b) * _quotient(both(a), both(b)))
    simple = {"&": operator.and_, "|": operator.or_, "~": operator.invert, "negate": (lambda a: _signed(-a)) if first == "int" else operator.neg, "&&": lambda a, b: a and b, "||": lambda a, b: a or b, "!": operator.not_}
    if name in simple:
        return simple[name]
    if name in ("to_string", "to_istring"):
        return _text(first)
    if name in _LETTERS:
        start, step = _LETTERS[name]
        table = {c: c + step for c in range(start, start + 26)}
        return lambda a: a.translate(table)
    if name in ("str.starts_with", "str.ends_with", "str.contains"):
        fold = str.lower if "istring" in tags else str
        act = {"str.starts_with": str.startswith, "str.ends_with": str.endswith, "str.contains": str.__contains__}[name]
        return lambda a, b: act(fold(a), fold(b))
    if name == "str.regex_match" and nodes[0].kind == "literal":
        pattern = re.compile(nodes[0].value, re.S | (re.I if "istring" in tags else 0))
        return lambda _, a: pattern.search(a) is not None
    if name == "str.sha256" and first in ("string", "istring", "ipaddress"):
        return lambda a: hashlib.sha256(a.encode()).hexdigest()
    if name == "str.json.get":
        return json_member
    if name.startswith("time.extract_"):
        part = name.removeprefix("time.extract_")
        return lambda a: getattr(_moment(a), part)
    scale = {"time.usec_to_msec": 1000, "time.usec_to_sec": 1_000_000}.get(name)
    if scale:
        return lambda a: _quotient(a, scale)
    scale = {"time.msec_to_usec": 1000, "time.sec_to_usec": 1_000_000}.get(name)
    return (lambda a: _signed(a * scale)) if scale else None


def compiled(node: Node, columns: dict[str, str], outputs: dict[str, str]) -> tuple[Callable, str]:
    """A function of (row, previous outputs, row number) for the fold, and the type of its value."""
    if node.kind == "literal":
        return (lambda row, before, number, v=node.value: v), node.tag
    if node.kind == "column":
        prefix, dot, rest = node.name.partition(".")
        older = prefix in ("prev", "other")
        name = rest if dot else node.name
        if name == "_rownum":
            return (lambda row, before, number: number - older), "uint"
        bare = split_heading(name)[1]
        found = outputs if older else columns
        if bare not in found:
            raise PipelineError(f"unknown name {node.name!r}", line=node.line)
        return ((lambda row, before, number: before[bare]) if older else (lambda row, before, number: row[bare])), found[bare]
    made = [compiled(a, columns, outputs) for a in node.args]
    acts, tags = [m[0] for m in made], tuple(m[1] for m in made)
    if node.kind == "if":
        test, yes, no = acts
        if tags[0] != "bool" or tags[1] != tags[2]:
            raise PipelineError(f"an if takes a bool and two values of one type, not {', '.join(tags)}", line=node.line)
        return (lambda row, before, number: yes(row, before, number) if test(row, before, number) else no(row, before, number)), tags[1]
    tag, act = resolve(node.name, tags, node.line)[1], _python(node.name, tags, node.args)
    if act is None:
        raise PipelineError(f"{node.name!r} can't be used in a select that refers to the previous record in this way", line=node.line)
    return (lambda row, before, number: act(*(f(row, before, number) for f in acts))), tag
