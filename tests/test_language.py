import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.errors import PipelineError
from millrace.functions import patterns
from millrace.functions.table import FUNCTIONS, json_member, resolve
from millrace.plans.lexer import tokens
from millrace.plans.parser import parse
from millrace.plans.script import OPERATORS, manual, pipelines


def shape(text):
    def show(n):
        if n.kind == "literal":
            return n.value
        if n.kind == "column":
            return n.name
        return ("if" if n.kind == "if" else n.name, *map(show, n.args))

    return show(parse(tokens(text)))


@pytest.mark.parametrize(
    "text, want",
    [
        ("1 + 2 * 3", ("+", 1, ("*", 2, 3))),
        ("(1 + 2) * 3", ("*", ("+", 1, 2), 3)),
        ("a - b - c", ("-", ("-", "a", "b"), "c")),
        ("-a + -(b)", ("+", ("negate", "a"), ("negate", "b"))),
        ("a - -1", ("-", "a", ("negate", 1))),
        ("a = b && c < d || !e", ("||", ("&&", ("=", "a", "b"), ("<", "c", "d")), ("!", "e"))),
        ("a & 1 = 1", ("&", "a", ("=", 1, 1))),
        ("a or b and not c", ("||", "a", ("&&", "b", ("!", "c")))),
        ("f(a, 'x', g())", ("f", "a", "x", ("g",))),
        ("if (a) then (1) else (if (b) then (2) else (3))", ("if", "a", 1, ("if", "b", 2, 3))),
        ("prev.x mod 2U", ("%", "prev.x", 2)),
        ("1.0E+4", 10000.0),
        (r"'a\tb\'\q'", "a\tb'\\q"),
    ],
)
def test_precedence_and_tokens(text, want):
    assert shape(text) == want


def test_comments_raw_blocks_and_lines():
    found = tokens("# note\nlang.python(@@@ a; ' @@@); $1")
    assert [(t.kind, t.line) for t in found][:3] == [("name", 2), ("symbol", 2), ("raw", 2)] and found[-1].kind == "argument"


@given(st.recursive(st.integers(0, 99).map(str), lambda inner: st.tuples(inner, st.sampled_from(["+", "-", "*"]), inner).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), max_leaves=8))
def test_random_arithmetic(text):
    def value(x):
        if not isinstance(x, tuple):
            return x
        op, *args = x
        a, b = map(value, args)
        return {"+": a + b, "-": a - b, "*": a * b}[op]

    assert value(shape(text)) == eval(text)


@pytest.mark.parametrize("text", ["1 +", "f(1", "(1", "1 2", "'open", "f(,)", "a ? b"])
def test_bad_expressions(text):
    with pytest.raises(PipelineError):
        parse(tokens(text))


@pytest.mark.parametrize("text", ["rel.where(a)", "rel.where(a) |", "rel.where(a;", "rel.where(a) rel.unique();", "5;"])
def test_bad_scripts(text):
    with pytest.raises(PipelineError):
        pipelines(tokens(text))


def test_whole_surface():
    assert len(OPERATORS) == 46 and len(FUNCTIONS) == 32
    assert all(f"`{n}`" in manual() for n in [*OPERATORS, *FUNCTIONS])


def test_no_implicit_conversion():
    with pytest.raises(PipelineError, match="int, int"):
        resolve("+", ("int", "uint"))
    with pytest.raises(PipelineError):
        resolve("=", ("double", "double"))


def test_patterns():
    assert patterns.regex("a$[$]") == r"(?s)a\z[$]"
    assert patterns.groups(r"(a)\((?:b)(?<n>c)[(]") == 2
    assert patterns.template(r"x\1\\\q\0") == ["x", 1, "\\q", 0]
    for bad in (r"\K", "(?R)", "(?1)", "(?(1)a|b)"):
        with pytest.raises(PipelineError):
            patterns.regex(bad)
    assert patterns.time_format("%F it's %H") == ("yyyy'-'MM'-'dd' it''s 'HH", r"\d{4}\-\d{2}\-\d{2}\ it's\ \d{2}")


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1.10, "b": [1, {"a": 2}]}', "1.10"), ('{"b":1}', ""), ("[1]", ""), ('{"a" : "x y"}', '"x y"'), ('{"a":{"b": [ 1 , 2 ]}}', '{"b":[1,2]}'), ('{"a":1,"a":2}', "12"), ('{"a":1', "1"), ("", "")],
)
def test_json_member(text, want):
    assert json_member(text, "a") == want


@pytest.mark.parametrize("text", ['{"a\\n": 1}', "{a: 1}", '{"a":' + "[" * 200])
def test_json_errors(text):
    with pytest.raises(ValueError):
        json_member(text, "a")
