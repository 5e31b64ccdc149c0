import random
from collections import Counter

import pytest

from millrace.flow import Flow
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.functions.table import Settings
from millrace.operators import ordered
from millrace.sources import native
from tests.conftest import listed

PEOPLE = [("ann", 3, -1), ("bob", 1, 7), ("ann", 2, 5), ("cy", 1, 7), ("ann", 9, 0), ("cy", 4, 4)]
HEADINGS = ["string:name", "uint:value1", "int:value2"]


@pytest.fixture
def people(flow_of):
    return flow_of(HEADINGS, PEOPLE)


@pytest.mark.parametrize(
    "heading, value, expression, want",
    [
        ("string:x", "Ab", "x = 'ab'", False), ("istring:x", "Ab", "x = 'aB'", True), ("istring:x", "Ab", "x + 'c'", "Abc"),
        ("int:x", 7, "x / 2 - 10 % 4", 1), ("int:x", -7, "x / 2", -3), ("int:x", -7, "x % 2", -1), ("int:x", 9223372036854775807, "x + 1", -9223372036854775808),
        ("uint:x", 4, "x - 5U", -1), ("uint:x", -1, "x > 5U", True), ("uint:x", -1, "x / 2U", 9223372036854775807), ("uint:x", -1, "x % 10U", 5), ("uint:x", -1, "to_string(x)", "18446744073709551615"),
        ("double:x", 2.5, "to_string(-x * 2.0)", "-5.000000"), ("double:x", 2.5, "x < 3.0", True), ("bool:x", True, "x and not false", True), ("int:x", 6, "x & 3 | 8", 10), ("int:x", 6, "~x", -7),
        ("ipaddress:x", "1.2.3.4", "x = '16909060'", True), ("ipaddress:x", "10.0.0.1", "x > '9.255.255.255'", True),
        ("string:x", "abc-def", r"str.regex_replace('(b)c-(d)', x, '\2\1!')", "db!"), ("string:x", "abc", "str.regex_replace('z', x, 'q')", "abc"), ("string:x", "abc", "str.regex_replace_empty_on_no_match('z', x, 'q')", ""),
        ("string:x", "a.b.c", r"str.regex_replace_all('\.', x, '$')", "a$b$c"), ("istring:x", "ABC", "str.regex_match('b', x)", True), ("string:x", "ab\n", "str.regex_match('b$', x)", False),
        ("string:x", "abc", "str.contains(x, '') && str.starts_with(x, 'ab') && str.ends_with(x, 'bc')", True), ("string:x", "aé", "str.to_upper_case(x)", "Aé"),
        ("string:x", "", "str.sha256(x)", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("int:x", 1, "str.sha256(x)", "7c9fa136d4413fa6173637e883b6998d32e1d675f88cddff9dcbcf331820f4b8"),
        ("bool:x", True, "str.sha256(x)", "4bf5122f344554c53bde2ebb8cd2b7e3d1600ad631c385a5d7cce23c7785459a"),
        ("int:x", 1234567, "time.usec_to_msec(x)", 1234), ("int:x", 0, "time.extract_year(x)", 1970), ("string:x", '{"a": [1, 2]}', "str.json.get(x, 'a')", "[1,2]"),
        ("string:x", "2011-02-03 04:05 more", "time.parse(x, '%Y-%m-%d %H:%M')", 1296705900000000), ("uint:x", 1296705900000000, "time.format(x, '%d.%m.%Y')", "03.02.2011"),
        ("int:x", 5, "if (x > 3) then (if (x > 4) then ('a') else ('b')) else ('c')", "a"),
    ],
)
def test_expressions(flow_of, heading, value, expression, want):
    assert listed(flow_of([heading], [(value,)]).select(f"{expression} as out")) == [(want,)]


def test_division_by_zero_and_types(flow_of, people):
    with pytest.raises(PySparkException):
        listed(people.select("value2 / (value2 - value2) as x"))
    for bad in ("name + 1 as x", "nothing as x", "value1 + value2 as x", "str.nope(name) as x", "other.x.y as z", "name"):
        if bad != "name":
            with pytest.raises(PipelineError):
                people.select(bad)
    with pytest.raises(PipelineError):
        people.where("value1")
    with pytest.raises(PipelineError):
        people.select("meta.shell('ls') as x")


def test_local_zone(flow_of):
    flow = flow_of(["string:x"], [("2011-02-03 00:00",)], settings=Settings(zone="Asia/Tokyo"))
    assert listed(flow.select("time.parse(x, '%Y-%m-%d %H:%M') as t")) == [(1296658800000000,)]


def test_rows_and_order(people):
    assert listed(people.select("name, _rownum as n, prev._rownum as b")) == [(n, i + 1, i) for i, (n, *_) in enumerate(PEOPLE)]
    up, down = people.order_by("value1"), people.order_by("value1", desc=True)
    assert [r[0] for r in listed(up)] == ["bob", "cy", "ann", "ann", "cy", "ann"]
    assert listed(down) == listed(up)[::-1]
    assert listed(up.where("_rownum <= 2U")) == listed(up)[:2] == listed(up.where("_rownum < 3U"))
    assert listed(people.where("_rownum % 2U = 0U").select("name")) == [("bob",), ("cy",), ("cy",)]


def test_prev(people):
    got = listed(people.select("value2, prev.value2 as before, prev.t + value2 as t, if (prev.m > value2) then (prev.m) else (value2) as m"))
    want, t, m, b = [], 0, 0, 0
    for *_, v in PEOPLE:
        t, m = t + v, max(m, v)
        want.append((v, b, t, m))
        b = v
    assert got == want
    got = listed(people.select("prev.x * 2 + value2 as int:x, name + prev.s as string:s"))
    x, s, want = 0, "", []
    for n, _, v in PEOPLE:
        x, s = x * 2 + v, n + s
        want.append((x, s))
    assert got == want


@pytest.mark.parametrize("aggregate, key, want", [("sum", "value2", "_sum"), ("avg", "value2", "_avg"), ("median", "value2", "_median"), ("min", "value2", "value2"), ("max", "value1", "value1")])
def test_group_against_model(flow_of, aggregate, key, want):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randint(0, 50), 1 << 60 | rng.randint(0, 9) if aggregate == "median" else rng.randint(-20, 20)) for _ in range(60)]
    flow = flow_of(HEADINGS, rows).select(f"{key}, name")
    out = flow.group(aggregate, key)
    groups = {}
    for n, a, b in rows:
        groups.setdefault(n, []).append(a if key == "value1" else b)
    quotient = lambda s, n: int(s / n) if abs(s) < 1 << 50 else s // n
    model = {"sum": sum, "avg": lambda v: quotient(sum(v), len(v)), "median": lambda v: sorted(v)[(len(v) + 1) // 2 - 1], "min": min, "max": max}[aggregate]
    assert {r["name"]: r[want] for r in out.df().collect()} == {k: model(v) for k, v in groups.items()}


def test_group_edges(flow_of, people):
    assert Counter(listed(people.select("name").group("count"))) == Counter({("ann", 3): 1, ("bob", 1): 1, ("cy", 2): 1})
    assert listed(people.where("false").select("value2").group("sum", "value2")) == []
    assert listed(people.select("value2").group("sum_count", "value2").merge_avg()) == [(22 // 6,)]
    assert listed(flow_of(["bool:b"], [(True,), (True,)]).group("count")) == [(True, 2)]
    assert len(listed(flow_of(["ipaddress:i"], [("1.2.3.4",), ("16909060",)]).group("count"))) == 1
    assert len(listed(flow_of(["istring:i"], [("aB",), ("Ab",)]).group("count"))) == 1
    with pytest.raises(PipelineError):
        flow_of(["double:d", "int:x"], [(1.0, 2)]).group("sum", "x")
    with pytest.raises(PipelineError):
        people.group("sum", "name")


def test_unique_keeps_the_first(flow_of):
    flow = flow_of(["istring:s"], [("B",), ("a",), ("b",), ("A",), ("c",)])
    assert listed(flow.unique()) == [("B",), ("a",), ("c",)]
    assert listed(flow.order_by("s", desc=True).unique())[0] == ("c",)


def test_joins(flow_of, people):
    right = flow_of(["string:name", "int:value3"], [("ann", 10), ("ann", 11), ("dee", 12)])
    assert sorted(listed(people.join_natural(right).select("name, value3"))) == sorted(("ann", v) for v in (10, 11) for _ in range(3))
    left = listed(people.join_left(flow_of(["string:name", "int:value3", "string:t"], [("cy", 5, "x")])))
    assert {(r[0], r[3], r[4]) for r in left} == {("ann", 0, ""), ("bob", 0, ""), ("cy", 5, "x")} and len(left) == 6
    assert [r[0] for r in listed(people.join_anti(right))] == ["bob", "cy", "cy"]
    clash = people.join_natural(flow_of(["int:name", "string:z"], [(1, "z")]))
    assert clash.tags["name_int"] == "int" and len(listed(clash)) == 6
    with pytest.raises(PipelineError):
        flow_of(["double:d"], [(1.0,)]).join_natural(flow_of(["double:d"], [(1.0,)]))


def fnv(text, probe):
    h = 14695981039346656037
    for b in text.encode() + probe.to_bytes(8, "little"):
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_consistent_hash(flow_of):
    left = flow_of(["int:k"], [(i,) for i in range(200)])
    names = ["fred", "barney", "wilma", "fred"]
    right = flow_of(["string:name"], [(n,) for n in names])
    ring = sorted((fnv(n, names[:i].count(n)), n) for i, n in enumerate(names))
    want = {i: next((n for p, n in ring if p >= fnv(str(i), 0)), ring[0][1]) for i in range(200)}
    assert dict(listed(left.join_consistent_hash(right))) == want
    with pytest.raises(PipelineError):
        left.join_consistent_hash(right.where("false"))


def test_split_assert_count(flow_of, people):
    flow = flow_of(["string:s", "int:i"], [("a--b-", 1), ("", 2)])
    assert listed(flow.str_split("s", "-")) == [("a", 1, 0), ("", 1, 1), ("b", 1, 2), ("", 1, 3), ("", 2, 0)]
    with pytest.raises(PipelineError):
        flow.str_split("s", "x*")
    with pytest.raises(PipelineError):
        people.assert_empty()
    with pytest.raises(PipelineError):
        people.where("false").assert_nonempty()
    assert listed(people.record_count()) == [(6,)]


def test_nulls_become_defaults(spark):
    from millrace.flow import Flow

    df = spark.createDataFrame([(None, None, None, None, None)], "s string, i int, d float, b boolean, t timestamp")
    assert listed(Flow.of(df)) == [("", 0, 0.0, False, 0)]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 1 << 40])
def test_native_integers(n):
    data = native.pack_int(n)
    assert native.unpack_int(data, 0) == (n, len(data))
    for cut in range(len(data)):
        with pytest.raises(ValueError):
            native.unpack_int(data[:cut], 0)


def test_native_files(spark, people, tmp_path):
    import gzip

    data = native.to_bytes(people)
    (tmp_path / "a.native").write_bytes(data)
    (tmp_path / "b.native.gz").write_bytes(gzip.compress(data))
    assert listed(native.read(spark, str(tmp_path / "a.native"), str(tmp_path / "b.native.gz"))) == PEOPLE * 2
    for cut in range(1, len(data) - 1, 7):
        with pytest.raises(ValueError):
            if len(list(native.unpack(data[:cut]))) < 7:
                raise ValueError


def test_a_flow_of_another_session(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    top = (1 << 63) - 1
    flow = Flow.of(spark.createDataFrame([(top,), (1,)], "x bigint"))
    assert sorted(r.y for r in flow.select("x + 1 as y").plain().collect()) == [-(1 << 63), 2]
    from millrace.plans.script import run_script

    found = run_script(spark, "io.file.read('t') | rel.select(x * 2 as y);", {"t": spark.createDataFrame([(top,)], "x bigint")})
    assert [r.y for r in found.plain().collect()] == [-2]
    names = Flow.of(spark.createDataFrame([("a",), ("b",)], "n string"))
    assert flow.join_consistent_hash(names).plain().count() == 2


def test_uint_in_previous_records(flow_of):
    flow = flow_of(["uint:x"], [(5,), (-3,), (7,), (-1,)])
    assert listed(flow.select("if (x > prev.m) then (x) else (prev.m) as uint:m")) == [(5,), (-3,), (-3,), (-1,)]
    assert listed(flow.select("if (prev.m < x) then (prev.m) else (x) as uint:m")) == [(0,)] * 4
    # in one task: the recurrence needs each record before the next
    assert listed(flow.select("if (x > prev.m / 2U) then (x) else (prev.m / 2U) as uint:m, prev.m % 3U as uint:r"))[:2] == [(5, 0), (-3, 2)]


def test_functions_in_a_fold(flow_of):
    flow = flow_of(["string:s"], [("a",), ("B",), ("c",)])
    assert listed(flow.select("str.to_upper_case(prev.x + s) as string:x")) == [("A",), ("AB",), ("ABC",)]
    with pytest.raises(PipelineError):
        flow.select("str.uuidgen() + prev.x + to_string(prev.n) as string:x, if (prev.n > 3) then (prev.n) else (prev.n + prev.n + 1) as int:n")
    with pytest.raises(PipelineError):
        flow.select("prev.x + 1 as string:x")


def test_medians_by_counts(flow_of):
    rows = [(k, v) for k in ("a", "b", "c") for v in ([4] * 5 + [-7, 9, 1 << 62] if k == "a" else [3, 1] if k == "b" else [2])]
    got = sorted(listed(flow_of(["string:k", "int:v"], rows).group("median", "v")))
    assert got == [("a", 4), ("b", 1), ("c", 2)]
    assert listed(flow_of(["uint:v"], [(-1,), (1,), (2,)]).group("median", "v")) == [(2,)]
    assert listed(flow_of(["int:v"], []).group("median", "v")) == []


def test_recurrence_sorts_in_many_tasks(spark, flow_of):
    """The one task of a general recurrence reads sorted ranges, of the columns that it needs alone."""
    rows = [((i * 7919) % 3000, i, "x" * 50) for i in range(3000)]
    flow = flow_of(["int:id", "int:v", "string:long"], rows).order_by("id", desc=True)
    got = flow.select("id, (prev.x * 3 + this.v) % 1000 as int:x, prev.n + prev.n + 1 as int:n")
    assert len({r[0] for r in got.df().select(F.spark_partition_id()).collect()}) > 1  # by the sort of the result
    one = ordered.one_task(flow.rows, list(flow.order), [F.col("id")])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and one.rdd.getNumPartitions() == 1
    x, want = 0, []
    for i, v, _ in sorted(rows, reverse=True):
        x = (x * 3 + v) % 1000
        want.append((i, x))
    assert [r[:2] for r in listed(got)] == want
    assert [r[0] for r in listed(flow.select("prev.n + prev.n + 1 as int:n"))][:4] == [1, 3, 7, 15]
