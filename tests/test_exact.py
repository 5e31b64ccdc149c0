"""Sums of doubles and their text, against exact arithmetic."""

import math
import random

import pytest

from tests.conftest import listed

VALUES = [270123456789.12, 1.0000005, 1e23, 0.0000005, 1.25e-6, 2.5e-6, -0.0, 5e-324, 4294967296.0000005, -1234567.9999995, 1.7e308, 9007199254740993.0]


def test_text_of_doubles_is_of_the_value_itself(spark, flow_of):
    got = [r[0] for r in listed(flow_of(["double:x"], [(v,) for v in [*VALUES, math.inf, -math.inf, math.nan]]).select("to_string(x) as s"))]
    assert got == ["%.6f" % v for v in VALUES] + ["Infinity", "-Infinity", "NaN"]


@pytest.mark.parametrize("scale", [0, 30, 300])
def test_sums_are_rounded_once(spark, flow_of, scale):
    draw = random.Random(scale)
    rows = [(f"k{i % 3}", draw.uniform(-1, 1) * 10.0 ** draw.randint(-scale, scale)) for i in range(600)]
    rows += [("big", v) for v in (1e308, 1e308, -1e308, -1e308, 5e-324, 2.0**32, -(2.0**32) * (1 - 2**-53))] + [("over", 1.7e308)] * 2 + [("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", -5.0), ("zero", 0.0), ("zero", -0.0)]
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    from fractions import Fraction

    def whole(vs):
        if not all(map(math.isfinite, vs)):
            return sum(vs)
        try:
            return float(sum(map(Fraction, vs)))
        except OverflowError:
            return math.inf

    flow = flow_of(["string:k", "double:v"], rows)
    for aggregate, f in (("sum", whole), ("avg", lambda vs: whole(vs) / len(vs))):
        assert {k: repr(v) for k, v in listed(flow.group(aggregate, "v"))} == {k: repr(f(vs)) for k, vs in groups.items()}
    assert {r[0]: repr(r[1]) for r in listed(flow.group("sum_count", "v").merge_avg())} == {k: repr(whole(vs) / len(vs)) for k, vs in groups.items()}
    assert listed(flow.where("k = 'big'").select("v").group("sum", "v")) == [(whole(groups["big"]),)]
    assert listed(flow.where("k = 'none'").select("v").group("sum", "v")) == []


def test_order_of_rows_does_not_show(spark, flow_of):
    cents = [(round(i * 1234.57 % 450_000, 2),) for i in range(20_000)]
    both = [listed(flow_of(["double:v"], x).group("sum", "v").select("to_string(_sum) as s")) for x in (cents, cents[::-1])]
    assert both == [[("%.6f" % math.fsum(v for v, in cents),)]] * 2
