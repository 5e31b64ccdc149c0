"""Queries over the supplied tables, and the SQL that gives the same rows.

Most are scripts of the pipeline language. Texts that a codec has to read are first written to the folder
that driver and executors share.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import __version__, streaming
from millrace.flow import Flow
from millrace.operators import scripting
from millrace.plans.script import OPERATORS, run_script
from millrace.session import child, shared_dir
from millrace.sources import native, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


class Tables(dict):
    """Tables of a folder, opened when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name) -> bool:
        return name in TABLES or super().__contains__(name)

    def __missing__(self, name: str) -> Flow:
        if name not in TABLES:
            raise KeyError(name)
        self[name] = flow(self.spark, self.sf_dir, name)
        return self[name]

    def get(self, name, default=None):
        return self[name] if name in self else default


def flow(spark: SparkSession, sf_dir: str, name: str) -> Flow:
    return Flow.parquet(spark, f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def script(name: str, code: str, sql: str | None = None, **more) -> None:
    """Registers a script; it may use any table by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_script(spark, code, Tables(spark, sf_dir), **more)
        return out.plain() if isinstance(out, Flow) else out.select("value")

    run.__name__ = name
    query(sql)(run)


# -- filters and expressions -----------------------------------------------------------------------
script("script_end_to_end", """
    # total price of finished orders by priority
    io.file.read('orders') | rel.where(o_orderstatus = 'F') | rel.select(o_orderpriority, o_totalprice)
    | rel.group(sum o_totalprice) | rel.select(o_orderpriority, to_string(_sum) as total) | rel.order_by(o_orderpriority);
""", "SELECT o_orderpriority, printf('%.6f', sum(o_totalprice)) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")  # fmt: skip
script("where_eq", "io.file.read('orders') | rel.where(o_orderstatus = 'O') | rel.select(o_orderkey, o_orderstatus);", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
script("where_range", "io.file.read('orders') | rel.where(o_totalprice >= 1000.0 && o_totalprice < 50000.0) | rel.select(o_orderkey, o_totalprice);", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
script("where_bool", "io.file.read('orders') | rel.where(not (o_orderstatus = 'F' or o_orderkey % 3 = 0) and !(o_custkey > 500)) | rel.select(o_orderkey);", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderkey % 3 = 0) AND NOT (o_custkey > 500)")
script("where_compare", "io.file.read('orders') | rel.where(o_orderpriority <> '1-URGENT' && o_orderkey <= 5000 && o_orderpriority != '5-LOW') | rel.select(o_orderkey, o_orderpriority);", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey <= 5000 AND o_orderpriority <> '5-LOW'")
script("select_arith", "io.file.read('lineitem') | rel.select(l_orderkey + l_partkey * 2 - l_suppkey as x, l_quantity * 2.0 + 1.5 as y, l_quantity - 0.5 as z);", "SELECT l_orderkey + l_partkey * 2 - l_suppkey AS x, l_quantity * 2.0::DOUBLE + 1.5::DOUBLE AS y, l_quantity - 0.5::DOUBLE AS z FROM lineitem")
script("select_int_div", "io.file.read('lineitem') | rel.select(l_orderkey / 7 as a, (0 - l_partkey) / 7 as b, l_quantity / 4.0 as c);", "SELECT l_orderkey // 7 AS a, -(l_partkey // 7) AS b, l_quantity / 4.0::DOUBLE AS c FROM lineitem")
script("select_mod", "io.file.read('lineitem') | rel.select(l_orderkey % 7 as a, (0 - l_partkey) mod 5 as b);", "SELECT l_orderkey % 7 AS a, -(l_partkey % 5) AS b FROM lineitem")
script("select_bitwise", "io.file.read('lineitem') | rel.select(l_orderkey & l_partkey as a, l_orderkey | l_suppkey as b, ~l_orderkey as c);", "SELECT l_orderkey & l_partkey AS a, l_orderkey | l_suppkey AS b, ~l_orderkey AS c FROM lineitem")
script("select_unary", "io.file.read('lineitem') | rel.select(-l_orderkey as a, -l_quantity as b);", "SELECT -l_orderkey AS a, -l_quantity AS b FROM lineitem")
script("select_uint", "io.file.read('orders') | rel.select(o_orderkey as uint:k, o_orderkey) | rel.select(k - 5U > 100U as wraps, k / 3U as q, k % 3U as r, o_orderkey);", "SELECT o_orderkey < 5 OR o_orderkey > 105 AS wraps, o_orderkey // 3 AS q, o_orderkey % 3 AS r, o_orderkey FROM orders")
script("select_if", "io.file.read('orders') | rel.select(o_orderkey, if (o_totalprice < 1000.0) then ('low') else (if (o_totalprice < 100000.0) then ('mid') else ('high')) as band);", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END AS band FROM orders")
script("select_concat", "io.file.read('nation') | rel.select(n_name + '/' + to_string(n_regionkey) as x);", "SELECT n_name || '/' || n_regionkey AS x FROM nation")
script("upper", "io.file.read('customer') | rel.select(c_custkey, str.to_upper_case(c_name) as x);", "SELECT c_custkey, upper(c_name) AS x FROM customer")
script("lower", "io.file.read('customer') | rel.select(c_custkey, str.to_lower_case(c_mktsegment) as x);", "SELECT c_custkey, lower(c_mktsegment) AS x FROM customer")
script("to_string_double", "io.file.read('customer') | rel.select(c_custkey, to_string(c_acctbal) as x, to_string(c_custkey = 5) as b);", "SELECT c_custkey, printf('%.6f', c_acctbal) AS x, (c_custkey = 5)::VARCHAR AS b FROM customer")
script("retag", "io.file.read('orders') | rel.select(o_totalprice as string:s, to_string(o_orderkey) as int:i, o_orderkey as double:d);", "SELECT printf('%.6f', o_totalprice) AS s, o_orderkey AS i, o_orderkey::DOUBLE AS d FROM orders")
script("regex_match", r"io.file.read('part') | rel.where(str.regex_match('^[a-m].*e', p_name)) | rel.select(p_partkey, p_name);", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e', 's')")
script("regex_replace", r"io.file.read('orders') | rel.select(o_orderkey, str.regex_replace('(\d)-([A-Z]+)', o_orderpriority, '\2:\1') as x);", r"SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '(\d)-([A-Z]+)') THEN regexp_extract(o_orderpriority, '(\d)-([A-Z]+)', 2) || ':' || regexp_extract(o_orderpriority, '(\d)-([A-Z]+)', 1) ELSE o_orderpriority END AS x FROM orders")
script("regex_replace_empty", r"io.file.read('orders') | rel.select(o_orderkey, str.regex_replace_empty_on_no_match('[12]-(.)', o_orderpriority, '<\1>') as x);", r"SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '[12]-(.)') THEN '<' || regexp_extract(o_orderpriority, '[12]-(.)', 1) || '>' ELSE '' END AS x FROM orders")
script("regex_replace_all", r"io.file.read('part') | rel.select(p_partkey, str.regex_replace_all('[aeiou](.)', p_name, '\1$') as x);", r"SELECT p_partkey, regexp_replace(p_name, '[aeiou](.)', '\1$', 'g') AS x FROM part")
script("starts_ends_contains", "io.file.read('part') | rel.select(p_partkey, str.starts_with(p_type, 'S') as s, str.ends_with(p_type, 'L') as e, str.contains(p_type, 'A') as c);", "SELECT p_partkey, starts_with(p_type, 'S') AS s, ends_with(p_type, 'L') AS e, contains(p_type, 'A') AS c FROM part")
script("istring_eq", "io.file.read('nation') | rel.where(to_istring(n_name) = str.to_lower_case(n_name)) | rel.select(n_nationkey, n_name);", "SELECT n_nationkey, n_name FROM nation")
script("istring_group", "io.file.read('orders') | rel.select(if (o_orderkey % 2 = 0) then (str.to_lower_case(o_orderpriority)) else (o_orderpriority) as istring:p) | rel.group(count) | rel.select(str.to_upper_case(p) as p, _count);", "SELECT o_orderpriority AS p, count(*) AS _count FROM orders GROUP BY 1")
script("sha256_str", "io.file.read('customer') | rel.select(c_custkey, str.sha256(c_name) as x);", "SELECT c_custkey, sha256(c_name) AS x FROM customer")
script("json_get", "io.file.read('events') | rel.select(event_id, str.json.get(props, 'k') as k, str.json.get(props, 'absent') as no);", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS k, '' AS no FROM events")
script("time_convert", "io.file.read('events') | rel.select(event_id, time.usec_to_msec(ts) as ms, time.usec_to_sec(ts) as s, time.sec_to_usec(time.usec_to_sec(ts)) as back, time.msec_to_usec(time.usec_to_msec(ts)) as mback);", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 * 1000000 AS back, epoch_us(ts) // 1000 * 1000 AS mback FROM events")
script("time_extract", "io.file.read('events') | rel.select(event_id, time.extract_year(ts) as y, time.extract_month(ts) as mo, time.extract_day(ts) as d, time.extract_hour(ts) as h, time.extract_minute(ts) as mi, time.extract_second(ts) as s);", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
script("time_format", "io.file.read('orders') | rel.select(o_orderkey, time.format(d, '%Y-%m-%d at %H:%M') as x) ;".replace("rel.select(o_orderkey, time", "rel.select(o_orderkey, o_orderdate as uint:d) | rel.select(o_orderkey, time"), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d at %H:%M') AS x FROM orders")
script("time_parse", "io.file.read('orders') | rel.select(o_orderkey, o_orderdate as uint:d) | rel.select(o_orderkey, time.parse(time.format(d, '%Y/%m/%d') + ' rest', '%Y/%m/%d') as x);", "SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS x FROM orders")

# -- aggregation ----------------------------------------------------------------------------------
script("group_count", "io.file.read('events') | rel.select(event_type, user_id) | rel.group(count);", "SELECT event_type, user_id, count(*) AS _count FROM events GROUP BY 1, 2")
script("group_sum", "io.file.read('lineitem') | rel.select(l_returnflag, l_linestatus, l_partkey) | rel.group(sum l_partkey);", "SELECT l_returnflag, l_linestatus, sum(l_partkey)::BIGINT AS _sum FROM lineitem GROUP BY 1, 2")
script("group_avg_int", "io.file.read('lineitem') | rel.select(l_returnflag, l_linestatus, l_partkey) | rel.group(avg l_partkey);", "SELECT l_returnflag, l_linestatus, sum(l_partkey)::BIGINT // count(*) AS _avg FROM lineitem GROUP BY 1, 2")
script("group_avg_double", "io.file.read('lineitem') | rel.select(l_returnflag, l_linestatus, l_quantity) | rel.group(avg l_quantity) | rel.select(l_returnflag, l_linestatus, to_string(_avg) as a);", "SELECT l_returnflag, l_linestatus, printf('%.6f', avg(l_quantity)) AS a FROM lineitem GROUP BY 1, 2")
script("group_min", "io.file.read('orders') | rel.select(o_orderpriority, o_totalprice) | rel.group(min o_totalprice);", "SELECT o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
script("group_max", "io.file.read('lineitem') | rel.select(l_extendedprice, l_returnflag) | rel.group(max l_extendedprice);", "SELECT max(l_extendedprice) AS l_extendedprice, l_returnflag FROM lineitem GROUP BY 2")
script("group_median", "io.file.read('events') | rel.select(user_id, event_type) | rel.group(median user_id);", "SELECT event_type, quantile_disc(user_id, 0.5) AS _median FROM events GROUP BY 1")
script("group_median_double", "io.file.read('events') | rel.select(event_type, value) | rel.group(median value);", "SELECT event_type, quantile_disc(value, 0.5) AS _median FROM events GROUP BY 1")
script("group_sum_count", "io.file.read('events') | rel.select(event_type, user_id) | rel.group(sum_count user_id);", "SELECT event_type, sum(user_id)::BIGINT AS _sum, count(*) AS _count FROM events GROUP BY 1")


@query("SELECT event_type, sum(user_id)::BIGINT // count(*) AS _avg FROM events GROUP BY 1")
def merge_avg(spark, sf_dir):
    events = flow(spark, sf_dir, "events")
    parts = [events.where(f"event_id % 2 = {k}").select("event_type, user_id").group("sum_count", "user_id") for k in (0, 1)]
    return parts[0].union(parts[1]).merge_avg().plain()


# -- joins ----------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_natural(spark, sf_dir):
    customers = flow(spark, sf_dir, "customer").select("c_custkey as o_custkey, c_name")
    return flow(spark, sf_dir, "orders").select("o_orderkey, o_custkey").join_natural(customers).plain()


@query("SELECT c_custkey, c_nationkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_natural_dup(spark, sf_dir):
    orders = flow(spark, sf_dir, "orders").select("o_custkey as c_custkey, o_orderkey")
    return flow(spark, sf_dir, "customer").select("c_custkey, c_nationkey").join_natural(orders).plain()


@query("SELECT a.r_name, b.r_name AS other FROM region a CROSS JOIN region b")
def join_natural_cross(spark, sf_dir):
    regions = flow(spark, sf_dir, "region")
    return regions.select("r_name").join_natural(regions.select("r_name as other")).plain()


@query("SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def join_left_defaults(spark, sf_dir):
    orders = flow(spark, sf_dir, "orders").where("o_totalprice > 200000.0").select("o_custkey as c_custkey, o_orderkey, o_orderstatus")
    return flow(spark, sf_dir, "customer").select("c_custkey").join_left(orders).plain()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_anti(spark, sf_dir):
    orders = flow(spark, sf_dir, "orders").where("o_totalprice > 200000.0").select("o_custkey as c_custkey")
    return flow(spark, sf_dir, "customer").select("c_custkey, c_name").join_anti(orders).plain()


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def istring_join(spark, sf_dir):
    wanted = Flow.of(child(spark).createDataFrame([("bUiLdInG",)], "seg string")).select("seg as istring:seg")
    return flow(spark, sf_dir, "customer").select("c_custkey, c_mktsegment as istring:seg").join_natural(wanted).select("c_custkey").plain()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_idiom(spark, sf_dir):
    keys = flow(spark, sf_dir, "customer").where("c_acctbal > 0.0").select("c_custkey as o_custkey").unique()
    return flow(spark, sf_dir, "orders").select("o_orderkey, o_custkey").join_natural(keys).plain()


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def except_idiom(spark, sf_dir):
    return flow(spark, sf_dir, "customer").select("c_nationkey as k").join_anti(flow(spark, sf_dir, "supplier").select("s_nationkey as k")).plain()


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def intersect_idiom(spark, sf_dir):
    return flow(spark, sf_dir, "customer").select("c_nationkey as k").unique().join_natural(flow(spark, sf_dir, "supplier").select("s_nationkey as k").unique()).plain()


# FNV-1a's start and prime for 64 bits, and its powers for eight zero bytes.
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(hex({0})) // 2 + 1), lambda i: ('0x' || hex({0})[2 * i - 1:2 * i])::UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)"
_ZEROS = pow(1099511628211, 8, 1 << 64)


@query(f"""WITH p AS (SELECT s_suppkey, s_name, s_suppkey || s_name AS t FROM supplier), q AS (SELECT o_orderkey, o_orderkey || '' AS t FROM orders),
  ps AS (SELECT s_suppkey, s_name, {_FNV.format('t')} * {_ZEROS}::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM p), qs AS (SELECT o_orderkey, {_FNV.format('t')} * {_ZEROS}::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM q),
  first AS (SELECT s_suppkey, s_name FROM ps ORDER BY h LIMIT 1)
  SELECT o_orderkey, coalesce(m.s_suppkey, first.s_suppkey) AS s_suppkey, coalesce(m.s_name, first.s_name) AS s_name FROM (SELECT o_orderkey, ps.s_suppkey, ps.s_name FROM qs ASOF LEFT JOIN ps ON qs.h <= ps.h) m, first""")
def join_consistent_hash(spark, sf_dir):
    suppliers = flow(spark, sf_dir, "supplier").select("s_suppkey, s_name")
    return flow(spark, sf_dir, "orders").select("o_orderkey").join_consistent_hash(suppliers).plain()


# -- order, distinct, sets ------------------------------------------------------------------------
script("order_by_multi", "io.file.read('orders') | rel.order_by(o_orderpriority, o_totalprice, o_orderkey) | rel.where(_rownum <= 50U) | rel.select(o_orderkey, o_orderpriority);", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice, o_orderkey LIMIT 50")
script("order_by_desc", "io.file.read('orders') | rel.order_by.desc(o_totalprice, o_orderkey) | rel.select(o_orderkey, o_totalprice) | rel.where(_rownum < 31U);", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30")
script("order_by_aliases", "io.file.read('orders') | rel.order_by.mergesort.desc(o_totalprice, o_orderkey) | rel.order_by.quicksort(o_orderstatus) | rel.where(_rownum <= 40U) | rel.select(o_orderkey);", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey DESC LIMIT 40")
script("topk_idiom", "io.file.read('lineitem') | rel.select(l_extendedprice) | rel.order_by.desc(l_extendedprice) | rel.where(_rownum <= 10U);", "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10")
script("rownum", "io.file.read('orders') | rel.order_by(o_orderkey) | rel.select(o_orderkey, _rownum as n, other._rownum as before);", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, row_number() OVER (ORDER BY o_orderkey) - 1 AS before FROM orders")
script("prev_lag", "io.file.read('events') | rel.order_by(event_id) | rel.select(event_id, user_id, user_id - prev.user_id as step);", "SELECT event_id, user_id, user_id - lag(user_id, 1, 0) OVER (ORDER BY event_id) AS step FROM events")
script("prev_running_sum", "io.file.read('events') | rel.order_by(event_id) | rel.select(event_id, prev.total + user_id as total, if (user_id > prev.top) then (user_id) else (prev.top) as top);", "SELECT event_id, (sum(user_id) OVER (ORDER BY event_id))::BIGINT AS total, greatest(0, max(user_id) OVER (ORDER BY event_id)) AS top FROM events")
script("prev_general", "io.file.read('events') | rel.order_by(event_id) | rel.select(event_id, (prev.x * 3 + user_id) % 1000 as int:x);", "WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS i FROM events), r AS (SELECT i, event_id, user_id % 1000 AS x FROM e WHERE i = 1 UNION ALL SELECT e.i, e.event_id, (r.x * 3 + e.user_id) % 1000 FROM r JOIN e ON e.i = r.i + 1) SELECT event_id, x FROM r")
script("unique_rows", "io.file.read('events') | rel.select(event_type, user_id) | rel.unique();", "SELECT DISTINCT event_type, user_id FROM events")
script("count_distinct_idiom", "io.file.read('events') | rel.select(event_type, user_id) | rel.unique() | rel.select(event_type) | rel.group(count);", "SELECT event_type, count(DISTINCT user_id) AS _count FROM events GROUP BY 1")
script("union_files", "io.file.read('nation', 'nation') | rel.select(n_nationkey);", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
script("str_split", "io.file.read('orders') | rel.select(o_orderkey, o_orderpriority) | rel.str_split(o_orderpriority, '-');", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS o_orderpriority, generate_subscripts(string_split(o_orderpriority, '-'), 1) - 1 AS _counter FROM orders")
script("generate_sequence", "rel.generate_sequence(-5, 3 * 1000) | rel.select(_seq, _seq * _seq as sq);", "SELECT range AS _seq, range * range AS sq FROM range(-5, 3000)")
script("record_count", "io.file.read('lineitem') | rel.where(l_returnflag = 'R') | rel.record_count();", "SELECT count(*) AS _count FROM lineitem WHERE l_returnflag = 'R'")
script("assert_nonempty", "io.file.read('region') | rel.assert.nonempty() | rel.select(r_name);", "SELECT r_name FROM region")
script("remote", "io.file.read('nation') | meta.remote('localhost', rel.where(n_regionkey = 1) | rel.select(n_name));", "SELECT n_name FROM nation WHERE n_regionkey = 1")


# -- codecs and files -----------------------------------------------------------------------------
def _roundtrip(kind: str):
    @query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
    def run(spark, sf_dir):
        nation, path = flow(spark, sf_dir, "nation").order_by("n_nationkey"), scratch(spark)
        if kind == "native":
            native.write(nation, path)
            return native.read(spark, path).plain()
        text.save(getattr(text, f"{kind}_lines")(nation), path, end="\0" if kind == "usv" else "\n")
        return (text.from_usv(spark, path) if kind == "usv" else getattr(text, f"from_{kind}")(text.lines(spark, path))).plain()

    del QUERIES["run"]
    QUERIES[f"{kind}_roundtrip"], ORACLE_SQL[f"{kind}_roundtrip"] = run, ORACLE_SQL.pop("run")


for _kind in ("tsv", "csv", "usv", "native"):
    _roundtrip(_kind)


@query(r"SELECT regexp_extract(url, '^(\w+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(\w+)://([^/]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^(\w+)://([^/]+)')")
def from_text(spark, sf_dir):
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.regexp_replace("url", "[\r\n]", " ")).write.text(path)
    return text.from_text(text.lines(spark, path), r"^(\w+)://([^/]+)", ["scheme", "string:host"], ignore_non_matching=True).plain()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def parallel_mapping(spark, sf_dir):
    """Orders split into files of 5,000 records, a filter over each, all together."""
    orders = flow(spark, sf_dir, "orders").order_by("o_orderkey").select("o_orderkey")
    files = text.record_split(orders, 5000, f"{scratch(spark)}/shard-")
    listed = Flow.of(child(spark).createDataFrame([(f, "localhost") for f in files], "file_name string, host_name string"))
    return scripting.per_file(listed, lambda f: f.where("o_orderkey % 7 = 0"), lambda name: text.from_tsv(text.lines(spark, name)), lambda names: text.tsv_tables(spark, *names)).plain()


@query("SELECT count(*) AS _count FROM orders")
def record_split(spark, sf_dir):
    orders = flow(spark, sf_dir, "orders").order_by("o_orderkey").select("o_orderkey, o_orderstatus")
    files = text.record_split(orders, 10_000, f"{scratch(spark)}/shard-")
    first, *rest = text.tsv_tables(spark, *files)
    for r in rest:
        first = first.union(r)
    return first.record_count().plain()


script("python_udtf", """
    io.file.read('events') | rel.select(event_id, value) | rel.order_by(event_id) | lang.python(@@@
        for r in input_stream:
            output_stream.write({'event_id': r.event_id, 'v': r.value + 1.0})
    @@@);
""", "SELECT event_id, value + 1 AS v FROM events", allow_side_effects=True)  # fmt: skip


@query("SELECT o_orderpriority, printf('%.6f', sum(o_totalprice)) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def macro_op(spark, sf_dir):
    """A script in a file as an operator of its own."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/totals_of", "w") as f:
            f.write("rel.where(o_orderstatus = $1) | rel.select(o_orderpriority, $2) | $3(sum $2) | rel.select(o_orderpriority, to_string(_sum) as total);")
        return run_script(spark, "io.file.read('orders') | totals_of('F', o_totalprice, rel.group);", Tables(spark, sf_dir), search=[folder]).plain()


# -- one row for each operator that the queries above don't name -------------------------------------
script("order_by_mergesort", "io.file.read('orders') | rel.order_by.mergesort(o_totalprice, o_orderkey) | rel.where(_rownum <= 25U) | rel.select(o_orderkey);", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
script("order_by_quicksort_desc", "io.file.read('orders') | rel.order_by.quicksort.desc(o_totalprice, o_orderkey) | rel.where(_rownum <= 25U) | rel.select(o_orderkey);", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
script("assert_empty", "io.file.read('region') | rel.where(r_regionkey > 100) | rel.assert.empty() | rel.record_count();", "SELECT 0 AS _count")
script("uuidgen", "io.file.read('nation') | rel.select(n_nationkey, str.regex_match('^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$', str.uuidgen()) as ok);", "SELECT n_nationkey, true AS ok FROM nation")
script("rand64", "io.file.read('nation') | rel.select(math.rand64() as r) | rel.unique() | rel.record_count();", "SELECT count(*) AS _count FROM nation")
script("now_epoch_usec", "io.file.read('nation') | rel.select(n_nationkey, time.now_epoch_usec() > 1700000000000000U as ok);", "SELECT n_nationkey, true AS ok FROM nation")
script("uint_running_max", "io.file.read('orders') | rel.order_by(o_orderkey) | rel.select(o_orderkey, o_custkey as uint:c) | rel.select(o_orderkey, c - 700U as d) | rel.select(o_orderkey, if (d > prev.top) then (d) else (prev.top) as uint:top) | rel.select(o_orderkey, to_string(top) as top);", "SELECT o_orderkey, max(CASE WHEN o_custkey < 700 THEN 18446744073709551616::HUGEINT + o_custkey - 700 ELSE o_custkey - 700 END) OVER (ORDER BY o_orderkey)::VARCHAR AS top FROM orders")
script("prev_functions", "io.file.read('nation') | rel.order_by(n_nationkey) | rel.select(n_nationkey, str.to_upper_case(prev.s + str.to_lower_case(n_name)) as string:s);", "SELECT n_nationkey, upper(string_agg(n_name, '') OVER (ORDER BY n_nationkey)) AS s FROM nation")
script("time_format_more", "io.file.read('orders') | rel.select(o_orderkey, o_orderdate as uint:d) | rel.select(o_orderkey, time.format(d, '%j %U %c') as x);", "SELECT o_orderkey, strftime(o_orderdate, '%j %U %a %b ') || lpad(day(o_orderdate)::VARCHAR, 2, ' ') || strftime(o_orderdate, ' %H:%M:%S %Y') AS x FROM orders")
script("shell_function", "io.file.read('region') | rel.select(r_name, meta.shell('printf ' + str.regex_replace_all(' ', r_name, '_')) as x);", "SELECT r_name, replace(r_name, ' ', '_') AS x FROM region", allow_side_effects=True)
script("shell_stream", "io.file.read('nation') | rel.select(n_name) | meta.shell('tail -n +2 | sort | head -n 7');", "SELECT n_name AS value FROM nation ORDER BY n_name LIMIT 7", allow_side_effects=True)
script("url_get", "io.file.read('region') | rel.select(r_name, io.net.url.get('http://127.0.0.1:9/none') as x);", "SELECT r_name, '' AS x FROM region", allow_side_effects=True)
script("help_version", "help.version();", f"SELECT '{__version__}' AS value")
script("help_markdown", r"help.markdown() | rel.from_text_ignore_non_matching('^- `([a-z0-9_A-Z.]+)` \((\w+) to (\w+)\)', 'name', 'takes', 'gives');", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{o.takes}', '{o.gives}')" for n, o in sorted(OPERATORS.items())) + ") t(name, takes, gives)")


def written(name: str, make: Callable, code: str, sql: str, **more) -> None:
    """Registers a script over a file that ``make(spark, sf_dir, path)`` writes; the code names it {path}, and another fresh one {other}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, other = scratch(spark), scratch(spark)
        make(spark, sf_dir, path)
        out = run_script(spark, code.replace("{path}", path).replace("{other}", other), Tables(spark, sf_dir), **more)
        return out.plain() if isinstance(out, Flow) else out.select("value")

    run.__name__ = name
    query(sql)(run)


def _raw(df: DataFrame, path: str) -> None:
    """One column of bytes as one file: the text writer takes them as they are and ends with a zero byte."""
    df.select(F.col(df.columns[0]).cast("string")).coalesce(1).write.option("lineSep", "\0").text(path)


def _nothing(spark, sf_dir, path):
    pass


def _urls(spark, sf_dir, path):
    spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("url").rlike(r"^\w+://[^/]+")).select(F.regexp_replace("url", "[\r\n]", " ")).write.text(path)


def _crs(spark, sf_dir, path):
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("\r"), F.col("n_name"), F.lit("\r\r"), F.col("n_nationkey").cast("string"), F.lit("\r"))).write.text(path)


def _utf16(spark, sf_dir, path):
    names = spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.array_join(F.sort_array(F.collect_list("r_name")), "é\n").alias("x"))
    whole = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.concat("x", F.lit("é\n")), "UTF-16LE"))
    # the last zero byte is the writer's own
    _raw(names.select(F.substring(whole, F.lit(1), F.octet_length(whole) - 1)), path)


def _shapes(spark, sf_dir, path):
    def run(batches):
        import struct

        import pandas as pd

        points = [p for b in batches for p in b.itertuples(index=False)]
        body = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<i2d", 1, x, y) for i, (x, y) in enumerate(points))
        yield pd.DataFrame({"value": [struct.pack(">i", 9994) + bytes(96) + body]})

    points = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey + 0.5D as x", "n_regionkey - 2.0D as y")
    _raw(points.coalesce(1).mapInPandas(run, "value binary"), path)


def _folders(spark, sf_dir, path):
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.partitionBy("n_regionkey").parquet(path)


written("from_text_strict", _urls, r"io.file.read('{path}') | rel.from_text('^(\w+)://([^/]+)', 'scheme', 'host');", r"SELECT regexp_extract(url, '^(\w+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(\w+)://([^/]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^(\w+)://([^/]+)')")
written("strip_cr", _crs, "io.file.read('{path}') | text.strip_cr();", "SELECT n_name || n_nationkey AS value FROM nation")
written("utf16_to_utf8", _utf16, "text.utf16_to_utf8('{path}');", "SELECT r_name || 'é' AS value FROM region")
written("from_shapefile", _shapes, "rel.from_shapefile('{path}');", "SELECT printf('POINT (%.6f %.6f)', n_nationkey + 0.5, n_regionkey - 2.0) AS _geom FROM nation")
_FOLDERS = "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS file_name FROM nation"
for _name, _operator in (("directory_list", "io.directory.list"), ("ls", "io.ls")):
    written(_name, _folders, _operator + "('{path}') | rel.where(is_directory) | rel.select(file_name);", _FOLDERS)
for _name, _operator in (("directory_list_recurse", "io.directory.list_recurse"), ("ls_r", "io.ls_r")):
    written(_name, _folders, _operator + "('{path}') | rel.where(str.contains(file_name, '.parquet') && !str.starts_with(file_name, '.')) | rel.select(str.regex_replace('.*/(n_regionkey=[0-9]+)$', directory_name, '\\\\1') as file_name);", _FOLDERS)
written("native_script_roundtrip", _nothing, "io.file.read('customer') | rel.order_by(c_custkey) | rel.where(_rownum <= 700U) | io.file.overwrite('{path}'); io.file.read('{path}') | rel.select(c_custkey, c_name, c_acctbal, _rownum as n);", "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, row_number() OVER (ORDER BY c_custkey) AS n FROM customer ORDER BY c_custkey LIMIT 700")
written("append_roundtrip", _nothing, "io.file.read('nation') | rel.where(n_regionkey = 1) | io.file.append('{path}'); io.file.read('nation') | rel.where(n_regionkey <> 1) | io.file.append('{path}'); io.file.read('{path}');", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
written("overwrite_text", _nothing, "io.file.read('nation') | rel.to_tsv() | io.file.overwrite('{path}'); io.file.read('region') | rel.to_csv() | io.file.overwrite('{path}'); io.file.read('{path}') | rel.from_csv();", "SELECT r_regionkey, r_name FROM region")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def meta_script(spark, sf_dir):
    """A script in a file, within a pipeline."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/part", "w") as f:
            f.write("rel.where(n_regionkey = 2) | rel.select(n_name);")
        return run_script(spark, f"io.file.read('nation') | meta.script('{folder}/part');", Tables(spark, sf_dir)).plain()


@query("SELECT 'kept' AS x, '' AS after, true AS gone")
def file_functions(spark, sf_dir):
    """Reads a file of the executors, erases it, and finds nothing: in the folder that all share, where that is a local one."""
    at = f"{scratch(spark).removeprefix('file://')}.txt"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        f.write("kept")
    step = lambda expression: run_script(spark, f"rel.generate_sequence(0, 1) | rel.select({expression} as x);", allow_side_effects=True).plain().first().x
    values = step(f"io.file.read('{at}')"), step(f"io.file.erase('{at}')"), step(f"io.file.read('{at}')")
    return spark.createDataFrame([(values[0], values[2], values[1])], "x string, after string, gone boolean")


def streamed(name: str, step: Callable, sql: str) -> None:
    """Registers a query over events as they come, a file at a time, whose output is read when all have come."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, out = scratch(spark), scratch(spark)
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events.repartition(3, "event_id").write.parquet(source)
        found = streaming.read_parquet(spark, source, events.schema)
        stream, mode = step(found, spark, sf_dir)
        rows = stream.plain()

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

        rows.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        return spark.read.parquet(out)

    run.__name__ = name
    query(sql)(run)


streamed("stream_stateless", lambda f, *_: (f.where("event_type = 'click'").select("event_id, value * 2.0 as v"), "append"), "SELECT event_id, value * 2.0::DOUBLE AS v FROM events WHERE event_type = 'click'")
streamed("stream_static_join", lambda f, spark, sf: (f.select("event_id, user_id").join_natural(flow(spark, sf, "customer").select("c_custkey as user_id, c_name")), "append"), "SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey")
streamed("stream_unique", lambda f, *_: (streaming.unique(f.select("event_type, user_id")), "append"), "SELECT DISTINCT event_type, user_id FROM events")
streamed("stream_rownum", lambda f, *_: (streaming.fold(f.select("event_id"), [], "_rownum as uint:n"), "append"), "SELECT range AS n FROM range(1, (SELECT count(*) + 1 FROM events))")
streamed("stream_fold", lambda f, *_: (streaming.fold(f.where("event_id % 10 = 0").select("event_id, user_id"), ["user_id"], "_rownum as uint:n"), "append"), "SELECT user_id, row_number() OVER (PARTITION BY user_id) AS n FROM events WHERE event_id % 10 = 0")
streamed("stream_group", lambda f, *_: (f.select("event_type, user_id").group("sum", "user_id"), "complete"), "SELECT event_type, sum(user_id)::BIGINT AS _sum FROM events GROUP BY 1")
