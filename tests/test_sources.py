import struct

import pytest
from pyspark.errors import PySparkException

from millrace import streaming
from millrace.errors import PipelineError
from millrace.plans.script import run_script
from millrace.sources import files, shapefile, text
from tests.conftest import listed


def write(tmp_path, data, name="x.txt"):
    (tmp_path / name).write_bytes(data.encode() if isinstance(data, str) else data)
    return str(tmp_path / name)


def test_tsv(spark, tmp_path):
    path = write(tmp_path, "a b\tint:n\todd:x\nx\\ty\t 5 \tp\\q\\\\\nlast\t6\tno end")
    flow = text.from_tsv(text.lines(spark, path))
    assert flow.headings == ["string:a_b", "int:n", "string:odd_x"] and listed(flow) == [("x\ty", 5, "p\\q\\")]
    assert [r.value for r in text.tsv_lines(flow).collect()] == ["string:a_b\tint:n\tstring:odd_x", "x\\ty\t5\tp\\q\\"]
    given = text.from_tsv(text.lines(spark, write(tmp_path, "1\t2\n")), ["int:a", "b"])
    assert listed(given) == [(1, "2")]
    with pytest.raises(PySparkException):
        listed(text.from_tsv(text.lines(spark, write(tmp_path, "a\tb\n1\n"))))


def test_csv(spark, tmp_path):
    path = write(tmp_path, 'int:id,name,note\n1,"a, ""b""",\n2,plain,""\n3,x,l\\nm\n')
    flow = text.from_csv(text.lines(spark, path))
    assert listed(flow) == [(1, 'a, "b"', ""), (2, "plain", ""), (3, "x", "l\nm")]
    assert [r.value for r in text.csv_lines(flow).collect()][1:] == ['1,"a, ""b""",', "2,plain,", "3,x,l\\nm"]
    for bad in ('"open', '"a"b,c'):
        with pytest.raises(ValueError):
            text.csv_fields(bad)


def test_usv_and_text(spark, tmp_path, flow_of):
    flow = flow_of(["string:a", "int:b"], [("x\ty\n", 1), ("", 2)])
    text.save(text.usv_lines(flow), f"{tmp_path}/usv", end="\0")
    assert listed(text.from_usv(spark, f"{tmp_path}/usv")) == [("x\ty\n", 1), ("", 2)]
    rows = text.lines(spark, write(tmp_path, "a|1|x\nnone\nb|2|y\n"))
    assert listed(text.from_text(rows, r"(\w)\|(\d)", ["c", "int:n"], True)) == [("a", 1), ("b", 2)]
    with pytest.raises(PySparkException):
        listed(text.from_text(rows, r"(\w)\|(\d)", ["c", "int:n"]))
    with pytest.raises(PipelineError):
        text.from_text(rows, r"(\w)", ["c", "n"])


def test_utf16_and_cr(spark, tmp_path):
    for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        path = write(tmp_path, mark + "é\r\n日\n".encode(code), code)
        assert [r.value for r in text.strip_cr(text.utf16_lines(spark, path)).collect()] == ["é", "日"]
    with pytest.raises(PipelineError):
        text.utf16_lines(spark, write(tmp_path, "plain"))


def test_shapefile(spark, tmp_path):
    def record(n, body):
        return struct.pack(">ii", n, len(body) // 2) + body

    head = struct.pack(">i", 9994) + bytes(96)
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    path = write(tmp_path, head + record(1, struct.pack("<i2d", 1, 1.5, -2)) + record(2, struct.pack("<i", 0)) + record(3, polygon), "a.shp")
    assert listed(shapefile.read(spark, path)) == [("POINT (1.500000 -2.000000)",), ("",), ("MULTIPOLYGON((0.000000 0.000000,1.000000 1.000000),(2.000000 2.000000,3.000000 3.000000))",)]


def test_listing_and_split(spark, tmp_path, flow_of):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    write(tmp_path / "d", "12345", "f")
    write(tmp_path / "d" / "sub", "1", "g")
    assert [(r[1], r[3], r[5]) for r in listed(files.listing(spark, f"{tmp_path}/d", True))] == [("f", 5, False), ("sub", 0, True), ("g", 1, False)]
    made = text.record_split(flow_of(["int:x"], [(i,) for i in range(25)]), 10, f"{tmp_path}/s-")
    assert [m.rsplit("/", 1)[1] for m in made] == [f"s-{i:016x}.gz" for i in range(3)]
    assert [len(listed(text.from_tsv(text.lines(spark, m)))) for m in made] == [10, 10, 5]


def test_tables_of_many_files(spark, tmp_path):
    """By one scan the same as file by file: lines that look like headings stay, files with other headings go by themselves."""
    made = [write(tmp_path, body, f"{i}.tsv") for i, body in enumerate(["string:a\tint:b\nx\t1\nstring:a\t2\n", "string:a\tint:b\n", "string:a\tint:b\ny\t3\ny\t3\n", "int:b\tstring:a\n4\tz\n"])]
    (tmp_path / "d").mkdir()
    write(tmp_path / "d", "string:a\tint:b\nu\t5\n", "0")
    write(tmp_path / "d", "v\t6\n", "1")
    made.append(f"{tmp_path}/d")
    alone = [sorted((r["a"], r["b"]) for r in text.from_tsv(text.lines(spark, m)).df().collect()) for m in made]
    found = text.tsv_tables(spark, *made)
    assert len(found) == 2
    assert sorted((r["a"], r["b"]) for f in found for r in f.df().collect()) == sorted(sum(alone, []))
    assert sum(f.rows.count() for f in text.tsv_tables(spark, made[0], made[0])) == 4
    with pytest.raises(PipelineError):
        text.tsv_tables(spark, made[0], write(tmp_path, "", "empty.tsv"))


def test_per_file_takes_many_files_at_once(spark, tmp_path, flow_of):
    from millrace.operators import scripting

    made = text.record_split(flow_of(["int:x"], [(i,) for i in range(25)]), 10, f"{tmp_path}/s-")
    named = flow_of(["string:file_name", "string:host_name"], [(m, "h") for m in made])
    opened = []

    def read(name):
        opened.append(name)
        return text.from_tsv(text.lines(spark, name))

    mapped = lambda step: sorted(listed(scripting.per_file(named, step, read, lambda names: text.tsv_tables(spark, *names))))
    assert mapped(lambda f: f.where("x % 7 = 0").select("x + 1 as y")) == [(1,), (8,), (15,), (22,)] and not opened
    assert mapped(lambda f: f.record_count()) == [(5,), (10,), (10,)] and len(opened) == 3
    assert mapped(lambda f: f.where("_rownum = 2U")) == [(1,), (11,), (21,)]
    assert mapped(lambda f: f.select("x, prev.s + x as int:s").where("x > 23 || x = 10")) == [(10, 10), (24, 110)]


def test_scripts_files_and_macros(spark, tmp_path):
    path = write(tmp_path, "string:name\tint:v\na\t1\nb\t2\n", "in.tsv")
    (tmp_path / "keep").write_text("$1($2);")
    (tmp_path / "main").write_text(f"io.file.read('{path}') | rel.from_tsv() | keep(rel.where, v > 1) | rel.to_tsv() | io.file.overwrite('{tmp_path}/out');\n")
    assert run_script(spark, str(tmp_path / "main")) is None
    assert [r.value for r in text.lines(spark, f"{tmp_path}/out").collect()] == ["string:name\tint:v", "b\t2"]
    mapped = run_script(spark, "io.file.read('files') | meta.parallel_explicit_mapping(rel.select(o_orderkey));", {"files": spark.createDataFrame([("/root/testdata/sf0.001/orders.parquet", "localhost")] * 2, "file_name string, host_name string")})
    assert len(listed(mapped)) == 2 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    for bad in ("rel.where(true);", "rel.generate_sequence(0, 3) | rel.from_tsv();", "nowhere();", "rel.generate_sequence(0, 3) | rel.assert.empty();"):
        with pytest.raises(PipelineError):
            run_script(spark, bad)
    assert run_script(spark, "help.version();").first().value


def test_shell_and_python(spark, flow_of):
    from millrace.functions.table import Settings
    from millrace.operators import scripting

    flow = flow_of(["int:x", "istring:s"], [(1, "a"), (2, "b")], settings=Settings(allow_side_effects=True))
    assert [r[0] for r in listed(scripting.shell(flow, "tr a-z A-Z"))][1:] == ["1\tA", "2\tB"]
    got = scripting.python(flow, "for r in input_stream:\n    output_stream.write({'y': r.x * 2, 'f': 0.5, 'ok': True, 't': r.s})")
    assert got.headings == ["int:y", "double:f", "bool:ok", "string:t"] and sorted(listed(got)) == [(2, 0.5, True, "a"), (4, 0.5, True, "b")]


def test_streaming(spark, tmp_path):
    rows = [(i, i % 3, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "t long, k long, v double")
    for i in range(3):
        df.where(f"t div 10 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def result(flow, name, mode="append"):
        query = flow.rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return flow.spark.sql(f"select * from {name}").collect()

    source = lambda: streaming.read_parquet(spark, f"{tmp_path}/in", df.schema)
    assert len(result(source().where("k = 1").select("t, v * 2.0 as w"), "s1")) == 10
    assert sorted(r.k for r in result(streaming.unique(source().select("k")), "s2")) == [0, 1, 2]
    got = result(streaming.fold(source(), ["k"], "prev.s + v as double:s, prev.n + 1 as int:n"), "s3")
    assert {(r.k, r.s) for r in got if r.n == 10} == {(k, float(sum(i for i in range(30) if i % 3 == k))) for k in range(3)}
    counts = result(streaming.tumbling(source().select("t * 1000000 as t, k"), "t", "10 seconds", "count"), "s4", "complete")
    assert sum(r._count for r in counts) == 30 and len(counts) == 9


def test_a_fold_keeps_many_keys_in_few_rows_of_state(spark, tmp_path):
    keys = [float(i) for i in range(1500)] + [float("nan"), -0.0]
    df = spark.createDataFrame([(t, k, f"é{k}\n\"", t * 0.1) for t in range(2) for k in keys], "t long, k double, s string, v double")
    for t in range(2):
        df.where(f"t = {t}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = streaming.read_parquet(spark, f"{tmp_path}/in", df.schema)
    found, state = {}, []
    for name, by in (("double", ["k"]), ("text", ["s", "k"])):
        query = streaming.fold(source, by, "_rownum as uint:n, prev.x + s as string:x, prev.y + v as double:y").rows.writeStream.format("memory").queryName(f"fold_{name}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        found[name] = source.spark.sql(f"select * from fold_{name}").collect()
        state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert max(state) <= streaming.BUCKETS
    got = {repr(r.k).replace("None", "nan"): r for r in found["double"] if r.n == 2 + 2 * (r.k == 0)}  # pandas makes NaN a null
    assert sorted(got) == sorted(map(repr, keys[:-1])) and len(found["double"]) == 2 * len(keys)
    assert all(r.x == f"é{k}\n\"" * 2 and r.y == 0.1 for k, r in got.items() if r.k != 0)
    assert sorted(r.n for r in found["double"] if r.k == 0) == [1, 2, 3, 4]
    assert sorted((r.n, r.x) for r in found["text"]) == sorted((n, f"é{k}\n\"" * n) for n in (1, 2) for k in keys)


def test_native_shards_keep_rows_like_their_headings(spark, tmp_path, flow_of):
    from millrace.sources import native

    flow = flow_of(["string:a"], [("string:a",), ("x",), ("",), ("y\nz\0",)])
    native.write(flow, f"{tmp_path}/n")
    assert listed(native.read(spark, f"{tmp_path}/n")) == [("string:a",), ("x",), ("",), ("y\nz\0",)]
    parts = sorted((tmp_path / "n").glob("part-*"))
    assert [list(native.unpack(p.read_bytes()))[0] for p in parts] == [[b"string:a"]] * len(parts)
    run_script(spark, f"io.file.read('t') | io.file.overwrite('{tmp_path}/x.native');", {"t": flow})
    assert listed(run_script(spark, f"io.file.read('{tmp_path}/x.native') | rel.where(a = 'x');")) == [("x",)]


def test_escapes_and_nul(spark, tmp_path):
    path = write(tmp_path, "a\n\\\\n\n\\n\\\\\\t\n\0\\q\n")
    assert listed(text.from_tsv(text.lines(spark, path))) == [("\\n",), ("\n\\\t",), ("\0\\q",)]


def test_many_files_in_order(spark, tmp_path):
    for i in (3, 1, 2):
        write(tmp_path, f"{i}\n{i}0\nlost" if i == 2 else f"{i}\n{i}0\n", f"f {i}.txt")
    rows = text.lines(spark, f"{tmp_path}/f 3.txt", f"{tmp_path}/f 2.txt", f"{tmp_path}/f 1.txt")
    assert listed(text.from_tsv(rows, ["int:x"])) == [(3,), (30,), (2,), (20,), (1,), (10,)]
    assert listed(text.from_tsv(rows, ["int:x"]).where("x > 2")) == [(3,), (30,), (20,), (10,)]


def test_tables_by_name_keep_their_order(spark, flow_of):
    a, b = flow_of(["int:x"], [(3,), (1,)]), flow_of(["int:x"], [(9,), (2,)])
    assert listed(run_script(spark, "io.file.read('a', 'b', 'a');", {"a": a, "b": b})) == [(3,), (1,), (9,), (2,), (3,), (1,)]


@pytest.mark.parametrize("form", ["%j %U", "%c", "%e/%k:%M", "%W %u %w %C", "%s", "%I %p", "%G-W%V"])
def test_time_formats_against_pythons(spark, flow_of, form):
    from datetime import datetime, timezone

    moments = [datetime(y, m, d, h, 5, 9, tzinfo=timezone.utc) for y, m, d, h in ((2023, 1, 1, 0), (2024, 2, 29, 12), (2021, 12, 31, 23), (2000, 7, 9, 13))]
    flow = flow_of(["uint:t"], [(int(t.timestamp()) * 1_000_000,) for t in moments])
    assert [r[0] for r in listed(flow.select(f"time.format(t, '{form}') as s"))] == [t.strftime(form) for t in moments]


def test_python_code_does_not_sort_in_its_task(spark, flow_of, monkeypatch):
    """Code sees all rows in order, though ranges are sorted by many tasks."""
    from millrace.functions.table import Settings
    from millrace.operators import ordered, scripting

    ranges = []
    monkeypatch.setattr(ordered, "ranged", lambda df, order, f=ordered.ranged: ranges.append(f(df, order)) or ranges[-1])
    rows = [((i * 7919) % 2000,) for i in range(2000)]
    flow = flow_of(["int:x"], rows, settings=Settings(allow_side_effects=True)).order_by("x")
    code = "last = -1\nfor r in input_stream:\n    assert r.x == last + 1\n    last = r.x\n    output_stream.write({'y': r.x})"
    for schema in ({"y": "int"}, None):
        assert sorted(listed(scripting.python(flow, code, schema))) == [(i,) for i in range(2000)]
    assert [r.rdd.getNumPartitions() for r in ranges] == [4, 4]
    assert [r[0] for r in listed(scripting.shell(flow, "cat"))] == ["int:x", *map(str, range(2000))]
