import hashlib

import corpus_pipeline
from millrace.llm.bpe import Bpe
from millrace.llm.common import public_vocabulary, read_vocabulary
from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_toxicity import corpus


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus()
    passage = "\n".join(" ".join(f"line{i}word{k}" for k in range(12)) for i in range(5))
    item = " ".join(f"bench{k}" for k in range(20))
    extra = [(1000, f"first of its kind\n{passage}"), (1001, f"second of its sort\n{passage}"), (1002, rows[10][1] + " z"), (1003, rows[10][1] + " z"), (1004, f"here {item} there"), (1005, "a clean and short one"), (1006, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, *_ in rows + [(*x, None, None) for x in extra]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 1003 repeats 1002's only line, so it is empty when near copies are looked for, as 1006 is: one of the empty ones stays
    assert 1004 not in got and {1000, 1001, 1005} <= set(got)
    assert sum(r.n_tokens == 0 for r in got.values()) == 1
    toxic = [i for i in got if i < 900 and i % 5 == 1]
    assert len(toxic) < 0.1 * 180 and len([i for i in got if i < 900 and i % 5 != 1]) > 0.95 * 720
    codec = Bpe(read_vocabulary(public_vocabulary("word_bpe_49k.json")))
    ids = codec.encode("second of its sort")
    assert got[1001].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() and got[1001].n_tokens == len(ids)


def test_every_stage_but_the_last_keeps_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == docs.schema.simpleString()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_nulls_repeats_ties_and_other_columns(spark, tmp_path):
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(None, "some words of a document without an id"), (None, None), (1, ""), (2, "  \t"), (3, "the same text in two rows"), (3, "the same text in two rows"), (4, "the same text in two rows"), (5, long), (6, "bench1 bench2 bench3 bench4 bench5 bench6 bench7")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source", "bigint(length(text)) as n_chars", "1 as node", "'x' as label", "2 as row", "3 as score", "4 as h", "5 as item_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "bench1 bench2 bench3 bench4 bench5 bench6 bench7"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:8]) for r in out.collect()) == [(-1, ""), (-1, "some wor"), (3, "the same"), (5, "w0x0 w1x")]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens > 0) for r in got) == [(-1, False), (-1, True), (3, True), (5, True)]


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
