import random
import zlib

import numpy as np
import pytest
import zstandard

from millrace.llm import toxicity
from millrace.llm.toxicity import Compressor, Model, content, drop_toxic, fit, op4_toxicity


def corpus(n=900, seed=1, bad=("blorgface", "snarkwit", "dungbrain", "vilesnout")):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(2, 5))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "src0"))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    rows += [(2000, None, None, None), (2001, "", None, None), (None, "some words", None, None), (5, rows[5][1], "en", "other"), (3000, "word " * 50_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as toxic", "'x' as score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels + [(None, 1, 1), (4, 1, None), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted for r in held if r.doc_id % 5 == 1]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 5 != 1]) < 0.03
    kept = {r.doc_id for r in drop_toxic(docs, known).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted} and {2000, 2001, None} <= kept


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fit(docs, labels).score(["x", ""]).tolist() == [0.0, 0.0]
    assert drop_toxic(docs, labels).count() == 2 and drop_toxic(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, flipped))
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.allclose(a.weights, b.weights)


def test_calibration_with_ties():
    model = Model(b" a", b" b")
    x = np.repeat(np.array([[0.0, 0, 0, 0], [3, 2, 1, 1], [9, 5, 2, 1]]), 20, axis=0)
    y = np.r_[np.zeros(40), np.ones(20)]
    model.calibrate(x, y)
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights
    assert ((z >= 0) == (y == 1)).all()


@pytest.mark.parametrize("text", [None, "", "!!!", "a", "é" * 500])
def test_features_of_odd_texts(text):
    model = Model(b" one two", b" bad")
    assert model.features([text]).shape == (1, toxicity.FEATURES)


@pytest.mark.parametrize("bad", [("zq", "kys", "xux", "qqq"), tuple("".join(random.Random(i).choices("abcdefgh", k=70)) for i in range(4))])
def test_words_of_any_length(spark, bad):
    rows, labels = corpus(700, 3, bad)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert all(f" {w}".encode() in model.toxic and f" {w}".encode() not in model.ordinary for w in bad)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    marked = [r[1] for r in held if sum(w in bad for w in r[1].split()) > 1]
    assert model.score([" ".join(["then"] * 9 + [w, "onan", w]) for w in bad]).mean() > model.score(["then " * 9 + "onan"]).mean() or len(bad[0]) < 4
    assert len(bad[0]) < 4 or (model.score(marked) >= 0.5).mean() > 0.9


def test_window_lengths_are_zstandards_own():
    shared, own = ["the", "and", "then"], ["blorg", "snark"]
    words = " ".join(["the blorg and then snark"] * 9).split()
    got = toxicity.features(" ".join(words), Compressor(content([], shared)), Compressor(content(own, shared)))
    params = zstandard.ZstdCompressionParameters(window_log=22, chain_log=20, hash_log=20, search_log=4, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
    gains = []
    for at in range(0, len(words), toxicity.WINDOW):
        window = f" {' '.join(words[at : at + toxicity.WINDOW])} ".encode()
        lengths = [len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window)) for c in (b" then and the ", b" snark blorg then and the ")]
        gains.append(lengths[0] - lengths[1])
    assert got[0] == max(gains) and got[-1] == pytest.approx(sum(sorted([0, 0, *gains])) / len(gains))


def test_calibration_without_a_class_in_the_last_fold(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    some = [(i, q, t) for i, q, t in labels if not (t and zlib.crc32(str(i).encode()) % 5 == 4)]
    one = [(i, q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 5 == 2]
    for known in (some, one):
        model = fit(docs, spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"))
        toxic = [r[1] for r in rows if r[0] % 5 == 1]
        assert (model.score(toxic) >= 0.5).mean() > 0.7 and (model.score([r[1] for r in rows if r[0] % 5 != 1]) >= 0.5).mean() < 0.1
