import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import near_copies
from millrace.llm.near_copies import keep_one
from tests.llm.test_simhash import labels


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, at_least=0.8):
    sets = [shingled(t) for _, t in rows]
    alike = lambda a, b: not a and not b or len(a & b) >= at_least * len(a | b)
    found = labels(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    return sorted(min(rows[j][0] for j in range(len(rows)) if found[j] == c) for c in set(found))


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([20, 60, 100, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            new = list(base)
            for _ in range(rng.randint(0, 6)):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 400)}"
            texts.append(" ".join(new + "a line that all the texts have in common".split()))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, more", [(1, {}), (2, {"small": 3}), (3, {"small": 1, "chunk": 5}), (4, {"every": 1, "hot": 2, "chunk": 7}), (5, {"every": 1, "hot": 3, "small": 2})])
def test_against_all_pairs(spark, seed, more):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as node", "'x' as label")
    assert sorted(r.doc_id for r in keep_one(frame.repartition(3), **more).collect()) == brute(rows)


def test_tries_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.sort(np.r_[rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.uint64(7) << rng.integers(0, 60, 40, dtype=np.uint64)])
    a, b, la, lb = keys[::2], np.sort(np.r_[keys[1::2], keys[:9]]), rng.integers(0, 4, 170), rng.integers(0, 4, 179)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((np.bitwise_count(a[:, None] ^ b[None]) <= 20) & (la[:, None] != lb[None])))}
    for leaf in (1, 40, 1 << 14):
        monkeypatch.setattr(near_copies, "LEAF", leaf)
        got = [(int(i), int(j)) for x, y in near_copies.near_pairs(a, b, la, lb, 20) for i, j in zip(x, y)]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_stage_drops_near_copies_beyond_four_bits(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words))] + [(i, " ".join("new" if k in (9 * i, 9 * i + 30) else w for k, w in enumerate(words))) for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()] == brute(rows) == [0]


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (7, "z y x w v")], "doc_id bigint, text string")
    assert sorted(r.doc_id or 0 for r in keep_one(frame).collect()) == [0, 7]
    assert keep_one(frame.limit(0)).count() == 0
