import random
import re
from collections import Counter

import pytest

from millrace.llm.decontaminate import BLOCK, decontaminate, find_leaks, op3_decontamination, prepare
from millrace.llm import decontaminate as module


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items, at_least=0.8):
    """Every window of every item's size; the start is the first of the best that begin with some shingle of an item of that size, or are the last."""
    best = {}
    begin = {}
    for _, item in items:
        iw = words(item)
        begin.setdefault(len(iw), set()).update(shingles(iw, min(5, len(iw))) if iw else ())
    for d, text in docs:
        w = words(text)
        for i, item in items:
            iw = words(item)
            if not iw:
                continue
            k = min(5, len(iw))
            own, n = shingles(iw, k), len(iw)
            for s in range(max(1, len(w) - n + 1)):
                part = shingles(w[s : s + n], k)
                known = part and (part[0] in begin[n] or s >= len(w) - n)
                x = similarity(part, own) if part else 0
                if x >= at_least and x > best.get((d, i), (0, 0))[0]:
                    assert known or any(similarity(shingles(w[z : z + n], k), own) >= x for z in range(s, max(1, len(w) - n + 1)) if shingles(w[z : z + n], k)[0] in begin[n] or z >= len(w) - n)
                if known and x >= at_least and x > best.get((d, i), (0, 0))[0]:
                    best[d, i] = (x, s)
    return {k: (round(x, 9), s) for k, (x, s) in best.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 12))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 15, 30, 40])))) for i in range(25)] + [(90, ""), (91, None), (92, "..."), (93, "a b a b a b a b a b a b a b a b")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = words(rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, 2)):
                j = rng.randrange(len(part) + 1)
                part[j : j + 1] = rng.choice([[], [word()], [*part[j : j + 1], word()]])
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text).title()))
    return docs + [(100, None), (101, ""), (102, "A b! " * 40), (103, items[6][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as h", "2 as similarity")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in find_leaks(d, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_same_in_many_passes(spark, monkeypatch):
    docs, items = corpus(3)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, find_leaks(d, b).collect()))
    monkeypatch.setattr(module, "BLOCK", 150)
    monkeypatch.setattr(module, "INDEX", 3)
    assert BLOCK > 150 and sorted(map(tuple, find_leaks(d, b).collect())) == one


def test_null_and_repeated_item_ids_and_a_long_text(spark):
    items = [(None, "one two three four five six seven"), (None, "nine ten eleven twelve thirteen"), (3, "alpha beta gamma delta eps zeta"), (3, "iota kappa lambda mu nu xi"), (3, "iota kappa lambda mu nu xi")]
    filler = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, "One two three four five six seven"), (2, f"{filler} nine ten eleven twelve thirteen {filler}"), (3, "iota kappa lambda mu nu xi"), (4, "alpha beta gamma delta eps zeta"), (5, filler)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in find_leaks(d, b).collect() if r.item_id) == [(3, 3, 1.0, 0), (4, 3, 1.0, 0)]
    assert sorted((r.doc_id, r.start) for r in find_leaks(d, b).collect() if r.item_id is None) == [(1, 0), (2, 20_000)]
    assert [r.doc_id for r in decontaminate(d, b).collect()] == [5]


def test_recall_of_the_radius(spark):
    """Against similarity alone, without fingerprints."""
    rng = random.Random(9)
    items = [(i, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(rng.randint(15, 60)))) for i in range(60)]
    docs = []
    for d in range(400):
        part = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            part[rng.choice([0, 1, -1, -2])] = f"new{rng.randint(0, 99)}"
        docs.append((d, " ".join(["x"] * rng.randint(0, 3) + part + ["y"] * rng.randint(0, 3))))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = set(brute(docs, items))
    assert got <= want and len(got) >= 0.995 * len(want) > 300


def test_empty_tables_nulls_and_repeats(spark, tmp_path):
    d, b = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words stand in this one")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert find_leaks(d.limit(0), b).count() == find_leaks(d, b.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in find_leaks(d, b).collect()) == [0, 1]
    assert [r.doc_id for r in decontaminate(d, b).collect()] == [2]
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert op3_decontamination(spark, str(tmp_path)).count() == 2
    assert prepare(b).first().n_words == 6
