import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components
from millrace.llm.simhash import fingerprint, keep_one, links, near_duplicates, op10_simhash, trie_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(int(i)), root(int(j))
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def families(seed, n=150):
    rng, out = random.Random(seed), {0, 1, (1 << 64) - 1}
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A B c\x0bd É é", "x y z w v", "word " * 40_000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("leaf", [2, 50, 1 << 14])
def test_trie_against_all_pairs(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    keys = families(leaf)
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 4
    assert trie_components(keys).tolist() == labels(len(keys), zip(*np.nonzero(near)))


@pytest.mark.parametrize("most", [1 << 16, 3, 1])
def test_links_connect_what_all_pairs_do(spark, most):
    keys = families(5, 60)
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 4
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    edges = links(spark.createDataFrame([(k,) for k in at], "fp bigint"), most=most).collect()
    assert labels(len(keys), [(at[e.a], at[e.b]) for e in edges]) == labels(len(keys), zip(*np.nonzero(near)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges + edges[:10], "a bigint, b bigint")).collect()}
    want = labels(501, edges)
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "one", "One", "a b c d"] + [" ".join(f"w{rng.randint(0, 300)}" for _ in range(120)) for _ in range(30)]
    for t in texts[5:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), t]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (7, texts[7])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as fp", "'x' as label", "2 as component_id")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_simhash(spark, str(tmp_path)).collect()
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    want = labels(len(texts), zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)))
    assert len(found) == len(rows) and all((r.fingerprint, r.component_id) == (f"{int(fps[r.doc_id]):016x}", want[r.doc_id]) for r in found)
    assert sorted(r.doc_id for r in keep_one(frame).collect()) == sorted(set(want))


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "z y x w v")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(frame).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]
    assert near_duplicates(frame.limit(0)).count() == keep_one(frame.limit(0)).count() == 0
