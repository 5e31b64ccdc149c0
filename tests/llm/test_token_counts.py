import random

import pytest
from tokenizers import Tokenizer

from millrace.llm.bpe import Bpe
from millrace.llm.common import public_vocabulary, read_vocabulary
from millrace.llm.token_counts import Known, count_tokens, op5_token_counts


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", " \n", "\t", "don't", "x" * 50, "12", "é", "日本", "<|endoftext|>", "\xa0", "\x1c", " ", ".", ",,", "a b", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("common", [{}, {" the": 1, "the": 1, " ": 1, "\n": 1}])
def test_frequencies_sum_to_the_library_counts(name, common):
    library, codec = Tokenizer.from_file(public_vocabulary(name)), Bpe(read_vocabulary(public_vocabulary(name)))
    common = {p: len(codec.piece_ids(p)) // 4 for p in common} if name.startswith("byte") else {}
    known = Known(codec, common)
    for text in texts(2000):
        total, rest = known.frequencies(text)
        assert all(codec.piece_count(p) == len(codec.piece_ids(p)) // 4 for p in rest)
        total += sum(codec.piece_count(p) * n for p, n in rest.items())
        assert total == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_same_whatever_is_common(spark, hot):
    library = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(texts(200))] + [(0, texts(1)[0]), (1000, None), (None, "one two"), (1001, ""), (1002, "long words " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "'x' as piece", "2 as key")
    got = count_tokens(docs, hot=hot).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == sorted((-1 if i in (None, 0) and i is None else (i or -1), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert count_tokens(docs.limit(0)).count() == 0


def test_query_over_limit(spark, tmp_path):
    spark.createDataFrame([(1, "a " * 512), (2, "a " * 600)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens > 512, r.over_limit) for r in op5_token_counts(spark, str(tmp_path)).collect()}
    assert all(a == b for a, b in got.values()) and got[2][1]
