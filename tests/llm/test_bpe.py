import hashlib
import random

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.bpe import Bpe, encode_decode, op1_bpe_codec
from millrace.llm.common import public_vocabulary, read_vocabulary


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_as_library(name):
    library, own = Tokenizer.from_file(public_vocabulary(name)), Bpe(read_vocabulary(public_vocabulary(name)))
    rng = random.Random(5)
    letters = "ab '.,\n\t  sXYé́日🙂12Σσ<|endoftext|>\x1c\xa0İ "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>x", " <|startoftext|> ", "  "])
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_piece_and_stale_entries():
    own = Bpe(read_vocabulary(public_vocabulary("word_bpe_49k.json")))
    library = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    for text in ("a" * 5000, "abab" * 2000, "the" * 3001):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_nulls_empty_repeated_and_clashing_columns(spark):
    rows = [(1, "Hello  World", 7), (1, "Hello  World", 7), (None, None, None), (2, "", 1), (3, "x" * 20000, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").withColumnsRenamed({})
    docs = docs.selectExpr("*", "'x' as ids", "'y' as decoded", "1 as _text")
    out = encode_decode(docs).collect()
    assert len(out) == 5 and sum(r.n_tokens == 2 for r in out) == 2
    assert {r.decoded for r in out if r.doc_id in (None, 2)} == {""}
    assert encode_decode(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello <|endoftext|> you's"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in op1_bpe_codec(spark, str(tmp_path)).collect()}
    for i, text in ((1, "Hello <|endoftext|> you's"), (2, "")):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_words_of_many_texts_are_merged_together(name, monkeypatch):
    library, own = Tokenizer.from_file(public_vocabulary(name)), Bpe(read_vocabulary(public_vocabulary(name)))
    monkeypatch.setattr(bpe, "CACHE", 300)
    monkeypatch.setattr(bpe, "ROWS", 100)
    alone, lengths = own.merge, []
    monkeypatch.setattr(own, "merge", lambda symbols: lengths.append(len(symbols)) or alone(symbols))
    rng = random.Random(9)
    parts = ["the", "ing", "ÉTAT", "a", "aaaa", "Σς", "don't", "1234", "日本", "🙂", "x" * 70, ",", "...", "(\x1c)", "é", "İ", "<|endoftext|>", "\n", "  "]
    for _ in range(30):
        texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 12))) for _ in range(50)]
        assert own.encode_all(texts) == [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert len(own.known_chunks.now) < 300 and all(len(w) <= bpe.CACHED_LENGTH for w in own.known_chunks.now)
    assert lengths and min(lengths) > bpe.WIDTHS[-1]
    for piece in ["the", "a", "aaaaaaaaa", "ing" * 21, "abcdefgh" * 8]:
        assert own.pieces_ids([piece]) == [own.piece_ids(piece)]


def test_letters_of_python_are_letters_of_the_expressions():
    letters = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert bpe._WORD.findall(letters) == [letters] and bpe._BYTE.findall(letters) == [letters]
