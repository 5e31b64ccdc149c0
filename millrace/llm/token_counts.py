"""Token counts without ids.

Pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies;
only numbers are summed, no ids are made. The commonest pre-tokens of one text in ``EVERY`` (at most ``HOT``, of at most
``HOT_BYTES`` bytes each, so the broadcast is bounded) are counted beforehand and summed where the
document is read; the others' frequencies are written, their distinct pre-tokens counted, and the two joined by exchanges
that AQE can split where one pre-token is in very many documents. Which pre-tokens are common changes the
cost alone, never a result: the commonest of each task compete for the places.

Edge cases: a null text counts as empty, with 0 bytes and 0 tokens; special strings inside a text
are one token each, as the tokenizers library has it; texts are counted whole; repeated rows are
counted once and appear as often as they occur; an empty table gives an empty one; only the id and
text columns are read, so further columns can have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import WHITE, Bpe, _Chunks, loaded
from millrace.llm.common import bound_batches, claim, keep, public_vocabulary, read_vocabulary, table, text_or_empty

HOT, HOT_BYTES, EVERY = 1 << 19, 64, 8
#: Distinct words a task keeps while it looks for common ones, and how many of them it reports.
SEEN, REPORTED = 1 << 20, 1 << 17
_SPACE = frozenset(c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{WHITE}\x1c-\x1f]", c))


def words(codec: Bpe, text: str) -> tuple[list[str], str]:
    """What blanks part, and what stands before each but the first in a chunk of its own."""
    return (text.split(), "") if codec.by_words else (text.split(" "), " ")


class Known:
    """For chunks of text, the tokens of their common pre-tokens and a list of the others.

    A chunk is a word with the blank before it; no pre-token reaches over its bounds unless white space
    other than single blanks lies there.
    """

    def __init__(self, codec: Bpe, known: dict[str, int]):
        self.codec, self.known = codec, known
        self.inner = _Chunks(self.of_word)

    def of(self, pieces: list[str]) -> tuple[int, tuple[str, ...]]:
        return sum(self.known.get(p, 0) for p in pieces), tuple(p for p in pieces if p not in self.known)

    def of_word(self, word: str):
        """None if the word can't be taken alone."""
        if not word or word[0] in _SPACE or word[-1] in _SPACE:
            return None
        return self.of(self.codec.pieces(" " + word))

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Tokens of specials and common pre-tokens, and how often each other one occurs."""
        total, rest = 0, Counter()
        for part, special in self.codec.plain(text) if any(map(text.__contains__, self.codec.special)) else ((text, None),):
            if special is not None:
                total += 1
            else:
                total += self.count(part, rest)
        return total, rest

    def count(self, text: str, rest: Counter) -> int:
        first, *words = text.split(" ")
        if not self.codec.by_words and not (words and first and first[-1] in _SPACE):
            found = [(self.inner[w], n) for w, n in Counter(words).items()]
            if all(f is not None for f, _ in found):
                found.append((self.of(self.codec.pieces(first) if first else []), 1))
                return self.add(found, rest)
        return self.add([(self.of(self.codec.pieces(c)), n) for c, n in Counter(self.codec.split(text)).items()], rest)

    @staticmethod
    def add(found: list, rest: Counter) -> int:
        total = 0
        for (tokens, others), n in found:
            total += tokens * n
            for p in others:
                rest[p] += n
        return total


def common_pre_tokens(docs: DataFrame, codec_data, hot: int) -> dict[str, int]:
    """Tokens of each of the ``hot`` commonest pre-tokens, more or less; docs: one column, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        codec, seen = loaded(codec_data.value), Counter()

        def report() -> pa.RecordBatch:
            pieces: Counter = Counter()
            for word, n in nlargest(REPORTED, seen.items(), key=itemgetter(1)):
                for p in codec.pieces(before + word):
                    if len(p.encode()) <= HOT_BYTES:
                        pieces[p] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], ["piece", "n"])

        before = " "
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found, before = words(codec, text)
                seen.update(found)
                if len(seen) > SEEN:
                    yield report()
        yield report()

    totals = docs.mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    best = totals.orderBy(F.desc("n"), "piece").limit(hot).select("piece").toArrow()
    codec = loaded(codec_data.value)
    return {p: codec.piece_count(p) for p in best.column(0).to_pylist()}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: the id column, ``n_bytes`` and ``n_tokens``."""
    sc = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    codec_data = sc.broadcast(read_vocabulary(vocabulary or public_vocabulary("byte_bpe_50k.json")))
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    some = source.where(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0).select("text")
    common = sc.broadcast(common_pre_tokens(some, codec_data, hot))
    id_type = source.schema["id"].dataType.simpleString()
    names = ["id", "key", "n_bytes", "rows", "total", "piece", "n"]
    schema = f"id {id_type}, key bigint, n_bytes bigint, rows bigint, total bigint, piece string, n bigint"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document with its common pre-tokens' sum, and one per other pre-token with its frequency."""
        claim("bpe")
        known = Known(loaded(codec_data.value), common.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index: list[int] = []
                cols: list[list] = [[] for _ in kinds]
                for i, (key, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    total, rest = known.frequencies(text)
                    m = len(rest) + 1
                    index += [i] * m
                    for col, head, tail in zip(cols, (key, len(text.encode()), 1, total, None, None), ([key] * (m - 1), [None] * (m - 1), [None] * (m - 1), [None] * (m - 1), rest.keys(), rest.values())):
                        col.append(head)
                        col += tail
                ids = part.column(0).take(pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        codec = loaded(codec_data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(codec.piece_count, batch.column(0).to_pylist()), pa.int64())], ["piece", "tokens"])

    found, _ = keep(source.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(frequencies, schema), "frequencies", 4 * sc.defaultParallelism)
    others = found.where("piece is not null")
    tokens = others.select("piece").distinct().mapInArrow(count, "piece string, tokens bigint")
    zero = F.lit(0).cast("bigint")
    joined = others.join(tokens, "piece").select("id", "key", zero.alias("n_bytes"), zero.alias("rows"), (F.col("n") * F.col("tokens")).alias("total"))
    sums = found.where("piece is null").select("id", "key", "n_bytes", "rows", "total").unionByName(joined).groupBy("id", "key").agg(F.max("n_bytes").alias("n_bytes"), F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    out = sums.select("id", "n_bytes", F.expr("total div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_")).drop("_")
    return out.withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
