"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary texts, by a cover selection whose segments are
words with the blank before them: a segment covers what it has in as many texts as have it. Of either class's texts the
dictionary takes the segments that occur in a larger share of them than of the other class's, by some standard errors at least (those of ``ERRORS`` that do best on the
calibrating texts; few texts prove less, and many words differ by chance), the largest difference first; and nearest to the text, where matches cost least, the segments that both classes
have, the commonest first. Prose therefore costs about the same under both, and what differs is what the classes
differ in. A text is cut into windows of ``WINDOW`` words. The compressed length of a window under the ordinary dictionary less
that under the toxic one is its gain; a logistic model calibrated on texts that neither dictionary has
seen turns a text's gains (the two greatest, the sum of those of 3 bytes or more, the number of windows, the shares of
windows with gains of 1 and of 3 bytes or more, and the mean) into a score, shifted so that 0.5 is the threshold of greatest F1.

Fitting takes at most ``SAMPLE`` labelled rows, those with the least hashes of doc_id, so they can be
broadcast to the documents; a dictionary has at most ``OWN_BYTES`` and ``SHARED_BYTES``. Any word of any length can be
a segment. Of the rows, crc32(doc_id) mod 5 picks folds: 0 is never used, 4 calibrates and the rest trains; where that
leaves either without both classes, another fold calibrates, or all train and calibrate.

Edge cases: null and empty texts have one empty window; texts of any length are scored whole; a row
without a label takes no part in fitting; of conflicting labels toxic wins; without labels of both
classes each score is 0; equal texts get equal scores, whatever their other columns; an empty
table gives an empty one; other columns can have any name but those that start with ``_tx_``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, claim, forget, keep, table, text_or_empty

SAMPLE, OWN_BYTES, SHARED_BYTES = 50_000, 1 << 18, 1 << 20
WINDOW, ERRORS = 16, (3.0, 4.0, 5.0)
_WORD = re.compile(r"[^\W_]+")
FEATURES = 7


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Compressor:
    """Compressed lengths of windows under a dictionary of raw content."""

    def __init__(self, content: bytes):
        params = zstandard.ZstdCompressionParameters(window_log=22, chain_log=20, hash_log=20, search_log=4, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(compression_params=params, dict_data=words).compress

    def length(self, window: bytes) -> int:
        return len(self.compress(window))


def content(own: list[str], shared: list[str]) -> bytes:
    """Segments, the first ones last: what is nearest to the text costs least."""
    return "".join(f" {w}" for w in [*reversed(own), *reversed(shared)]).encode() + b" "


def features(text: str, ordinary: Compressor, toxic: Compressor) -> list[float]:
    words = _WORD.findall((text or "").lower())
    gains = [0, 0]
    for at in range(0, max(1, len(words)), WINDOW):
        w = f" {' '.join(words[at : at + WINDOW])} ".encode()
        gains.append(ordinary.length(w) - toxic.length(w))
    best = sorted(gains, reverse=True)
    n = len(gains) - 2
    return [best[0], best[1], float(np.log1p(sum(g for g in best if g >= 3))), float(np.log1p(n)), sum(g >= 1 for g in best) / n, sum(g >= 3 for g in best) / n, sum(best) / n]


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), None
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def features(self, texts: list[str]) -> np.ndarray:
        if self._ready is None:
            self._ready = Compressor(self.ordinary), Compressor(self.toxic)
        return np.array([features(t, *self._ready) for t in texts], float).reshape(-1, FEATURES)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> float:
        """Logistic regression by Newton's method with a small ridge, then the shift to the best F1 (ties: the highest threshold), which is returned."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        z = a @ w
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
        f1[np.r_[z[order][1:] == z[order][:-1], False]] = -1  # no threshold between equals
        k = int(np.argmax(f1))
        after = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
        w[-1] -= (z[order][k] + after) / 2
        self.weights = w
        return float(f1[k])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = np.c_[(self.features(texts) - self.mean) / self.scale, np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _first(words: DataFrame, by: Column, size: int) -> list[str]:
    """The words with the greatest ``by``, as many as ``size`` bytes hold."""
    ordered = words.orderBy(F.desc(by), "word")
    lengths = ordered.limit(size // 2).select(F.octet_length("word").alias("n")).toArrow().column(0).to_numpy()
    return ordered.limit(int((np.cumsum(lengths + 1) <= size).sum())).select("word").toArrow().column(0).to_pylist()


def _calibration_fold(by_class: dict[tuple[int, int], int]) -> int | None:
    """The last fold that has both classes and leaves both to the others; None if none does."""
    both = lambda folds: all(sum(by_class.get((f, c), 0) for f in folds) for c in (0, 1))
    return next((k for k in (4, 3, 2, 1) if both([k]) and both({1, 2, 3, 4} - {k})), None)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample, at_sample = keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    rows, at_rows = keep(found.select("text", F.col("toxic").cast("int").alias("toxic"), fold(F.col("doc_id")).cast("int").alias("fold")), "examples")
    by_class = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # eight at most
    n = {c: sum(k for (_, x), k in by_class.items() if x == c) for c in (0, 1)}
    if not n[0] or not n[1]:
        forget(spark, at_sample, at_rows)
        return Model(b"", b"")
    last = _calibration_fold(by_class)
    if last is not None:
        n = {c: n[c] - by_class.get((last, c), 0) for c in (0, 1)}
    train, held = (rows, rows) if last is None else (rows.where(F.col("fold") != last), rows.where(F.col("fold") == last))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    each = train.select("toxic", F.explode_outer(words).alias("word")).where("word is not null")
    share = each.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("k")).select("word", (F.col("t") / n[1]).alias("p"), ((F.col("k") - F.col("t")) / n[0]).alias("q"), "k")
    error = lambda of, na, other, nb: F.sqrt(F.col(of) / na + (F.col(other) + 1 / nb) / nb)
    share = share.withColumn("toxic", (F.col("p") - F.col("q")) / error("p", n[1], "q", n[0])).withColumn("ordinary", (F.col("q") - F.col("p")) / error("q", n[0], "p", n[1]))
    share, at_share = keep(share.where((F.greatest("toxic", "ordinary") > min(ERRORS)) | (F.col("k") >= 3)), "segments")
    best: tuple[float, Model] | None = None
    for errors in ERRORS:
        shared = _first(share.where((F.greatest("toxic", "ordinary") <= errors) & (F.col("k") >= 3)), F.col("k"), SHARED_BYTES)
        own = {s: _first(share.where(F.col(s) > errors), F.abs(F.col("p") - F.col("q")), OWN_BYTES) for s in ("ordinary", "toxic")}
        model = Model(content(own["ordinary"], shared), content(own["toxic"], shared))
        got = held.select("toxic", measuring(spark, model, f"toxicity at {errors}")("text").alias("x")).toArrow()  # numbers of SAMPLE rows at most
        f1 = model.calibrate(np.array(got.column(1).to_pylist(), float), np.array(got.column(0).to_pylist(), float))
        if best is None or f1 >= best[0]:
            best = f1, model
    forget(spark, at_sample, at_rows, at_share)
    return best[1]


def measuring(spark: SparkSession, model: Model, name: str) -> Callable:
    """A function of columns that gives texts' features; under its name workers give back what other models took."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim(name)
        for texts in batches:
            yield pd.Series(list(sent.value.features(texts.tolist())), dtype=object)

    return measured


def scores(model: Model, spark: SparkSession, text: Column) -> Column:
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()), dtype=float)

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is 0.5 or more."""
    model = fit(docs, labels)
    marked = docs.withColumn("_tx_score", scores(model, docs.sparkSession, text_or_empty()))
    return marked.where(F.col("_tx_score") < 0.5).drop("_tx_score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), scores(model, spark, text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
