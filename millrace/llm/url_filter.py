"""URL filter: rules first, then a ratio of character language models.

Each url that a rule decides is an example, accepted or rejected. Characters (41 symbols: letters,
digits, ``. / -``, any other, start) are counted in runs of four for either class over all examples
but every fifth; two variable-order Markov models with Witten-Bell smoothing follow from the counts,
and a url's score is the difference of its log-likelihoods divided by its length. The threshold is
that of least balanced error on the examples held back. What goes through the driver, counts and the
table of differences, has at most 41**4 (2.8 million) cells, whatever the input.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; its
score is 0. Ties for the threshold go to the one nearest 0; with examples of one class only it is 0.
Repeated rows count and appear as often as they occur; an empty table gives an empty result. Only
page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SYMBOLS = "^_./-" + "abcdefghijklmnopqrstuvwxyz" + "0123456789"
ORDER = 4
#: Scores are put in bins this wide for the threshold, up to this far from 0.
BIN, REACH = 0.01, 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise("")
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and decided (allow, block or null) to a table with a column url."""
    host, path = host_and_path(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, decided = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return out.withColumn("rule", rule).withColumn("decided", decided)


def symbols(url: Column) -> Column:
    """The url in the models' alphabet, without its scheme."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.regexp_replace(ascii_lower(rest), r"(?s)[^a-z0-9./\-]", "_")


def count_runs(examples: DataFrame) -> DataFrame:
    """gram, allow, block: how often each run of four symbols occurs, from a table of coded and decided."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), F.col("coded"))
    runs = F.transform(F.sequence(F.lit(1), F.length("coded")), lambda i: F.substring(padded, i, F.lit(ORDER)))
    each = examples.where(F.length("coded") > 0).select("decided", F.explode(runs).alias("gram"))
    return each.groupBy("gram").agg(F.count(F.when(F.col("decided") == "allow", 1)).alias("allow"), F.count(F.when(F.col("decided") == "block", 1)).alias("block"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before it), from counts in an array with an axis for each of the four.

    Witten-Bell: a context's own share grows with what was seen in it, the rest comes from the context
    one shorter; a context never seen counts for nothing, so the order varies with the evidence.
    """
    p = np.full(len(SYMBOLS), 1 / len(SYMBOLS))
    for order in range(1, ORDER + 1):
        n = counts.sum(axis=tuple(range(ORDER - order)))
        total, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p)


def fit(counts: pd.DataFrame) -> np.ndarray:
    """The difference of the two models' logs for each run of four, flat."""
    index = {c: i for i, c in enumerate(SYMBOLS)}
    at = tuple(counts["gram"].map(lambda g, k=k: index[g[k]]).to_numpy(int) for k in range(ORDER))
    logs = []
    for verdict in ("allow", "block"):
        n = np.zeros((len(SYMBOLS),) * ORDER)
        n[at] = counts[verdict].to_numpy(float)
        logs.append(log_model(n))
    return (logs[0] - logs[1]).astype(np.float32).ravel()


def score_text(coded: str, table_: np.ndarray) -> float:
    if not coded:
        return 0.0
    codes = _CODE[np.frombuffer(("^" * (ORDER - 1) + coded).encode(), np.uint8)]
    n, at = len(coded), np.zeros(len(coded), np.int64)
    for k in range(ORDER):
        at = at * len(SYMBOLS) + codes[k : k + n]
    return float(table_[at].mean(dtype=np.float64))


_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i


def scored(urls: DataFrame, table_: np.ndarray) -> DataFrame:
    """Adds score to a table with a column coded."""
    shared = urls.sparkSession.sparkContext.broadcast(table_)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda c: score_text(c, shared.value)).astype(float)

    return urls.withColumn("score", score("coded"))


def threshold(examples: DataFrame) -> float:
    """Of the bins' edges the one with the least balanced error, from a table of score and decided."""
    held = examples.withColumn("bin", F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("score"))) / BIN))
    bins = held.groupBy("bin", "decided").count().toPandas()  # at most 2,001 bins twice
    n = {v: np.zeros(int(2 * REACH / BIN) + 2) for v in ("allow", "block")}
    for b, v, k in bins.itertuples(index=False):
        n[v][int(b) + round(REACH / BIN)] += k
    if not n["allow"].sum() or not n["block"].sum():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(n["allow"])]) / n["allow"].sum()
    let = 1 - np.concatenate([[0], np.cumsum(n["block"])]) / n["block"].sum()
    edges = (np.arange(len(lost)) - round(REACH / BIN)) * BIN
    return float(min(zip(np.round(lost + let, 12), np.abs(edges), edges))[2])


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score and threshold for each row."""
    judged = with_rule(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")), rules).withColumn("coded", symbols(F.col("url")))
    examples = judged.where(F.col("decided").isNotNull()).select("coded", "decided")
    held_back = F.pmod(F.xxhash64("coded"), F.lit(5)) == 0
    model = fit(count_runs(examples.where(~held_back)).toPandas())
    at_least = threshold(scored(examples.where(held_back), model))
    verdict = F.coalesce("decided", F.when(F.col("score") >= at_least, "allow").otherwise("block"))
    return scored(judged, model).select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(at_least).alias("threshold"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
