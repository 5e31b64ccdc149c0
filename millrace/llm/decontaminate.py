"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased and cut into words (runs of letters and digits); a shingle is five words, of
an item with fewer words all of them. A window of a document has as many words as the item. It is
contaminated if the weighted Jaccard similarity of its shingles (counted with repeats) and the
item's is at least ``SIMILARITY``, and their 64-bit SimHashes differ in at most ``RADIUS`` bits, which at the least
similarity is three deviations (of 3) above what they differ in on average (10).

A window that doesn't begin with a shingle of any item of its size is no better than a later one that does, or than
the last of the text, and one with too few such shingles can't be similar: other windows are left out, whatever item
they may be of. The rest get a SimHash, which is looked up in an index of the items' fingerprints by four
16-bit blocks. Each block is stored with every value two or fewer bits away, and looked up with every value two or
fewer bits away: two fingerprints within ``RADIUS`` = 4 * 5 - 1 bits agree in some block up to four bits, so no pair within
it is missed, and a pair is taken from its first such block alone. Pairs that the index returns are then verified
exactly. The documents are never shuffled: shingles of items are broadcast in blocks of at most ``BLOCK``, and the index
in parts of at most ``INDEX`` items, however many there are.

Edge cases: null and empty texts, and items without words, match nothing; a document with fewer
words than the item is one window; repeated rows, which share their doc_id, are reported once; null and repeated
item_ids are ids like others, under which the best of their items is reported; ties between windows go to the first;
empty tables give an empty result; only doc_id, text and item_id are read, so other columns can have any name but
``_dc_leak``; per word of a text a bounded slice is held at most, so long texts cost in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import forget, keep, table, text_or_empty

WORDS, SIMILARITY = 5, 0.8
BLOCKS, BITS, FLIPS = 4, 16, 2
RADIUS = BLOCKS * (2 * FLIPS + 1) - 1
#: Shingles of items that are broadcast at a time (16 bytes each), and items whose index is (548 rows of 40 bytes each).
BLOCK, INDEX = 1 << 20, 1 << 11


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, from an array of the words' hashes."""
    starts = F.sequence(F.lit(0), F.size(hashed) - size)
    return F.when(F.size(hashed) >= size, F.transform(starts, lambda i: F.xxhash64(*(hashed[i + k] for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingle_hashes: Column) -> Column:
    """A bit is 1 if it is in over half of the hashes."""
    ones = lambda bit: F.aggregate(shingle_hashes, F.lit(0), lambda n, h: n + F.getbit(h, bit))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
        lambda fp, bit: fp.bitwiseOR(F.when(ones(bit) * 2 > F.size(shingle_hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))),
    )


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays, with repeats."""
    times = lambda x, among: F.size(F.filter(among, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))
    return both / (F.size(a) + F.size(b) - both)


def _block(fp: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, (block * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))


def _near() -> Column:
    """Every mask of a block with two or fewer bits."""
    return F.array(*(F.lit(m).cast("bigint") for m in range(1 << BITS) if m.bit_count() <= FLIPS))


def prepare(benchmark: DataFrame) -> DataFrame:
    """key, item_id, size (words in a shingle), n_words, item (its shingles) and item_fp for each different item with words."""
    hashed = benchmark.select("item_id", F.transform(words(text_or_empty()), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)
    size = F.least(F.lit(WORDS), F.size("h"))
    item = F.lit(None).cast("array<bigint>")
    for k in range(1, WORDS + 1):
        item = F.when(size == k, shingles(F.col("h"), k)).otherwise(item)
    found = hashed.select("item_id", size.alias("size"), F.size("h").alias("n_words"), item.alias("item"))
    # ids can be null or repeat, so items have keys of their own
    keyed = found.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "n_words", "item").alias("key"), "*").dropDuplicates(["key"])
    return keyed.withColumn("item_fp", simhash(F.col("item")))


def windows(docs: DataFrame, items: DataFrame, size: int, at_least: float) -> DataFrame:
    """doc_id, start, n and window (its shingles) of the windows of ``docs`` (doc_id, row, h: hashes of words) that may be similar to an item."""
    rows = docs.select("doc_id", "row", shingles(F.col("h"), size).alias("s"))
    sizes = items.select(F.explode(F.array_distinct("item")).alias("shingle"), F.size("item").alias("n")).distinct()
    # outer, and keys never null: otherwise Catalyst derives filters that work out the arrays once more
    hits = rows.select("doc_id", "row", "s", F.posexplode_outer("s").alias("pos", "shingle")).join(F.broadcast(sizes), "shingle")
    total, last = F.size("s"), F.greatest(F.lit(0), F.size("s") - F.col("n"))
    start = F.least("pos", last)
    hits = hits.select("doc_id", "row", "n", "pos", start.alias("start"), (total < F.col("n")).alias("short"), F.slice("s", start + 1, F.col("n")).alias("window"))
    by = ["doc_id", "row", "n"]
    hits = hits.repartition(*by).dropDuplicates([*by, "pos"])
    order = W.partitionBy(*by).orderBy(F.expr("pos * 1000000L div n"))
    # positions are told in millionths of n, so that the frame is the window
    hits = hits.withColumn("k", F.count(F.lit(1)).over(order.rangeBetween(0, 999_999))).withColumn("before", F.lag("start").over(order))
    need = F.ceil(F.col("n") * (2 * at_least / (1 + at_least)) - 1e-9)
    begins = (F.col("pos") == F.col("start")) & ~F.col("short")
    return hits.where(F.when(begins, F.col("k") >= need).otherwise(F.col("before").isNull() | (F.col("before") < F.col("start")))).select("doc_id", "start", "n", "window")


def look_up(found: DataFrame, items: DataFrame, at_least: float, radius: int) -> DataFrame:
    """doc_id, item_id, similarity and start of those windows in ``found`` (with fp) that the index of ``items`` finds, verified."""
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    stored = items.select("key", F.size("item").alias("n"), "item_fp", F.explode(blocks).alias("block")).select("key", "n", "item_fp", "block", F.explode(_near()).alias("m"))
    stored = stored.select("key", "n", "item_fp", "block", _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("m")).alias("value"))
    asked = found.select("*", F.explode(blocks).alias("block")).select("*", F.explode(_near()).alias("mask"))
    asked = asked.withColumn("value", _block(F.col("fp"), F.col("block")).bitwiseXOR(F.col("mask")))
    pairs = asked.join(F.broadcast(stored), ["n", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that several blocks find is taken from the first of them, and of several masks from that of the lowest bits
    again = F.exists(blocks, lambda b: (b < F.col("block")) & (F.bit_count(_block(apart, b)) <= 2 * FLIPS))
    pairs = pairs.withColumn("d", _block(apart, F.col("block"))).withColumn("d1", F.col("d").bitwiseAND(F.col("d") - 1))
    lowest = F.col("d").bitwiseXOR(F.col("d1").bitwiseAND(F.col("d1") - 1))
    pairs = pairs.where((F.bit_count(apart) <= radius) & (F.col("mask") == lowest) & ~again)
    verified = pairs.join(F.broadcast(items.select("key", "item_id", "item")), "key").withColumn("similarity", similarity(F.col("window"), F.col("item")))
    return verified.where(F.col("similarity") >= at_least).select("doc_id", "item_id", "similarity", "start")


def find_leaks(docs: DataFrame, benchmark: DataFrame, at_least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity and start (in words, of the best window) for each document and item that match."""
    spark = docs.sparkSession
    items, _ = keep(prepare(benchmark), "items", spark.sparkContext.defaultParallelism)
    groups = items.groupBy("size").agg(F.sum(F.size("item")).alias("n"), F.count(F.lit(1)).alias("k")).collect()  # five rows at most
    hashed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.transform(words(text_or_empty()), lambda w: F.xxhash64(w)).alias("h"))
    part = lambda df, n, k, seed: df if n == 1 else df.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)) == k)
    found = None
    for size, n, count in groups:
        passes = -(-n // BLOCK)
        parts = -(-count // (passes * INDEX))
        for k in range(passes):
            own = part(items.where(F.col("size") == size), passes, k, 1)
            some = windows(hashed, own, size, at_least).withColumn("fp", F.coalesce(simhash(F.col("window")), F.lit(0).cast("bigint")))
            if parts > 1:
                some, _ = keep(some, "windows")
            for j in range(parts):
                one = look_up(some, part(own, parts, j, 2), at_least, radius)
                found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select("doc_id").where(F.lit(False)).join(benchmark.select("item_id"), F.lit(True)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that match an item; documents that share a doc_id go together."""
    # written, so that its size is known before the documents are joined to it
    leaks, _ = keep(find_leaks(docs, benchmark).select(F.col("doc_id").alias("_dc_leak")).distinct(), "leaks", docs.sparkSession.sparkContext.defaultParallelism)
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_dc_leak")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
