"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint is the majority of the bits of the XXH64 hashes (seed 42) of a text's four-word
shingles. Two fingerprints link if at most ``RADIUS`` of their 64 bits differ. Only distinct
fingerprints are compared. Of ``RADIUS`` + 1 blocks of bits at least one is equal in two that link,
so each fingerprint goes once to a trie per block, whose root is that block's value. In a trie pairs
of nodes are traversed together: their common bits are compared, the pair is dropped once more bits
differ than the budget has, and where all below is one component already. A root with more than
``ROOT`` fingerprints is dealt out by the pairs of nodes some levels below it that the budget allows, and
so on with these, until no pair of nodes has more. Of a trie's links a
spanning forest is kept, at most one edge a fingerprint, and components follow by star contraction.

Edge cases: texts without words (null, empty) have fingerprint zero, which links like any other; of
a text with fewer than four words the whole is the only shingle; repeated rows appear as often as
they occur; a component's id is its least document id, null only where it has no other; an empty
table gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, claim, forget, keep, table, text_or_empty
from millrace.llm.components import components

RADIUS, WORDS = 4, 4
#: A root with more fingerprints is dealt out, by so many bits at a time at most.
ROOT, LEVELS = 1 << 16, 8
#: A pair of nodes with at most so many pairs of fingerprints is compared at once.
LEAF = 1 << 14


def fingerprint(text: bytes, words: int = WORDS) -> int:
    found = text.lower().split()  # of bytes: A-Z, and blanks of ASCII, alone
    if not found:
        return 0
    joined, lengths = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    n = max(1, len(found) - words + 1)
    stops = (starts + lengths)[-n:].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        hashes = [of(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + (1 << 14))].tolist(), stops[at : at + (1 << 14)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and fp (the fingerprint as a signed integer) for each row."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    source = source.select("id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def trie_components(keys: np.ndarray, cut_at: int | None = None, radius: int = RADIUS) -> np.ndarray:
    """For each of ``keys`` (unsigned, distinct, ascending) the index of the first of its component.

    A node of the trie is a range of keys that start alike. With ``cut_at`` only links between the
    keys before and from that index on are looked for.
    """
    n = len(keys)
    parent = np.arange(n)

    def roots(low: int, high: int) -> np.ndarray:
        at = parent[low:high]
        while True:
            up = parent[at]
            if np.array_equal(up, at):
                parent[low:high] = at
                return at
            at = up

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def split(low: int, high: int, depth: int) -> int:
        first = ((int(keys[low]) >> (63 - depth)) | 1) << (63 - depth)
        return low + int(np.searchsorted(keys[low:high], np.uint64(first)))

    stack = [(0, n, 0, n)] if cut_at is None else [(0, cut_at, cut_at, n)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1 or (a0, a1) == (b0, b1) and a1 - a0 == 1:
            continue
        first, second = int(keys[a0]), int(keys[b0])
        depth_a = 64 - (first ^ int(keys[a1 - 1])).bit_length()
        depth_b = 64 - (second ^ int(keys[b1 - 1])).bit_length()
        common = min(depth_a, depth_b)
        if common and ((first ^ second) >> (64 - common)).bit_count() > radius:
            continue
        la, lb = roots(a0, a1), roots(b0, b1)
        if (la == la[0]).all() and (lb == la[0]).all():
            continue
        if (a1 - a0) * (b1 - b0) <= LEAF:
            near = np.bitwise_count(keys[a0:a1, None] ^ keys[None, b0:b1]) <= radius
            if not near.any():
                continue
            new_a, new_b = la, lb
            while True:  # least label over links, until nothing changes
                to_b = np.minimum(new_b, np.where(near, new_a[:, None], n).min(axis=0))
                to_a = np.minimum(new_a, np.where(near, to_b[None, :], n).min(axis=1))
                if np.array_equal(to_a, new_a) and np.array_equal(to_b, new_b):
                    break
                new_a, new_b = to_a, to_b
            moved = np.concatenate([la, lb]), np.concatenate([new_a, new_b])
            which = moved[0] != moved[1]
            for old, new in np.unique(np.stack([moved[0][which], moved[1][which]], axis=1), axis=0).tolist():
                x, y = root(old), root(new)
                parent[max(x, y)] = min(x, y)
        elif (a0, a1) == (b0, b1):
            m = split(a0, a1, depth_a)
            stack += [(a0, m, m, a1), (m, a1, m, a1), (a0, m, a0, m)]
        elif depth_a <= depth_b:
            m = split(a0, a1, depth_a)
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = split(b0, b1, depth_b)
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]
    return roots(0, n)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """First bit from the top and width of each block."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


KEY = ["block", "value", "depth", "low", "high"]


def _turned(blocks: list[tuple[int, int]]) -> Column:
    """The bits that follow the entry's block, around the end."""
    out = F.lit(0).cast("bigint")
    for i, (a, w) in enumerate(blocks):
        at = (a + w) % 64
        turned = F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")
        out = F.when(F.col("block") == i, turned).otherwise(out)
    return out


def _dealt(entries: DataFrame, large: DataFrame, blocks: list[tuple[int, int]], radius: int) -> DataFrame:
    """``entries`` with those of the groups ``large`` (KEY, levels, sides) dealt out by pairs of nodes ``levels`` bits deeper.

    An entry comes to each pair of its own node and one that the error budget, less what the pair of nodes
    above has used, still allows. Groups with nothing on one side are left out.
    """
    rest = entries.join(large, KEY, "left").where("levels is null or low = high or sides = 2").withColumn("turned", _turned(blocks))
    masks = "filter(sequence(0, shiftleft(1, levels) - 1), m -> bit_count(m) <= {} - bit_count(low ^ high))".format(radius)
    rest = rest.withColumn("mask", F.explode(F.when(F.col("levels").isNull(), F.array(F.lit(0))).otherwise(F.expr(masks))))
    rest = rest.withColumn("node", F.expr("shiftrightunsigned(turned, 64 - depth - levels) & (shiftleft(1L, levels) - 1)")).withColumn("other", F.expr("node ^ mask"))
    deeper = lambda side, node: F.expr(f"shiftleft({side}, levels) | {node}")
    low = F.when(F.expr("low = high"), deeper("low", "least(node, other)")).when(F.expr("second = 0"), deeper("low", "node")).otherwise(deeper("low", "other"))
    high = F.when(F.expr("low = high"), deeper("high", "greatest(node, other)")).when(F.expr("second = 0"), deeper("high", "other")).otherwise(deeper("high", "node"))
    second = F.when(F.expr("low = high"), F.expr("int(node > other)")).otherwise(F.col("second"))
    settled = F.col("levels").isNull()
    return rest.select("block", "value", F.expr("depth + coalesce(levels, 0)").alias("depth"), F.when(settled, F.col("low")).otherwise(low).alias("low"), F.when(settled, F.col("high")).otherwise(high).alias("high"), F.when(settled, F.col("second")).otherwise(second).alias("second"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, most: int = ROOT) -> DataFrame:
    """Edges a, b that connect all of ``fps`` (distinct fp) that differ in at most ``radius`` bits."""
    spark, blocks = fps.sparkSession, _blocks(radius)
    parts = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", 64 - a - w).bitwiseAND((1 << w) - 1).alias("value")) for i, (a, w) in enumerate(blocks)))
    zero = F.lit(0).cast("bigint")
    entries = fps.select("fp", F.explode(parts).alias("x")).select("x.block", "x.value", F.lit(0).alias("depth"), zero.alias("low"), zero.alias("high"), F.lit(0).alias("second"), "fp")
    bits = F.element_at(F.array(*(F.lit(64 - w) for _, w in blocks)), F.col("block") + 1) - F.col("depth")  # below the group's node
    levels = F.least(F.lit(LEVELS), bits, F.ceil(F.log2(F.col("n") / most)) + 1).cast("int")
    while True:  # ends at the last bit, where a pair of nodes has two keys
        counts = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("second") - F.min("second") + 1).alias("sides"))
        large, at = keep(counts.where((F.col("n") > most) & (bits > 0)).select(*KEY, levels.alias("levels"), "sides"), "roots", spark.sparkContext.defaultParallelism)
        if large.isEmpty():
            forget(spark, at)
            break
        entries = _dealt(entries, large, blocks, radius)
    starts = np.array([a for a, _ in blocks], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        held: list[np.ndarray] = []

        def edges(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shift = starts[group[0, 0]]
            raw = np.ascontiguousarray(group[:, 6]).view(np.uint64)
            keys = (raw << shift) | (raw >> ((np.uint64(64) - shift) % np.uint64(64))) if shift else raw
            order = np.lexsort((keys, group[:, 5]))
            cut_at = int((group[:, 5] == 0).sum()) if group[0, 3] != group[0, 4] else None
            label = trie_components(keys[order], cut_at, radius)
            own = raw.view(np.int64)[order]
            moved = label != np.arange(len(label))
            return own[moved], own[label[moved]]

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            bounds = [0, *(np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(axis=1)) + 1).tolist(), len(rows)]
            found = [edges(rows[a:b]) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*found)) or [[], []])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            # what belongs to the batch's last group waits for the next batch
            tail = int(np.argmax((rows[:, :5] == rows[-1, :5]).all(axis=1)))
            if tail or held and (held[-1][-1, :5] != rows[0, :5]).any():
                yield flush(np.concatenate([*held, rows[:tail]]))
                held = []
            held.append(rows[tail:])
        if held:
            yield flush(np.concatenate(held))

    return entries.repartition(*KEY).sortWithinPartitions(*KEY).select(*KEY, "second", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column, text_hash, fp and component_id for each row."""
    rows, _ = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    label = components(links(rows.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    own = least.join(label, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    ids = own.groupBy("label").agg(F.min("least").alias("component_id"))
    of = own.join(ids, "label").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the least doc_id (null first); of rows that repeat it exactly in doc_id and text, one."""
    found = near_duplicates(docs, radius)
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash")).distinct()
    marked = docs.withColumn("_row_hash", F.xxhash64(text_or_empty()))
    kept = marked.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_row_hash"]).drop("_row_hash")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
