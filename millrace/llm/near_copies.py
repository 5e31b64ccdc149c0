"""Near copies at a similarity of 0.8: SimHash tries below the shingles that texts share.

A text is the set of its five-word shingles (words are what blanks of ASCII part, A-Z lower-cased), as
64-bit hashes, and has the SimHash of that set. Two texts link if the Jaccard similarity of their sets is at least
``SIMILARITY``, and of each component of links one document stays. At that similarity fingerprints
differ in 10 bits on average with a deviation of 3, so the error budget has to be ``BUDGET`` bits, and blocks of bits, which
lead to the tries at 4 bits, would part nothing. Here shared shingles do that.

Grouping misses no pair (prefix filtering; the budget itself lies over four deviations above the average, so a pair of
exactly 0.8 is lost about once in 100,000): in one order of all shingles, two sets of sizes n and m that are so
similar share one among the first n - ceil(0.8 n) + 1 of the one and m - ceil(0.8 m) + 1 of the other. The
order puts shingles that a sample of one text in ``EVERY`` repeats behind all others, which keeps
groups small; any order is right. Texts that share a shingle of a prefix are candidates: in a group of at most ``SMALL``
all of them, in a larger one each with one centre, which the sample gives for the commonest shingles, so
that these are never gathered. Candidates within the budget are compared exactly on their texts.

What is left of large groups are pairs of texts in different components. A group's rows are dealt out in
chunks: those of its commonest component stay, all others meet each chunk. In a chunk the two sides' tries of fingerprints
are traversed together, pairs of nodes are pruned whose common bits differ too often or below which all is one
component, and pairs within the budget are checked by bitmaps, in which each shingle turns one of ``BITS`` bits: shingles
that only one text has number at least the bits that differ. At first only a spanning forest of a chunk's pairs
is compared exactly, which joins most components; then all pairs that are left are.

Edge cases: of a text with fewer than five words the whole is the only shingle; null, empty and blank
texts are alike; texts with equal sets are alike; null doc_ids come first; rows that repeat a doc_id and text are one; an
empty table gives an empty one; a text without blanks is one word, so only equal ones are alike. Names that start with ``_nc_``
are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, claim, forget, keep, maybe_in, text_or_empty
from millrace.llm.components import components

WORDS, SIMILARITY, BUDGET = 5, 0.8, 23
SMALL, EVERY, HOT = 64, 16, 4
BITS, CHUNK = 2048, 4096
#: Shingles that the order puts last, at most; which ones they are doesn't change the result.
COMMON = 200_000
#: A pair of nodes with at most so many pairs of fingerprints is compared at once.
LEAF = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the different shingles, ascending."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    words = np.fromiter((of(w, 42) for w in found), np.uint64, len(found))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = (out ^ words[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, at_least: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= at_least * (len(a) + len(b) - both) - 1e-9


def simhash(found: np.ndarray) -> int:
    """A bit is 1 if it is in over half of the shingles' hashes; as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 14):
        ones += np.unpackbits(found[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little", signed=True)


def bitmap(found: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of shingles fall on it."""
    return np.packbits(np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def prefix(found: np.ndarray, keys: np.ndarray, counts: np.ndarray, at_least: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order: one of them is in any similar set's prefix."""
    rank = np.zeros(len(found), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(at_least * len(found) - 1e-9) + 1]


def _sizes(n: np.ndarray, m: np.ndarray, at_least: float) -> np.ndarray:
    return np.minimum(n, m) >= at_least * np.maximum(n, m) - 1e-9


def _possible(x: np.ndarray, y: np.ndarray, at_least: float) -> np.ndarray:
    """Whether sizes and places (columns 2 and 3) of a shingle in common leave the similarity possible."""
    n, m = x[:, 2], y[:, 2]
    most = np.minimum(x[:, 3], y[:, 3]) + np.minimum(n - x[:, 3], m - y[:, 3])
    return _sizes(n, m, at_least) & (most >= at_least / (1 + at_least) * (n + m) - 1e-9)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0, lesser and greater node, 0 for each pair, once."""
    ends = np.sort(np.stack([a, b], axis=1), axis=1)
    ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
    zero = np.zeros(len(ends), np.int64)
    return np.stack([zero, ends[:, 0], ends[:, 1], zero], axis=1)


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in rows.T], names)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)


def near_pairs(fp_a: np.ndarray, fp_b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of fingerprints (unsigned, ascending on each side) with different labels that differ in at most ``budget`` bits."""

    def split(keys: np.ndarray, low: int, high: int, depth: int) -> int:
        first = ((int(keys[low]) >> (63 - depth)) | 1) << (63 - depth)
        return low + int(np.searchsorted(keys[low:high], np.uint64(first)))

    stack = [(0, len(fp_a), 0, len(fp_b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        first, second = int(fp_a[a0]), int(fp_b[b0])
        depth_a, depth_b = 64 - (first ^ int(fp_a[a1 - 1])).bit_length(), 64 - (second ^ int(fp_b[b1 - 1])).bit_length()
        common = min(depth_a, depth_b)
        if common and ((first ^ second) >> (64 - common)).bit_count() > budget:
            continue
        la, lb = label_a[a0:a1], label_b[b0:b1]
        if (la == la[0]).all() and (lb == la[0]).all():
            continue
        if (a1 - a0) * (b1 - b0) <= LEAF or common == 64:
            near = (np.bitwise_count(fp_a[a0:a1, None] ^ fp_b[None, b0:b1]) <= budget) & (la[:, None] != lb[None])
            x, y = np.nonzero(near)
            if len(x):
                yield x + a0, y + b0
        elif depth_b == 64 or depth_a <= depth_b and depth_a < 64:
            m = split(fp_a, a0, a1, depth_a)
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = split(fp_b, b0, b1, depth_b)
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges between labels join what those before them have left apart."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[x], out[k] = y, True
    return out


def _node(text: Column) -> Column:
    """Texts are known by their hashes; all without words are one."""
    return F.xxhash64(F.when(F.btrim(text, F.lit(" \t\r\n\x0b\x0c")) == "", F.lit("")).otherwise(text))


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Rows of batches sorted by the first columns, so that no group is parted."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch)
        tail = int(np.argmax((rows[:, :keys] == rows[-1, :keys]).all(axis=1)))
        if tail or held and (held[-1][-1, :keys] != rows[0, :keys]).any():
            yield np.concatenate([*held, rows[:tail]])
            held = []
        held.append(rows[tail:])
    if held:
        yield np.concatenate(held)


class _Search:
    """The stages of one search; each stored table is deleted once nothing reads it."""

    def __init__(self, docs: DataFrame, at_least: float, small: int, every: int, hot: int, chunk: int):
        self.spark, self.at_least, self.small, self.every, self.hot, self.chunk = docs.sparkSession, at_least, small, every, hot, chunk
        bound_batches(self.spark)
        self.texts = docs.select(text_or_empty().alias("t")).select(_node(F.col("t")).alias("node"), F.col("t").cast("binary").alias("text"))
        self.width = self.spark.sparkContext.defaultParallelism

    def common(self):
        """Shingles (ascending) that the sample repeats, how often, and for each of them the node and size of one text."""
        at_least = 3 if self.every > 1 else 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            for batch in batches:
                for node, t in zip(batch.column(0).to_numpy(), batch.column(1)):
                    found = shingles(t.as_py())
                    yield _batch(np.stack([found.view(np.int64), np.full(len(found), node), np.full(len(found), len(found))], axis=1), ["h", "node", "n"])

        some = self.texts.where(F.pmod(F.xxhash64("node"), F.lit(self.every)) == 0).dropDuplicates(["node"])
        often = some.mapInArrow(run, "h bigint, node bigint, n bigint").groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("node", "n"), "node").alias("c")).where(F.col("k") >= at_least)
        found = often.orderBy(F.desc("k"), "h").limit(COMMON).select("h", "k", "c.node", "c.n").toArrow()
        got = np.stack([c.to_numpy().astype(np.int64) for c in found.columns], axis=1)
        got = got[np.argsort(np.ascontiguousarray(got[:, 0]).view(np.uint64))]
        return np.ascontiguousarray(got[:, 0]).view(np.uint64), got[:, 1], got[:, 2], got[:, 3]

    def candidates(self) -> tuple[DataFrame, str]:
        """kind 0: a pair a, b; kind 1: a member a, of size n, of the large group b."""
        common, at_least, small, hot = self.spark.sparkContext.broadcast(self.common()), self.at_least, self.small, self.hot
        columns = ["kind", "h", "node", "n", "pos"]

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """kind 0: an entry of a group; 1: a member of one known to be large; 2: a pair (h, node) of such a one."""
            claim("simhash")
            keys, counts, centres, centre_n = common.value
            seen: set[int] = set()
            for batch in batches:
                out = [np.zeros((0, 5), np.int64)]
                for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if node in seen:
                        continue
                    seen.add(node)
                    found = shingles(t.as_py())
                    first = prefix(found, keys, counts, at_least) if len(found) else found
                    if not len(first):
                        continue
                    rows = np.stack([np.zeros(len(first), np.int64), first.view(np.int64), np.full(len(first), node), np.full(len(first), len(found)), np.arange(len(first))], axis=1)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                        large = (keys[at] == first) & (counts[at] >= hot)
                        if large.any():
                            rows[large, 0] = 1
                            at = at[large & (centres[at] != node) & _sizes(centre_n[at], np.full(len(at), len(found)), at_least)]
                            pairs = np.unique(centres[at])
                            out.append(np.stack([np.full(len(pairs), 2), pairs, np.full(len(pairs), node), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)], axis=1))
                    out.append(rows)
                if len(seen) > 1 << 20:
                    seen.clear()
                yield _batch(np.concatenate(out), columns)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            for got in _sorted_groups(batches, 2):
                out = []
                for kind in (1, 2):
                    own = got[got[:, 0] == kind]
                    out.append(_pairs(own[:, 1], own[:, 2]) if kind == 2 else np.stack([own[:, 0], own[:, 2], own[:, 1], own[:, 3]], axis=1))
                rows = got[got[:, 0] == 0][:, 1:]
                if len(rows):
                    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
                    first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
                    sizes = np.diff(np.r_[first, len(rows)])
                    size = np.repeat(sizes, sizes)
                    few = rows[size <= small]
                    for d in range(1, small):
                        x, y = few[:-d], few[d:]
                        same = x[:, 0] == y[:, 0]
                        if not same.any():
                            break
                        x, y = x[same], y[same]
                        ok = _possible(x, y, at_least)
                        out.append(_pairs(x[ok, 1], y[ok, 1]))
                    many = rows[size > small]
                    if len(many):
                        centre = np.repeat(rows[first], sizes, axis=0)[size > small]
                        ok = _possible(many, centre, at_least)
                        out += [_pairs(many[ok, 1], centre[ok, 1]), np.stack([np.ones(len(many), np.int64), many[:, 1], many[:, 0], many[:, 2]], axis=1)]
                yield _batch(np.concatenate(out), ["kind", "a", "b", "n"])

        dealt = self.texts.mapInArrow(entries, ", ".join(f"{c} bigint" for c in columns))
        dealt = dealt.repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("node", "h"))).sortWithinPartitions("kind", "h", "node")
        return keep(dealt.mapInArrow(pairs, "kind bigint, a bigint, b bigint, n bigint").distinct(), "candidates")

    def sketched(self, nodes: DataFrame) -> tuple[DataFrame, str]:
        """node, text, n, fp and bits of the texts that ``nodes`` (node) names, each once."""
        held = self.texts.where(maybe_in(nodes)(F.col("node"))).join(nodes, "node", "left_semi").dropDuplicates(["node"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            for batch in batches:
                found = [shingles(t.as_py()) for t in batch.column(1)]
                own = [pa.array([len(x) for x in found], pa.int64()), pa.array([simhash(x) for x in found], pa.int64()), pa.array([bitmap(x) for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["node", "text", "n", "fp", "bits"])

        return keep(held.mapInArrow(run, "node bigint, text binary, n bigint, fp bigint, bits binary"), "sketches")

    def possible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose fingerprints and bitmaps leave the similarity possible."""
        at_least = self.at_least
        side = lambda node, k: sketches.select(F.col("node").alias(node), F.col("n").alias(f"n{k}"), F.col("fp").alias(f"fp{k}"), F.col("bits").alias(f"bits{k}"))
        near = pairs.join(side("a", 0), "a").join(side("b", 1), "b").where((F.bit_count(F.col("fp0").bitwiseXOR(F.col("fp1"))) <= BUDGET) & (F.least("n0", "n1") >= at_least * F.greatest("n0", "n1") - 1e-9))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (3, 4))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(_apart(x, y) <= _most_apart(batch.column(2).to_numpy(), at_least)))

        return near.select("a", "b", (F.col("n0") + F.col("n1")).alias("n"), "bits0", "bits1").mapInArrow(run, "a bigint, b bigint")

    def verified(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose texts are similar."""
        at_least = self.at_least
        both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            for batch in batches:
                yes = [similar(shingles(x.as_py()), shingles(y.as_py()), at_least) for x, y in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

        return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")

    def across(self, members: DataFrame, label: DataFrame, only_forest: bool) -> tuple[DataFrame, str] | None:
        """Possible pairs of large groups in different components, and where they are kept; None where there is no such group."""
        at_least, chunk = self.at_least, self.chunk
        rows, at = keep(members.join(label, "node", "left").select("h", "node", F.coalesce("label", "node").alias("label"), "n", "fp", "bits"), "members")
        by_label = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
        groups = by_label.groupBy("h").agg(F.max_by("label", "k").alias("most"), F.sum("k").alias("k"), F.max("k").alias("m")).where("k > m")
        parts = lambda c: F.ceil(F.expr(c) / chunk).cast("int")
        groups, at_groups = keep(groups.select("h", "most", parts("k").alias("s"), parts("k - m").alias("q")), "groups", self.width)
        if groups.isEmpty():
            forget(self.spark, at, at_groups)
            return None
        rows = rows.join(groups, "h").withColumn("i", F.expr("int(pmod(xxhash64(node), s))")).withColumn("j", F.expr("int(pmod(xxhash64(node, 1), q))"))
        base = rows.select("h", "i", F.explode(F.expr("sequence(0, q - 1)")).alias("j"), F.lit(0).alias("side"), "node", "label", "n", "fp", "bits")
        probes = rows.where("label <> most").select("h", F.explode(F.expr("sequence(0, s - 1)")).alias("i"), "j", F.lit(1).alias("side"), "node", "label", "n", "fp", "bits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("simhash")
            def chunks() -> Iterator[pa.Table]:
                held: list[pa.RecordBatch] = []
                for batch in batches:
                    while batch.num_rows:
                        k = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
                        if held and tuple(held[-1].column(i)[0].as_py() for i in range(3)) != tuple(k[0].tolist()):
                            yield pa.Table.from_batches(held)
                            held = []
                        end = int(np.argmin((k == k[0]).all(axis=1))) or batch.num_rows
                        held.append(batch.slice(0, end))
                        batch = batch.slice(end)
                if held:
                    yield pa.Table.from_batches(held)

            for part in chunks():
                side = part.column("side").to_numpy()
                if side[0] == side[-1]:
                    continue
                node, label, n, fp = (part.column(c).to_numpy() for c in ("node", "label", "n", "fp"))
                fp = fp.view(np.uint64)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
                own = [np.flatnonzero(side == k) for k in (0, 1)]
                own = [x[np.argsort(fp[x], kind="stable")] for x in own]
                out = [np.zeros((0, 2), np.int64)]
                for x, y in near_pairs(fp[own[0]], fp[own[1]], label[own[0]], label[own[1]]):
                    x, y = own[0][x], own[1][y]
                    ok = _sizes(n[x], n[y], at_least)
                    x, y = x[ok], y[ok]
                    ok = _apart(bits[x], bits[y]) <= _most_apart(n[x] + n[y], at_least)
                    out.append(np.stack([x[ok], y[ok]], axis=1))
                found = np.concatenate(out)
                if only_forest:
                    found = found[forest(label[found[:, 0]], label[found[:, 1]])]
                if len(found):
                    yield _batch(_pairs(node[found[:, 0]], node[found[:, 1]])[:, 1:3], ["a", "b"])

        key = ["h", "i", "j"]
        out = keep(base.unionByName(probes).repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "a bigint, b bigint").distinct(), "across")
        forget(self.spark, at, at_groups)
        return out

    def labels(self) -> DataFrame:
        """node and label of all texts that are alike with others."""
        found, at_found = self.candidates()
        pairs, members = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("h"))
        sketches, at_sketches = self.sketched(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct())
        made = [at_found, at_sketches]

        def kept(df: DataFrame, what: str) -> DataFrame:
            out, at = keep(df, what, self.width)
            made.append(at)
            return out

        tried = kept(self.possible(pairs, sketches), "possible")
        edges = kept(self.verified(tried, sketches), "links")
        label = components(edges)
        members = members.join(sketches.drop("text"), "node")
        for only_forest in (True, False):
            found = self.across(members, label, only_forest)
            if found is None:
                break
            more, at = found
            made.append(at)
            more = more.join(tried, ["a", "b"], "left_anti")
            links = kept(self.verified(more, sketches), "links")
            tried, edges = tried.unionByName(more), edges.unionByName(links)
            label = components(edges)
        forget(self.spark, *made)
        return label


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _most_apart(total: np.ndarray, at_least: float) -> np.ndarray:
    """Shingles that one of two similar texts alone can have."""
    return total * ((1 - at_least) / (1 + at_least)) + 1e-9


def near_copies(docs: DataFrame, at_least: float = SIMILARITY, small: int = SMALL, every: int = EVERY, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """node and label (of the component) of all texts that are alike with others."""
    return _Search(docs, at_least, small, every, hot, chunk).labels()


def keep_one(docs: DataFrame, **more) -> DataFrame:
    """Of each component the document with the least doc_id (null first); of rows that repeat it exactly in doc_id and text, one."""
    label, at_label = keep(near_copies(docs, **more).distinct(), "labels")
    marked = docs.withColumn("_nc_node", _node(text_or_empty())).withColumn("_nc_row", F.xxhash64("doc_id", text_or_empty()))
    rows = marked.select("doc_id", F.col("_nc_node").alias("node"), F.col("_nc_row").alias("row"))
    by_label = rows.join(label, "node", "left").select("doc_id", "row", "node", F.coalesce("label", "node").alias("label"))
    first = by_label.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("x"))
    # documents that are alone stay where they are; only the others are dealt out
    involved = label.select("node").unionByName(rows.groupBy("node").count().where("count > 1").select("node"))
    both = marked.withColumn("_nc_shared", maybe_in(involved)(F.col("_nc_node")))
    stay, _ = keep(first.select(F.col("x.row").alias("_nc_kept")).distinct(), "stay")
    forget(docs.sparkSession, at_label)
    others = both.where("_nc_shared").join(stay, F.col("_nc_row") == F.col("_nc_kept"), "left_semi").dropDuplicates(["_nc_row"])
    return both.where("not _nc_shared").unionByName(others).select(*docs.columns)
