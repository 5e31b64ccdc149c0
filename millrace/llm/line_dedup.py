"""Line deduplication by winnowing.

A line is what a line end parts, or the end of a sentence (``.``, ``!`` or ``?`` and a blank, after
``SENTENCE`` other characters), so that a passage inside a long line is found too. Lines are compared without white space of ASCII at their ends; lines
without words count for nothing. A run is consecutive lines of at least ``MIN_WORDS`` words together. A line goes if
it lies in a run that has occurred before: in the order of doc_id, then of lines. What overlaps its own
first occurrence stays.

Each smallest run from a line on is a window, whose minimum (the longest line, then the least hash) is
selected: its hash is a fingerprint, and two places that share a run share one. Only selected lines are
kept, each with the keys of the windows it stands for, and fingerprints that occur at one place alone go. From the
places that are left matches are extended both ways: the windows around a place, from each line on and up to
each line, are looked up by the hash of all their lines, and their union is the whole of each repeated
run. A key's first occurrence is an aggregate, and later ones are joined to it alone, so no pairs within a
group are made; both joins read exchanges that AQE can split where a key is common.

Edge cases: null and empty texts have no lines to lose and stay as they are; a text that loses all its
lines is empty; rows that repeat a doc_id and text are one document, and each gets its result; null
doc_ids come first; an empty table gives an empty one; a text of any length is taken whole, and nothing
but a line's own windows is repeated per line. Further columns pass through untouched; names that start with
``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import forget, keep, table, text_or_empty

MIN_WORDS = 50
BLANKS = " \t\r\n\x0b\x0c"
#: Sentences shorter than this belong to the next line, which keeps lines few.
SENTENCE = 24
ENDS = rf"(?<=\n)|(?<=[.!?][ \t])(?<=[^.!?\n]{{{SENTENCE}}}[.!?][ \t])"


def lines_of(text: Column) -> Column:
    """The text in pieces, which put together are the text."""
    return F.split(text, ENDS, -1)


def places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, doc_id, fp and windows (first and last line, and key) of each selected line."""
    lines = F.transform(lines_of(text_or_empty()), lambda s, i: F.struct(i.alias("at"), F.xxhash64(F.btrim(s, F.lit(BLANKS))).alias("h"), F.regexp_count(s, F.lit(r"[^ \t\r\n\x0B\f]+")).alias("n")))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.filter(lines, lambda x: x.n > 0).alias("lines"))
    # of the longest line, cut off at 255 words, then the hash's lower bits
    order = F.transform("lines", lambda x: F.shiftleft((255 - F.least(x.n, F.lit(255))).cast("bigint"), 55).bitwiseOR(x.h.bitwiseAND((1 << 55) - 1)))
    # by transform: Catalyst would put a plain field of the array into the lambdas below, and take it from all lines for each
    part = lambda name: F.transform("lines", lambda x: x[name]).alias(name)
    rows = rows.select("row", "doc_id", part("at"), part("h"), part("n"), order.alias("ord"), F.size("lines").alias("k"))
    # for each line the end, exclusive, of the smallest run from it on; null where too few words follow. Lines are
    # looked at eight at first, as that is seldom too few: words count below 1 << 16, lines above
    grow = f"(x, y) -> if((x & 65535) >= {min_words}, x, x + least(y, {min_words}) + 65536)"
    reach = f"aggregate(slice(n, i + 1, {{}}), 0, {grow}, x -> if((x & 65535) >= {min_words}, i + shiftright(x, 16), null))"
    first = reach.format(min(8, min_words))
    rows = rows.withColumn("ends", F.expr(f"transform(n, (_, i) -> coalesce({first}, {reach.format(min_words)}))" if min_words > 8 else f"transform(n, (_, i) -> {first})"))
    # where the window's minimum is, the first of equal ones: it never goes back, so windows with one place are neighbours
    rows = rows.withColumn("p", F.expr("transform(ends, (e, a) -> if(e is null, null, a + int(transform(array(slice(ord, a + 1, e - a)), w -> array_position(w, array_min(w)))[0]) - 1))"))
    # a run up to a line ends before the next line's smallest run does
    around = "transform(sequence(get(ends, a), greatest(get(ends, a), coalesce(get(ends, a + 1) - 1, k))), b -> named_struct('first', get(at, a), 'last', get(at, b - 1), 'key', xxhash64(slice(h, a + 1, b - a))))"
    windows = f"flatten(transform(filter(sequence(s, get(p, s)), a -> get(p, a) = get(p, s)), a -> {around}))"
    selected = "filter(transform(p, (x, s) -> if(x is null or s > 0 and x <=> get(p, s - 1), null, s)), s -> s is not null)"
    found = F.expr(f"transform({selected}, s -> named_struct('fp', get(ord, get(p, s)), 'windows', {windows}))")
    # outer: otherwise Catalyst derives filters that work out the arrays once more
    return rows.select("row", "doc_id", found.alias("found")).select("row", "doc_id", F.explode_outer("found").alias("x")).where("x is not null").select("row", "doc_id", "x.fp", "x.windows")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, doc_id and ranges (array of first and last line) to delete, for each document with any."""
    spark = docs.sparkSession
    every, at_every = keep(places(docs, min_words), "places")
    width = spark.sparkContext.defaultParallelism
    shared, at_shared = keep(every.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fp"), "shared", width)
    matches, at_matches = keep(every.join(shared, "fp", "left_semi").select("row", "doc_id", "fp", F.inline("windows")), "matches")
    forget(spark, at_every, at_shared)
    here = F.struct("doc_id", "row", "first", "last")
    first = matches.groupBy("fp", "key").agg(F.min(here).alias("original"), F.max(here).alias("latest")).where(~F.col("original").eqNullSafe(F.col("latest"))).select("fp", "key", "original")
    original, at_original = keep(first, "originals", width)
    later = matches.join(original, ["fp", "key"]).where(~here.eqNullSafe(F.col("original")))
    same = (F.col("row") == F.col("original.row")) & F.col("doc_id").eqNullSafe(F.col("original.doc_id"))
    start = F.when(same, F.greatest("first", F.col("original.last") + 1)).otherwise(F.col("first"))
    ranges = later.select("row", "doc_id", start.alias("first"), "last").where("first <= last")
    out, _ = keep(ranges.groupBy("row", "doc_id").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges", width)
    forget(spark, at_matches, at_original)
    return out


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the shortened ``text``, and _ld_deleted, the number of lines that it lost."""
    found = repeats(docs, min_words).select(F.col("row").alias("_ld_row"), F.col("doc_id").alias("_ld_id"), F.col("ranges").alias("_ld_ranges"))
    marked = docs.withColumn("_ld_key", F.xxhash64("doc_id", "text"))
    both = marked.join(found, (F.col("_ld_key") == F.col("_ld_row")) & F.col("doc_id").eqNullSafe(F.col("_ld_id")), "left")
    untouched = F.col("_ld_ranges").isNull()
    both = both.withColumn("_ld_lines", F.when(~untouched, lines_of(F.col("text"))))
    gone = F.array_distinct(F.flatten(F.transform("_ld_ranges", lambda r: F.sequence(r.first, r.last))))
    both = both.withColumn("_ld_stay", F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), gone))
    text = F.when(untouched, F.col("text")).otherwise(F.array_join(F.transform("_ld_stay", lambda i: F.get("_ld_lines", i)), ""))
    lost = F.when(untouched, 0).otherwise(F.size("_ld_lines") - F.size("_ld_stay")).cast("bigint")
    return both.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), lost.alias("_ld_deleted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = drop_repeated_lines(docs)
    return done.select("doc_id", F.col("_ld_deleted").alias("lines_deleted"), F.length(text_or_empty()).cast("bigint").alias("chars_left"), F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))
