import random
import re

import pytest

from millrace.llm.line_dedup import drop_repeated_lines, op6_line_dedup


def runs(counts, least):
    """Every smallest run from a line on or up to a line."""
    n, out = len(counts), set()
    for a in range(n):
        for b in range(a, n):
            if sum(counts[a : b + 1]) >= least:
                if sum(counts[a:b]) < least or sum(counts[a + 1 : b + 1]) < least:
                    out.add((a, b))
    return out


BLANK = " \t\r\n\x0b\x0c"


def cut(text):
    """Pieces that end at a line end, or after a sentence of 24 characters, its full stop, exclamation or question mark and a blank."""
    out, start = [], 0
    for i in range(1, len(text) + 1):
        if text[i - 1] == "\n" or i > 25 and text[i - 1] in " \t" and text[i - 2] in ".!?" and not set(text[i - 26 : i - 2]) & set(".!?\n"):
            out.append(text[start:i])
            start = i
    return [*out, text[start:]]


def brute(docs, least):
    """Any run of so many words that has occurred before goes, but for what overlaps its own first occurrence."""
    seen, gone = {}, {}
    every = []
    for d, text in sorted(docs):
        lines = [(i, x.strip(BLANK)) for i, x in enumerate(cut(text))]
        lines = [(i, x) for i, x in lines if x]
        counts = [len(re.findall(r"[^ \t\r\n\x0b\x0c]+", x)) for _, x in lines]
        for a, b in runs(counts, least):
            every.append((d, lines[a][0], lines[b][0], tuple(x for _, x in lines[a : b + 1])))
    for d, first, last, content in sorted(every, key=lambda x: x[:3]):
        if content not in seen:
            seen[content] = (d, last)
        else:
            o, end = seen[content]
            start = max(first, end + 1) if o == d else first
            gone.setdefault(d, set()).update(range(start, last + 1))
    return {d: "".join(x for i, x in enumerate(cut(text)) if i not in gone.get(d, ())) for d, text in docs}


def corpus(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 6, 12]))) for _ in range(25)]
    pool += ["a b. c d! e", "f g?\th", "of so many characters it is a sentence. d e", "of so many characters this is one! d", "\t\t", "\r", "a\tb\r", "\u00a0 e\u00a0f"]
    passage = [" ".join(f"p{rng.randint(0, 99)}" for _ in range(k)) for k in (2, 5, 1, 9, 3)]
    passage[3] = passage[3].replace(" p", " long_enough_for_a_sentence. p", 2)
    docs = []
    for d in range(n):
        lines = [rng.choice(pool + ["", "  "]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[rng.randint(0, 1) :]
        docs.append((d, rng.choice(["\n", "\r\n", "\n\t", ". "]).join(lines)))
    return docs + [(n, docs[3][1]), (n + 1, "q\n" * 40), (n + 2, "x y z\n" * 9), (n + 3, "\t\n" * 30), (n + 4, "\t\n" * 30)]


@pytest.mark.parametrize("seed, least", [(1, 10), (2, 15), (3, 4), (4, 1)])
def test_against_brute_force(spark, seed, least):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as row", "'x' as ranges", "2 as first")
    got = {r.doc_id: r.text for r in drop_repeated_lines(frame.repartition(3), least).collect()}
    assert got == brute(docs, least)


def test_passage_goes_after_its_first_occurrence(spark):
    passage = "\n".join(" ".join(f"w{i}{k}" for k in range(10)) for i in range(6))
    docs = [(i, f"own line {i}\n{passage}\nthe end of {i}") for i in range(50)] + [(99, "short\nlines\nshort\nlines")]
    got = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0].text == docs[0][1] and got[99].text == docs[-1][1]
    assert all(got[i].text == f"own line {i}\nthe end of {i}" and got[i]._ld_deleted == 6 for i in range(1, 50))


def test_nulls_repeats_empty(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, None), (2, None), (3, ""), (4, f"{long}\n\nrest")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.text or "", r._ld_deleted) for r in drop_repeated_lines(frame).collect())
    assert got == sorted([(0, long, 0), (1, "", 1), (1, "", 1), (2, "", 0), (2, "", 0), (3, "", 0), (4, "\nrest", 1)])
    assert drop_repeated_lines(frame.limit(0)).count() == 0
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_line_dedup(spark, str(tmp_path)).count() == len(rows)


def test_wordless_lines_and_line_ends(spark):
    passage = [" ".join(f"w{i}{k}" for k in range(15)) for i in range(4)]
    docs = [(1, "\t\n" * 30), (2, "\t\n" * 30), (3, "\n".join(passage)), (4, "start\r\n" + "\t\r\n".join(passage) + "\r\nend"), (5, "Inside a line that is long enough. " + ". ".join(passage) + ". And more of it.")]
    docs += [(6, ". ".join(passage) + ". Last.")]
    got = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got[i].text == docs[i - 1][1] and not got[i]._ld_deleted for i in (1, 2, 3, 5))
    assert got[4].text == "start\r\nend" and got[6].text == "Last."


def test_a_very_long_text(spark):
    rng = random.Random(5)
    lines = [" ".join(f"v{rng.randint(0, 999)}" for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    passage = lines[7_000:7_040]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["own", *passage, "too"])), (3, "\n".join(lines[:10_000] + ["between"] + lines[10_000:]))]
    got = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "own\ntoo" and got[3].text == "between\n"
