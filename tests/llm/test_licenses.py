import random
import re
from collections import Counter

import duckdb
import pytest

from millrace.llm.licenses import TEMPLATES, op8_license_scan, scan, sql

MIT = TEMPLATES[3][1]


def test_against_sql(spark, tmp_path):
    texts = [
        None, "", "word", "Released under the MIT License.", "text\nRELEASED, under the mit license", "This is released under the MIT License today", MIT, MIT.replace(". ", ".\n").replace(", ", ",\n"),
        "intro\n\n" + MIT.replace("copy", "copies").replace(": ", ":\n") + "\n\noutro", "Licensed under CC BY-NC 4.0.\nAll rights reserved.\nAll rights reserved.", "the the the the", "Licensed under the Apache License, Version 3.0.", "x " * 5000 + "all rights reserved", "Copyright 2024 Acme. All rights reserved.", "A small parser. Licensed under the Apache License, Version 2.0. See NOTICE.", "/*\n * own words of it\n * " + TEMPLATES[10][1].replace(", ", ",\n * ") + "\n * and more\n */",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as license", "1 as n", "'y' as words", "2 as template")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.license, r.dice, r.template) for r in op8_license_scan(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in c.execute(sql()).fetchall())
    assert {(12, "Proprietary"), (13, "Proprietary"), (14, "Apache-2.0"), (15, "GPL-3.0"), (3, "MIT"), (6, "MIT"), (7, "MIT"), (8, "MIT"), (9, "CC-BY-NC-4.0"), (9, "Proprietary"), (-1, "MIT")} <= {x[:2] for x in got}
    assert not any(x[0] in (0, 1, 2, 10) for x in got)


def test_empty_and_own_templates(spark):
    frame = spark.createDataFrame([(1, "one two three four"), (2, "none of it")], "doc_id bigint, text string")
    assert scan(frame.limit(0)).count() == 0 and scan(frame, []).count() == 0
    assert [(r.doc_id, r.dice) for r in scan(frame, [("own", "one two three"), ("short", "one")], 0.5).collect()] == [(1, 1.0)]


def brute(text, template, at_least):
    """The best Dice of any passage."""
    pairs = lambda t: (lambda w: list(zip(w, w[1:])))(re.findall(r"[^\W_]+", (t or "").lower()))
    a, b = pairs(text), pairs(template)
    best = 0.0
    for i in range(len(a)):
        for j in range(i + 1, min(len(a), i + 3 * len(b) + 2) + 1):
            both = sum((Counter(a[i:j]) & Counter(b)).values())
            best = max(best, 2.0 * both / (j - i + len(b)))
    return best if best >= at_least else 0.0


@pytest.mark.parametrize("seed, at_least", [(1, 0.8), (2, 0.5), (3, 0.9)])
def test_against_all_passages(spark, seed, at_least):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef")
    templates = [(f"l{i % 3}", " ".join(word() for _ in range(rng.randint(2, 12)))) for i in range(6)]
    docs = []
    for d in range(40):
        text = [word() for _ in range(rng.randint(0, 25))]
        part = rng.choice(templates)[1].split()
        part[rng.randrange(len(part)) :][:1] = [word()]
        text[3:3] = part
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.license): round(r.dice, 9) for r in scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates, at_least).collect()}
    want = {}
    for d, text in docs:
        for name, template in templates:
            if x := brute(text, template, at_least):
                want[d, name] = max(round(x, 9), want.get((d, name), 0))
    assert got == want and len(want) > 20
