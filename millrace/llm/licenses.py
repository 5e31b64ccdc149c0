"""License scans: Dice coefficient over word bigrams.

Texts are lower-cased and cut into words. A passage, wherever in the text it begins and ends, matches a template
if twice the number of bigrams that both have, counted with repeats, over the number of both together is at
least ``AT_LEAST`` (t). A passage of n bigrams can only match templates of n t / (2 - t) to n (2 - t) / t bigrams, and has to
share t / (2 - t) of a template's. The bigrams of all templates are broadcast and joined to the texts' own; of the places where they
meet, those go around which too few others lie within the size bound, and a text without any left is compared with that template no
further. Passages that begin and end with a shared bigram are enough, as what lies outside only adds to n; from each beginning
they are counted exactly, one bigram after the other: a bigram counts unless as many as the template has lie between the beginning
and it.

Edge cases: null and empty texts, and texts of fewer than two words, match nothing; of each document and license the best
passage is reported, and rows that share a doc_id are one document; ties go to the first template; an empty table
gives an empty result; only doc_id and text are read, so other columns can have any name; a long text costs in proportion to the
places that it shares with templates.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, text_or_empty

AT_LEAST = 0.8
# The licences' own notices and texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0."),
)
#: The templates' bigrams are broadcast; there are no more than these, of 30 bytes each.
MOST_BIGRAMS = 1 << 20


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_rows(templates=TEMPLATES) -> list[tuple[str, int, list[tuple[str, str]]]]:
    """License, number and bigrams of each template with any."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = re.findall(r"[^\W_]+", text.lower())
        if len(words) > 1:
            out.append((name, i, list(zip(words, words[1:]))))
    if sum(len(b) for _, _, b in out) > MOST_BIGRAMS:
        raise ValueError("too many templates, or too long ones, to broadcast")
    return out


def scan(docs: DataFrame, templates=TEMPLATES, at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, license, dice and template (its number), of the best match for each document and license."""
    spark = docs.sparkSession
    own = template_rows(templates)
    # c: how often the template has the bigram, m: how many it has in all, need: fewest that a match shares, most: length of the longest
    contents = [(x, y, i, n, len(b), math.ceil(len(b) * at_least / (2 - at_least) - 1e-9), math.floor(len(b) * (2 - at_least) / at_least + 1e-9)) for _, i, b in own for (x, y), n in Counter(b).items()]
    known = spark.createDataFrame(contents, "x string, y string, template int, c int, m int, need int, most int").select(F.xxhash64("x", "y").alias("bigram"), "template", "c", "m", "need", "most")
    names = spark.createDataFrame([(i, name) for name, i, _ in own], "template int, license string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _words(text_or_empty()).alias("w"))
    rows = rows.select("doc_id", "row", F.expr("if(size(w) < 2, array(), transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1])))").alias("b"))
    # outer explode and keys never null: otherwise Catalyst derives filters that cut the words once more
    hits = rows.select("doc_id", "row", F.posexplode_outer("b").alias("pos", "bigram")).join(F.broadcast(known), "bigram")
    by = hits.groupBy("doc_id", "row", "template", "m", "need", "most").agg(F.sort_array(F.collect_set(F.struct("pos", "bigram", "c"))).alias("h"))
    by = by.where(F.size("h") >= F.col("need")).withColumn("pos", F.transform("h", lambda x: x.pos))
    begins = "filter(transform(pos, (p, i) -> if(get(pos, i + need - 1) - p < most, i, null)), i -> i is not null)"
    by = by.withColumn("begins", F.expr(begins)).where(F.size("begins") > 0)
    # where the bigram stands that a passage must not reach back to for this one to count; at most ``most`` places lie so near
    earlier = "filter(slice(h, greatest(0, j - most) + 1, least(j, most)), y -> y.bigram = x.bigram)"
    by = by.withColumn("q", F.expr(f"transform(h, (x, j) -> transform(array({earlier}), e -> coalesce(get(e, size(e) - x.c).pos, -1))[0])"))
    grow = "(acc, j) -> transform(array(acc.n + int(get(q, j) < get(pos, i))), n -> named_struct('n', n, 'best', greatest(acc.best, 2.0D * n / (get(pos, j) - get(pos, i) + 1 + m))))[0]"
    ends = "filter(sequence(i, least(i + most, size(pos)) - 1), j -> get(pos, j) - get(pos, i) < most)"
    dice = f"array_max(transform(begins, i -> aggregate({ends}, named_struct('n', 0, 'best', 0.0D), {grow}, acc -> acc.best)))"
    found = by.select("doc_id", "template", F.expr(dice).alias("dice")).where(F.col("dice") >= at_least - 1e-12).join(F.broadcast(names), "template")
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("dice", (-F.col("template")).alias("back"))).alias("x"))
    return best.select("doc_id", "license", F.col("x.dice").alias("dice"), (-F.col("x.back")).alias("template"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql(templates=TEMPLATES, at_least: float = AT_LEAST) -> str:
    """The same for DuckDB: all passages between two shared bigrams, counted anew."""
    values = ", ".join(f"('{name}', {i}, '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    cut_words = r"list_filter(string_split_regex(lower({}), '[^\pL\pN]+'), lambda w: w <> '')"
    return f"""
WITH t0(license, template, text) AS (VALUES {values}),
t AS (SELECT license, template, {cut_words.format('text')} AS w FROM t0),
tb AS (SELECT license, template, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM t),
tc AS (SELECT license, template, bigram, count(*) AS k FROM tb GROUP BY ALL),
tn AS (SELECT template, sum(k) AS m FROM tc GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {cut_words.format("coalesce(text, '')")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT r, doc_id, unnest(range(1, len(w))) AS pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM d WHERE len(w) > 1),
h AS (SELECT r, doc_id, template, license, m, pos, bigram, k, row_number() OVER (PARTITION BY r, template ORDER BY pos) AS i
  FROM b JOIN tc USING (bigram) JOIN tn USING (template)),
p AS (SELECT x.r, x.template, x.pos AS first, y.pos AS last FROM h x JOIN h y ON x.r = y.r AND x.template = y.template
  AND y.i >= x.i AND y.pos - x.pos + 1 <= x.m * {2 - at_least} / {at_least} + 1e-9 AND 2 * (y.i - x.i + 1) >= {at_least} * (y.pos - x.pos + 1 + x.m) - 1e-9),
c AS (SELECT p.r, p.template, first, last, doc_id, license, m, bigram, least(count(*), any_value(k)) AS k
  FROM p JOIN h ON h.r = p.r AND h.template = p.template AND h.pos BETWEEN first AND last GROUP BY ALL),
s AS (SELECT doc_id, license, template, 2.0::DOUBLE * sum(k) / (last - first + 1 + m) AS dice FROM c GROUP BY r, doc_id, license, template, first, last, m),
o AS (SELECT doc_id, license, template::INTEGER AS template, dice, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, template) AS i FROM s WHERE dice >= {at_least} - 1e-12)
SELECT doc_id, license, dice, template FROM o WHERE i = 1
"""
