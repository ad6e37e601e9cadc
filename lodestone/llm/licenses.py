"""Licence scan by sentence rules (native).

A text is cut into fragments at line ends and after sentence marks, and everything
but ASCII letters and digits becomes one space.  Fragments that follow each other
are joined, up to the words of the longest known sentence, so a sentence may be
wrapped over any number of lines, with comment marks in front; a join that equals a
known licence sentence, in lower case, is mapped to its identifier (the shortest such
join from a fragment).  The identifiers of a text, in order, are matched against the
rules, each an ordered list of identifiers; up to ``GAP`` other known sentences may
stand between two of them, and any that aren't known.

All of it happens within the row: no shuffle, no row per sentence.

An SPDX expression is a sentence for each identifier that or, and, with join.  A name that
another one says more exactly (``COVERED``) isn't given beside it.

Query ``op3_license_scan``: one row per row of ``documents``: doc_id, sentence_ids
(joined by commas), n_sentences, licenses (names of all rules that match, in the
rules' order, joined by semicolons) and license (the first of them, null if none).
Null and empty texts: no sentences.  Very long texts are scanned whole, within their row.
Of several known joins from a fragment the shortest counts, so there are no ties.
Repeated rows give equal rows; an empty table none.  Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_text, docs_of, let, read_table

GAP = 2

# Sentences of public licences, and which of them in which order make a licence.
SENTENCES = {
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache-short": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-use": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "gpl-grant-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-grant-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl2-short": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd3-short": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-short": ["SPDX-License-Identifier: MPL-2.0"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-short": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0-short": ["SPDX-License-Identifier: CC0-1.0"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-unless": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "lgpl-grant-21": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-grant-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-short": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-short": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "gpl3-later-short": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-later-short": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "bsd-warranty": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "bsd2-short": ["SPDX-License-Identifier: BSD-2-Clause"],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "isc-short": ["SPDX-License-Identifier: ISC"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "boost-grant": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "unlicense-short": ["SPDX-License-Identifier: Unlicense"],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
#: Who is licensed, how, and the licences that are named in a sentence of that form.
SUBJECTS = ("This file", "This project", "This software", "This program", "This code", "This work")
VERBS = ("licensed under", "released under", "distributed under")
NAMED = {
    "mit-short": "the MIT License", "apache-short": "the Apache License, Version 2.0", "gpl3-short": "the GNU General Public License, version 3", "gpl2-short": "the GNU General Public License, version 2",
    "bsd3-short": "the BSD 3-Clause License", "bsd2-short": "the BSD 2-Clause License", "isc-short": "the ISC License", "mpl-short": "the Mozilla Public License 2.0",
}
for _id, _name in NAMED.items():
    SENTENCES[_id] = list(dict.fromkeys([*SENTENCES[_id], *(f"{v.capitalize()} {_name}." for v in VERBS), *(f"{s} is {v} {_name}." for s in SUBJECTS for v in VERBS)]))
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-short"]),
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-copy", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl-grant-3", "gpl-warranty"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0-or-later", ["gpl-grant-2", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-warranty"]),
    ("MPL-2.0", ["mpl-grant"]),
    ("MPL-2.0", ["mpl-copy"]),
    ("MPL-2.0", ["mpl-short"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("LGPL-2.1-or-later", ["lgpl-grant-21", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl-grant-3", "gpl-warranty"]),
    ("LGPL", ["lgpl-short"]),
    ("AGPL-3.0-or-later", ["agpl-grant", "gpl-warranty"]),
    ("AGPL-3.0", ["agpl-short"]),
    ("GPL-3.0-or-later", ["gpl3-later-short"]),
    ("GPL-2.0-or-later", ["gpl2-later-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("ISC", ["isc-short"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("GPL", ["gpl-warranty", "gpl-received"]),
]
#: A name goes where one of these says more.
COVERED = {"BSD-2-Clause": ["BSD-3-Clause"], "GPL": sorted({name for name, _ in RULES if "GPL-" in name})}

#: The fragment before an expression of identifiers, and what joins these.
SPDX, JOINED, LATER = "spdx license identifier", " (?:or|and|with) ", " or later"
#: What ends a fragment; both engines' patterns mean the same by it.
BREAK, REST = "[.!?;:]+([ \\t\\r\\n]|\\z)|\\n", "[^A-Za-z0-9\\x01]+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


NUMBERED = {name: k + 1 for k, name in enumerate(SENTENCES)}
KNOWN = {normalised(s): NUMBERED[name] for name, texts in SENTENCES.items() for s in texts}
STARTS = sorted({" ".join(s.split(" ")[:2]) for s in KNOWN})
#: A fragment has a word at least, so no longer join can be a known sentence.
MOST_WORDS, MOST_CHARS = max(len(s.split(" ")) for s in KNOWN), max(map(len, KNOWN))
#: Each rule as a pattern on the identifiers between commas.
RUNS = [(name, "," + f",([0-9]+,){{0,{GAP}}}".join(str(NUMBERED[s]) for s in run) + ",") for name, run in RULES]


def spread(parts: Column) -> Column:
    """Fragments with each identifier of an expression after a fragment of its own."""
    kept = lambda x: F.replace(x, F.lit("+"), F.lit(LATER))
    each = lambda p: F.flatten(F.transform(F.split(p, JOINED), lambda x, k: F.when(k == 0, F.array(kept(x))).otherwise(F.array(F.lit(SPDX), kept(x)))))

    def one(p: Column, i: Column) -> Column:
        whole = F.replace(p, F.lit(LATER), F.lit("+"))
        return F.when((i > 0) & (F.get(parts, i - 1) == SPDX) & whole.rlike(JOINED), each(whole)).otherwise(F.array(p))

    return F.when(F.array_contains(parts, SPDX), F.flatten(F.transform(parts, one))).otherwise(parts)


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences in a text, in order (array<int>)."""
    marked = F.regexp_replace(F.regexp_replace(text, BREAK, "\u0001"), REST, " ")
    fragments = F.filter(F.transform(F.split(F.lower(marked), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")

    def found(parts: Column) -> Column:
        places = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
        two = lambda i: F.substring_index(F.concat_ws(" ", F.slice(parts, i, 2)), " ", 2)
        likely = F.filter(places, lambda i: two(i).isin(STARTS))
        heads = F.transform(likely, lambda i: F.left(F.array_join(F.slice(parts, i, MOST_WORDS), "\u0001"), F.lit(MOST_CHARS + 1)))
        both = F.transform(heads, lambda h: F.struct(h.alias("cut"), F.translate(h, "\u0001", " ").alias("flat")))
        whole = lambda h, s: h["flat"].startswith(s) & F.substring(h["cut"], len(s) + 1, 1).isin("", "\u0001")
        return F.array_compact(F.transform(both, lambda h: F.coalesce(*(F.when(whole(h, s), F.lit(k)) for s, k in sorted(KNOWN.items(), key=lambda x: len(x[0]))))))

    return let(let(fragments, spread), found)


def matched(ids: Column) -> Column:
    """The names of the rules that a text's identifiers match."""
    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))
    named = F.array_distinct(F.array_compact(F.array(*(F.when(line.rlike(run), F.lit(name)) for name, run in RUNS))))

    def said(names: Column) -> Column:
        covered = lambda n: reduce(or_, ((n == name) & F.arrays_overlap(names, F.array(*map(F.lit, by))) for name, by in COVERED.items()))
        return F.filter(names, lambda n: ~covered(n))

    return let(named, said)


def scan(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", sentence_ids(blank_text(F.col("text"))).alias("ids"))
    names = found.select("doc_id", "ids", matched(F.col("ids")).alias("names"))
    return names.select(
        "doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("names", ";").alias("licenses"), F.get("names", F.lit(0)).alias("license"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(docs_of(read_table(spark, sf_dir, "documents"), "doc_id", "text"))


def _quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


SQL = rf"""
WITH known(s, id) AS (VALUES {", ".join(f"('{s}', {k})" for s, k in KNOWN.items())}),
rules(k, name, run) AS (VALUES {", ".join(f"({k}, '{name}', '{run}')" for k, (name, run) in enumerate(RUNS))}),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;:]+([ \t\r\n]|\z)|\n', chr(1), 'g'), '[^A-Za-z0-9\x01]+', ' ', 'g')), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
f AS (SELECT doc_id, CASE WHEN list_contains(parts, '{SPDX}') THEN flatten(list_transform(parts, lambda p, g: CASE WHEN g > 1 AND parts[g - 1] = '{SPDX}' AND regexp_matches(replace(p, '{LATER}', '+'), '{JOINED}')
  THEN flatten(list_transform(string_split_regex(replace(p, '{LATER}', '+'), '{JOINED}'), lambda x, h: CASE WHEN h = 1 THEN [replace(x, '+', '{LATER}')] ELSE ['{SPDX}', replace(x, '+', '{LATER}')] END)) ELSE [p] END)) ELSE parts END AS parts FROM cut),
starts AS (SELECT doc_id, i, parts FROM f, range(1, CAST(len(parts) + 1 AS BIGINT)) AS t(i) WHERE array_to_string(list_slice(string_split(array_to_string(list_slice(parts, i, i + 1), ' '), ' '), 1, 2), ' ') IN ({_quoted(STARTS)})),
joins AS (SELECT doc_id, i, n, array_to_string(list_slice(parts, i, i + n - 1), ' ') AS s FROM starts, range(1, {MOST_WORDS + 1}) AS t(n) WHERE i + n - 1 <= len(parts)),
hits AS (SELECT doc_id, i, arg_min(id, n) AS id FROM joins JOIN known USING (s) GROUP BY 1, 2),
seqs AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids, count(*) AS n FROM hits GROUP BY 1),
covers(name, other) AS (VALUES {", ".join(f"('{n}', '{x}')" for n, by in COVERED.items() for x in by)}),
named AS (SELECT doc_id, name, min(k) AS k FROM seqs, rules WHERE regexp_matches(',' || ids || ',', run) GROUP BY 1, 2),
names AS (SELECT doc_id, string_agg(name, ';' ORDER BY k) AS licenses, arg_min(name, k) AS license FROM named n WHERE NOT EXISTS (SELECT 1 FROM covers c JOIN named o ON o.name = c.other WHERE c.name = n.name AND o.doc_id = n.doc_id) GROUP BY 1)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(licenses, '') AS licenses, license
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN names USING (doc_id)
"""
