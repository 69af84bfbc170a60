"""Operator 8: licence scans by canonical digest lookup.

A text is put in canonical form: lower case, copyright lines removed, equivalent spellings made one, everything but
letters and digits read as one space. Its SHA-256 is hash-joined to the digests of known licences. Whole texts are
looked up, and so is every line and every paragraph (lines between such without letters or digits), since a notice is often a line of its
own in a longer text. Only Spark SQL functions are used.

Null texts, and texts of copyright lines only, have no canonical form and match nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.staging import tables

#: Above this the table of licences is joined without a broadcast.
BROADCAST_LICENSES = 100_000

# SPDX identifiers with the public wording of the licence or of its notice.
LICENSES: list[tuple[str, str]] = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]

# Whole texts of short licences below their copyright lines, paragraph by paragraph. Longer ones are in license_texts/.
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = next(t for i, t in LICENSES if i == "MIT" and t.startswith("Permission"))
_ISC = next(t for i, t in LICENSES if i == "0BSD")
_GRANT, _WARRANTY = _ISC.split(" THE SOFTWARE IS", 1)
SHORT: list[tuple[str, list[str], list[str]]] = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], re.split(r" (?=The above copyright|THE SOFTWARE IS)", _MIT, maxsplit=2)),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"], [_GRANT, "THE SOFTWARE IS" + _WARRANTY]),
    ("ISC", ["ISC License", "The ISC License"], [_GRANT.replace("granted.", "granted, provided that the above copyright notice and this permission notice appear in all copies."), "THE SOFTWARE IS" + _WARRANTY]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License"], [_REDISTRIBUTION, "1. " + _SOURCE, "2. " + _BINARY, _DISCLAIMER]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License"], [_REDISTRIBUTION, "1. " + _SOURCE, "2. " + _BINARY, "3. " + _NAMES, _DISCLAIMER]),
]
#: Letters and digits of a paragraph that stands for its licence, at least.
PART = 60


def whole_texts() -> list[tuple[str, str]]:
    """SHORT and license_texts/ with and without title (and, where there is one, without the trailer), and the paragraphs that one licence alone has."""
    rows: list[tuple[str, str]] = []
    parts: dict[str, set[str]] = defaultdict(set)
    texts: dict[str, str] = {}

    def add_parts(license_id: str, paragraphs: list[str]) -> None:
        for x in paragraphs:
            plain = " ".join(re.findall(r"[a-z0-9]+", x.lower()))
            if len(plain) >= PART:
                parts[plain].add(license_id)
                texts[plain] = x

    for license_id, titles, paragraphs in SHORT:
        for title in ["", *titles]:  # conditions may go without numbers, and the mark of rights reserved on a line of its own before them
            for rights in ("", "All rights reserved."):
                for body in (paragraphs, [re.sub(r"^\d\. ", "", x) for x in paragraphs]):
                    rows.append((license_id, "\n\n".join(x for x in (title, rights, *body) if x)))
        add_parts(license_id, paragraphs)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text()
        bodies = {text, re.split(r"\n\s*(?:END OF TERMS AND CONDITIONS|APPENDIX: How to apply)", text)[0], re.split(r"(?<=END OF TERMS AND CONDITIONS)", text)[0]}
        for body in sorted(bodies):
            paragraphs = re.split(r"\n(?:\s*\n)+", body.strip("\n"))
            rows += [(path.stem, "\n\n".join(paragraphs[k:])) for k in (0, 1)]  # the first paragraph is the title
        add_parts(path.stem, re.split(r"\n(?:\s*\n)+", text))
    return rows + [(min(ids), texts[x]) for x, ids in parts.items() if len(ids) == 1]


# Spellings that licence comparison treats as equal.
SPELLINGS: list[tuple[str, str]] = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("v", "version"), ("ver", "version"), ("whilst", "while"), ("wilful", "willful"),
]

LICENSES += whole_texts()

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright\b|\(c\)\s|©)[^\n]*$"


def marked(text: Column) -> Column:
    """The text in canonical words, each between two spaces of its own, its line feeds kept as words; one pass for all of its parts."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}\n]+", "  ")
    words = F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    return words


def canonical(words: Column) -> Column:
    """The canonical form of a part of marked()."""
    return F.trim(F.regexp_replace(words, "[ \n]+", " "))


def known_digests(licenses: DataFrame) -> DataFrame:
    """license_id and digest of a table (license_id, text)."""
    return licenses.select("license_id", F.sha2(canonical(marked(F.col("text"))), 256).alias("digest")).distinct()


def scanned(docs: DataFrame, licenses: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, license_id, unit ('text', 'paragraph' or 'line', the largest that matched) and n_matches per licence found in a row."""
    spark = docs.sparkSession
    if licenses is None:
        licenses = spark.createDataFrame(LICENSES, "license_id string, text string")
        known = F.broadcast(known_digests(licenses))
    else:
        known = known_digests(licenses)
        known = F.broadcast(known) if licenses.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES else known
    rows = docs.where(F.col("text").isNotNull()).select(F.col(key).alias("key"), marked(F.col("text")).alias("m"), F.monotonically_increasing_id().alias("row"))
    part = lambda size, parts: F.transform(parts, lambda x: F.struct(F.lit(size).alias("size"), x.alias("part")))
    none = F.array().cast("array<string>")
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(none)
    parts = F.concat(part(3, F.array("m")), part(2, several(F.split("m", r"\n(?: *\n)+"))), part(1, several(F.split("m", r"\n"))))
    units = rows.select("row", "key", F.explode(parts).alias("u")).select("row", "key", "u.size", canonical(F.col("u.part")).alias("form")).where("form <> ''")
    found = units.join(known, F.sha2("form", 256) == F.col("digest")).groupBy("row", "key", "license_id").agg(F.max("size").alias("size"), F.count("*").alias("n_matches"))
    unit = F.when(F.col("size") == 3, "text").when(F.col("size") == 2, "paragraph").otherwise("line")
    return found.select(F.col("key").alias(key), "license_id", unit.alias("unit"), "n_matches")


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document that has any; null and repeated ids give rows of their own."""
    return scanned(tables(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = r"' ' || replace(regexp_replace(regexp_replace(lower(text), '^[^\p{L}\p{N}\n]*(copyright\b|\(c\)\s|©)[^\n]*$', '', 'gm'), '[^\p{L}\p{N}\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    canon = "trim(regexp_replace({0}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""
        WITH known AS (SELECT DISTINCT license_id, sha256({canon.format(form)}) AS digest FROM (VALUES {values}) t(license_id, text)),
        marked AS (SELECT doc_id, {form} AS m FROM documents WHERE text IS NOT NULL),
        parts AS (
            SELECT doc_id, 3 AS size, m AS part FROM marked
            UNION ALL SELECT doc_id, 2, unnest(p) FROM (SELECT doc_id, regexp_split_to_array(m, '\\n(?: *\\n)+') AS p FROM marked) WHERE len(p) > 1
            UNION ALL SELECT doc_id, 1, unnest(p) FROM (SELECT doc_id, string_split(m, chr(10)) AS p FROM marked) WHERE len(p) > 1
        ),
        forms AS (SELECT doc_id, size, {canon.format("part")} AS form FROM parts)
        SELECT doc_id, license_id, CASE max(size) WHEN 3 THEN 'text' WHEN 2 THEN 'paragraph' ELSE 'line' END AS unit, count(*) AS n_matches
        FROM forms JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id, license_id"""


QUERIES = {"op8_license_digests": op8_license_digests}
ORACLE_SQL = {"op8_license_digests": _sql()}
