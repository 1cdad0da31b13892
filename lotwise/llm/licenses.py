"""Operator 10: licence scan by canonical digests (native DataFrame code).

A unit of text is canonicalised (letter case, equivalent spellings, typographic signs, punctuation
and white space), copyright lines are left out, and its SHA-256 is hash-joined with the digests of
known licences. Units are the entire document (a full licence text, or a notice alone) and each
entire line (a notice inside a document). Nothing is matched in part: a unit is a known licence word
by word, or it is none.

The table of known licences is the caller's, or ``all_known`` below; either way it is read as a table of
digests and Spark broadcasts it only when its measured size allows.

Null texts match nothing (counts 0). Texts or lines that are empty once canonicalised match nothing.
Repeated rows get equal results, one per row. An empty table gives an empty result; extra columns of
the input are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the notices by which documents refer to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

#: (licence id, text). Ids follow SPDX where it has one.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _0BSD),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = _BSD_2.replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY", 1)

#: Entire texts besides those of KNOWN; files hold the longer ones as distributed.
TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_3),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
)
FILES = {
    "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
    "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def all_known() -> list[tuple[str, str]]:
    """(licence id, text) of KNOWN, TEXTS and the files."""
    folder = Path(__file__).parent / "licence_texts"
    files = [(i, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name, i in FILES.items()]
    return [*KNOWN, *TEXTS, *files]


#: Equivalent spellings, as whole canonical words: (pattern, replacement).
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"\blicen[cs]e(s|d)?\b", r"license$1"),
    (r"\bsub ?licen[cs]e\b", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bv(ersion)? (\d)", "version $2"),
    (r"\bcreative commons attribution noncommercial\b", "cc by nc"),
)
_SIGNS = "©‘’“”–— "  # copyright sign, quotes, dashes, no-break space
#: A copyright line names a sign, a year or a holder; a wrapped body may start a line with "copyright notice".
_BODY = (
    "notices?|holders?|owners?|ownership|licen[cs]e[sd]?|licen[cs]ing|laws?|statements?|treat(y|ies)|and|or|on|in|of|as|to|is|are|for|if|"
    "that|which|permissions?|interests?|disclaimers?|restrictions?|rights?|protection|patents?|trademarks?|the software|the program|"
    "the library|this|doctrines?|like|resulting|material|status|terms?|information|applicable|under|with|by copyright")
_COPYRIGHT = r"^((c )?copyright |c [12][0-9]{3}|all rights reserved)"
_NO_COPYRIGHT = rf"^(c )?copyright ({_BODY})\b"


def canonical(c: Column) -> Column:
    """Canonical form of one line: lower case, one spelling, words parted by one space."""
    c = F.lower(c)
    c = F.translate(c, _SIGNS, "c" + " " * (len(_SIGNS) - 1))
    c = F.trim(F.regexp_replace(c, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    # spellings only where one of their stems occurs: most lines skip the replacements
    spelt = c
    for pattern, to in SPELLINGS:
        spelt = F.regexp_replace(spelt, pattern, to)
    return F.when(c.rlike(r"licen|infringe|merchant|\bv(ersion)? \d|creative commons"), spelt).otherwise(c)


def _lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), canonical)


def _is_text(line: Column) -> Column:
    return (line != "") & (~line.rlike(_COPYRIGHT) | line.rlike(_NO_COPYRIGHT))


def _digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _entire(lines: Column) -> Column:
    return F.array_join(F.filter(lines, _is_text), " ")


def known_licenses(spark: SparkSession, known=None) -> DataFrame:
    """(license_id, digest) of the known texts, canonicalised like any other text."""
    raw = spark.createDataFrame([(i, t) for i, t in (all_known() if known is None else known)], "license_id string, text string")
    return raw.select("license_id", _digest(_entire(_lines(F.col("text")))).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, license_id (of the entire text, or null), license_ids (of entire
    text and lines, sorted, comma-joined, '' if none), n_license_lines."""
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    base = docs.select("doc_id", "text").withColumn("key", F.md5(F.encode("text", "UTF-8")))
    lines = base.where("text is not null").select("doc_id", "key", _lines(F.col("text")).alias("lines"))
    entire = F.array(F.struct(F.lit(-1).alias("pos"), _entire(F.col("lines")).alias("unit")))
    single = F.transform(F.col("lines"), lambda l, i: F.struct(i.alias("pos"), l.alias("unit")))
    units = lines.select("doc_id", "key", F.explode(F.concat(entire, single)).alias("x"))
    units = units.where(F.col("x.unit") != "").select(
        "doc_id", "key", F.col("x.pos").alias("pos"), _digest(F.col("x.unit")).alias("digest"))
    hits = (
        units.join(known, "digest")
        .groupBy("doc_id", "key")
        .agg(
            F.min(F.when(F.col("pos") < 0, F.col("license_id"))).alias("license_id"),
            F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_ids"),
            F.countDistinct(F.when(F.col("pos") >= 0, F.col("pos"))).alias("n_license_lines"),
        )
        .withColumnsRenamed({"doc_id": "h_id", "key": "h_key"})
    )
    with_text = base.where("text is not null").select("doc_id", "key").join(
        hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
    cols = [
        F.col("doc_id"), F.col("license_id"),
        F.coalesce("license_ids", F.lit("")).alias("license_ids"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
    ]
    no_text = base.where("text is null").select(
        "doc_id", F.lit(None).cast("string").alias("license_id"),
        F.lit("").alias("license_ids"), F.lit(0).cast("long").alias("n_license_lines"))
    return with_text.select(*cols).unionByName(no_text)


def _sql_canonical(c: str) -> str:
    signs = "".join(_SIGNS)
    c = f"translate(lower({c}), '{signs}', 'c{' ' * (len(signs) - 1)}')"
    c = f"trim(regexp_replace({c}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def sql() -> str:
    quoted = ",\n".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in all_known())
    canon = _sql_canonical("l")
    entire = f"array_to_string(list_filter(lines, lambda l: l <> '' AND (NOT regexp_matches(l, '{_COPYRIGHT}') OR regexp_matches(l, '{_NO_COPYRIGHT}'))), ' ')"
    return f"""
WITH known_raw(license_id, text) AS (VALUES {quoted}),
known AS (
  SELECT DISTINCT license_id, sha256({entire}) AS digest
  FROM (SELECT license_id, list_transform(string_split(text, chr(10)), lambda l: {canon}) AS lines FROM known_raw)),
lined AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {canon}) AS lines FROM documents),
units AS (
  SELECT doc_id, -1 AS pos, {entire} AS unit FROM lined WHERE lines IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS unit FROM lined),
hits AS (
  SELECT doc_id, min(CASE WHEN pos < 0 THEN license_id END) AS license_id,
         string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids,
         count(DISTINCT CASE WHEN pos >= 0 THEN pos END) AS n_license_lines
  FROM units JOIN known ON unit <> '' AND sha256(unit) = digest GROUP BY doc_id)
SELECT d.doc_id, h.license_id, coalesce(h.license_ids, '') AS license_ids,
       CAST(coalesce(h.n_license_lines, 0) AS BIGINT) AS n_license_lines
FROM documents d LEFT JOIN hits h USING (doc_id)"""
