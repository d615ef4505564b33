"""License scan by lookup of canonical digests.

A text's canonical form has lower case, no copyright lines, no punctuation,
one spelling of words that licences spell in several ways and single spaces.
Entire texts are joined by the SHA-256 of that form with the digests of known
licences.  Lines that are, as entire texts, a known notice are listed beside.
Column expressions only; the known texts are a fixed small table.

Where that finds no licence a wider form is looked up too, which only
``license_id`` shows: punctuation, symbols and spaces of all of Unicode go, and
of lines that begin with copyright those with a sign, year or name.  Its
digests cover the texts above and ``WHOLE``, of which no text is kept here.

Defined cases: a null text counts as empty; a text without words has the digest
of the empty text and no licence.  Rows with equal texts or ids are rows of
their own.  Texts that differ from a licence in one word aren't that licence.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_digests import WHOLE

#: Spellings that count as the same word.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "authorised": "authorized",
    "authorisation": "authorization",
    "organisation": "organization",
    "favour": "favor",
    "honour": "honor",
    "merchantibility": "merchantability",
    "non infringement": "noninfringement",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "acknowledgement": "acknowledgment",
    "fulfil": "fulfill",
    "whilst": "while",
    "http": "https",
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known licences and notices as (identifier, text).
KNOWN = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC,
    ),
    (
        "0BSD",
        "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted.\n\n" + _ISC,
    ),
    (
        "Zlib",
        "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: Copyright lines, in lower case, and what isn't part of a word: patterns that
#: Java's and RE2's regular expressions read alike.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*$"
RESERVED = r"all rights reserved\.?"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same for the wider form: lines whose copyright isn't a word of a sentence.
NAMED = (
    r"(?m)^[ #*/;-]*(copyright\b(?! (notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|disclaimers?|treaty|status|rights?"
    r"|and|or|in|to|is|are|as|on|for|of|that|this|under|with|if|shall|may|will|can|resulting|permission)\b)(?=[ :]*[^ \n:,.;)])"
    r"|\(c\)(?=[^\n]*((19|20)[0-9]{2}|yyyy|<year>))|\x{A9})[^\n]*$"
)
SIGNS = r"[\p{P}\p{S}\p{Z}\p{Cf}\x00-\x09\x0B-\x1F\x7F\x{85}]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its lines still apart."""
    out = F.concat(F.lit("\n"), F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, ""), RESERVED, "")
    out = F.regexp_replace(F.regexp_replace(out, PUNCTUATION, " "), r" *\n *", " \n ")
    for spelling, word in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {word} "))
    return out


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def wider(text: Column) -> Column:
    """The wider form, null for texts without a word that all licences have."""
    out = F.concat(F.lit("\n"), F.lower(text.cast("string")), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?|[\x{2028}\x{2029}]", "\n"), r"[\p{Zs}\t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, NAMED, ""), RESERVED, "")
    out = F.regexp_replace(F.regexp_replace(out, SIGNS, " "), r"[ \n]+", " ")
    for spelling, word in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {word} "))
    return F.when(text.rlike("(?i)licen[sc]e|software"), F.trim(out))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, canonical_sha256, license_id`` of every row and ``notices``, the
    sorted licences of its notice lines, joined by commas (null if none)."""
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "license_id string, known string").select("license_id", canonical(F.col("known")).alias("form"))
    forms = table.groupBy("form").agg(F.min("license_id").alias("license_id")).collect()
    digests = spark.createDataFrame([(r.form, r.license_id) for r in forms], "form string, license_id string").select(
        F.sha2("form", 256).alias("canonical_sha256"), "license_id"
    )
    more = spark.createDataFrame(known, "license_id string, known string").where(F.length("known") > 200).select(F.sha2(wider(F.col("known")), 256).alias("wider_sha256"), "license_id")
    more = more.unionByName(spark.createDataFrame(WHOLE, "license_id string, wider_sha256 string")).groupBy("wider_sha256").agg(F.min("license_id").alias("wider_id"))
    short = {r.form: r.license_id for r in forms if len(r.form.split(" ")) < 20}
    names = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), canonical_lines(F.col(text_col)).alias("lines"), wider(F.col(text_col)).alias("wide")).select(
        "id",
        F.sha2("wide", 256).alias("wider_sha256"),
        F.sha2(F.trim(F.regexp_replace("lines", r"[ \n]+", " ")), 256).alias("canonical_sha256"),
        F.array_sort(F.array_distinct(F.transform(F.filter(lines, lambda x: x.isin(*short)), lambda x: F.element_at(names, x)))).alias("found"),
    )
    notices = F.when(F.size("found") > 0, F.array_join("found", ","))
    hit = rows.join(F.broadcast(digests), "canonical_sha256", "left").join(F.broadcast(more), "wider_sha256", "left")
    return hit.select("id", "canonical_sha256", F.coalesce("license_id", "wider_id").alias("license_id"), notices.alias("notices"))


def oracle() -> str:
    """The same scan in DuckDB's SQL."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        out = f"concat(chr(10), lower(coalesce({x}, '')), chr(10))"
        out = f"regexp_replace(regexp_replace({out}, {text(COPYRIGHT)}, '', 'g'), {text(RESERVED)}, '', 'g')"
        out = f"regexp_replace(regexp_replace({out}, {text(PUNCTUATION)}, ' ', 'g'), ' *\\n *', concat(' ', chr(10), ' '), 'g')"
        for spelling, word in SPELLINGS.items():
            out = f"replace({out}, ' {spelling} ', ' {word} ')"
        return out

    values = ", ".join(f"({text(i)}, {text(t)})" for i, t in KNOWN)
    one = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
        WITH raw(license_id, t) AS (VALUES {values}),
        known AS (SELECT form, min(license_id) AS license_id
                  FROM (SELECT license_id, {one} AS form FROM (SELECT license_id, {lines("t")} AS lines FROM raw)) GROUP BY form),
        d AS (SELECT doc_id, lines, {one} AS form FROM (SELECT doc_id, {lines("text")} AS lines FROM documents)),
        hit AS (SELECT DISTINCT doc_id, k.license_id
                FROM (SELECT doc_id, trim(unnest(string_split(lines, chr(10))), ' ') AS line FROM d) l
                JOIN known k ON k.form = l.line WHERE len(string_split(k.form, ' ')) < 20),
        notice AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM hit GROUP BY doc_id)
        SELECT d.doc_id, sha256(d.form) AS canonical_sha256, k.license_id, n.notices
        FROM d LEFT JOIN known k ON k.form = d.form LEFT JOIN notice n ON n.doc_id = d.doc_id"""
