"""Canonical digest lookup of licence texts.

A text is reduced to what a licence is recognised by: lower case, one spelling of words that are spelled
in several ways, letters and digits only, no copyright statements, no line ends. The digest of what is left is
joined to the digests of known licences. Notices are looked up the same way, line by line. Built-in
functions only.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: spellings that count as equal (pattern, replacement), applied in this order -----------
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("http:", "https:"),
    ("©", "(c)"),
    ("&", " and "),
)
#: Spellings of words with a blank, a sign or a line end between them: applied when those are single blanks.
PHRASES = (("non commercial", "noncommercial"), ("copyright holder", "copyright owner"))

# --- fixed values: known licence texts and notices ----------------------------------------------------
SHORT = (
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
#: Licences whose full texts, title included, are the files of ``licence_texts``.
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
#: Title lines with which copies of the short texts start, or none.
TITLES = {
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(MIT)", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> tuple[tuple[str, str], ...]:
    """``(licence, text)`` of all known texts in the forms that copies have: with and without a title, with
    clauses numbered or not, with and without what follows the end of the terms."""
    isc, mit = SHORT[:2]
    bsd = (("BSD-2-Clause", BSD.format(third="")), ("BSD-3-Clause", BSD.format(third=BSD_NAMES)))
    bodies = [isc, mit, (isc[0], isc[1].replace("and/or distribute", "and distribute"))]
    names = ("HOLDER OR", "OWNER OR", "HOLDERS OR")
    forms = [(name, text.replace("HOLDER OR", of)) for name, text in bsd for of in names]
    forms += [(name, text.replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")) for name, text in bsd]
    bodies += [(name, form) for name, text in forms for form in (text, re.sub(r"(?m)^\d\. ", "", text))]
    titled = [(name, f"{title}\n{text}") for name, text in bodies for title in TITLES[name]]
    long = [(name, files(__package__).joinpath("licence_texts", f"{name}.txt").read_text("utf-8")) for name in LONG]
    apache = long[0][1]
    long += [("Apache-2.0", form) for form in (apache.partition("Copyright [yyyy]")[0], re.sub(r"\([a-d]\) ", "", apache))]
    ends = [(name, text.partition(END_OF_TERMS)[0] + more) for name, text in long if END_OF_TERMS in text for more in (END_OF_TERMS, "")]
    return tuple(dict.fromkeys([*SHORT, *bodies, *titled, *long, *ends]))


KNOWN = known_texts()

# --- fixed values: statements that name a holder or a year and differ in every copy ------------------------
#: First words of known texts after such a statement; it ends there if they stand on the same line.
OPENINGS = (
    "permission is hereby granted free", "permission to use copy modify", "redistribution and use in source",
    "everyone is permitted to copy", "licensed under the apache license", "this program is free software", "this library is free software",
)
_YEAR = "(?:[0-9]{4}|19yy|yyyy|year)"
_MARK = "(?:copyright|c)(?: (?:copyright|c|by))*"
_END = f"(?=$| (?:{'|'.join(OPENINGS)}))"
_TITLE = "|".join(sorted({" ".join(re.findall("[a-z0-9]+", t.lower())) for ts in TITLES.values() for t in ts}, key=len, reverse=True))
#: At the start of a line or after a title: the year and then the holder, the holder and then the year, or "copyright (c)" and
#: the holder, up to the end of the line, if that is near, or an opening. The title is the first group.
STATEMENT = (
    f"(?m)^((?:(?:{_TITLE}) )?)(?:{_MARK} {_YEAR}(?: [^ \\n]+){{0,30}}?{_END}"
    f"|{_MARK}(?: [^ \\n]+){{1,8}}? {_YEAR}(?: {_YEAR}| present)*(?: all rights reserved)?{_END}"
    f"|copyright c(?: [^ \\n]+){{1,12}}?{_END}|all rights reserved{_END})"
)
#: Statements of the long texts themselves, which stand in the middle of a line when it is wrapped otherwise.
FIXED_STATEMENT = re.sub(" ", "[ \\\\n]", (
    f"\\bcopyright (?:c )?(?:{_YEAR} name of (?:author|copyright owner)|(?:[0-9]{{4}} )+free software foundation inc"
    "(?: 51 franklin street fifth floor boston ma 02110 1301 usa| 59 temple place suite 330 boston ma 02111 1307 usa| https fsf org)?)\\b"
))
#: The holder whose name the third clause of the BSD licence protects.
NAMES_OF = "neither the name of (?:[^ ]+ ){1,12}?nor the names of its contributors"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line; a line without letters and digits is empty."""

    def line(raw: Column) -> Column:
        out = F.lower(raw)
        for pattern, to in SPELLINGS:
            out = F.replace(out, F.lit(pattern), F.lit(to))
        return spelled(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def spelled(words: Column) -> Column:
    """Words, one blank apart, with one spelling of phrases."""
    for pattern, to in PHRASES:
        words = F.replace(words, F.lit(pattern), F.lit(to))
    return words


def canonical(text: Column) -> Column:
    """Canonical form of a whole text, however its lines are wrapped; empty if nothing but copyright statements
    is left. Of a copyright statement that goes on in the next line, what stands there is kept."""
    lines = F.array_join(F.filter(canonical_lines(text), lambda x: x != ""), "\n")
    kept = F.regexp_replace(F.regexp_replace(lines, FIXED_STATEMENT, ""), STATEMENT, "$1")
    words = F.trim(F.regexp_replace(kept, r"[ \n]+", " "))
    return spelled(F.regexp_replace(words, NAMES_OF, "neither the name of the copyright holder nor the names of its contributors"))


def known_licences(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``(digest, licence)`` of ``(licence, text)`` pairs, one row per digest."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.groupBy(F.md5(canonical(F.col("text"))).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: digest of its canonical text, the licence that its entire text is, or null,
    and the licences that entire lines of it name, sorted and joined by commas, or null.

    An empty text, or one of copyright statements only, has the digest of the empty text, which no licence
    has. Null texts are empty. Repeated rows and null ids are looked up like others; an empty table gives
    no rows. Other columns are ignored. ``known`` has one row per digest.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = known.where(F.col("digest") != F.md5(F.lit("").cast("binary")))
    # Lines are looked up once per row; what is found goes back by the digest of the raw text, so that
    # copies, however many, add no more than one row each task.
    lines = source.select(F.md5("text").alias("raw"), F.explode(F.array_distinct(canonical_lines(F.col("text")))).alias("line"))
    notices = (
        lines.where(F.col("line") != "")
        .select("raw", F.md5("line").alias("digest"))
        .join(known, "digest")
        .groupBy("raw")
        .agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    )
    whole = source.select("doc_id", F.md5("text").alias("raw"), F.md5(canonical(F.col("text"))).alias("digest"))
    return whole.join(known, "digest", "left").join(notices, "raw", "left").select("doc_id", "digest", "licence", "notices")
