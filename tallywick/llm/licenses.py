"""Licence scans by canonical digest: whole texts, normalised, hash-joined to the digests of known licences."""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of public licences, by SPDX identifier, and notices that stand for one.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must "
    "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
    "in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and "
    "must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
    "any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of "
    "our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
    "to this software under copyright law.\n\n" + _MIT_BODY[_MIT_BODY.index("THE SOFTWARE IS PROVIDED") :].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
)
LICENCES: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + ".\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC_GRANT + _ISC_NOTICE + ".\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org>"),
]
_TERMS_END = "END OF TERMS AND CONDITIONS"
for _name in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"):
    _body = pkgutil.get_data(__package__, f"texts/{_name}.txt").decode()
    LICENCES.append((_name, _body))
    if _TERMS_END in _body:  # without the appendix on how to apply it
        LICENCES.append((_name, _body[: _body.index(_TERMS_END)] + _TERMS_END))
        LICENCES.append((_name, _body[: _body.index(_TERMS_END)]))

# Spellings that count as one.
SPELLINGS: list[tuple[str, str]] = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
]
NOTICE_LINE = r"(^|\n)[ \t]*(copyright [^a-z]|copyright \(c\)|\(c\)|©|all rights reserved)[^\n]*"
#: A copyright line with a holder's name alone: a capital tells it from a sentence wrapped before the word.
HOLDER_LINE = r"(^|\n)[ \t]*Copyright (by )?[A-Z][^\n]*"
#: Typographic quotes, dashes and bullets (U+2010 to U+2027) are punctuation; other letters beyond ASCII belong to words.
NOT_WORD = r"[^a-z0-9\x{80}-\x{200F}\x{2028}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """A licence text as compared: lower case, no copyright lines, no punctuation, one spelling, single spaces; null counts as empty."""
    x = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), HOLDER_LINE, "\n"))
    x = F.regexp_replace(x, NOTICE_LINE, "\n")
    # Two spaces between words, one for either, so that neighbours are both matched.
    x = F.concat(F.lit(" "), F.regexp_replace(x, NOT_WORD, "  "), F.lit(" "))
    for other, one in SPELLINGS:
        x = F.replace(x, F.lit(f" {_wide(other)} "), F.lit(f" {one} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def _wide(words: str) -> str:
    return words.replace(" ", "  ")


def known_digests(spark) -> DataFrame:
    """One row per known canonical text: digest, license_id. Its size is that of the fixed list above."""
    texts = spark.createDataFrame(LICENCES, "license_id string, body string")
    return texts.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence that each whole text is, after normalisation: doc_id, digest, license_id (null: none).

    Null and empty texts, and those with nothing but punctuation or copyright lines, have the digest of the empty text
    and no licence. Repeated rows each give a row; an empty table gives none; further columns play no part. The known
    digests are the fixed list, whose size is bounded, so they go to every task; the texts are never shuffled.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    own = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return own.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id")


def scan_notices(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that are a known text, as notices within prose are: doc_id, license_id, lines; documents without one have no row."""
    known = known_digests(docs.sparkSession) if known is None else known
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\n")).alias("line"))
    own = lines.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    return own.join(F.broadcast(known), "digest").groupBy("doc_id", "license_id").agg(F.count(F.lit(1)).alias("lines"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of scan_licences over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(col: str) -> str:
        x = f"lower(regexp_replace(coalesce({col}, ''), {quote(HOLDER_LINE)}, chr(10), 'g'))"
        x = f"regexp_replace({x}, {quote(NOTICE_LINE)}, chr(10), 'g')"
        x = f"(' ' || regexp_replace({x}, {quote(NOT_WORD)}, '  ', 'g') || ' ')"
        for other, one in SPELLINGS:
            x = f"replace({x}, ' {_wide(other)} ', ' {one} ')"
        return f"sha256(trim(replace({x}, '  ', ' ')))"

    rows = ", ".join(f"({quote(i)}, {quote(body)})" for i, body in LICENCES)
    return f"""WITH known AS (SELECT {sql('body')} AS digest, min(license_id) AS license_id FROM (VALUES {rows}) AS t(license_id, body) GROUP BY 1),
own AS (SELECT doc_id, {sql('text')} AS digest FROM documents)
SELECT own.doc_id, own.digest, known.license_id FROM own LEFT JOIN known ON own.digest = known.digest"""


def notices_sql() -> str:
    """DuckDB SQL for the rows of scan_notices over documents."""
    lines = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)"
    return oracle_sql().split("SELECT own.doc_id")[0].replace("FROM documents)", f"FROM {lines})") + "SELECT own.doc_id, known.license_id, count(*) AS lines FROM own JOIN known ON own.digest = known.digest GROUP BY 1, 2"
