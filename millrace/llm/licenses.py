"""Licence scan by canonical digest: a text that is a known licence, whatever its spelling.

A text is normalised (case, copyright lines, equivalent spellings, punctuation,
white space) and its SHA-256 joined to the digests of known licence texts.
DataFrame functions only; the whole text counts, never a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare

#: Spellings that count as the same word, as in the SPDX matching guidelines.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: Short licence texts and notices, with their SPDX identifiers.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0 (header)", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later (header)", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0 (header)", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT (notice)", "Released under the MIT License."),
    ("Apache-2.0 (notice)", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only (notice)", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 (notice)", "Licensed under CC BY-NC 4.0."),
]

#: Titles that stand over licence texts.
TITLES = [
    ("MIT", ["MIT", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "License: MIT"]),
    ("ISC", ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"]),
    ("0BSD", ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD (0BSD)"]),
    ("Zlib", ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"]),
    ("Unlicense", ["Unlicense", "The Unlicense"]),
]

# Copyright statements, line by line. The same texts serve Spark's and the SQL engine's regular expressions, so they look
# neither ahead nor back, and no group repeats without a bound (Java's would use up the stack on a very long line).
_SPACE, _INK = r"[\t\r ]", r"[^\t\n\x0B\f\r ]"
_SIGN = r"(?:\(c\)|©)"
_YEAR = r"(?:[0-9]{4}|<year>|\[year\]|\[yyyy\]|<yyyy>)"
_YEARS = rf"{_YEAR}(?:{_SPACE}*[-–,]{_SPACE}*(?:{_YEAR}|[0-9]{{2}}|present)){{0,30}}"
#: A word of a holder's name: no small letter first (but for some small words and addresses), and no full stop last (but after initials and abbreviations).
_NAME = (
    rf"(?:(?:and|the|of|by|its|et|al|de|da|di|van|von|del|la|for|contributors?|authors?|others|owners?)[,;]?|\p{{Lu}}\.|(?:Inc|Ltd|Co|Corp|Jr|Sr|Dr|Bros|LLC|GmbH|St)\.,?"
    rf"|[^\t\n\x0B\f\r @]+@{_INK}+|[^\p{{Ll}}\t\n\x0B\f\r ]{_INK}*[^\t\n\x0B\f\r .]|[^\p{{Ll}}\t\n\x0B\f\r .])"
)
_HEAD = rf"(?i:copyright{_SPACE}*{_SIGN}[\t ,:]*(?:{_YEARS})?|copyright[\t ,:]*{_YEARS}|\(c\)[\t ,:]*{_YEARS}|©[\t ,:]*(?:{_YEARS})?)"
_LATE = rf"(?i:copyright)(?:{_SPACE}+{_NAME}){{1,8}}[\t ,]+{_YEARS}"
#: A statement wherever it stands in a line: its head and the names that follow, 60 words at most.
STATEMENT = rf"(?:{_HEAD}|{_LATE})(?:[\t ,;:&-]+{_NAME}){{0,60}}(?:{_SPACE}+[^\p{{Ll}}\t\n\x0B\f\r ]{_INK}*\.)?"
#: A line of a statement and up to four words of any kind is one.
LINE = rf"^[^\p{{L}}\p{{N}}(©]*{_HEAD}(?:{_SPACE}+{_INK}+){{0,4}}{_SPACE}*$"
HAS_STATEMENT = r"(?i)copyright|\(c\)|©"
#: Says what a statement says, wherever it stands.
RESERVED = r"(?i)all[\t\r\n ]+rights[\t\r\n ]+reserved"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def without_statements(text: Column) -> Column:
    """Text without its copyright statements; the rest of their lines stays."""
    of = lambda line: F.when(line.rlike(LINE), "").otherwise(F.regexp_replace(line, STATEMENT, " "))
    free = F.regexp_replace(text, RESERVED, " ")
    return F.when(text.rlike(HAS_STATEMENT), F.array_join(F.transform(F.split(free, "\n"), of), "\n")).otherwise(free)


def normalised(text: Column) -> Column:
    """Lower case in ASCII, no copyright statements, words of letters and digits of any script parted by single spaces, one spelling."""
    out = F.translate(without_statements(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # two spaces between words, so that each has its own on either side
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, "  "), F.lit(" "))
    for other, one in EQUIVALENT:
        out = F.replace(out, F.lit(_spaced(other)), F.lit(_spaced(one)))
    return F.trim(F.regexp_replace(out, " +", " "))


def titled(licences: DataFrame) -> DataFrame:
    """Each licence as it is, under each of its titles, and, where its first line has eight words at most and says licence, without that line."""
    titles = licences.sparkSession.createDataFrame([(i, t) for i, own in TITLES for t in own], "license_id string, title string")
    under = licences.join(F.broadcast(titles), "license_id").select("license_id", F.concat("title", F.lit("\n"), "text").alias("text"))  # TITLES
    first = r"^\s*[^\n]*(?i:licen[cs]e)[^\n]*\n"
    short = F.size(F.split(F.trim(F.regexp_extract("text", first, 0)), r"\s+")) <= 8
    bare_text = licences.where(F.col("text").rlike(first) & short).select("license_id", F.regexp_replace("text", first, "").alias("text"))
    return licences.select("license_id", "text").unionByName(under).unionByName(bare_text)


def digests(licences: DataFrame) -> DataFrame:
    """(license_id, license_digest) of (license_id, text), with and without titles; of equal digests the first id stays, of null and empty texts none."""
    out = titled(licences).select("license_id", normalised(F.col("text")).alias("t")).where("t != ''")
    return out.groupBy(F.sha2("t", 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def known(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(license_id, text): KNOWN and, where a folder is given, a licence for each text file in it, by its name without .txt."""
    out = spark.createDataFrame(KNOWN, "license_id string, text string")
    if folder is None:
        return out
    read = spark.read.text(folder, wholetext=True).select(
        F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), "([^/]+)$", 1), r"\.txt$", "").alias("license_id"), F.col("value").alias("text")
    )
    return out.unionByName(read)


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Per document: doc_id, canonical_digest, license_id (null: none).

    A null text has a null digest; one without a letter or digit has the digest
    of the empty text; neither matches. A text matches only as a whole: one
    that holds a licence among other words does not. Repeated rows stay, other
    columns are left aside, an empty table gives an empty one. The licence side
    has distinct digests, so no row multiplies; Spark picks the join by
    measured size.
    """
    side = digests(licences)
    base = bare(docs, "doc_id", "text").select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("canonical_digest"))
    return base.join(side, base["canonical_digest"] == side["license_digest"], "left").select("doc_id", "canonical_digest", "license_id")


def _sql_normalised(text: str) -> str:
    free = f"regexp_replace({text}, '{RESERVED}', ' ', 'g')"
    of = f"CASE WHEN regexp_matches(x, '{LINE}') THEN '' ELSE regexp_replace(x, '{STATEMENT}', ' ', 'g') END"
    out = f"CASE WHEN regexp_matches({text}, '{HAS_STATEMENT}') THEN array_to_string([{of} FOR x IN string_split({free}, chr(10))], chr(10)) ELSE {free} END"
    out = f"translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace({out}, '{NOT_WORD}', '  ', 'g') || ' '"
    for other, one in EQUIVALENT:
        out = f"replace({out}, '{_spaced(other)}', '{_spaced(one)}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def oracle() -> str:
    quote = "'"
    titles = dict(TITLES)
    every = [(i, t) for i, t in KNOWN] + [(i, f"{title}\n{t}") for i, t in KNOWN for title in titles.get(i, [])]
    values = ", ".join(f"('{i}', '{t.replace(quote, quote * 2)}')" for i, t in every)
    return f"""
WITH known(license_id, text) AS (VALUES {values}),
side AS (SELECT sha256(t) AS license_digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_normalised('text')} AS t FROM known) WHERE t != '' GROUP BY 1),
base AS (SELECT doc_id, sha256({_sql_normalised('text')}) AS canonical_digest FROM documents)
SELECT b.doc_id, b.canonical_digest, s.license_id FROM base b LEFT JOIN side s ON b.canonical_digest = s.license_digest
"""
