"""Licence scans by canonical digests.

A text is made canonical (ASCII lower case, copyright lines out, equivalent spellings,
punctuation and white space to single blanks) and hashed; the digests of entire texts
are joined to those of known licences. Every line that a text has is looked up alike, so
that licence notices inside a document are found too; a text of several lines within a
larger document is not. The known texts are a fixed list (KNOWN as texts, FULL as digests),
which bounds the broadcast side of the join. A digest has one licence.

Null and empty texts have the digest of an empty text, and no licence. Texts are hashed
whole, however long. Repeated rows get equal results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a holder (a sign or year after the word, or a year later in the line) and the reservation that follows them.
COPYRIGHT = r"(?m)^[ \t]*(?:(?:copyright|\(c\)|©)[ \t:]*(?:\(c\)|©|[0-9])[^\n]*|copyright\b[^\n]*\b(?:19|20)[0-9][0-9]\b[^\n]*|all rights reserved[. \t]*)$"
#: Equivalent spellings, applied to lower-case text in this order.
SPELLINGS = (
    (r"licenc(e|es|ed|ing)\b", "licens$1"),
    (r"\bsub[- ]licens", "sublicens"),
    (r"\bnon[- ]?infringement\b", "noninfringement"),
    (r"\bhttps://", "http://"),
    (r"\b(favo|hono|colo)ur", "$1r"),
    (r"\bversion ([0-9])\.0\b", "version $1"),
)
OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_BODY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
#: Published licence texts and notices, under their public identifiers.
KNOWN = (
    ("MIT", MIT_BODY + DISCLAIMER),
    ("MIT", "MIT License " + MIT_BODY + DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
    ("ISC", "ISC License " + ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
    ("0BSD", ISC_BODY + ". " + ISC_END),
    ("BSD-2-Clause", BSD_START + BSD_CONDITIONS + BSD_END),
    ("BSD-3-Clause", BSD_START + BSD_CONDITIONS + BSD_THIRD + BSD_END),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: SHA-256 of the canonical form of entire published texts, as distributions of them carry them. Fixed values.
FULL = (
    ("Apache-2.0", "1dde100b4dd613df1b9b8ce5929fb32d7b58e4d423cd9555b0c905f6a6d6117b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "22c9324e5634aa07c32060365e6191d4f9ec61fafc6091ce7394333c6d7db95e"),
)

#: Every known text has one of these in its canonical form, and so in any spelling of it: lines without them are not looked up.
MARKS, MARKED = ("licens", "permission", "redistribution"), "(?i)licen[cs]|permission|redistribution"


def canonical(text):
    """Column: the canonical form of a text column."""
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT, "")
    for a, b in SPELLINGS:
        t = F.regexp_replace(t, a, b)
    return F.trim(F.regexp_replace(t, OTHER, " "))


def canonical_text(text: str) -> str:
    """The same for the known texts."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    t = re.sub(COPYRIGHT, "", t)
    for a, b in SPELLINGS:
        t = re.sub(a, b.replace("$1", r"\1"), t)
    return re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", t).strip(" ")


def digests(known=KNOWN, full=FULL) -> dict[str, str]:
    return {**{digest: name for name, digest in full}, **{hashlib.sha256(canonical_text(x).encode()).hexdigest(): name for name, x in known}}


def scan(docs: DataFrame, known=KNOWN, full=FULL) -> DataFrame:
    """doc_id, digest, license_id of the entire text, line_licenses (ids of its lines, sorted, comma-joined)."""
    table = digests(known, full)
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    t = F.coalesce(F.col("text"), F.lit(""))
    marked = full is FULL and all(any(m in canonical_text(x) for m in MARKS) for _, x in known)
    of_lines = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(MARKED) if marked else x != ""), lambda x: F.try_element_at(lookup, F.sha2(canonical(x), 256)))
    hashed = docs.select(
        "doc_id",
        F.sha2(canonical(t), 256).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(of_lines))), ",").alias("line_licenses"),
    )
    dim = docs.sparkSession.createDataFrame(list(table.items()), "digest string, license_id string")
    return hashed.join(F.broadcast(dim), "digest", "left").select("doc_id", "digest", "license_id", "line_licenses")


def _sql(text: str) -> str:
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    for a, b in ((COPYRIGHT, ""), *SPELLINGS, (OTHER, " ")):
        out = f"regexp_replace({out}, '{a}', '{b.replace('$1', chr(92) + '1')}', 'g')"
    return f"sha256(trim({out}, ' '))"


ORACLE = f"""
WITH k(digest, license_id) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in digests().items())}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT DISTINCT doc_id, k.license_id FROM (SELECT doc_id, {_sql("x")} AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)) JOIN k USING (digest)),
g AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS ids FROM l GROUP BY doc_id),
h AS (SELECT doc_id, {_sql("t")} AS digest FROM d)
SELECT h.doc_id, h.digest, k.license_id, coalesce(g.ids, '') AS line_licenses
FROM h LEFT JOIN k ON h.digest = k.digest LEFT JOIN g ON h.doc_id = g.doc_id
"""
