"""License scans by canonical digest lookup, with built-in expressions only.

A text is brought to a canonical form (A-Z lower-cased, copyright lines dropped, equivalent spellings unified,
punctuation and white space reduced to single spaces) and hashed; whole texts are hash-joined to the digests of
known licences. The same lookup is made for each line, which finds licence notices inside other texts.

The known texts are a fixed list (this module and license_texts), each in its usual forms: with and without its title,
numbered and bulleted, with and without the appendix on how to apply it. So the digest table has a fixed size
and is broadcast. The SQL knows the untitled texts of TEXTS only.

Defined results: a null or empty text, or one with nothing left in canonical form, matches nothing; repeated rows
are reported each; a line that occurs twice counts twice; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, UPPER, ascii_lower, table, written

#: Texts of licences, whole.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: The usual one-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
}
#: Titles that stand before a text of TEXTS or BSD-3-Clause, whose bodies have none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD License", "Zero-Clause BSD (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: Where the text starts after the title, in the licences that are files.
STARTS = {
    "Apache-2.0": r"(?m)^\s*TERMS AND CONDITIONS FOR USE", "CC-BY-SA-4.0": r"Creative Commons Corporation \(", "CC0-1.0": r"CREATIVE COMMONS CORPORATION IS", "GFDL-1.2": r"Everyone is permitted", "GFDL-1.3": r"Everyone is permitted",
    "GPL-1.0": r"Everyone is permitted", "GPL-2.0": r"Everyone is permitted", "GPL-3.0": r"Everyone is permitted", "LGPL-2.0": r"Everyone is permitted", "LGPL-2.1": r"Everyone is permitted", "LGPL-3.0": r"Everyone is permitted",
    "MPL-1.1": r"(?m)^\s*1\. +Definitions", "MPL-2.0": r"(?m)^\s*1\. +Definitions",
}
#: Where the part on how to apply a licence starts; texts also end there, or before the line that ends the terms.
ENDS = [r"(?m)^\s*(APPENDIX|Appendix|ADDENDUM): How to", r"(?m)^\s*How to Apply These Terms", r"(?m)^\s*END OF TERMS AND CONDITIONS"]
#: Holders that clause 3 of the BSD licence names, and whom its disclaimer names.
HOLDERS = [("the copyright holder", "COPYRIGHT HOLDERS"), ("the copyright holders", "COPYRIGHT HOLDERS"), ("the copyright owner", "COPYRIGHT HOLDERS"), ("the University", "REGENTS"), ("the author", "COPYRIGHT HOLDERS")]
#: Addresses of the Free Software Foundation in editions of its licences.
ADDRESS = r"51 Franklin St(reet)?, Fifth Floor,\s+Boston,?\s+MA\s+02110-1301,?\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
#: Spellings that count as equal, after lower-casing and before punctuation goes.
SPELLINGS = [
    ("licence", "license"), ("authoriz", "authoris"), ("organiz", "organis"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("https://", "http://"), ("non-infringement", "noninfringement"), ("sub-license", "sublicense"),
    ("\u2018", " "), ("\u2019", " "), ("\u201c", " "), ("\u201d", " "), ("\u2013", " "), ("\u2014", " "),
]
COPYRIGHT_LINE = "(?m)^[ \t]*(copyright|\\(c\\)|\u00a9|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HINT = r"licen[cs]e|spdx"


def canonical(text: Column) -> Column:
    c = ascii_lower(F.coalesce(text, F.lit("")))
    for line_end in ("\r\n", "\r"):
        c = F.replace(c, F.lit(line_end), F.lit("\n"))
    owned = F.contains(c, F.lit("copyright")) | F.contains(c, F.lit("(c)")) | F.contains(c, F.lit("\u00a9")) | F.contains(c, F.lit("all rights reserved"))
    c = F.when(owned, F.regexp_replace(c, COPYRIGHT_LINE, "")).otherwise(c)
    for spelling, to in SPELLINGS:
        c = F.replace(c, F.lit(spelling), F.lit(to))
    return F.trim(F.regexp_replace(c, PUNCTUATION, " "))


def canonical_sql(text: str) -> str:
    c = f"replace(replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    c = f"regexp_replace({c}, '{COPYRIGHT_LINE}', '', 'g')"
    for spelling, to in SPELLINGS:
        c = f"replace({c}, '{spelling}', '{to}')"
    return f"trim(regexp_replace({c}, '{PUNCTUATION}', ' ', 'g'))"


def bsd3(holder: str, providers: str) -> str:
    """BSD-2-Clause with the clause against endorsement."""
    clause = f"3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    head, tail = TEXTS["BSD-2-Clause"].split("THIS SOFTWARE IS PROVIDED", 1)
    tail = tail.replace("COPYRIGHT HOLDERS AND", f"{providers} AND", 1)
    return head + clause + "THIS SOFTWARE IS PROVIDED" + (tail if providers != "REGENTS" else tail.replace("COPYRIGHT HOLDER OR", "REGENTS OR", 1))


def listed(text: str) -> list[str]:
    """The text with its list numbered and bulleted. Not lettered: a line that starts with (c) counts as copyright."""
    return [text, re.sub(r"(?m)^\d\. ", "* ", text)]


def forms() -> list[tuple[str, str]]:
    """(license, text): every known licence in its usual forms."""
    bodies = [*TEXTS.items(), *(("BSD-3-Clause", bsd3(*h)) for h in HOLDERS)]
    # Another body whose disclaimer says "copyright owner", as many copies of the BSD licences do.
    bodies += [(n, b.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")) for n, b in bodies if n.startswith("BSD-")]
    found = [(n, f"{title}\n\n{form}") for n, b in bodies for form in listed(b) for title in ("", *TITLES[n])]
    for name, start in STARTS.items():
        text = files("weftline.llm").joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")
        cuts = [text, *(text[: m.start()] for end in ENDS if (m := re.search(end, text)))]
        for cut in [t for c in cuts for t in (c, c[re.search(start, c).start() :])]:
            found += [(name, re.sub(ADDRESS, a, cut)) for a in (ADDRESSES if re.search(ADDRESS, cut) else [""])] + [(name, cut)]
    return sorted(set(found))


def canonical_text(text: str) -> str:
    """canonical() of one of the fixed texts, so that only digests are shipped."""
    c = text.translate(str.maketrans(UPPER, LOWER)).replace("\r\n", "\n").replace("\r", "\n")
    c = re.sub(COPYRIGHT_LINE, "", c)
    for spelling, to in SPELLINGS:
        c = c.replace(spelling, to)
    return re.sub(PUNCTUATION, " ", c).strip(" ")


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license, kind) of the fixed lists above; kind is text or notice."""
    rows = [(name, "text", text) for name, text in forms()] + [(name, "notice", line) for name, lines in NOTICES.items() for line in lines]
    rows = sorted({(name, kind, hashlib.sha256(canonical_text(body).encode()).hexdigest()) for name, kind, body in rows})
    return spark.createDataFrame(rows, "license string, kind string, digest string").groupBy("digest", "kind").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, text_digest, license (its whole text is that licence), notices (licences of its lines)."""
    known = known_digests(docs.sparkSession)
    whole = F.broadcast(known.select(F.col("digest").alias("text_digest"), "license").groupBy("text_digest").agg(F.min("license").alias("license")))
    notices = F.broadcast(known.filter("kind = 'notice'").select(F.col("digest").alias("line_digest"), F.col("license").alias("notice")))
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lines = F.filter(F.split("body", "\r\n|\r|\n", -1), lambda x: F.lower(x).rlike(HINT))
    digests = F.transform(lines, lambda x: F.sha2(canonical(x), 256))
    named = F.when(F.lower("body").rlike(HINT), digests).otherwise(F.array().cast("array<string>"))
    rows = written(body.select(key, F.sha2(canonical(F.col("body")), 256).alias("text_digest"), named.alias("lines")), "licenses").join(whole, "text_digest", "left")
    none = F.array().cast("array<string>")
    bare = rows.filter(F.size("lines") == 0).select(key, "text_digest", "license", none.alias("notices"))
    # Only texts with a line that names a licence are joined further; equal sets of lines are looked up once.
    some = rows.filter(F.size("lines") > 0).withColumn("lines_digest", F.sha2(F.array_join("lines", ""), 256))
    hits = some.groupBy("lines_digest").agg(F.first("lines").alias("lines")).select("lines_digest", F.explode("lines").alias("line_digest"))
    hits = hits.join(notices, "line_digest").groupBy("lines_digest").agg(F.sort_array(F.collect_list("notice")).alias("notices"))
    found = some.join(hits, "lines_digest", "left").select(key, "text_digest", "license", F.coalesce("notices", none).alias("notices"))
    return bare.unionByName(found)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text_digest", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"))


def oracle() -> str:
    quote = lambda s: s.replace("'", "''")
    values = ", ".join([f"('{n}', 'text', '{quote(t)}')" for n, t in TEXTS.items()] + [f"('{n}', 'notice', '{quote(x)}')" for n, xs in NOTICES.items() for x in xs])
    return f"""
    WITH known AS (SELECT sha256({canonical_sql('body')}) AS digest, kind, license FROM (VALUES {values}) v(license, kind, body)),
    whole AS (SELECT digest, min(license) AS license FROM known GROUP BY digest),
    note AS (SELECT digest, min(license) AS license FROM known WHERE kind = 'notice' GROUP BY digest),
    lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE regexp_matches(lower(text), '{HINT}')),
    hits AS (SELECT doc_id, count(*) AS n, string_agg(note.license, ',' ORDER BY note.license) AS notices
      FROM lines JOIN note ON sha256({canonical_sql('line')}) = note.digest WHERE regexp_matches(lower(line), '{HINT}') GROUP BY doc_id)
    SELECT d.doc_id, sha256({canonical_sql('d.text')}) AS text_digest, whole.license, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_notices, coalesce(hits.notices, '') AS notices
    FROM documents d LEFT JOIN whole ON whole.digest = sha256({canonical_sql('d.text')}) LEFT JOIN hits ON hits.doc_id = d.doc_id
    """


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {"op9_license_scan": oracle()}
