"""Licence scans: normalised texts are looked up by digest among known licences and notices, in Spark's own functions.

Whole texts and each of their lines are normalised: lower case, lines that are copyright notices left out, everything but
letters and digits to single blanks, and then, where lines no longer matter, equivalent spellings made one. SHA-256
digests of what is left meet the digests of known licence texts and notices in hash joins. A text is a licence if it is
one as a whole, with or without a usual title; a line is a notice if it is one as a whole.

Defined results: a null, empty or purely punctuational text has no digest and no licence; rows that repeat each give a
row; a known text that repeats under several names counts for the first name; an empty table gives no rows. Only the id
and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import written

from .common import table

#: Licence texts as their authors published them, and usual notices.
KNOWN = {
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
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
KNOWN["MIT-0"] = KNOWN["MIT"].split(", subject to the following conditions:")[0] + ".\n" + KNOWN["MIT"].split("\n")[-1]
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
#: Titles that stand above these texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["The Unlicense"],
}
#: One-line notices.
NOTICES = {
    "MIT notice": ["Released under the MIT License."],
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0 notice": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0 notice": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0 notice": ["Licensed under CC BY 4.0."],
    "CC0-1.0 notice": ["Released under CC0 1.0."],
    "BSD-3-Clause notice": ["Released under the BSD 3-Clause License."],
    "MPL-2.0 notice": ["Licensed under the Mozilla Public License, Version 2.0."],
}
#: Identifiers that a line may name after "SPDX-License-Identifier".
IDENTIFIERS = "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib BSL-1.0 Unlicense Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-3.0-only AGPL-3.0-only MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
#: Spellings that licence matching guidelines hold to be equal, as they are after normalising, and the one they become.
SPELLINGS = {"licence": "license", "sub license": "sublicense", "non infringement": "noninfringement", "copyright owner": "copyright holder", "acknowledgement": "acknowledgment", "favour": "favor", "honour": "honor", "organisation": "organization", "per cent": "percent", "https": "http"}
_OTHER = r"[^\p{L}\p{N}\n]"
#: A line that is a copyright notice: it names a year or the sign, or is the usual sentence. Others that begin so stay.
COPYRIGHT = rf"^{_OTHER}*(?:copyright{_OTHER}[^\n]*(?:[0-9]{{4}}|\(c\)|©)[^\n]*|(?:\(c\)|©)[^\n]*[0-9]{{4}}[^\n]*|all rights reserved{_OTHER}*)$"
NOT_LETTERS = r"[^\p{L}\p{N}]+"


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of all that is known here: licences with and without their titles, and notices."""
    out = [(n, f"{title}\n{t}") for n, t in KNOWN.items() for title in ("", *TITLES.get(n, ()))]
    out += [(n, t) for n, texts in NOTICES.items() for t in texts]
    return out + [(f"{i} notice", f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS.split()]


def _bare(t: Column) -> Column:
    """Lower-case text without notices of copyright and punctuation; a line's is a part of the whole text's."""
    t = F.regexp_replace(t, f"(?dm){COPYRIGHT}", " ")
    return F.btrim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), NOT_LETTERS, " "))


def _spelled(t: Column) -> Column:
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def normalised(text: Column) -> Column:
    """``text`` as it is compared; empty if nothing is left."""
    return _spelled(_bare(F.lower(text)))


def digest(normal: Column) -> Column:
    return F.when(normal != "", F.sha2(normal, 256))


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, name, length of the line or null) of the known ``texts`` (name, text), by default those of this module."""
    rows = spark.createDataFrame(known_texts(), "name string, text string") if texts is None else texts.select("name", "text")
    k = rows.select("name", normalised(F.col("text")).alias("t"), F.instr(F.btrim("text", F.lit("\n")), "\n").alias("ends"))
    k = k.select("name", digest(F.col("t")).alias("digest"), F.when(F.col("ends") == 0, F.length("t")).alias("length")).filter("digest is not null")
    return k.groupBy("digest").agg(F.min("name").alias("name"), F.max("length").alias("length"))


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, licence, notices) of each row; ``notices``: (line, name) of each line that is a known text.

    Whole texts and lines meet the known digests in hash joins; Spark broadcasts the known ones if they are few. Only lines
    as long as a known one are looked up: these lengths are fewer than the longest known line has characters. What is
    joined is written first, digests without texts.
    """
    spark = docs.sparkSession
    k = known(spark, texts)
    lengths = [r["length"] for r in k.select("length").filter("length is not null").distinct().collect()]
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.transform(F.split(F.lower(F.col(f"`{text_col}`")), "\n"), _bare).alias("lines"))
    whole = digest(_spelled(F.array_join(F.filter("lines", lambda x: x != ""), " ")))
    lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), _spelled(x).alias("text")))
    lines = F.filter(lines, lambda x: F.length(x["text"]).isin(lengths) if lengths else F.lit(False))
    lines = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.sha2(x["text"], 256).alias("digest")))
    d = written(spark, d.select("row", "doc_id", whole.alias("digest"), lines.alias("lines")), "licence-digests", keep=True)
    hits = d.select("row", F.explode("lines").alias("x")).select("row", "x.line", "x.digest").join(k.filter("length is not null"), "digest")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("notices"))
    out = d.join(k.select("digest", F.col("name").alias("licence")), "digest", "left").join(hits, "row", "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("notices", F.array().cast("array<struct<line:int,name:string>>")).alias("notices"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence and notices of every whole text of ``documents``."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "licence", F.size("notices").alias("n_notices"), F.array_join(F.transform("notices", lambda x: x["name"]), "; ").alias("notices"))


def _sql(col: str) -> str:
    t = f"regexp_replace(lower({col}), '(?m){COPYRIGHT}', ' ', 'g')"
    t = f"trim(regexp_replace(replace({t}, '&', ' and '), '{NOT_LETTERS}', ' ', 'g'))"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"nullif({t}, '')"


def _values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())


OP6_SQL = f"""
with known as (select sha256({_sql("body")}) as digest, min(name) as name, bool_or(instr(trim(body, chr(10)), chr(10)) = 0) as is_line from (values {_values()}) as v(name, body) group by 1),
d as (select doc_id, text, sha256({_sql("text")}) as digest from documents),
n as (select doc_id, i, sha256({_sql("line")}) as digest from
      (select doc_id, unnest(range(1, len(x) + 1)) as i, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents))),
h as (select doc_id, count(*) as n, string_agg(name, '; ' order by i) as names from n join known using (digest) where is_line group by doc_id)
select d.doc_id, d.digest, k.name as licence, cast(coalesce(h.n, 0) as int) as n_notices, coalesce(h.names, '') as notices
from d left join known k using (digest) left join h using (doc_id)
"""
