"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case; copyright lines dropped; equivalent spellings made
one; every run of other characters than letters a-z and digits a space. SHA-256 digests of the canonical
whole text, of its paragraphs and lines, and of runs of paragraphs are hash-joined to the digests of known licence
texts and notices, brought to the same form. A run is looked at where a paragraph has the digest of a known text's first one, and
is as many paragraphs long as that text, so that a whole licence is found between other paragraphs.

The known texts are the fixed lists below, so the broadcast side has a constant size; known_digests() also takes texts of one's own.
In full are known: MIT, ISC, Zlib, BSD-2-Clause, BSD-3-Clause, 0BSD, BSL-1.0, Unlicense, WTFPL by text, and Apache-2.0, Artistic-1.0, CC0-1.0, GFDL-1.2 and
-1.3, GPL-1.0, -2.0 and -3.0, LGPL-2.0, -2.1 and -3.0, MPL-1.1 and -2.0 by digest; others by the notices that name them.

Null and empty texts, and units without letters or digits, match nothing. Texts of any length are scanned whole. A
text with one line is found as a text, a paragraph and a line. Rows with equal ids are counted together; a null id is a
group of its own. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import table

#: Known notices and licence texts, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD2 = f"{_BSD_HEAD}\n{_WARRANTY}"
BSD3 = f"""{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_WARRANTY}"""
BSD0 = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
KNOWN = [
    ("BSD-2-Clause", BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD2), ("BSD-3-Clause", BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD3), ("0BSD", BSD0), ("0BSD", "BSD Zero Clause License\n\n" + BSD0),
    ("BSL-1.0", BOOST), ("Unlicense", UNLICENSE), ("WTFPL", WTFPL), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("0BSD", "SPDX-License-Identifier: 0BSD"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"), ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    *((i, f"{a} under {t}.") for i, t in (("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC0-1.0", "CC0 1.0"), ("Unlicense", "the Unlicense"), ("Zlib", "the zlib License")) for a in ("Released", "This project is licensed")),
    *((i, f"SPDX-License-Identifier: {t}") for i, t in (("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("MPL-2.0", "MPL-2.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"))),
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("ISC", "Released under the ISC License."), ("ISC", "Licensed under the ISC License."), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB), ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Spellings that count as one, in the canonical form.
SPELLINGS = [
    ("licence", "license"), ("organisation", "organization"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
]
#: Longer licence texts, by the number of their paragraphs and the digests of their first paragraph and of the whole.
KNOWN_LONG: list[tuple[str, int, str, str]] = [
    ("Apache-2.0", 32, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0", 29, "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 13, "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 57, "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", 67, "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", 50, "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 59, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 122, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 83, "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 85, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 37, "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 73, "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 83, "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright *(\(c\)|©|[0-9]|by |<|\[|:)|\(c\) *[0-9]|©)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form, with its line ends."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text), F.lit("\n")), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, r"[^a-z0-9\n]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")


def paragraphs_of(c: str) -> Column:
    return F.filter(F.transform(F.split(c, r"\n *\n"), lambda p: joined(F.split(p, "\n"))), lambda x: x != "")


def known_digests(spark: SparkSession, more: list[tuple[str, str]] = ()) -> DataFrame:
    """(license_id, n, head, digest): paragraphs, digests of the first and of all; more: (license_id, text) of one's own."""
    rows = spark.createDataFrame([*KNOWN, *more], "license_id string, text string").withColumn("c", canonical(F.col("text"))).withColumn("p", paragraphs_of("c"))
    own = rows.select("license_id", F.size("p").alias("n"), F.sha2(F.get("p", F.lit(0)), 256).alias("head"), F.sha2(joined(F.split("c", "\n")), 256).alias("digest"))
    return own.union(spark.createDataFrame(KNOWN_LONG, "license_id string, n int, head string, digest string")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[tuple[str, str]] = ()) -> DataFrame:
    """docs -> (id_col, license_id, scope, n): units of each scope (text, run of paragraphs, paragraph, line) that equal a known licence."""
    known = known_digests(docs.sparkSession, more)
    # Few rows of fixed size: the first digests of texts of several paragraphs, by number of paragraphs.
    heads: dict[int, list[str]] = {}
    for r in known.where("n > 1").select("n", "head").distinct().collect():
        heads.setdefault(r["n"], []).append(r["head"])
    rows = docs.select(F.col(id_col).alias("__id"), canonical(F.col(text_col)).alias("c")).where("c is not null")
    rows = rows.withColumn("p", paragraphs_of("c")).withColumn("d", F.transform("p", lambda x: F.sha2(x, 256)))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    unit = lambda scope, digest: F.struct(F.lit(scope).alias("scope"), digest.alias("digest"))
    whole = F.transform(F.filter(F.array(joined(F.split("c", "\n"))), lambda x: x != ""), lambda u: unit("text", F.sha2(u, 256)))
    starts = lambda k: F.filter(F.transform("d", lambda x, i: F.when(x.isin(heads[k]) & (i + k <= F.size("p")), i)), lambda i: i.isNotNull())
    any_head = F.exists("d", lambda x: x.isin(sorted({h for own in heads.values() for h in own})))
    run_at = lambda k: lambda i: unit("run", F.sha2(F.array_join(F.slice("p", i + 1, F.lit(k)), " "), 256))
    runs = F.concat(*(F.transform(starts(k), run_at(k)) for k in sorted(heads)))
    none = F.array().cast("array<struct<scope:string,digest:string>>")
    units = F.concat(whole, F.transform("d", lambda x: unit("paragraph", x)), F.transform(lines, lambda u: unit("line", F.sha2(u, 256))), F.when(any_head, runs).otherwise(none))
    units = rows.select("__id", F.explode(units).alias("u"))
    found = units.select("__id", "u.scope", "u.digest").join(F.broadcast(known.select("license_id", "digest").distinct()), "digest")
    return found.groupBy(F.col("__id").alias(id_col), "license_id", "scope").agg(F.count("*").alias("n"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(chr(10) || lower(%s) || chr(10), {quote(COPYRIGHT_LINE)}, chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, {quote(a)}, {quote(b)})"
    join = "array_to_string(list_filter(list_transform(string_split(%s, chr(10)), lambda y: trim(y)), lambda y: y <> ''), ' ')"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(c, '\\n *\\n'), lambda q: {join % 'q'}), lambda q: q <> '')"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    long = ", ".join(f"({quote(i)}, {n}, {quote(h)}, {quote(d)})" for i, n, h, d in KNOWN_LONG)
    return f"""
WITH forms AS (SELECT license_id, {form % "text"} c FROM (VALUES {known}) k(license_id, text)),
known AS (SELECT license_id, len({paragraphs}) n, sha256(({paragraphs})[1]) head, sha256({join % "c"}) digest FROM forms UNION SELECT * FROM (VALUES {long}) l(license_id, n, head, digest)),
c AS (SELECT row_number() OVER () k, doc_id, {form % "text"} c FROM documents WHERE text IS NOT NULL),
p AS (SELECT k, doc_id, {paragraphs} p FROM c),
places AS (SELECT k, doc_id, p, unnest(range(1, len(p) + 1)) i FROM p),
heads AS (SELECT DISTINCT n, head FROM known WHERE n > 1),
u AS (
  SELECT doc_id, 'text' AS "scope", {join % "c"} t FROM c
  UNION ALL SELECT doc_id, 'paragraph', p[i] FROM places
  UNION ALL SELECT doc_id, 'run', array_to_string(p[i:i + n - 1], ' ') FROM places JOIN heads ON sha256(p[i]) = head AND i + n - 1 <= len(p)
  UNION ALL SELECT doc_id, 'line', trim(l) FROM (SELECT doc_id, unnest(string_split(c, chr(10))) l FROM c))
SELECT doc_id, license_id, "scope", count(*) n FROM u JOIN (SELECT DISTINCT license_id, digest FROM known) known ON sha256(u.t) = known.digest WHERE t <> '' GROUP BY ALL
"""


OP6_SQL = _sql()
