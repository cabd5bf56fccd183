"""Licence scan by canonical digest, in DataFrame operations alone.

A text is normalised (case, punctuation, white space, copyright lines and equivalent spellings), and its SHA-256 is
hash-joined to the digests of known licences, normalised alike. That is done for entire texts; the lines of a text
are looked up the same way among known one-line notices.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equivalent spellings, applied in this order after lower-casing.
SPELLINGS = [
    ("\u2010", "-"), ("\u2011", "-"), ("©", "(c)"), ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("https://", "http://"), ("per cent", "percent"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("favour", "favor"), ("behaviour", "behavior"), ("fulfilment", "fulfillment"),
    ("copyright owner", "copyright holder"),
]
#: One-line notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY}"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Entire texts.
TEXTS = {
    "MIT": [_MIT, f"MIT License\n{_MIT}", f"The MIT License (MIT)\n{_MIT}"],
    "ISC": [_ISC, f"ISC License\n{_ISC}"],
    "BSD-2-Clause": [f"{_BSD_START}\n{_BSD_END}", f"BSD 2-Clause License\n{_BSD_START}\n{_BSD_END}"],
    "BSD-3-Clause": [f"{head}{_BSD_START}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}" for head in ("", "BSD 3-Clause License\n")],
}
_END = "END OF TERMS AND CONDITIONS"
for _file in sorted(resources.files(__package__).joinpath("texts").iterdir(), key=lambda x: x.name):  # as Debian ships them; also without what follows the terms
    _text = _file.read_text("utf-8")
    TEXTS.setdefault(_file.name.removesuffix(".txt"), []).extend([_text] + ([_text[: _text.index(_END) + len(_END)]] if _END in _text else []))


#: No-break space, guillemets, general punctuation, ideographic space and stops, byte order mark; in a character class.
_TYPOGRAPHIC = "\u00a0\u00ab\u00bb\u2000-\u206f\u3000-\u3002\ufeff"


def normalized(text: Column) -> Column:
    """Lower-cased lines with one spelling, without copyright lines; other runs of punctuation or space are one space.

    Typographic punctuation and spaces (curly quotes, dashes, no-break spaces, guillemets) count like any other.
    """
    out = F.lower(text)
    for was, becomes in SPELLINGS:
        out = F.replace(out, F.lit(was), F.lit(becomes))
    out = F.regexp_replace(out, r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|[0-9]{4})|\(c\)[^a-z0-9\n]*[0-9]{4}|all rights reserved)[^\n]*$", "")
    return F.regexp_replace(out, rf"[\x00-\x09\x0B-\x20!-/:-@\[-`{{-\x7F{_TYPOGRAPHIC}]+", " ")


def digest(lines: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(lines, "[ \n]+", " ")), 256)


def registry(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """license_id, digest, size of known texts."""
    rows = [(name, x) for name, some in texts.items() for x in some]
    lines = normalized(F.col("x"))
    return spark.createDataFrame(rows, "license_id string, x string").select("license_id", digest(lines).alias("known"), F.length(F.trim(lines)).alias("size"))


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """Adds digest, license_id (of the entire text) and notices (ids of lines that are notices, sorted, comma between).

    A null text has a null digest and no licence; an empty text has the digest of nothing and no licence. Two known
    texts with one digest give the id that sorts first. Repeated rows stay; columns of the names added are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("digest", "license_id", "notices")
    names = docs.columns
    lines_name, known_name = common.free(names, "lines"), common.free([*names, "digest", "license_id"], "known_digest")
    whole = registry(spark, (known or TEXTS) | {}).unionByName(registry(spark, notices or NOTICES)).groupBy("known").agg(F.min("license_id").alias("license_id"))
    one = registry(spark, notices or NOTICES).groupBy("known").agg(F.min("license_id").alias("license_id"), F.first("size").alias("size")).collect()  # as many as notices are known
    ids = F.create_map(*[F.lit(v) for r in one for v in (r.known, r.license_id)]) if one else F.create_map().cast("map<string,string>")
    low, high = min((r["size"] for r in one), default=0), max((r["size"] for r in one), default=-1)
    ready = docs.withColumn(lines_name, normalized(F.col(text)))
    fitting = F.filter(F.split(F.col(lines_name), "\n"), lambda x: F.length(x).between(low, high + 2))
    found = F.filter(F.transform(fitting, lambda x: ids[digest(x)]), lambda x: x.isNotNull())
    marked = ready.select(*names, digest(F.col(lines_name)).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    whole = whole.withColumnRenamed("known", known_name)
    many = sum(map(len, (known or TEXTS).values())) > 100_000
    joined = marked.join(whole if many else F.broadcast(whole), F.col("digest") == F.col(known_name), "left")  # as many as texts are known
    return joined.select(*names, "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: licence of every document's entire text, and of its lines."""
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license_id", "notices")


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def norm(x: str) -> str:
        out = f"lower({x})"
        for was, becomes in SPELLINGS:
            out = f"replace({out}, {quote(was)}, {quote(becomes)})"
        out = rf"regexp_replace({out}, '(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|[0-9]{{4}})|\(c\)[^a-z0-9\n]*[0-9]{{4}}|all rights reserved)[^\n]*$', '', 'g')"
        return rf"regexp_replace({out}, '[\x00-\x09\x0B-\x20!-/:-@\[-`{{-\x7F{_TYPOGRAPHIC}]+', ' ', 'g')"

    dig = lambda x: rf"sha256(trim(regexp_replace({x}, '[ \n]+', ' ', 'g')))"
    rows = lambda t: ", ".join(f"({quote(k)}, {quote(x)})" for k, some in t.items() for x in some)
    return f"""
WITH w AS (SELECT {dig("n")} AS known, min(id) AS license_id FROM (SELECT id, {norm("x")} AS n FROM (VALUES {rows(TEXTS)}, {rows(NOTICES)}) v(id, x)) q GROUP BY 1),
o AS (SELECT {dig("n")} AS known, min(id) AS id FROM (SELECT id, {norm("x")} AS n FROM (VALUES {rows(NOTICES)}) v(id, x)) q GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {norm("text")} AS n FROM documents),
l AS (SELECT rid, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM (SELECT rid, unnest(string_split(n, chr(10))) AS x FROM d) y JOIN o ON {dig("x")} = o.known GROUP BY rid)
SELECT doc_id, {dig("n")} AS digest, license_id, coalesce(notices, '') AS notices FROM d LEFT JOIN l ON d.rid = l.rid LEFT JOIN w ON {dig("n")} = w.known
"""
