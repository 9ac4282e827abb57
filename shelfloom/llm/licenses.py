"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (ASCII case, copyright lines, equivalent spellings, punctuation and white space), its
SHA-256 is taken, and the digest is joined to those of known licences and notices. Whole texts are looked up, and each of
their lines too, since a notice often stands on a line of its own.
"""

from __future__ import annotations

from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ’‘“”–—", "abcdefghijklmnopqrstuvwxyz''\"\"--"
#: A line that begins with a copyright sign, or with the word and holds a year or a sign; not a line of terms about a copyright notice.
COPYRIGHT = r"(^|\n)[ \t]*(\(c\)|©|copyright[ \t]+by |copyright[^\n]*([0-9]{4}|\(c\)|©))[^\n]*"
#: Equivalent spellings: fixed values, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("http:", "https:"), ("organisation", "organization"), ("whilst", "while"), ("favour", "favor"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"),
)
SIGNS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Licences whose full texts lie in license_texts, and where their terms end if an appendix follows.
_TEXTS = (
    ("Apache-2.0", "Apache-2.0", "APPENDIX: How to apply"), ("GPL-1.0", "GPL-1", "Appendix: How to Apply"), ("GPL-2.0", "GPL-2", "How to Apply These Terms"), ("GPL-3.0", "GPL-3", "How to Apply These Terms"),
    ("LGPL-2.0", "LGPL-2", "How to Apply These Terms"), ("LGPL-2.1", "LGPL-2.1", "How to Apply These Terms"), ("LGPL-3.0", "LGPL-3", ""), ("MPL-1.1", "MPL-1.1", ""), ("MPL-2.0", "MPL-2.0", ""),
    ("CC0-1.0", "CC0-1.0", ""), ("GFDL-1.2", "GFDL-1.2", "ADDENDUM: How to use"), ("GFDL-1.3", "GFDL-1.3", "ADDENDUM: How to use"), ("Artistic-1.0-Perl", "Artistic", ""),
)


def _full_texts() -> list[tuple[str, str]]:
    out = []
    for name, file, appendix in _TEXTS:
        text = files(__package__).joinpath("license_texts", f"{file}.txt").read_text("utf-8")
        out.append((name, text))
        if appendix and appendix in text:
            terms = text[: text.rindex(appendix)].rstrip()
            out.append((name, terms))
            if terms.endswith("END OF TERMS AND CONDITIONS"):
                out.append((name, terms.removesuffix("END OF TERMS AND CONDITIONS")))
    return out


def _gnu(short: str, title: str, version: str) -> list[tuple[str, str]]:
    """Names of a GNU licence's version, alone and with later ones; the canonical form knows no signs."""
    spelled = dict.fromkeys((version, version.removesuffix(".0")))
    base = [f"{head} {word}{v}" for head in (title, f"GNU {title}", f"GNU {short}", short) for v in spelled for word in ("", "v", "version ")]
    base += [f"{head}v{v}" for head in (short, f"GNU {short}") for v in spelled]
    later = ("or later", "or any later version", "or (at your option) any later version")
    return [(f"{short}-{version}", x) for x in base] + [(f"{short}-{version}-or-later", f"{x} {y}") for x in base for y in later]


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _creative_commons(kind: str, version: str) -> list[tuple[str, str]]:
    ends = ("", *({"3.0": (" Unported",), "4.0": (" International",)}.get(version, ())))
    heads = (f"CC {kind}", f"Creative Commons {kind}", f"Creative Commons CC {kind}", f"Creative Commons {_CC[kind]}")
    names = [f"{h} {version}{e}" for h in heads for e in ends]
    return [(f"CC-{kind}-{version}", x) for x in (*names, f"{names[-1]} (CC {kind} {version})")]


#: Names of licences, as notices spell them.
NAMES = (
    *(("Apache-2.0", x) for x in ("Apache 2.0", "Apache 2", "Apache v2", "Apache v2.0", "Apache Version 2.0", "Apache License 2.0", "Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache License, Version 2", "Apache License v2.0", "Apache License v2", "Apache Software License 2.0", "Apache Software License, Version 2.0")),
    *(("MIT", x) for x in ("MIT", "MIT License (MIT)", "Expat")), *(("ISC", x) for x in ("ISC",)), *(("Zlib", x) for x in ("zlib",)), *(("0BSD", x) for x in ("0BSD", "BSD Zero Clause", "Zero-Clause BSD")),
    *((f"BSD-{n}-Clause", x) for n, w, k in ((2, "Two", "Simplified"), (3, "Three", "New")) for x in (f"BSD {n}-Clause", f"{n}-Clause BSD", f"{w}-Clause BSD", f"{k} BSD", f'BSD {n}-Clause "{k}"')), ("BSD-3-Clause", "Modified BSD"), ("BSD-3-Clause", "Revised BSD"), ("BSD-2-Clause", "FreeBSD"),
    *_gnu("GPL", "General Public License", "1.0"), *_gnu("GPL", "General Public License", "2.0"), *_gnu("GPL", "General Public License", "3.0"), *_gnu("LGPL", "Library General Public License", "2.0"), *_gnu("LGPL", "Lesser General Public License", "2.1"),
    *_gnu("LGPL", "Lesser General Public License", "3.0"), *_gnu("AGPL", "Affero General Public License", "3.0"), *_gnu("GFDL", "Free Documentation License", "1.2"), *_gnu("GFDL", "Free Documentation License", "1.3"),
    *((f"{k}-{v}", x) for k, t, vs in (("MPL", "Mozilla Public License", ("1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("BSL", "Boost Software License", ("1.0",))) for v in vs for x in (f"{k} {v}", f"{k} v{v}", f"{t} {v}", f"{t} v{v}", f"{t}, Version {v}", f"{t}, v. {v}", f"{t} {v} ({k} {v})")),
    *(x for v in ("2.0", "2.5", "3.0", "4.0") for k in _CC for x in _creative_commons(k, v)),
    *(("CC0-1.0", x) for x in ("CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0", "Creative Commons CC0 1.0", "Creative Commons CC0 1.0 Universal")),
    ("Unlicense", "Unlicense"), ("Artistic-2.0", "Artistic License 2.0"), ("WTFPL", "WTFPL"),
)
SUBJECTS = ("work", "program", "software", "file", "project", "code", "library", "package", "document", "content", "dataset")
LEADS = tuple(f"{x} under" for x in ("Licensed", "Released", "Distributed", "Permission is hereby granted", *(f"This {a} is licensed" for a in SUBJECTS)))
_IDS = tuple(dict.fromkeys(i for i, _ in NAMES))
#: Identifiers of SPDX lines.
SPDX = tuple((i, i) for i in _IDS) + tuple((i, f"{i}-only") for i in _IDS if i.startswith(("GPL", "LGPL", "AGPL", "GFDL")) and "later" not in i)


def notices() -> list[tuple[str, str]]:
    """Every lead-in with every name, with and without an article and the word license; and SPDX lines."""
    named = dict.fromkeys((i, f"{a}{x}{z}") for i, x in NAMES for a in ("", "the ", *(["a "] if x.startswith("Creative") else [])) for z in ("", " license") if not (z and ("License" in x or "later" in x)))
    return [(i, f"{lead} {x}.") for lead, (i, x) in product(LEADS, named)] + [(i, f"SPDX-License-Identifier: {x}") for i, x in SPDX]


#: Known licences and notices: fixed values.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("0BSD", _ZERO), ("0BSD", "Zero-Clause BSD\n" + _ZERO),
    ("BSD-2-Clause", _BSD.format(third="")), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD.format(third="")), ("BSD-3-Clause", _BSD.format(third=_THIRD)), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD.format(third=_THIRD)),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Permission is hereby granted under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "Released under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    *_full_texts(), *notices(),
)


#: Rows of known digests (some hundred bytes each) that may be broadcast.
BROADCAST = 200_000


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty ones; a null text has none."""
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT, "\n")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, SIGNS, " ")
    return F.coalesce(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def known_digests(spark: SparkSession) -> DataFrame:
    """license_id, digest, size (characters of the canonical text) of the known licences: a fixed list of some tens of thousands of short rows, of the same size for any input."""
    # one literal for all; the separators are in no text
    rows = F.explode(F.split(F.lit("\x1e".join(f"{a}\x1f{b}" for a, b in KNOWN)), "\x1e"))
    pair = spark.range(1).select(rows.alias("pair")).select(F.split("pair", "\x1f").alias("pair"))
    known = pair.select(F.col("pair")[0].alias("license_id"), F.array_join(canonical_lines(F.col("pair")[1]), " ").alias("t"))
    return known.select("license_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("size")).distinct()


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each document and known licence that its whole text or one of its lines equals in canonical form.

    doc_id, license_id, whole (does the whole text equal it), n_lines (lines that do). Documents without a known licence,
    and null or empty texts, give no row. Rows with the same doc_id (or none) count together, each repeated row once more; an
    empty table gives no rows; texts of any length are whole; other columns are ignored. Only texts and lines no longer than
    the longest known one are hashed. `known` is broadcast if it has at most BROADCAST rows, else joined by digest.
    """
    span, rows = known.agg(F.max("size"), F.count("*")).first()
    span = span or 0
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), F.array_join("lines", " ").alias("t"))
    single = F.transform(F.filter("lines", lambda x: F.length(x) <= span), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t")))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), single)).alias("u")).select("doc_id", "u.whole", F.col("u.t").alias("t")).where(F.length("t") <= span)
    ids = known.select("license_id", "digest")
    hit = units.select("doc_id", "whole", F.sha2("t", 256).alias("digest")).join(F.broadcast(ids) if rows <= BROADCAST else ids, "digest")
    return hit.groupBy("doc_id", "license_id").agg(F.max("whole").alias("whole"), F.sum((~F.col("whole")).cast("long")).alias("n_lines"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices in all documents."""
    prepared(spark)
    return license_scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_lines(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate({text}, {quoted(UPPER)}, {quoted(LOWER)})"
    t = f"regexp_replace({t}, {quoted(COPYRIGHT)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    return f"list_filter(list_transform(string_split(regexp_replace({t}, {quoted(SIGNS)}, ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def op2_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
with known as (select distinct license_id, sha256(array_to_string({_sql_lines("text")}, ' ')) as digest from (values {values}) k(license_id, text)),
lines as (select doc_id, {_sql_lines("text")} as l from documents where text is not null),
units as (select doc_id, true as whole, array_to_string(l, ' ') as t from lines union all select doc_id, false, unnest(l) from lines)
select doc_id, license_id, max(whole) as whole, sum(case when whole then 0 else 1 end)::bigint as n_lines
from units join known on sha256(t) = digest group by doc_id, license_id"""
