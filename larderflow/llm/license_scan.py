"""Licence scan by canonical digest lookup (native).

Texts are brought to a canonical form and their digests hash-joined to those of
known licence texts. What is looked up is always an entire text: a whole
document, and each of its lines as a text of its own, which finds notices that
are a line of something longer.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests up to this many are broadcast.
BROADCAST_ROWS = 100_000

#: Names as in the public licence list, and for each short name its long name.
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0",
    "MIT": "MIT License",
    "BSD-2-Clause": 'BSD 2-Clause "Simplified" License',
    "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License',
    "ISC": "ISC License",
    "GPL-2.0-only": "GNU General Public License, version 2",
    "GPL-3.0-only": "GNU General Public License, version 3",
    "LGPL-2.1-only": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-only": "GNU Lesser General Public License, version 3",
    "AGPL-3.0-only": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "Unlicense": "The Unlicense",
    "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}
#: Notices that name a licence; {} is its long name.
NOTICES = (
    "{}",
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under {}.",
    "This file is licensed under the {}.",
    "This software is licensed under the {}.",
    "This project is licensed under the {}.",
    "SPDX-License-Identifier: {}",
)
#: Full texts of short public licences.
TEXTS = {
    "MIT": (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
}
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
)
#: Full texts of two more short public licences.
MORE_TEXTS = {
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        'copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any "
        "person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, "
        "this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
#: Licences whose full texts are files, and the line from which on a copy may lack the appendix; the second tells if that line stays.
FILES = {
    "Apache-2.0": ("   APPENDIX: How to apply", False),
    "GPL-2.0-only": ("END OF TERMS AND CONDITIONS", True),
    "GPL-3.0-only": ("END OF TERMS AND CONDITIONS", True),
    "LGPL-2.1-only": ("END OF TERMS AND CONDITIONS", True),
    "LGPL-3.0-only": None,
    "MPL-2.0": None,
    "CC0-1.0": None,
}
#: The notices that GNU licences tell to put in files: licence, its name, its version, what it covers.
GNU_HEADERS = (
    ("GPL-2.0-or-later", "GNU General Public License", "2", "program"),
    ("GPL-3.0-or-later", "GNU General Public License", "3", "program"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0-or-later", "GNU Lesser General Public License", "3", "library"),
    ("AGPL-3.0-or-later", "GNU Affero General Public License", "3", "program"),
)
_GNU_GRANT = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_WARRANTY = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
_GNU_COPY = "You should have received a copy of the {name} along with this {what}"
#: What follows the last sentence of a GNU notice.
_GNU_ENDS = (
    ". If not, see <https://www.gnu.org/licenses/>.",
    "; if not, see <https://www.gnu.org/licenses/>.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
#: Equivalent spellings, as words of canonical text: each becomes the second.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("https", "http"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)
#: A line, in lower case, that says who holds the rights and since when.
COPYRIGHT = r"^[ \t]*((portions )?copyright\b[ \t:,]*(\(c\)|©|[0-9]|by\b).*|(\(c\)|©).*|all rights reserved\.?[ \t\r]*)$"
#: A copyright line holds one of these; what holds none needs no pattern match.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")
PUNCTUATION = r"[^\p{L}\p{N}]+"


def _plain_line(line: Column) -> Column:
    """A line in lower case with punctuation and space as one space; '' for a copyright line."""
    low = F.lower(line)
    marked = low.contains(COPYRIGHT_MARKS[0])
    for mark in COPYRIGHT_MARKS[1:]:
        marked = marked | low.contains(mark)
    plain = F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), PUNCTUATION, " "))
    return F.when(marked & low.rlike(COPYRIGHT), F.lit("")).otherwise(plain)


def plain_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _plain_line)


def one_spelling(plain: Column) -> Column:
    # spaces around each word keep a spelling from matching inside another
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    for old, new in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(padded)


def whole(lines: Column) -> Column:
    """The canonical text of a document: its plain lines that aren't empty, in one spelling."""
    return one_spelling(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def _bsd() -> list[tuple[str, str]]:
    """The two BSD licences with their conditions numbered, bulleted or plain, with and without a title."""
    out = []
    for key, n in (("BSD-2-Clause", 2), ("BSD-3-Clause", 3)):
        for title in ("", NAMES[key], f"BSD {n}-Clause License"):
            for mark in ("", "{}. "):
                for owner in ("HOLDER", "HOLDERS", "OWNER"):
                    conditions = [mark.format(i + 1) + c for i, c in enumerate(_BSD_CONDITIONS[:n])]
                    out.append(("\n\n".join([title, _BSD_GRANT, *conditions, _BSD_WARRANTY.format(owner)]), key))
    return out


def _files() -> list[tuple[str, str]]:
    out = []
    for key, end in FILES.items():
        text = resources.files(__package__).joinpath("licenses", f"{key}.txt").read_text(encoding="utf-8")
        out.append((text, key))
        if end:
            before, line, _ = text.partition(end[0])
            out.append((before + line * end[1], key))
    return out


def _headers() -> list[tuple[str, str]]:
    out = [(_MPL_HEADER, "MPL-2.0")]
    for key, name, version, covers in GNU_HEADERS:
        for what in dict.fromkeys((covers, "program")):
            parts = [p.format(name=name, version=version, what=what) for p in (_GNU_GRANT, _GNU_WARRANTY, _GNU_COPY)]
            out += [("\n\n".join(parts) + end, key) for end in _GNU_ENDS]
    return out


def known_texts() -> list[tuple[str, str]]:
    """(text, licence): every notice for every name, the full texts and the notices of several sentences."""
    out = [(n.format(form), key) for key, name in NAMES.items() for n in NOTICES for form in dict.fromkeys((name, key))]
    out += [(n.format(f"{key} license"), key) for key in ("MIT", "ISC") for n in NOTICES]
    return out + [(text, key) for key, text in (TEXTS | MORE_TEXTS).items()] + _bsd() + _files() + _headers()


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license``: one row per canonical known text. A few hundred rows, whatever the input is."""
    rows = spark.createDataFrame(known_texts(), "text string, license string")
    rows = rows.select("license", F.sha2(whole(plain_lines(F.col("text"))), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, canonical_sha256, license, n_notices, line_licenses``.

    ``license`` is that of the entire text, null where it is none that is known.
    ``n_notices`` counts lines that are a known text, ``line_licenses`` names
    their licences, distinct, in order, comma-separated ('' for none). Null text
    counts as empty, an empty canonical text is no licence, rows are told apart
    by their place in the input, and an empty table gives no rows. ``known``
    (``digest, license``) is broadcast if it is small and joined by shuffle if
    not; of the documents, only digests are ever shuffled.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.filter(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known.hint("merge")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), plain_lines(F.col("text")).alias("lines")
    )
    units = F.concat(F.array(whole(F.col("lines"))), F.transform("lines", one_spelling))
    units = rows.select("row", "doc_id", F.posexplode(units).alias("at", "unit"))
    units = units.select("row", "doc_id", "at", F.sha2("unit", 256).alias("digest")).join(known, "digest", "left")
    # a document's units are in one task, so the partial aggregate sends one row per document
    found = units.filter((F.col("at") == 0) | F.col("license").isNotNull()).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("at") == 0, F.col("digest"))).alias("canonical_sha256"),
        F.max(F.when(F.col("at") == 0, F.col("license"))).alias("license"),
        F.count(F.when(F.col("at") > 0, 1)).alias("n_notices"),
        F.collect_set(F.when(F.col("at") > 0, F.col("license"))).alias("names"),
    )
    return found.select("doc_id", "canonical_sha256", "license", "n_notices", F.array_join(F.array_sort("names"), ",").alias("line_licenses"))
