"""Licence texts and notices found by the digest of a canonical form."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, text_of

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = _BSD_2.replace("\n\nTHIS", """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS""")
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _text(name: str) -> str:
    return (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


def _variants(text: str) -> list[str]:
    """The usual forms of one text: links with http or https, and list items with or without numbers."""
    out = [text, text.replace("https://", "http://"), text.replace("http://", "https://")]
    return list(dict.fromkeys(out + [re.sub(r"(?m)^[1-9]\. ", "* ", t) for t in out]))


def _whole() -> list[tuple[str, str, str]]:
    """Entire licence texts and the entire headers of files."""
    texts = [("BSD-3-Clause", "permissive", t + _BSD_3) for t in ("", "BSD 3-Clause License\n\n")] + [("BSD-2-Clause", "permissive", t + _BSD_2) for t in ("", "BSD 2-Clause License\n\n")]
    texts += [("Zlib", "permissive", t + _ZLIB) for t in ("", "zlib License\n\n")] + [("Apache-2.0", "permissive", _APACHE_HEADER), ("MPL-2.0", "weak copyleft", _MPL_HEADER)]
    for name, category, kind in (("GPL", "copyleft", "GNU General"), ("LGPL", "weak copyleft", "GNU Lesser General"), ("AGPL", "copyleft", "GNU Affero General")):
        own = _GPL_HEADER.replace("GNU General", kind)
        texts.append((f"{name}-3.0", category, own))
        if name == "GPL":
            texts.append(("GPL-2.0", category, own.replace("version 3", "version 2")))
    files = (("Apache-2.0", "permissive", "Apache-2.0"), ("BSD-3-Clause", "permissive", "BSD"), ("CC0-1.0", "permissive", "CC0-1.0"), ("GPL-2.0", "copyleft", "GPL-2"), ("GPL-3.0", "copyleft", "GPL-3"), ("LGPL-2.1", "weak copyleft", "LGPL-2.1"), ("LGPL-3.0", "weak copyleft", "LGPL-3"), ("MPL-2.0", "weak copyleft", "MPL-2.0"), ("Unlicense", "permissive", "Unlicense"))
    texts += [(i, c, _text(name)) for i, c, name in files]
    return [(i, c, t) for i, c, text in texts for t in _variants(text)]


#: Fixed values (with `_whole`, `_GPL_HEADER`, the other texts above and `license_texts/`): licence id, category, and a text that states it (whole licence, file header or the usual notice).
KNOWN: tuple[tuple[str, str, str], ...] = (
    ("MIT", "permissive", "MIT License\n\n" + _MIT),
    ("MIT", "permissive", _MIT),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the MIT License."),
    ("ISC", "permissive", "ISC License\n\n" + _ISC),
    ("ISC", "permissive", _ISC),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "weak copyleft", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "weak copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "weak copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "permissive", "This work is dedicated to the public domain under CC0 1.0."),
    *_whole(),
)

#: Spellings that count as one, pattern then the form kept (in lower-case text without punctuation).
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"licence", "license"),
    (r"\bsub[ \n]+licens", "sublicens"),
    (r"\bnon[ \n]+commercial\b", "noncommercial"),
    (r"\bnon[ \n]+infringement\b", "noninfringement"),
    (r"\bcopyright[ \n]+owner", "copyright holder"),
    (r"\bcreative[ \n]+commons[ \n]+attribution\b", "cc by"),
    (r"\bnoncommercial\b", "nc"),
    (r"\bshare[ \n]*alike\b", "sa"),
    (r"\bversion[ \n]+([0-9])", "v$1"),
    (r"\bv[ \n]*([0-9])", "$1"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bper[ \n]+cent\b", "percent"),
    (r"\bauthoris", "authoriz"),
    (r"\bfavour", "favor"),
    (r"\bwhilst\b", "while"),
)
#: The notice at the head of a text: an optional title line, kept, then all lines that state a copyright or reserve rights; such a
#: line goes with up to three of usual width that follow it where a blank line ends them, as a long notice may be wrapped. Possessive
#: repetitions mean the same here as greedy ones and keep the work linear; Java reads any number of lines in a loop.
HEAD = (
    r"\A([^\p{L}\p{N}]*+[^\n]*licen[sc]e(?: \(mit\))?[^\p{L}\p{N}\n]*\n)?[^\p{L}\p{N}©(]*"
    r"(?:(?:copyright\b|\(c\) ?[0-9]|©|all rights reserved)(?:[^\n]*(?:\n[^\n]{1,120}(?:\n[^\n]{1,120}(?:\n[^\n]{1,120})?)?)?\n[^\p{L}\p{N}\n]*\n|[^\n]*(?:\n|$))[^\p{L}\p{N}©(]*)++"
)


def _forms(col: Column) -> Column:
    """Lower case, without a copyright notice at the head, punctuation as single spaces, one spelling; line ends stay."""
    low = F.lower(col)
    low = F.when(low.rlike("copyright|©|\\(c\\)|all rights reserved"), F.regexp_replace(low, HEAD, "$1")).otherwise(low)
    words = F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " ")
    same = words
    for pattern, kept in SPELLINGS:
        same = F.regexp_replace(same, pattern, kept)
    words = F.when(words.rlike("|".join(p for p, _ in SPELLINGS)), same).otherwise(words)
    return F.regexp_replace(words, r" *\n[ \n]*", "\n")


def _form(text: str) -> str:
    """The canonical form of one of the few known texts, on the driver, on one line."""
    low = regex.sub(HEAD, lambda m: m[1] or "", text.lower())
    low = regex.sub(r"[^\p{L}\p{N}\n]+", " ", low)
    for pattern, kept in SPELLINGS:
        low = regex.sub(pattern, kept.replace("$", "\\"), low)
    return regex.sub(r" *\n[ \n]*", " ", low).strip(" ")


def by_form(known: tuple[tuple[str, str, str], ...] | None = None) -> dict[str, str]:
    """The licence id of each known form; the first of equal ones counts."""
    out: dict[str, str] = {}
    for name, _, text in known or KNOWN:
        out.setdefault(_form(text), name)
    return out


def known_digests(known: tuple[tuple[str, str, str], ...] = KNOWN) -> list[tuple[str, str, str, int]]:
    """(digest, licence id, category, length of the form) of each known text; the first of equal forms counts."""
    out: dict[str, tuple[str, str, str, int]] = {}
    for name, category, text in known:
        form = _form(text)
        key = hashlib.md5(form.encode()).hexdigest()
        out.setdefault(key, (key, name, category, len(form)))
    return list(out.values())


def known_table(spark: SparkSession, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    return spark.createDataFrame(known_digests(known), "digest string, license_id string, category string, form_chars int")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """One row per input row: doc_id, digest, license_id, category, notices, n_notices.

    The whole text's canonical form (case, punctuation, line ends and equivalent spellings made one, without the copyright
    notice at its head) is hashed
    and joined to the known digests: license_id and category are null where no known licence is the entire text. Each
    line is an entire text of its own too, as notices stand inside other prose: `notices` has the sorted distinct
    licence ids of such lines joined by commas (empty for none) and n_notices their number of lines. Only lines as
    long as a known form are hashed, which loses none. The known table is a constant of the program, so it is
    broadcast; no row is shuffled.

    Null and empty texts have the digest of the empty form and match nothing; repeated rows give repeated results; a null
    id is carried through; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    table = known_digests(known)
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text")).select("doc_id", _forms(text_of(F.col("text"))).alias("form"))
    lengths = sorted({row[3] for row in table})
    by_digest = F.create_map(*(F.lit(x) for row in table for x in row[:2])) if table else F.create_map().cast("map<string,string>")
    lines = F.transform(F.split("form", "\n"), lambda x: F.trim(x))
    found = F.filter(F.transform(F.filter(lines, lambda x: F.length(x).isin(lengths)), lambda x: by_digest[F.md5(x.cast("binary"))]), lambda x: x.isNotNull())
    whole = F.trim(F.translate(F.col("form"), "\n", " "))
    rows = rows.select("doc_id", F.md5(whole.cast("binary")).alias("digest"), found.alias("found"))
    out = rows.join(F.broadcast(known_table(spark, known).select("digest", "license_id", "category")), "digest", "left")
    return out.select("doc_id", "digest", "license_id", "category", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))
