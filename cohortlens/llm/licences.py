"""Licence scans by canonical digest.

A text is brought into a canonical form - lower case, copyright lines removed,
equivalent spellings made one, everything but letters and digits turned into
single spaces - and the SHA-256 of all of it is looked up among the digests of
known licences with a hash join. Whole documents are matched against whole
licences, and so are single lines against licence notices ("Licensed under the
Apache License, Version 2.0."), which stand for the licence they name.

The whole texts are those of ``TEXTS`` and of the files in ``licence_texts``
(named after the licence), in the editions that are spread. AGPL-3.0, CC-BY-4.0
and CC-BY-NC-4.0 are known by their notices only; their texts can be given as
``more``.

DataFrame functions only. The known digests are a fixed list of some hundred
rows (nearly all are notices) and are broadcast; a documents table is read for its digests and nothing
of a text is shuffled. A user's own licences (id, text) can be added; if they are
more than ``BROADCAST_ROWS`` the join is left to the optimiser.

Defined results: NULL and empty texts have the digest of the empty canonical
form, which matches nothing. Rows with the same doc_id share the notices of
all of them. A line that goes on with a word of ``SENTENCE_WORDS``
after "copyright" ("copyright notice") is no copyright line, and stays; so does
"(c)" before a word that starts a list item. A text that equals several known licences (none of the built-in
ones) has the first id. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import lower_ascii

BROADCAST_ROWS = 100_000

# Spellings that count as the same word (public matching guidelines).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
    ("http", "https"),
)

# Names of licences as notices write them.
NAMES = (
    ("0BSD", ("BSD Zero Clause License",)),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPL-2.0", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPL-3.0", "GPLv3")),
    ("ISC", ("ISC License",)),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3")),
    ("MIT", ("MIT License",)),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0")),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("zlib License",)),
)

# How notices put it.
NOTICES = (
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under {}.",
    "Released under the {}.",
    "This work is licensed under {}.",
    "This work is licensed under the {}.",
    "Distributed under the {}.",
    "SPDX-License-Identifier: {}",
)

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
{_NO_WARRANTY}"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

# Whole licence texts and header notices, without their copyright lines; with and without a title.
TEXTS = (
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("0BSD", f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("Apache-2.0", _APACHE_HEADER),
    ("BSD-2-Clause", f"{_BSD_TWO}\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_TWO}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TWO}\n{_BSD_THREE}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_TWO}\n{_BSD_THREE}\n{_BSD_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("MPL-2.0", _MPL_HEADER),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n{_ZLIB}"),
)

#: Whole licences as files, "<id>.txt" or "<id>.<edition>.txt"; read by the driver only
TEXT_FILES = Path(__file__).parent / "licence_texts"

# Words after "copyright" or "(c)" at the start of a line that is a sentence or a list item.
SENTENCE_WORDS = (
    "a act all an and any are as at be but can conditions disclaimer disclaimers doctrine doctrines for from grant has have "
    "holder holders if in including infringement interest interests is it its law laws license licensed licensee licenses "
    "licensing licensor may must not notice notices of on or other otherwise owner owners ownership permission permissions "
    "policy protected protection resulting right rights shall so statement statements status such term terms that this to "
    "treaties treaty under unless was were when where which who will with work works would you your"
).split()
# Words after "the" that make it a sentence; other words are taken for the name of a holder.
THINGS = (
    "copyright covered documentation file files holder holders library license licensed licensor material notice owner owners "
    "program rights software source terms text work works"
).split()
# Words that start a list item "(c) ..."; these follow the mark in known texts or are common there.
ITEM_WORDS = (
    "accompany accompanies affirmer alter by cause convey derivative disclaim distribute each every give if include "
    "indicate keep limit made make modify no pass permit preserve prohibit prominent provide redistribute remove "
    "reproduce require retain the there use"
).split()


def _other_word(words: list[str]) -> str:
    """A pattern for the start of a word that is none of ``words``; without look-ahead, which not all engines have."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def other(node: dict, inside: bool) -> str:
        letters = "".join(sorted(c for c in node if c))
        if not inside:
            ways = [rf"[^\P{{L}}{letters}]"]
        elif "" in node:
            ways = [f"[{''.join(c for c in ascii_lowercase if c not in node)}]"]
        else:  # a word that ends here is another one
            ways = [rf"[^{letters}\n]", "(?m:$)"]
        return "(?:" + "|".join([*ways, *(c + other(node[c], True) for c in letters)]) + ")"

    return other(tree, False)


_YEAR = r"[<\[{(]*\d\d|[<\[{]|\((?:year|yyyy)"
_HOLDER = rf"the[ \t]+{_other_word(THINGS)}"
#: A line that begins with copyright, (c) or the sign and goes on with a year, a placeholder or a name
COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}\n]*(?:"
    r"(?:copyright[ :\t]*(?:\(c\)|©)|©|\(c\)[ :\t]*copyright[ :\t])"
    rf"|copyright[ :,\t]*(?:{_YEAR})|copyright[ :\t]+(?:{_HOLDER}|{_other_word([*SENTENCE_WORDS, 'the'])})"
    rf"|\(c\)[ :\t]*(?:{_YEAR}|{_other_word([*SENTENCE_WORDS, *ITEM_WORDS])})"
    r")[^\n]*"
)
ALL_RIGHTS = r"(^|\n)[ ]*all rights reserved[ .]*"


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends kept."""
    out = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, ALL_RIGHTS, "\n")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return out


def spelt(canonical: Column) -> Column:
    """One spelling of equivalent words; only texts that have one of them pay for it."""
    out = canonical
    for other, one in EQUIVALENT:
        out = F.regexp_replace(out, rf"(^|[ \n]){other}($|[ \n])", f"$1{one}$2")
    any_ = r"(^|[ \n])(" + "|".join(other for other, _ in EQUIVALENT) + r")($|[ \n])"
    return F.when(canonical.rlike(any_), out).otherwise(canonical)


def digest(canonical: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(spelt(canonical), r"[ \n]+", " ")), 256)


def file_texts() -> list[tuple[str, str]]:
    """(id, text) of the licences that are kept as files."""
    ids = {i for i, _ in NAMES}
    out = []
    for path in sorted(TEXT_FILES.glob("*.txt")):
        name = path.name.removesuffix(".txt")
        out.append((name if name in ids else name.rpartition(".")[0], path.read_text(encoding="utf-8")))
    return out


def known_texts() -> list[tuple[str, str, str]]:
    """(unit, id, text) of the built-in licences; the unit is "text" or "line"."""
    lines = [("line", i, n.format(name)) for i, names in NAMES for name in names for n in NOTICES]
    return [*(("text", i, t) for i, t in (*TEXTS, *file_texts())), *lines, *(("text", i, t) for _, i, t in lines)]


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """unit, digest and licence of all known licences; ``more`` adds rows (licence, text)."""
    out = spark.createDataFrame(known_texts(), "unit string, licence string, text string")
    if more is not None:
        own = more.select(F.lit("text").alias("unit"), F.col("licence").cast("string").alias("licence"), F.col("text").cast("string").alias("text"))
        out = out.unionByName(own.where("licence IS NOT NULL"))
    out = out.select("unit", "licence", digest(canonical_lines(F.col("text"))).alias("digest"))
    empty = F.sha2(F.lit(""), 256)
    return out.where(F.col("digest") != empty).groupBy("unit", "digest").agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, licence (of the whole text), n_notices and notices (ids, sorted)."""
    spark = documents.sparkSession
    known = known_digests(spark, more)
    if more is None or more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text").cast("string")).alias("c"))
    whole = docs.select("doc_id", digest(F.col("c")).alias("digest"))
    text_known = known.where("unit = 'text'").select("digest", "licence")
    line_known = known.where("unit = 'line'").select(F.col("digest").alias("line_digest"), F.col("licence").alias("notice"))
    whole = whole.join(text_known, "digest", "left")
    # digests are made inside the explode: the join's tests on its key would make them again for every line
    each = F.filter(F.array_distinct(F.split("c", "\n")), lambda line: line != "")
    lines = docs.select("doc_id", F.explode(F.transform(each, digest)).alias("line_digest")).join(line_known, "line_digest")
    notices = lines.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_set("notice")).alias("found"))
    both = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return both.select(
        "doc_id",
        "digest",
        "licence",
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("notices"),
    )
