"""Operator 9: license scan, DataFrame functions only.

Templates are known notices and whole license texts, those of this module or a
table of the user's own. A document's words are laid out in windows that
overlap by half; a template of at most W / 2 words lies wholly within a window
of W words, and each template goes with the smallest such W. Windows and
templates meet where one of BANDS min-hashes of their five-word shingles is
equal (bands of one row), and a template counts as found when the window holds
at least CONTAINMENT of its distinct shingles.

A window that holds that much of a template has a Jaccard similarity of at
least 0.1 to it by these sizes, so the bands retrieve it with a probability of
1 - 0.9**64, over 0.998. Only windows with an anchor word are hashed: without
its shingles that hold an anchor word no template has CONTAINMENT left, which
``check_templates`` proves for the list. Windows that have fewer words than the
share of their smallest template aren't hashed either.

Results for odd input: null and wordless texts have no license; each row is
scanned by itself, even if doc_ids repeat or are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from importlib import resources
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
#: Bytes of a table of templates, which are broadcast as hashes and shingles.
MOST_BYTES = 8 << 20

#: License notices and whole license texts as they are published.
WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
MIT_TERMS = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-2-clause-text": f"{BSD_2} {WARRANTY_BSD}",
    "bsd-3-clause-text": f"{BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {WARRANTY_BSD}",
    "bsl-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {GPL_REST}",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-terms": MIT_TERMS,
    "mit-text": f'{MIT_TERMS} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
ANCHORS = ["license", "licensed", "software", "copyright", "permission", "permitted", "redistribution", "redistributions", "conditions", "distribute", "distributed", "sublicense", "warranty", "warranties", "merchantability", "liability", "gnu", "works", "work", "covered", "terms", "version", "program", "library", "source", "affirmer", "waiver"]
WORD = "[a-z0-9]+"


def known_templates() -> dict[str, str]:
    """The notices above and the whole texts that are kept beside this module."""
    folder = resources.files(__package__) / "license_texts"
    return TEMPLATES | {f"{x.name.removesuffix('.txt')}-whole": x.read_text("utf-8") for x in folder.iterdir() if x.name.endswith(".txt")}


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text) of at most MOST_BYTES; a license of several rows has several templates."""
    rows = table.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).filter("license is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"templates have {size} bytes, over {MOST_BYTES}: scan with parts of the table")
    out: dict[str, str] = {}
    for r in rows.orderBy("license", "text").collect():
        name, k = r["license"], 1
        while name in out:
            k += 1
            name = f"{r['license']} ({k})"
        out[name] = r["text"]
    return out


def _distinct_shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def check_templates(templates: dict[str, str]) -> None:
    """Every template must have a shingle, and must lose too much of itself without its shingles that hold an anchor word."""
    for name, text in templates.items():
        words = re.findall(WORD, text.lower())
        shingles = _distinct_shingles(words)
        if not shingles or sum(not set(s) & set(ANCHORS) for s in shingles) >= CONTAINMENT * len(shingles):
            raise ValueError(f"template {name} needs {SHINGLE} words and an anchor word in over {1 - CONTAINMENT:.0%} of its shingles")


def window_of(n_words: int) -> int:
    """Words of the windows that a template of so many words goes with: the least 12 * 2**k of at least twice as many."""
    size = 12
    while size < 2 * n_words:
        size *= 2
    return size


def _shingles(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))).otherwise(F.array().cast("array<bigint>"))


def _least_hash(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))


def _bands(shingles: Column) -> Column:
    return F.array(*(_least_hash(shingles, k) for k in range(BANDS)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(size, band, value, license, template): BANDS rows a template."""
    rows = [(name, text, window_of(len(re.findall(WORD, text.lower())))) for name, text in templates.items()]
    table = spark.createDataFrame(rows, "license string, text string, size int").select("license", "size", _shingles(_words(F.col("text"))).alias("template"))
    return table.select("license", "size", "template", F.posexplode(_bands(F.col("template"))).alias("band", "value"))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, licenses (names found, sorted), and containment (the best match of any template, 0 without one).

    ``templates`` are names with texts, or a table (license, text); by default those of ``known_templates``.
    """
    templates = known_templates() if templates is None else templates_of(templates) if isinstance(templates, DataFrame) else templates
    check_templates(templates)
    # of each size of window the least words that can hold enough of a template
    needed: dict[int, int] = {}
    for words in (re.findall(WORD, t.lower()) for t in templates.values()):
        least = ceil(CONTAINMENT * len(_distinct_shingles(words))) + SHINGLE - 1
        needed[window_of(len(words))] = min(needed.get(window_of(len(words)), least), least)
    sizes = sorted(needed)
    anchors = F.array(*(F.lit(a) for a in ANCHORS))
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("(?i)" + "|".join(ANCHORS)), _words(text)).alias("words"))
    # stretches of the largest window's size, so that no row carries its whole text from here on
    half = max(sizes, default=2) // 2
    stretches = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {half}")), lambda k: F.slice("words", (k * half + 1).cast("int"), 2 * half))
    rows = rows.select("row", "doc_id", F.explode_outer(F.when(F.size("words") > 0, stretches)).alias("words"))
    # places of anchor words, and the windows that hold one: the two (of stride size / 2) around each place
    at = F.filter(F.transform(F.col("words"), lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "doc_id", "words", at.alias("at"))

    def windows(size: int) -> Column:
        """Those that begin in the stretch's first half; the next stretch has the others."""
        step = size // 2
        around = lambda i: F.array(F.greatest(F.floor(i / step) - 1, F.lit(0)), F.floor(i / step))
        chosen = F.filter(F.array_distinct(F.flatten(F.transform(F.col("at"), around))), lambda k: (k * step < half) & (F.size("words") - k * step >= needed[size]))
        # each with its own words, so that no row carries the whole stretch along
        return F.transform(chosen, lambda k: F.struct(F.lit(size).alias("size"), F.slice("words", (k * step + 1).cast("int"), size).alias("words")))

    held = rows.select("row", "doc_id", F.explode_outer(F.concat(*(windows(s) for s in sizes))).alias("w")) if sizes else rows.select("row", "doc_id", F.lit(None).cast("struct<size:int,words:array<string>>").alias("w"))
    held = held.select("row", "doc_id", "w.size", F.when(F.col("w").isNotNull(), _shingles(F.col("w.words"))).alias("shingles"))
    keyed = held.select("row", "doc_id", "size", "shingles", F.posexplode_outer(F.when(F.size("shingles") > 0, _bands(F.col("shingles")))).alias("band", "value"))
    # a row a template and band: as many as the list of templates has, whatever the input
    met = keyed.join(F.broadcast(template_bands(docs.sparkSession, templates)), ["size", "band", "value"], "left")
    share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
    met = met.select("row", "doc_id", "license", F.when(F.col("license").isNotNull(), share).alias("share"))
    return met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.when(F.col("share") >= CONTAINMENT, F.col("license")))).alias("licenses"), F.coalesce(F.max("share"), F.lit(0.0)).alias("containment")).drop("row")
