"""License scans: Dice coefficient over word bigrams, in DataFrame functions only.

Texts and licence templates are normalised alike: lower case, runs of everything but letters
and digits made one space. A unit is a window of as many consecutive words as a template has,
wherever it lies (over lines, inside prose), that begins with a bigram of the template: others
can only hold fewer. The distinct word bigrams of both give Dice = 2 |A and B| / (|A| + |B|).

A template of b bigrams can reach the threshold t only if t / (2 - t) * b <= |A and B|, and so
only in a text that holds so many of its distinct bigrams: that bound prunes templates before
any window is made. The bigrams of all templates are looked up in one hash set; a text is
read once. Templates are a small list of the caller's (TEMPLATES), part of the expression: no
join, no shuffle.

Defined cases: null and empty texts match nothing, nor do texts of one word; equal scores go
to the template named first in alphabetical order, then to the window that begins first;
repeated rows are scanned alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts and notices of common licences, as their owners publish them. What follows a colon in a name tells texts of one licence apart.
TEMPLATES = {
    "agpl-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0:copyright": "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-2.0:notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0:trademarks": "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
    "bsd-2-clause:text": _CONDITIONS + _DISCLAIMER,
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "bsd-3-clause:text": _CONDITIONS + _NAMES + _DISCLAIMER,
    "bsl-1.0:text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0:notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1:notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit:text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved. No part of this work may be reproduced without permission.",
    "reserved:short": "All rights reserved.",
    "unlicense:text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib:text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words_of(text: str) -> list[str]:
    """The same for a template, in Python."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def least(n: int, threshold: float) -> float:
    """Of a template's n bigrams, how many a text must hold for a window to reach the threshold."""
    return threshold / (2 - threshold) * n


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (of the best window, or null), dice, start_word (where it begins, from 0; -1 without), n_licenses (different ones found)."""
    grams = {k: bigrams_of(v) for k, v in sorted(templates.items())}
    every = sorted({g for own in grams.values() for g in own})
    words = F.split(normal(F.coalesce("text", F.lit(""))), " ")
    pairs = F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: F.concat_ws(" ", a, b))
    hits = F.filter(F.transform("_grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(every))
    rows = docs.select(F.col("doc_id").alias("_id"), words.alias("_words")).select("_id", F.slice(pairs, F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))).alias("_grams")).select("_id", "_grams", hits.alias("_hits"))

    def best_of(name: str) -> Column:
        g, length = grams[name], len(words_of(templates[name])) - 1
        mine = F.expr(f"array({', '.join(repr(x) for x in g)})")
        own = F.filter("_hits", lambda h: h["gram"].isin(g))
        held = F.size(F.array_distinct(F.transform(own, lambda h: h["gram"])))

        def score(h: Column) -> Column:
            window = F.array_distinct(F.slice("_grams", h["at"] + 1, F.lit(length)))
            return F.struct((F.size(F.array_intersect(window, mine)) * -2.0 / (F.size(window) + len(g))).alias("low"), F.lit(name).alias("name"), h["at"].alias("at"))

        best = F.array_min(F.transform(own, score))
        return F.when((F.size("_hits") >= least(len(g), threshold)) & (held >= least(len(g), threshold)), F.when(best["low"] <= -threshold, best))

    found = [best_of(name) for name in grams]
    rows = rows.select("_id", F.array_compact(F.array(*found)).alias("_found"))
    id_of = lambda f: F.substring_index(f["name"], ":", 1)
    best = F.array_min("_found")
    return rows.select(F.col("_id").alias("doc_id"), id_of(best).alias("license"), F.coalesce(F.round(-best["low"], 6), F.lit(0.0)).alias("dice"), F.coalesce(best["at"].cast("long"), F.lit(-1).cast("long")).alias("start_word"), F.size(F.array_distinct(F.transform("_found", id_of))).cast("long").alias("n_licenses"))
