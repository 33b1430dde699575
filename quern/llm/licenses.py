"""License scans: normalised lines and texts against licence templates by Dice over word bigrams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower

#: Dice coefficient from which a unit matches, times 100.
DICE = 80


class Template(NamedTuple):
    license: str
    kind: str
    text: str


#: Short notices as they stand in files.
TEMPLATES = (
    Template("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    Template("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    Template("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "share-alike", "Licensed under CC BY-SA 4.0."),
    Template("CC0-1.0", "public-domain", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    Template("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0-or-later", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    Template("LGPL-3.0", "weak-copyleft", "Licensed under the GNU Lesser General Public License, version 3."),
    Template("MIT", "permissive", "Released under the MIT License."),
    Template("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    Template("MPL-2.0", "weak-copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)

#: Whole licences and the grant of MIT as it stands in them; matched by windows only.
BODIES = (
    Template("MIT", "permissive", _GRANT),
    Template("MIT", "permissive", _GRANT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("BSD-2-Clause", "permissive", _CLAUSES + _WARRANTY),
    Template("BSD-3-Clause", "permissive", _CLAUSES + _THIRD + _WARRANTY),
    Template("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)


def words_of(text: str) -> list[str]:
    """Words of a template; the same rule as ``_normal``."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c if c in "0123456789" or "a" <= c <= "z" or ord(c) > 127 else " " for c in text)
    return low.split(" ")


def bigrams_of(text: str) -> list[tuple[str, str]]:
    words = [w for w in words_of(text) if w]
    return sorted(set(zip(words, words[1:], strict=False)))


def _hashes(bigrams: list[tuple[str, str]]) -> str:
    """SQL for an array of bigram hashes. Words hold no quotes; a text for all is parsed at once, literals by the thousand are
    not passed one by one."""
    return "array(" + ", ".join(f"xxhash64('{a}', '{b}')" for a, b in bigrams) + ")"


def _normal(text: Column) -> Column:
    """Words of each line: runs of letters and digits, A-Z in lower case; other ASCII marks separate."""
    plain = F.regexp_replace(ascii_lower(text), r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    return F.transform(F.split(plain, "\n", -1), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))


def _bigrams(words: Column) -> Column:
    """Distinct word bigrams, each as a 64-bit hash."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.transform(firsts, lambda w, i: F.xxhash64(w, F.get(words, i + 1))))


def _windows(rows: DataFrame, templates: tuple[Template, ...], dice: int) -> DataFrame:
    """``rows(doc_id, lines, found)`` with ``more``: matches of windows of words, outside of the lines in ``found``.

    A window has as many words as its template and starts at a bigram of it, wherever lines end. It can match only if
    the text holds dice / (200 - dice) of the template's bigrams at least, and so their words; other texts form no bigrams.
    Of windows that overlap, the one of most common bigrams less those of one side only stays, so that a whole licence
    goes before a notice in it; then the first, then that of the first template.
    """
    known = []
    for k, t in enumerate(templates):
        own = bigrams_of(t.text)
        pairs = ", ".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in own)
        known.append(f"named_struct('k', {k}, 'n', {sum(w != '' for w in words_of(t.text))}, 'pairs', array({pairs}), 'h', {_hashes(own)})")
    known = F.expr(f"array({', '.join(known)})")
    vocabulary = F.expr("array(" + ", ".join(f"'{w}'" for w in sorted({w for t in templates for w in words_of(t.text) if w})) + ")")
    enough = lambda n, of: n * (200 - dice) >= of * dice
    rows = rows.withColumn("v", F.array_intersect(F.flatten("lines"), vocabulary))
    both = lambda p: F.array_contains("v", p["a"]) & F.array_contains("v", p["b"])
    fitting = F.filter(known, lambda t: enough(F.size(F.filter(t["pairs"], both)), F.size(t["pairs"])))
    rows = rows.withColumn("fitting", F.when(F.size("v") > 2, fitting).otherwise(F.filter(known, lambda t: F.lit(False))))
    words = F.when(F.size("fitting") > 0, F.flatten("lines"))
    rows = rows.withColumn("w", words)
    firsts = F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))
    rows = rows.withColumn("b", F.transform(firsts, lambda w, i: F.xxhash64(w, F.get("w", i + 1))))
    places = F.transform("b", lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def tried(t: Column) -> Column:
        def one(p: Column) -> Column:
            own = F.array_distinct(F.slice("b", p["i"] + 1, t["n"] - 1))
            common, both = F.size(F.array_intersect(own, t["h"])), F.size(own) + F.size(t["h"])
            end = F.least(p["i"] + t["n"], F.size("w"))
            return F.struct((both - 3 * common).alias("s"), p["i"].alias("i"), t["k"].alias("k"), end.alias("end"), (200 * common / both).alias("dice"))

        starts = F.filter(places, lambda p: F.array_contains(t["h"], p["x"]))
        held = F.size(F.array_intersect(F.col("b"), t["h"]))
        return F.when(enough(held, F.size(t["h"])), F.filter(F.transform(starts, one), lambda m: m["dice"] >= dice))

    every = F.flatten(F.filter(F.transform("fitting", tried), lambda x: x.isNotNull()))
    rows = rows.withColumn("tried", F.array_sort(every))
    lines_of_words = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, F.size(x))))
    rows = rows.withColumn("at", F.when(F.size("tried") > 0, lines_of_words))
    line = lambda i: F.get("at", i)
    free = F.filter("tried", lambda m: ~F.exists("found", lambda f: (f["back"] == 0) | (-f["back"]).between(line(m["i"]), line(m["end"] - 1))))
    apart = lambda kept, m: ~F.exists(kept, lambda o: (m["i"] < o["end"]) & (o["i"] < m["end"]))
    kept = F.aggregate(free, F.filter("tried", lambda m: F.lit(False)), lambda kept, m: F.when(apart(kept, m), F.array_append(kept, m)).otherwise(kept))
    more = F.transform(kept, lambda m: F.struct(m["dice"], (-line(m["i"])).alias("back"), (-m["k"]).alias("t")))
    none = F.filter("found", lambda f: F.lit(False))
    return rows.select("doc_id", "found", F.when(F.size("tried") > 0, more).otherwise(none).alias("more"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, dice: int = DICE, bodies: tuple[Template, ...] = BODIES) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, license, kind, line, dice, n_notices``: its best match, or nulls and 0.

    Units are the lines of a text and the whole text (line 0, if it has several), and windows of words of each template
    and of ``bodies`` outside of the lines that match, at the line of their first word (see ``_windows``). A unit and a template of a and b
    distinct bigrams with c in common have Dice 2c / (a + b); as c is at most the smaller, only units of
    dice / (200 - dice) to (200 - dice) / dice times b bigrams can match a template. Others are dropped by their size,
    as are those whose bigrams in any template are too few for the smallest template of a fitting size; a unit of
    more distinct words than bigrams allow is dropped before its bigrams are formed. The best match has the highest Dice,
    then the first line, then the first template. A null, empty or blank text has no unit and matches nothing; a text of any
    length is read whole, and its windows start only at bigrams of a template whose words it holds. Repeated rows are
    judged one by one and never leave their task; an empty table gives an empty result. Columns other than doc_id and
    text are ignored, whatever their names.
    """
    sets = [bigrams_of(t.text) for t in templates]
    low, high = min(map(len, sets)) * dice // (200 - dice), -(-max(map(len, sets)) * (200 - dice) // dice)
    hashed = [F.expr(_hashes(own)) for own in sets]
    every = F.expr(_hashes(sorted({x for own in sets for x in own})))
    rows = docs.select("doc_id", _normal(F.coalesce(F.col("text"), F.lit(""))).alias("lines"))
    words = F.concat(F.array(F.when(F.size("lines") > 1, F.flatten("lines"))), F.col("lines"))
    units = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("line"), w.alias("w"))), lambda s: F.size(s["w"]) > low)
    units = F.filter(units, lambda s: (F.size(s["w"]) <= high) | (F.size(F.array_distinct(s["w"])) <= high + 1))
    sized = F.transform(units, lambda s: F.struct(s["line"].alias("line"), _bigrams(s["w"]).alias("b")))
    fitting = F.filter(sized, lambda s: F.size(s["b"]).between(low, high))
    likely = F.filter(fitting, lambda s: F.size(F.array_intersect(s["b"], every)) * (200 - dice) >= F.size(s["b"]) * dice)
    rows = rows.select("doc_id", "lines", likely.alias("units"))

    def best(s: Column) -> Column:
        n, tries = F.size(s["b"]), []
        for k, own in enumerate(sets):
            common = F.size(F.array_intersect(s["b"], hashed[k]))
            fits = (n * (200 - dice) >= len(own) * dice) & (n * dice <= len(own) * (200 - dice))
            tries.append(F.when(fits, F.struct((200 * common / (n + len(own))).alias("dice"), (-s["line"]).alias("back"), F.lit(-k).alias("t"))))
        return F.array_max(F.array(*tries))

    found = F.filter(F.transform("units", best), lambda m: m["dice"] >= dice)
    rows = _windows(rows.select("doc_id", "lines", found.alias("found")), (*templates, *bodies), dice)
    rows = rows.select("doc_id", F.concat("found", "more").alias("found")).withColumn("top", F.array_max("found"))
    by = lambda field: F.element_at(F.array(*(F.lit(getattr(t, field)) for t in (*templates, *bodies))), 1 - F.col("top.t"))
    hit = F.col("top").isNotNull()
    return rows.select(
        "doc_id",
        F.when(hit, by("license")).alias("license"),
        F.when(hit, by("kind")).alias("kind"),
        F.when(hit, -F.col("top.back")).alias("line"),
        F.round(F.col("top.dice") / 100, 6).alias("dice"),
        F.size("found").alias("n_notices"),
    )
