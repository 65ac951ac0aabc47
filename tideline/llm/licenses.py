"""Licence scans: Dice coefficient over word bigrams, with Spark expressions only.

``scan_licenses`` compares each line of a text and, where it has more than one, the whole text.
``scan_passages`` compares stretches of words of any place and length, across lines or inside one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import text_of

THRESHOLD = 0.8

# Licence ids, their whole texts and the notices that stand for them.
TEXTS = tuple((path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))

GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version."
GNU_REST = " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
GNU_HEADERS = tuple(
    (license, (GNU + rest).format(what=what, name=name, version=version, colon=colon, either=either))
    for license, what, name, version, colon, either in (
        ("AGPL-3.0", "program", "Affero General Public License", "3", ":", ", either"),
        ("GPL-2.0", "program", "General Public License", "2", ";", "; either"),
        ("GPL-3.0", "program", "General Public License", "3", ":", ", either"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1", ";", "; either"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3", ":", ", either"),
    )
    for rest in (GNU_REST, "")
)

FILE_HEADERS = GNU_HEADERS + (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

TEMPLATES = TEXTS + FILE_HEADERS + NOTICES

# Fixed value: from so many bigrams on a template is long.
LONG = 400

# Words too common to look for first, and more of them that only long texts need.
COMMON = frozenset("a any by for in is of or the this to under use with work".split())
PLAIN = frozenset("above about after before between either other their there these those unless where whether which whole within without".split())


def normalised_words(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits; all else parts words."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def _pairs(text: str) -> set[tuple[str, str]]:
    words = re.findall("[a-z0-9]+", text.lower())
    return set(zip(words, words[1:]))


def anchors(threshold: float, templates) -> list[str]:
    """Words of which a unit must have one to reach the threshold with any template.

    Dice t with a template of n bigrams takes at least n t / (2 - t) of them. So of any more than
    the rest one must be shared, and with it its words: words are chosen until the bigrams they are
    in are that many. Rare words go first; of a long template, of which hundreds would be needed,
    those in the most bigrams.
    """
    chosen = set()
    for _, text in templates:
        pairs = _pairs(text)
        needed = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1
        often = Counter(w for p in pairs for w in set(p)) if len(pairs) >= LONG else Counter()
        hit = set()

        def rank(w):
            return (w not in chosen, w in COMMON or bool(often) and (len(w) < 5 or w in PLAIN), -often[w], -len(w), w)

        for word in sorted({w for p in pairs for w in p}, key=rank):
            if len(hit) >= needed:
                break
            if more := {p for p in pairs if word in p} - hit:
                hit |= more
                chosen.add(word)
    return sorted(chosen, key=lambda w: (-len(w), w))


def may_match(text: Column, threshold: float, templates) -> Column:
    """Whether a text may hold a unit that reaches the threshold with any template.

    Long templates are asked for only where a text has the length that their share of bigrams takes.
    """
    long = [t for t in templates if len(_pairs(t[1])) >= LONG]
    test = has_anchor(text, anchors(threshold, [t for t in templates if t not in long]))
    if not long:
        return test
    least = min(len(_pairs(t[1])) for t in long) * threshold / (2 - threshold)
    return test | ((F.length(text) > math.floor(2 * least)) & has_anchor(text, anchors(threshold, long)))


def _alternatives(words: list[str]) -> str:
    """A pattern of the words in which what begins alike is tried once."""
    rests: dict[str, list[str]] = {}
    for word in sorted(set(words) - {""}):
        rests.setdefault(word[0], []).append(word[1:])
    found = "|".join(letter + _alternatives(rest) for letter, rest in rests.items())
    return f"(?:{found})" + ("?" if "" in words else "") if found else ""


def has_anchor(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, in one pass over it."""
    return F.lower(text).rlike(f"(?<![a-z0-9]){_alternatives(words)}(?![a-z0-9])") if words else F.lit(False)


def bigrams(words: Column) -> Column:
    """The different pairs of neighbouring words, each as one string."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, bigram, size): a row per template and bigram, some ten thousand in all."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    made = rows.select("template", "license", bigrams(normalised_words(F.col("text"))).alias("b"))
    return made.select("template", "license", F.size("b").alias("size"), F.explode("b").alias("bigram"))


def license_hits(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, unit, license, dice): the units whose best template reaches the threshold.

    unit counts lines from 0; -1 is the whole text. Dice of bigram sets of sizes m and n is at
    most 2 min(m, n) / (m + n), so only templates between n t / (2 - t) and n (2 - t) / t can
    reach t; others are never joined. Texts and lines without any of a few words that a match must
    have are left out first (see ``may_match``). Bigrams meet templates in one equality join with a table
    of fixed size. Of equal values the first template wins. Null texts are empty; rows with
    one doc_id are told apart by row and stay separate hits; null ids stay null.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.filter(may_match(F.col("text"), threshold, templates))
    lines = F.split("text", "\n")
    units = rows.select(
        "row", "doc_id",
        F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(lines)).alias("at", "line"),
        F.size(lines).alias("n_lines"),
    ).select("row", "doc_id", F.when(F.col("n_lines") > 1, F.col("at") - 1).otherwise(F.col("at")).alias("unit"), "line")
    units = units.filter(may_match(F.col("line"), threshold, templates))
    known = template_bigrams(docs.sparkSession, templates)
    made = units.select("row", "doc_id", "unit", bigrams(normalised_words(F.col("line"))).alias("b"))
    sized = made.withColumn("n", F.size("b")).filter("n > 0").select("row", "doc_id", "unit", "n", F.explode("b").alias("bigram"))
    near = (F.col("n") >= F.col("size") * low - 1e-9) & (F.col("n") <= F.col("size") * high + 1e-9)
    shared = sized.join(F.broadcast(known), "bigram").filter(near)
    each = shared.groupBy("row", "doc_id", "unit", "template", "license", "n", "size").agg(F.count("*").alias("both"))
    scored = each.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).filter(F.col("dice") >= threshold)
    best = F.max_by(F.struct("license", "dice"), F.struct("dice", -F.col("template"))).alias("best")
    return scored.groupBy("row", "doc_id", "unit").agg(best).select("doc_id", "unit", "best.license", "best.dice")


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, n_units, best_dice) per document and licence found in it."""
    hits = license_hits(docs, threshold, templates)
    return hits.groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.max("dice").alias("best_dice"))


def passage_hits(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, at, n_words, dice): the stretches of a text that reach the threshold.

    A run is a longest row of neighbouring bigrams that all are the template's. A stretch goes from
    the first word of a run to the last of the same or a later one. With bigram sets a stretch
    that is cut elsewhere has no higher Dice: a bigram of the template more at an end never lowers
    it, another one never raises it. Its bigrams, repeats counted, are at most p (2 - t) / t for p of
    the template; so words strewn over a long text make none. Of the stretches with one
    beginning the best counts, of equal ones the shortest; a stretch is left out if it overlaps a
    better one of any template (of equal ones the earlier template, then the earlier place).
    at counts normalised words from 0.

    Texts that lack the t / (2 - t) of a template's bigrams are left out before, by an equality join.
    Texts are met again by a hash of id and text: repeated rows each have their own hits.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = docs.select("doc_id", text_of().alias("text")).filter(may_match(F.col("text"), threshold, templates))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    known = template_bigrams(docs.sparkSession, templates)
    own = rows.select("key", F.explode(bigrams(normalised_words(F.col("text")))).alias("bigram"))
    shared = own.join(F.broadcast(known), "bigram").groupBy("key", "template", "size").agg(F.count("*").alias("both"))
    shared = shared.filter(F.col("both") >= F.col("size") * low - 1e-9).select("key", "template")
    whole = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    words = normalised_words(F.col("text"))
    whole = whole.select("template", "license", bigrams(words).alias("b"), F.floor((F.size(words) - 1) * high + 1e-9).cast("int").alias("most"))
    asked = shared.join(F.broadcast(whole), "template").groupBy("key").agg(F.collect_list(F.struct("template", "license", "b", "most")).alias("asked"))
    met = rows.join(asked, "key").withColumn("w", normalised_words(F.col("text"))).select(
        "doc_id", "asked", F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))).alias("pairs")
    )
    found = F.flatten(F.transform("asked", lambda t: _stretches(F.col("pairs"), t, low, threshold)))
    better = lambda g, h: (g["at"] <= h["end"]) & (h["at"] <= g["end"]) & (_rank(g) > _rank(h))
    kept = met.select("doc_id", found.alias("found")).select(
        "doc_id", F.explode(F.filter("found", lambda h: ~F.exists("found", lambda g: better(g, h)))).alias("h")
    )
    return kept.select("doc_id", "h.license", "h.at", (F.col("h.end") - F.col("h.at") + 2).alias("n_words"), "h.dice")


def _rank(hit: Column) -> Column:
    return F.struct(hit["dice"], -hit["template"], -hit["at"])


def _stretches(pairs: Column, t: Column, low: float, threshold: float) -> Column:
    """The best stretch of each beginning, ``at`` and ``end`` being its first and last bigram."""

    def dice(at: Column, end: Column) -> Column:
        own = F.array(F.array_distinct(F.slice(pairs, at + 1, end - at + 1)))
        return F.transform(own, lambda b: 2.0 * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + F.size(t["b"])))[0]

    def best(at: Column, ends: Column) -> Column:
        inside = F.filter(ends, lambda e: (e - at + 1 >= F.size(t["b"]) * low - 1e-9) & (e - at + 1 <= t["most"]))
        return F.array_max(F.transform(inside, lambda e: F.struct(dice(at, e).alias("dice"), (-e).alias("back"))))

    def of_runs(runs: Column) -> Column:
        made = F.transform(runs["first"], lambda at: F.struct(at.alias("at"), best(at, runs["last"]).alias("best")))
        return F.transform(
            F.filter(made, lambda s: s["best"]["dice"] >= threshold),
            lambda s: F.struct(
                s["at"].alias("at"), (-s["best"]["back"]).alias("end"), s["best"]["dice"].alias("dice"),
                t["template"].alias("template"), t["license"].alias("license"),
            ),
        )

    def runs(inside: Column) -> Column:
        place = F.transform(inside, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        first = F.filter(place, lambda p: p["x"] & ~F.coalesce(F.get(inside, p["i"] - 1), F.lit(False)))
        last = F.filter(place, lambda p: p["x"] & ~F.coalesce(F.get(inside, p["i"] + 1), F.lit(False)))
        return F.struct(F.transform(first, lambda p: p["i"]).alias("first"), F.transform(last, lambda p: p["i"]).alias("last"))

    # A value used more than once is held as the only item of an array.
    inside = F.array(F.transform(pairs, lambda b: F.array_contains(t["b"], b)))
    return F.transform(F.transform(inside, runs), of_runs)[0]


def scan_passages(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, n_passages, best_dice) per document and licence found anywhere in it."""
    hits = passage_hits(docs, threshold, templates)
    return hits.groupBy("doc_id", "license").agg(F.count("*").alias("n_passages"), F.max("dice").alias("best_dice"))
