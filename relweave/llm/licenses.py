"""Licence notices found by Dice coefficient over word bigrams; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relweave.llm.scratch import clean

THRESHOLD = 0.85

# Public licence notices, as (licence, notice).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a notice, in order, normalised as documents are."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set that can reach ``threshold`` with a set of ``n``: 2*min/(a+b) >= threshold."""
    sizes = [m for m in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n)]
    return sizes[0], sizes[-1]


def witnesses(grams: Sequence[Sequence[str]], threshold: float) -> list[str]:
    """Words of which every text that reaches ``threshold`` with some bigram set holds at least one.

    A set of n bigrams needs the m of them with 2m/(m + n) >= threshold, so words that touch more
    than n - m of its bigrams can't all be missing. Words are picked by how many bigrams they
    touch in the sets that aren't settled yet, long words (the rare ones) first; a word also
    stands for those that contain it.
    """
    rest = {}
    for i, g in enumerate(grams):
        need = min(m for m in range(1, len(g) + 1) if 2 * m >= threshold * (m + len(g)))
        rest[i] = [set(g), len(g) - need]
    out: list[str] = []
    for shortest in (6, 4, 1):
        words = sorted({w for g, _ in rest.values() for b in g for w in b.split(" ") if len(w) >= shortest})
        while rest:
            gain = {w: sum(min(left + 1, sum(w in b for b in g)) for g, left in rest.values()) for w in words}
            best = max(words, key=lambda w: (gain[w], len(w), w), default=None)
            if best is None or not gain[best]:
                break
            out.append(best)
            for i, (g, left) in list(rest.items()):
                hit = {b for b in g if best in b}
                rest[i] = [g - hit, left - len(hit)]
                if left < len(hit):
                    del rest[i]
    return out


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words, lower-cased once."""
    def one(t: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        return hit

    return F.exists(F.array(F.lower(text)), one)


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.array_distinct(F.zip_with(
        F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches ``(doc_id, unit, unit_no, license, template, dice)`` of whole texts against notices.

    Text is normalised (letters and digits, lower case) and compared unit by unit: every line,
    every paragraph of several lines, and the whole text if it has several paragraphs. A unit
    whose number of words can't give a bigram set inside a template's size bounds is never
    expanded, and one without any known bigram is compared with no template. Texts and units
    that hold none of the words that a match can't do without (``witnesses``) end before they
    are taken apart. No row is shuffled, so hot sources or lines cost nothing extra;
    ``templates`` is a short list that becomes part of the plan.

    Null and empty texts match nothing; repeated rows are scanned each; ties between templates
    are all returned. A null id is carried along.
    """
    known = [(lic, i, template_bigrams(t)) for i, (lic, t) in enumerate(templates)]
    known = [(lic, i, b, *size_bounds(len(b), threshold)) for lic, i, b in known if b]
    least = min((k[3] for k in known), default=0)
    every = sorted({g for k in known for g in k[2]})
    marks = witnesses([k[2] for k in known], threshold)
    docs = clean(docs, doc_id="long", text="string").filter(_holds_any(F.col("text"), marks))
    plain = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}\n]+", " "))
    lines = F.transform(F.split("plain", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("body")))
    parts = F.split("plain", r"\n *\n")
    paragraphs = F.filter(
        F.transform(parts, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("unit_no"), x.alias("body"))),
        lambda s: F.contains(F.trim(s["body"], F.lit(" \n")), F.lit("\n")))
    whole = F.when(F.size(parts) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("plain").alias("body")))).otherwise(F.array())
    units = docs.filter("text is not null").select("doc_id", plain.alias("plain")).select("doc_id", F.explode(F.concat(lines, paragraphs, whole)).alias("u"))
    units = units.filter(_holds_any(F.col("u.body"), marks))
    body = F.trim(F.regexp_replace("u.body", "[ \n]+", " "))
    units = units.select("doc_id", "u.unit", "u.unit_no", F.split(body, " ").alias("words")).filter(F.size("words") > least)
    units = units.withColumn("grams", _bigrams(F.col("words"))).drop("words")
    n = F.size("grams")
    fits = F.lit(False)
    for lo, hi in sorted({(k[3], k[4]) for k in known}):
        fits = fits | n.between(lo, hi)
    units = units.filter(fits).filter(F.arrays_overlap("grams", F.array(*map(F.lit, every))))
    scores = [
        F.when(n.between(lo, hi), F.struct(
            F.lit(lic).alias("license"), F.lit(i).alias("template"),
            (F.lit(2.0) * F.size(F.array_intersect("grams", F.array(*map(F.lit, b)))) / (n + len(b))).alias("dice")))
        for lic, i, b, lo, hi in known
    ]
    found = units.select("doc_id", "unit", "unit_no", F.explode(F.array_compact(F.array(*scores))).alias("m"))
    return found.select("doc_id", "unit", "unit_no", "m.license", "m.template", "m.dice").filter(F.col("dice") >= threshold)


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan as SQL over ``documents``."""
    rows = ", ".join(
        f"('{lic}', {i}, [{', '.join(repr(g) for g in template_bigrams(t))}])" for i, (lic, t) in enumerate(templates))
    return f"""
WITH t(license, template, tg) AS (VALUES {rows}),
p AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, string_split(plain, chr(10)) AS l, string_split_regex(plain, '\\n *\\n') AS g, plain FROM p),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS unit_no, unnest(l) AS body FROM q
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(g))), unnest(g) AS body FROM q) WHERE contains(trim(body, chr(32) || chr(10)), chr(10))
  UNION ALL SELECT doc_id, 'text', 0, plain FROM q WHERE len(g) > 1),
w AS (SELECT doc_id, unit, unit_no, string_split(trim(regexp_replace(body, '[ \\n]+', ' ', 'g')), ' ') AS words FROM u),
b AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1)
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, license, template, 2.0::DOUBLE * len(list_intersect(grams, tg)) / (len(grams) + len(tg)) AS dice
FROM b, t WHERE 2 * least(len(grams), len(tg)) >= {threshold} * (len(grams) + len(tg))
  AND 2.0::DOUBLE * len(list_intersect(grams, tg)) / (len(grams) + len(tg)) >= {threshold}
"""
