"""Licence scanning with a positional rare-token index.

The index holds, for every word of the licence templates, the templates and positions where it stands. For each
template a file looks up the rarest of the template's words that it holds (highest inverse document
frequency, counted over all documents), so no other licence in the file takes their room. An occurrence at word
p of a template word at q votes for the template lying at p - q. Only places on which enough distinct rare
words agree go on (where a notice stands whole, all agree); there the template's mandatory key phrases
are verified, and the score is the share of template words that stand in their places.

Two passes read the texts: one counts documents for the templates' words (a table no larger than that
vocabulary), one scans. Neither shuffles texts.

The templates here are notices and telling paragraphs of common licences, not whole licence texts; ``templates`` takes any other pack.

Defined cases: null text is empty; a text without words has no labels, null places and score 0; repeated rows and
null ids are kept; of words that are equally rare in a template the first in byte order are chosen; a file with a base phrase and no verified
template has score 0.5; texts of any length are read whole, one at a time; an empty table gives an empty result; columns besides id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_rows, python_rows, table


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Base phrases, and notices of well-known licences in their published wording.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT license.", ("mit license",)),
    Template(
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ("gnu general public license", "free software foundation"),
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
        ("redistribution and use in source and binary forms", "retain the above copyright notice"),
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license",),
    ),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution",)),
    Template(
        "mit",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("fitness for a particular purpose and noninfringement", "authors or copyright holders be liable for any claim"),
    ),
    Template(
        "apache",
        """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
        worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
        publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
        ("grant of copyright license", "each contributor hereby grants to you a perpetual"),
    ),
    Template(
        "apache",
        """Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or
        conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.""",
        ("licensor provides the work", "each contributor provides its contributions"),
    ),
    Template(
        "gpl",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "gpl",
        """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU
        General Public License is a free, copyleft license for software and other kinds of works.""",
        ("gnu general public license is a free copyleft license",),
    ),
    Template(
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.""",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "bsd",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("provided by the copyright holders and contributors as is",),
    ),
    Template(
        "isc",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
        ("the author disclaims all warranties with regard to this software",),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions:""",
        ("without any express or implied warranty", "alter it and redistribute it freely"),
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software.""",
        ("any person or organization obtaining a copy of the software",),
    ),
    Template(
        "epl",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
        ("eclipse public license",),
    ),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    Template(
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
        ("waived all copyright and related",),
    ),
    Template(
        "ofl",
        """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ
        at: https://scripts.sil.org/OFL""",
        ("sil open font license",),
    ),
    Template(
        "wtfpl",
        """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
        ("you want to public license",),
    ),
)
RARE = 24
AGREE = 0.6
SLACK = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class Index:
    """Positional postings of the templates' words."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, agree: float = AGREE):
        self.templates, self.rare, self.agree = templates, rare, agree
        self.words = [words_of(t.text) for t in templates]
        self.keys = [[words_of(k) for k in t.keys] for t in templates]
        self.places_of: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in templates]
        for own, words in zip(self.places_of, self.words):
            for q, w in enumerate(words):
                own[w].append(q)
        self.vocabulary = frozenset(w for words in self.words for w in words)
        self.phrases = [(words_of(p), label) for p, label in PHRASES]

    def places(self, words: list[bytes], seen: set[bytes]) -> list[tuple[int, str]]:
        """Where each base phrase stands: (first word, label)."""
        wanted = [(p, label) for p, label in self.phrases if seen.issuperset(p)]
        if not wanted:
            return []
        at: dict[bytes, list[int]] = {p[0]: [] for p, _ in wanted}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        return sorted((i, label) for p, label in wanted for i in at[p[0]] if words[i : i + len(p)] == p)

    def candidates(self, words: list[bytes], seen: set[bytes], idf: dict[bytes, float]) -> set[tuple[int, int]]:
        """(template, place) on which enough of the template's rarest words in the file agree."""
        need: dict[int, int] = {}
        chosen: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.places_of):
            if not all(seen.issuperset(k) for k in self.keys[t]):
                continue
            known = sorted(seen.intersection(own), key=lambda w: (-idf.get(w, 0.0), w))[: self.rare]
            need[t] = max(min(2, len(own)), math.ceil(self.agree * len(known)))
            for w in known:
                chosen[w] += [(t, q) for q in own[w]]
        if not chosen:
            return set()
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for p, w in enumerate(words):
            for t, q in chosen.get(w, ()):
                votes[t, p - q].add(w)
        return {spot for spot, by in votes.items() if len(by) >= need[spot[0]]}

    def verify(self, words: list[bytes], t: int, place: int) -> float:
        """Share of the template's words that stand in place, or 0 without all of its key phrases near there."""
        own = self.words[t]
        low = max(0, place - SLACK)
        part = words[low : max(low, place + len(own) + SLACK)]
        joined = b" " + b" ".join(part) + b" "
        if not all(b" " + b" ".join(k) + b" " in joined for k in self.keys[t]):
            return 0.0
        return sum(0 <= place + q < len(words) and words[place + q] == w for q, w in enumerate(own)) / len(own)

    def scan(self, text: str | None, idf: dict[bytes, float]) -> tuple:
        words = words_of(text)
        seen = set(words)
        places = self.places(words, seen)
        base = {label for _, label in places}
        labels, score = set(base), 0.5 if base else 0.0
        for t, place in self.candidates(words, seen, idf):
            found = self.verify(words, t, place)
            if found:
                labels.add(self.templates[t].label)
                score = max(score, found)
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def document_frequency(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(word, n)``: in how many documents each template word stands; the empty word counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Index(templates).vocabulary
        count: Counter[bytes] = Counter()
        for batch in batches:
            for (text,) in python_rows(batch):
                count[b""] += 1
                count.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Base phrases, labels and score of each row."""
    counts = {r["word"].encode(): r["n"] for r in document_frequency(docs, text_col, templates).collect()}  # vocabulary-sized
    total = counts.pop(b"", 0)
    idf = {w: math.log((total + 1) / (n + 1)) for w, n in counts.items()}

    def setup():
        index = Index(templates)
        return lambda batch: ((key, *index.scan(text, idf)) for key, text in batch)

    schema = f"{id_col} bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_rows(docs, None, schema, [F.col(id_col).cast("bigint"), F.col(text_col).cast("string")], setup)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The query again: words of texts meet words of templates, and what lies in one place is counted."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    index = Index()
    words, keys = [], []
    for t, (own, phrases) in enumerate(zip(index.words, index.keys)):
        words += [f"({t}, {q}, {quoted(w.decode())})" for q, w in enumerate(own)]
        keys += [f"({t}, {quoted(b' '.join(k).decode())})" for k in phrases]
    labels = ", ".join(f"({t}, {quoted(x.label)})" for t, x in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quoted(p)}, {len(p.split())}, {quoted(label)})" for p, label in PHRASES)
    return f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(words)}) AS t(t, q, w)),
k AS (SELECT * FROM (VALUES {", ".join(keys)}) AS k(t, phrase)),
n AS (SELECT * FROM (VALUES {labels}) AS n(t, label)),
b AS (SELECT * FROM (VALUES {phrases}) AS b(phrase, size, label)),
z AS (SELECT t, count(*) AS size, count(DISTINCT w) AS kinds FROM t GROUP BY t),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
df AS (SELECT w, count(DISTINCT rid) AS n FROM w GROUP BY w),
known AS (
  SELECT rid, t, w, row_number() OVER (PARTITION BY rid, t ORDER BY n, w) AS place
  FROM (SELECT DISTINCT w.rid, t.t, w.w, df.n FROM w JOIN t ON t.w = w.w JOIN df ON df.w = w.w)),
rare AS (SELECT rid, t, w, count(*) OVER (PARTITION BY rid, t) AS m FROM known WHERE place <= {RARE}),
met AS (SELECT w.rid, t.t, w.p - t.q AS place, t.w FROM w JOIN t ON t.w = w.w),
spot AS (
  SELECT met.rid, met.t, met.place, count(*) AS there, count(DISTINCT rare.w) AS votes, any_value(rare.m) AS m
  FROM met LEFT JOIN rare ON rare.rid = met.rid AND rare.t = met.t AND rare.w = met.w GROUP BY ALL),
near AS (
  SELECT rid, t, there / z.size AS score,
    ' ' || array_to_string(list_slice(d.words, greatest(place - {SLACK}, 0) + 1, greatest(place + z.size + {SLACK}, 0)), ' ') || ' ' AS words
  FROM spot JOIN z USING (t) JOIN d USING (rid) WHERE votes >= greatest(least(2, z.kinds), ceil(CAST({AGREE} AS DOUBLE) * m))),
hit AS (SELECT rid, label, score FROM near JOIN n USING (t) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = near.t AND NOT contains(near.words, ' ' || k.phrase || ' '))),
base AS (
  SELECT rid, label, p FROM (SELECT rid, label, phrase, p, list_slice(d.words, p + 1, p + size) AS part FROM w JOIN d USING (rid) JOIN b ON w.w = split_part(b.phrase, ' ', 1))
  WHERE array_to_string(part, ' ') = phrase),
bs AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
ls AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM hit UNION ALL SELECT rid, label FROM base) GROUP BY rid),
sc AS (SELECT rid, max(score) AS score FROM (SELECT rid, score FROM hit UNION ALL SELECT rid, 0.5 FROM base) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ls USING (rid) LEFT JOIN sc USING (rid)
"""


ORACLE = _sql()
