"""License scans by sentence rules.

Sentences are normalised and looked up among the known licence sentences, each of which
has an identifier. The identifiers of a text, in order, are matched against ordered rules:
a rule applies where its identifiers follow each other with few others between.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers and wordings of the known licence sentences.
SENTENCES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-line": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "cc0-1.0-line": "Released under CC0 1.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-line": "Licensed under the BSD 3-Clause License",
    "bsd-2-line": "Licensed under the BSD 2-Clause License",
    "gpl-2-only-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl-2.1-library": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl-2.0-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
}


@dataclass(frozen=True)
class Rule:
    """A licence, the identifiers that stand for it in order, and how many other known sentences may lie between neighbours."""

    licence: str
    ids: tuple[str, ...]
    gap: int = 2


#: The rules in order; an identifier that a rule used is not used by a later one.
RULES = (
    Rule("Apache-2.0", ("apache-2.0-grant", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see")),
    Rule("Apache-2.0", ("apache-2.0-grant", "apache-2.0-copy-s", "apache-2.0-as-is", "apache-2.0-see")),
    Rule("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("GPL-3.0-or-later", ("gpl-program", "gpl-useful", "gpl-see")),
    Rule("GPL-2.0-or-later", ("gpl-2-program", "gpl-useful", "gpl-see")),
    Rule("Apache-2.0", ("apache-2.0-grant",)),
    Rule("Apache-2.0", ("apache-2.0-line",)),
    Rule("MIT", ("mit-line",)),
    Rule("MIT", ("mit-licensed",)),
    Rule("GPL-3.0-only", ("gpl-3-line",)),
    Rule("GPL-3.0-or-later", ("gpl-program",)),
    Rule("GPL-2.0-or-later", ("gpl-2-program",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4.0-line",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4.0-work",)),
    Rule("CC-BY-4.0", ("cc-by-4.0-line",)),
    Rule("CC-BY-4.0", ("cc-by-4.0-work",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4.0-line",)),
    Rule("CC0-1.0", ("cc0-1.0-line",)),
    Rule("BSD-3-Clause", ("bsd-line",)),
    Rule("BSD-2-Clause", ("bsd-2-line",)),
    Rule("GPL-2.0-only", ("gpl-2-only-program",)),
    Rule("LGPL-2.1-or-later", ("lgpl-2.1-library",)),
    Rule("LGPL-3.0-or-later", ("lgpl-3-program",)),
    Rule("AGPL-3.0-or-later", ("agpl-3-program",)),
    Rule("MPL-2.0", ("mpl-2.0-form",)),
    Rule("EPL-2.0", ("epl-2.0-terms",)),
    Rule("ISC", ("isc-grant",)),
    Rule("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    Rule("Unlicense", ("unlicense-domain",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4.0-work",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-4.0-work",)),
)

#: A fragment ends at a sentence's mark before white space and at every line's end.
BREAK = re.compile(r"(?<=[.!?:;])[\"'”’)]*\s+|\s*\n\s*")
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def normalise(sentence: str) -> str:
    """Lower case, letters and digits of ASCII only, one space between words."""
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


class Scanner:
    """Finds rules in texts. A known sentence may be wrapped over lines and hold marks: it is put together from fragments."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.known = {normalise(wording): name for name, wording in (sentences or SENTENCES).items()}
        self.begun = {" ".join(w[:k]) for w in map(str.split, self.known) for k in range(1, len(w))}
        self.longest = max(map(len, self.known), default=0)
        self.hints = self._cover(list(self.known))

    @staticmethod
    def _cover(wordings: list[str]) -> list[str]:
        """A few words of which each known sentence holds one: texts without any are passed by."""
        hints, left = [], [w.split() for w in wordings]
        while left:
            counts: dict[str, int] = {}
            for words in left:
                for w in set(words):
                    counts[w] = counts.get(w, 0) + len(w)
            hints.append(max(sorted(counts), key=counts.__getitem__))
            left = [w for w in left if hints[-1] not in w]
        return hints

    def identifiers(self, text: str) -> list[tuple[int, str]]:
        """(number of the fragment where it ends, identifier) for each known sentence, in order; the longest one wins."""
        low = text.lower()
        if not any(h in low for h in self.hints):
            return []
        parts = [normalise(f) for f in BREAK.split(text)]
        found, i = [], 0
        while i < len(parts):
            whole, j, best = parts[i], i, None
            while whole:
                if whole in self.known:
                    best = (j, self.known[whole])
                if whole not in self.begun or j + 1 == len(parts):
                    break
                j += 1
                whole = f"{whole} {parts[j]}" if parts[j] else whole
            if best:
                found.append(best)
                i = best[0]
            i += 1
        return found

    def licences(self, text: str) -> list[tuple[int, str, int]]:
        """(fragment where its first sentence ends, licence, rule) for each rule that applies, in order of the text."""
        ids = self.identifiers(text)
        used, out = [False] * len(ids), []
        for number, rule in enumerate(self.rules if ids else ()):
            places: dict[str, list[int]] = {}
            for k, (_, name) in enumerate(ids):
                places.setdefault(name, []).append(k)
            if not all(w in places for w in rule.ids):
                continue
            for start in places[rule.ids[0]]:
                chain = [] if used[start] else [start]
                for want in rule.ids[1:] if chain else ():
                    spots, k = places[want], bisect.bisect_right(places[want], chain[-1])
                    while k < len(spots) and used[spots[k]] and spots[k] - chain[-1] <= rule.gap + 1:
                        k += 1
                    if k == len(spots) or used[spots[k]] or spots[k] - chain[-1] > rule.gap + 1:
                        chain = []
                        break
                    chain.append(spots[k])
                if chain:
                    for k in chain:
                        used[k] = True
                    out.append((ids[chain[0]][0], rule.licence, number))
        return sorted(out)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Licences of every text.

    One row per input row: ``id_col``, matches (array of sentence, licence, rule in order of
    the text) and licences (distinct, sorted). Null and empty texts have none. Ids may be null or repeat; other columns are ignored; empty
    input, empty result. Texts are read whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("sentence", pa.int32()), ("licence", pa.string()), ("rule", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for batch in batches:
            found = [scanner.licences(t or "") for t in batch.column(1).to_pylist()]
            rows = [[{"sentence": a, "licence": b, "rule": c} for a, b, c in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, match), pa.array([sorted({b for _, b, _ in f}) for f in found], pa.list_(pa.string()))], names=["id", "matches", "licences"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, matches array<struct<sentence:int,licence:string,rule:int>>, licences array<string>").withColumnRenamed("id", id_col)
