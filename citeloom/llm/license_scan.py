"""License scans by sentence rules.

Texts are cut into sentences, sentences are normalised and looked up in a table of known license sentences,
and the sequence of their identifiers is matched against ordered rules: a rule names a license and the
sentences that state it, in order. The longest rule that fits at a place wins, of equal ones the first by
name; matches don't overlap. The table holds notices and references, stated here, and whole license texts,
read from a data file with a sentence a line.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, id_and_text, pieces, raw_bytes

# Sentences of public license texts and notices, by identifier.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-notice-1": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-notice-2": "you may not use this file except in compliance with the License",
    "apache-notice-3": "You may obtain a copy of the License at",
    "apache-notice-4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-notice-5": "See the License for the specific language governing permissions and limitations under the License",
    "mit-ref": "Released under the MIT License",
    "mit-ref-2": "Licensed under the MIT License",
    "mit-ref-3": "This project is licensed under the MIT License",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "liability-mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-ref": "Licensed under the BSD License",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2",
    "gpl-notice-1": "This program is free software",
    "gpl2-notice-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl3-notice-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-notice-3": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-notice-4": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-notice-5": "See the GNU General Public License for more details",
    "mpl2-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-2": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
# Rules as (license, sentence identifiers in order).
RULES = [
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-notice-1", "apache-notice-2", "apache-notice-3", "apache-notice-4", "apache-notice-5"]),
    ("Apache-2.0", ["apache-notice-1", "apache-notice-2"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-ref-3"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("MIT", ["mit-1", "mit-2", "as-is-mit", "liability-mit"]),
    ("ISC", ["isc-1"]),
    ("BSD", ["bsd-ref"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-2.0-or-later", ["gpl-notice-1", "gpl2-notice-2", "gpl-notice-3", "gpl-notice-4", "gpl-notice-5"]),
    ("GPL-2.0-or-later", ["gpl-notice-1", "gpl2-notice-2"]),
    ("GPL-3.0-or-later", ["gpl-notice-1", "gpl3-notice-2", "gpl-notice-3", "gpl-notice-4", "gpl-notice-5"]),
    ("GPL-3.0-or-later", ["gpl-notice-1", "gpl3-notice-2"]),
    ("MPL-2.0", ["mpl2-1"]),
    ("MPL-2.0", ["mpl2-1", "mpl2-2"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("Unlicense", ["unlicense-1"]),
    ("proprietary", ["reserved"]),
]
def table() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All sentences by identifier and all rules: the stated ones, and one for each text of the data file.

    Texts share the sentences that they have in common: one normalised sentence has one identifier."""
    sentences, rules = dict(SENTENCES), [(name, list(ids)) for name, ids in RULES]
    known = {_key(s): name for name, s in sentences.items()}
    for block in pkgutil.get_data(__package__, "licenses.txt").decode().split("\n= ")[1:]:
        name, *lines = block.strip().split("\n")
        ids = []
        for line in lines:
            if _key(line) not in known:
                known[_key(line)] = f"{name}-{len(ids) + 1}"
                while known[_key(line)] in sentences:
                    known[_key(line)] += "x"
                sentences[known[_key(line)]] = line
            ids.append(known[_key(line)])
        if (name, ids) not in rules:
            rules.append((name, ids))
    return sentences, rules


def _key(sentence: str) -> bytes:
    """A sentence as its words: marks between them, which differ from copy to copy, don't count."""
    return b" ".join(p for m in PIECE.finditer(sentence.encode()) if (p := normal(m[0])))


#: A sentence ends at one of these before white space, a line's end, or the text's end; list marks may follow a line's start.
PIECE = re.compile(rb"(?:[^.!?:;\n]|[.!?:;](?![\s\"')]|$))+")
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b in b"./-" or b >= 128 else 32 for b in range(256))
MATCH = "array<struct<license:string,start:int,end:int,sentences:array<string>>>"


def normal(piece: bytes) -> bytes:
    """Lower-case words parted by single spaces; dots, strokes and hyphens stay inside words only."""
    return b" ".join(w for x in piece.translate(NORMAL).split() if (w := x.strip(b"./-")))


class Recogniser:
    """Known sentences as sequences of normalised pieces, and rules as sequences of sentence identifiers."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]):
        self.known = {tuple(p for m in PIECE.finditer(s.encode()) if (p := normal(m[0]))): name for name, s in sentences.items()}
        self.known = {(b" ".join(k),): v for k, v in self.known.items() if k}
        self.prefixes = {b" ".join(k[0].split()[:n]) for k in self.known for n in range(1, len(k[0].split()) + 1)}
        self.rules: dict[str, list[tuple[list[str], str]]] = {}
        for name, ids in rules:
            self.rules.setdefault(ids[0], []).append((ids, name))
        for options in self.rules.values():
            options.sort(key=lambda x: (-len(x[0]), x[1]))

    def sentences(self, text: bytes) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences in bytes; a sentence may run over several pieces, as over wrapped lines."""
        pieces = [(p, m.start(), m.end()) for m in PIECE.finditer(text) if (p := normal(m[0]))]
        out, i = [], 0
        while i < len(pieces):
            joined, best = b"", None
            for k in range(i, len(pieces)):
                joined = joined + b" " + pieces[k][0] if joined else pieces[k][0]
                if joined not in self.prefixes:
                    break
                if (joined,) in self.known:
                    best = (self.known[(joined,)], k)
            if best:
                out.append((best[0], pieces[i][1], pieces[best[1]][2]))
                i = best[1]
            i += 1
        return out

    def licenses(self, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[str]]]:
        ids, out, i = [x[0] for x in found], [], 0
        while i < len(ids):
            for rule, name in self.rules.get(ids[i], ()):
                if ids[i : i + len(rule)] == rule:
                    out.append((name, found[i][1], found[i + len(rule) - 1][2], rule))
                    i += len(rule) - 1
                    break
            i += 1
        return out


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences (known ones), matches (license, start, end, sentences).

    start and end are byte offsets of the UTF-8 text. Null and empty texts have no sentence; null ids stay, ids that aren't
    whole numbers raise; repeated rows are scanned each; of rules of one length at a place the first by name wins; very long
    texts are scanned by themselves; other columns, of whatever name, are not read; an empty table gives no rows."""
    if sentences is None or rules is None:
        sentences, rules = table()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("licenses")
        known = Recogniser(sentences, rules)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.list_(pa.string()))]))
        for batch in pieces(batches):
            found = [known.sentences(t) for t in raw_bytes(batch.column(1))]
            rows = [[{"license": a, "start": b, "end": c, "sentences": d} for a, b, c, d in known.licenses(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_sentences", "matches"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, n_sentences long, matches {MATCH}")


def digest(docs: DataFrame) -> DataFrame:
    found = license_scan(docs)
    return found.select("doc_id", "n_sentences", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"))
