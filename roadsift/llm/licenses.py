"""Licence scans by sentence rules: sentences become identifiers, identifier sequences become licences.

A text is cut into sentences at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space or the end, once with line breaks ending
sentences too and once with the lines of a paragraph joined, so that wrapped sentences are found as well. Normalised (letters and digits
only, lower case, single blanks), a sentence is looked up among known licence sentences. Known sentences in order of place
form the document's identifier sequence; a rule is an ordered sequence of identifiers with its licence, and matches
where its identifiers follow each other, with at most ``GAP`` characters between two of them. Of overlapping matches the
one that begins first stays, of those that begin together the longest.

A text without any of the anchors, stems of which every known sentence has one (which is checked), is passed over.

Scale: rows are scanned where they are; sentences and rules are small fixed tables. Nothing is shuffled.

Defined results: null and empty texts, like others without licences, have no match; null ids are carried along; repeated
rows match alike; an empty table gives an empty result; other columns are left alone.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.llm.batches import bounded
from roadsift.llm.texts import utf8

#: Known licence sentences by identifier.
SENTENCES = {
    "apache-2-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2-notice-file": "Licensed under the Apache License, Version 2.0 (the License)",
    "apache-2-compliance": "you may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
    "to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-free": "This program is free software",
    "gpl-3-may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
}
#: Ordered rules, the licence and the identifiers that follow each other.
RULES = [
    ("Apache-2.0", ("apache-2-notice",)),
    ("Apache-2.0", ("apache-2-notice-file",)),
    ("Apache-2.0", ("apache-2-notice-file", "apache-2-compliance")),
    ("Apache-2.0", ("apache-2-notice-file", "apache-2-compliance", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-may")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-may", "gpl-hope")),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("GPL-3.0-only", ("spdx-gpl-3",)),
]
#: Every known sentence has one of these stems.
ANCHORS = ("licen", "permission", "redistribut", "warrant", "free software", "copyright")
#: Characters that may lie between two sentences of a rule.
GAP = 400

LETTERS = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?;:]+(?=\s|$)")
#: Lines joined: a sentence ends at a mark, or where a line is blank but for comment marks.
SENTENCE_OR_PARAGRAPH_END = re.compile(r"[.!?;:]+(?=\s|$)|\n[\s#/*;%!-]*(?=\n)")
SENTENCE_OR_LINE_END = re.compile(r"[.!?;:]+(?=\s|$)|\n")
COMMENT = re.compile(r"^[\s#/*;%!-]+", re.M)


def normalised(sentence: str) -> str:
    return " ".join(LETTERS.findall(sentence.lower()))


class Scanner:
    """Known sentences and rules, and the longest of each kept at hand."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]], anchors: tuple[str, ...], gap: int = GAP):
        # Marks that end sentences inside a known sentence end its parts; the parts then follow each other.
        self.parts: dict[str, tuple[str, ...]] = {}
        self.known: dict[str, str] = {}
        for name, sentence in sentences.items():
            if not any(anchor in sentence.lower() for anchor in anchors):
                raise ValueError(f"no anchor in {name}")
            texts = [text for text in map(normalised, SENTENCE_END.split(sentence)) if text]
            for at, text in enumerate(texts):
                self.known.setdefault(text, name if at == 0 else f"{name}/{at}")
            self.parts[name] = tuple(self.known[text] for text in texts)
        # A rule's identifiers, with those of sentences that are cut into parts in place of the sentence.
        self.rules = sorted(((licence, tuple(part for name in names for part in self.parts[name])) for licence, names in rules), key=lambda rule: -len(rule[1]))
        self.anchors, self.gap = anchors, gap

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, identifier) of the known sentences in a text, in order of place."""
        found: dict[tuple[int, str], int] = {}
        for cut in (SENTENCE_OR_LINE_END, SENTENCE_OR_PARAGRAPH_END):
            start = 0
            for end, after in [*((mark.start(), mark.end()) for mark in cut.finditer(text)), (len(text), len(text))]:
                piece = text[start:end]
                if cut is SENTENCE_OR_LINE_END or "\n" in piece:
                    name = self.known.get(normalised(piece if cut is SENTENCE_OR_LINE_END else COMMENT.sub(" ", piece)))
                    if name is not None:
                        found.setdefault((start + LETTERS.search(piece).start(), name), end)
                start = after
        return sorted((start, end, name) for (start, name), end in found.items())

    def matches(self, text: str) -> list[tuple[str, str, int, int]]:
        """(licence, rule, start, end) of the matches in a text."""
        lowered = text.lower()
        if not any(anchor in lowered for anchor in self.anchors):
            return []
        known = self.sentences(text)
        out, at = [], 0
        while at < len(known):
            for licence, names in self.rules:
                own = known[at : at + len(names)]
                if tuple(name for _, _, name in own) == names and all(b[0] - a[1] <= self.gap for a, b in zip(own, own[1:])):
                    out.append((licence, "+".join(names), own[0][0], own[-1][1]))
                    at += len(names)
                    break
            else:
                at += 1
        return out


_SCANNER: list[Scanner] = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNER:
        _SCANNER.append(Scanner(SENTENCES, RULES, ANCHORS))
    for batch in bounded(batches, "text"):
        owners, rows = [], []
        for at, text in enumerate(batch.column("text")):
            for match in _SCANNER[0].matches(text.as_py().decode()):
                owners.append(at)
                rows.append(match)
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])]
        ids = batch.column("doc_id").take(pa.array(owners, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "license", "rule", "span_start", "span_end"])


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, span_start, span_end): a row per licence found in a document; spans count characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), utf8(docs["text"]).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, license string, rule string, span_start bigint, span_end bigint")


def by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, license, places): a row per document and licence, with the number of its matches."""
    return matches(docs).groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("places"))
