"""License scans by conditional compression.

Lines that speak of licensing make candidate blocks. A block is compressed by zstandard once on its own and once with each
template as a raw dictionary; the templates that shrink it most are compared word by word, and a match is confirmed if the
template's words are there in order, up to a stated share of differences, which are reported exactly. What stands before and
after a match is searched again, so every copy in a block is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

CUES = re.compile(
    r"licen[sc]e|copyright|\(c\)\s*\d{4}|all rights reserved|permission is hereby|permission to use|redistribution|"
    r"warrant|public domain|creative commons|\bcc[ -](?:by|0)|spdx|\bgnu\b|\bgpl|apache|mozilla public", re.I)
GAP = 3  # lines without a cue that a block may span
MOST_DIFFERENT = 0.25  # of a template's words
LEAST_REDUCTION = 0.15  # of the bytes of a template's words

# The wording of public license statements and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
SCHEMA = (
    "doc_id bigint, first_line int, last_line int, license string, reduction double, n_template_words int, "
    "missing array<string>, added array<string>"
)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def blocks(text: str, gap: int = GAP) -> Iterator[tuple[int, list[str]]]:
    """(first line, lines) of runs of lines with cues, with at most ``gap`` other lines between two of them."""
    if not CUES.search(text):
        return
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if CUES.search(line)]
    start = None
    for i, j in zip(hits, [*hits[1:], None]):
        start = i if start is None else start
        if j is None or j - i > gap + 1:
            yield start, lines[start : i + 1]
            start = None


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = {n: words(templates[n]) for n in self.names}
        self.plain = zstandard.ZstdCompressor(level=3)
        self.primed = {n: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
            " ".join(self.words[n]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.names}

    def ranked(self, found: list[str]) -> list[tuple[float, str]]:
        """Templates by the bytes they save, as a share of what their own words take."""
        data = " ".join(found).encode()
        alone = len(self.plain.compress(data))
        saved = [((alone - len(self.primed[n].compress(data))) / max(8, min(alone, len(" ".join(self.words[n])))), n) for n in self.names]
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def difference(self, name: str, found: list[str]) -> tuple[int, int, list[str], list[str]]:
        """Where the match begins and ends, the template's words that it lacks, and its words that the template lacks."""
        same = [m for m in SequenceMatcher(None, self.words[name], found, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return 0, 0, self.words[name], []
        kept = {i for m in same for i in range(m.a, m.a + m.size)}
        used = {i for m in same for i in range(m.b, m.b + m.size)}
        begin, end = same[0].b, same[-1].b + same[-1].size
        return begin, end, [w for i, w in enumerate(self.words[name]) if i not in kept], [found[i] for i in range(begin, end) if i not in used]

    def scan(self, found: list[str], most_different: float = MOST_DIFFERENT, least_reduction: float = LEAST_REDUCTION) -> Iterator[tuple]:
        """(template, reduction, begin, end, missing, added) of every confirmed copy in a block's words, best template first.

        All templates that save enough are compared; the words on both sides of a copy are searched for more of it.
        """
        for gain, name in self.ranked(found):
            if gain < least_reduction:
                return
            wanted = len(self.words[name])
            todo = [(0, len(found))]
            while todo:
                low, high = todo.pop()
                if high - low < (1 - most_different) * wanted:
                    continue
                begin, end, missing, added = self.difference(name, found[low:high])
                if len(missing) + len(added) <= most_different * wanted:
                    yield name, gain, low + begin, low + end, missing, added
                    todo += [(low + end, high), (low, low + begin)]


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, gap: int = GAP, most_different: float = MOST_DIFFERENT,
    least_reduction: float = LEAST_REDUCTION,
) -> DataFrame:
    """One row per copy of a confirmed license in every whole text, with the lines it covers; null and empty texts have none.

    Words can confirm several licenses whose wording differs little; the row without differences is the exact one.
    Repeated rows give repeated results, a null doc_id keeps its own. Templates are a parameter shipped with the task.
    """
    given = templates if templates is not None else TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for first, lines in blocks(text or "", gap):
                    placed = [(first + i, word) for i, line in enumerate(lines) for word in words(line)]
                    for name, gain, begin, end, missing, added in scanner.scan([w for _, w in placed], most_different, least_reduction):
                        rows.append((doc, placed[begin][0], placed[end - 1][0], name, gain, len(scanner.words[name]), missing, added))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
