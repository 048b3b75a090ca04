"""License scans by conditional compression.

A block of lines that may be a license notice is compressed alone and once with each
template as a raw zstandard dictionary. What the dictionary saves tells how much of the
wording the block shares with the template; the best few are then compared word by
word, and a template wins only if its wording stands in the block: "version 2" is not
"version 3" however much a dictionary saves.

Texts are judged where they lie; equal blocks, which are the rule for notices, are
judged once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ordina.llm.common import WordTable, utf8

BEST = 4
LEAST_SAVED = 0.25
LEVEL = 3
WRAPPED = 3
REACH = 600
MAX_CHANGED = 0.05  # share of a template's words that may be missing or exchanged

# Notices by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_CUE = re.compile(
    rb"licen[sc]e|copyright|spdx|\bcc[ -]by|creative commons|permission|redistribut|public domain|waived all", re.IGNORECASE
)
_STOPS = (b".", b"!", b"?", b":", b";")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _line_before(text: bytes, at: int) -> int:
    """Beginning of the line before the one that begins at `at`."""
    return text.rfind(b"\n", max(0, at - REACH), max(0, at - 1)) + 1 or max(0, at - REACH)


def blocks_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, block): lines with a cue, runs of them with at most a line between as one.

    A block goes on over up to WRAPPED lines while its sentence does, on both sides, and
    not further than REACH bytes from a cue: templates are shorter.
    """
    start = end = None
    searched = 0
    while found := _CUE.search(text, searched):
        searched = found.end()
        lowest, highest = max(0, found.start() - REACH), min(len(text), found.end() + REACH)
        left = text.rfind(b"\n", lowest, found.start()) + 1 or lowest
        for _ in range(WRAPPED):
            before = text[_line_before(text, left) : max(0, left - 1)].rstrip()
            if left <= lowest or not before or before[-1:] in _STOPS:
                break
            left = max(lowest, _line_before(text, left))
        right = text.find(b"\n", found.end(), highest)
        for _ in range(WRAPPED):
            last = text[max(0, right - REACH) : max(0, right)].rstrip()[-1:]
            if right < 0 or not last or last in _STOPS:
                break
            right = text.find(b"\n", right + 1, highest)
        right = highest if right < 0 else right
        if end is not None and (left <= end or text.count(b"\n", end, left) <= 2):
            end = max(end, right)
            continue
        if start is not None:
            yield start, text[start:end]
        start, end = left, right
    if start is not None:
        yield start, text[start:end]


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(name, words_of(text)) for name, text in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=kind),
            )
            for _, words in self.templates
        ]

    def saved(self, block: list[str]) -> list[tuple[float, int]]:
        """(share of the template that the dictionary saves, template), best first."""
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        found = []
        for k, (squeeze, (_, words)) in enumerate(zip(self.given, self.templates)):
            size = min(len(data), len(" ".join(words)))
            found.append(((alone - len(squeeze.compress(data))) / max(1, size), k))
        return sorted(found, key=lambda f: (-f[0], f[1]))

    def changed(self, block: list[str], words: list[str]) -> int:
        """Words by which the block's closest stretch differs from the template."""
        match = SequenceMatcher(None, words, block, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        if not same:
            return len(words)
        kept = sum(m.size for m in same)
        span = same[-1].b + same[-1].size - same[0].b
        return max(len(words), span) - kept

    def judge(self, block: bytes) -> list[tuple[str, float, int]]:
        """(license, share saved, changed words) of the notices that the block holds, in order of saving.

        Matched stretches are taken out, so that a block may hold several notices.
        """
        words, found = words_of(block.decode("utf-8", "replace")), []
        while words:
            best = None
            for share, k in self.saved(words)[:BEST]:
                name, template = self.templates[k]
                changed = self.changed(words, template)
                if share >= LEAST_SAVED and changed <= MAX_CHANGED * len(template):
                    if best is None or changed < best[2]:
                        best = (name, share, changed, k)
            if best is None:
                # A long block may hide a short notice from the ranking: look for exact wordings.
                for k, (name, template) in enumerate(self.templates):
                    at = _place(words, template)
                    if at is not None and (best is None or len(template) > len(self.templates[best[3]][1])):
                        best = (name, LEAST_SAVED, 0, k)
            if best is None:
                break
            template = self.templates[best[3]][1]
            found.append(best[:3])
            at = _place(words, template)
            if at is None:
                match = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
                at, to = match[0].b, match[-1].b + match[-1].size
            else:
                to = at + len(template)
            words = words[:at] + words[to:]
        return found


def _place(words: list[str], template: list[str]) -> int | None:
    """Where the template stands in the words, word for word."""
    n = len(template)
    at = -1
    while True:
        try:
            at = words.index(template[0], at + 1)
        except ValueError:
            return None
        if words[at : at + n] == template:
            return at


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    judged = WordTable(scanner.judge, 20_000)
    for batch in batches:
        blocks, names, exact, saved, offsets = [], [], [], [], []
        for text in utf8(batch.column("text")):
            mine = list(blocks_of(text or b""))
            found = [(at, j) for at, b in mine for j in judged[b]]
            blocks.append(len(mine))
            names.append(sorted({j[0] for _, j in found}))
            exact.append(bool(found) and all(j[2] == 0 for _, j in found))
            saved.append(max((j[1] for _, j in found), default=0.0))
            offsets.append([at for at, _ in found])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(blocks, pa.int64()),
                pa.array(names, pa.list_(pa.string())),
                pa.array(exact, pa.bool_()),
                pa.array(saved, pa.float64()),
                pa.array(offsets, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_blocks", "licenses", "exact", "saved", "offsets"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, licenses, exact, saved, offsets) for each row of `docs` (doc_id, text).

    `licenses` are the distinct ids found, sorted; `exact` says that every notice has its
    template's wording; `offsets` are the byte places of the blocks that hold them. Null
    and empty texts have no block. Rows with equal or null ids stay rows; other columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_blocks long, licenses array<string>, exact boolean, saved double, offsets array<long>"
    return docs.select("doc_id", "text").mapInArrow(_scanned, schema)
