"""License scans by conditional compression.

Candidate blocks around cues are cut into windows, and each window is compressed alone and with each template as a raw
zstandard dictionary. A template whose dictionary saves nearly what its wording costs, or half of the window, is a winner;
the others are not looked at again. Winners, ranked by their savings, are confirmed by the exact differences in wording:
words with digits (versions) must be there as they are, and up to a tenth of the others may differ. Of wordings that fit a
place equally well, the rank decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public wordings of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT licence": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE"
    ),
    "BSD-2-Clause licence": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "BSD-3-Clause licence": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ),
    "ISC licence": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ),
    "Zlib licence": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely"
    ),
}

#: A block is a candidate if it has one of these stems; every template has one, most have several.
CUES = re.compile(r"licen[sc]|copyright|redistribut|permission|creative commons|cc[- ]by", re.IGNORECASE)
#: Words around a cue that a block reaches out to, at least, on the same line or on others: wrapped notices stay whole.
REACH = 60
#: Share of a template's words that may be missing or different.
TOLERANCE = 0.1
#: Words of a window that is compressed at a time.
WINDOW = 150
LEVEL = 9
#: Share of what its wording costs (or of half the window, where that is less) that a template must save to win. Measured on
#: planted notices with as many changed words as are tolerated: see the tests.
FLOOR = 0.3

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_DIGIT = re.compile(r"[0-9]")
RESULT = "array<struct<start:int,end:int,license:string,saved:double,missing:array<string>,added:array<string>>>"


class Templates:
    """Wordings, and a compressor with each as its dictionary."""

    def __init__(self, texts: dict[str, str]):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        self.bare = zstandard.ZstdCompressor(**options)
        self.own, self.worth = {}, {}
        self.words = {name: [w.lower() for w in _WORD.findall(text)] for name, text in texts.items()}
        for name, words in self.words.items():
            text = " ".join(words).encode()
            # zstandard uses no dictionary below a few dozen bytes, so short wordings are repeated
            raw = zstandard.ZstdCompressionDict((text + b" ") * (64 // len(text) + 1), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.own[name] = zstandard.ZstdCompressor(dict_data=raw, write_dict_id=False, **options)
            self.worth[name] = len(self.bare.compress(text)) - len(self.own[name].compress(text))
        self.reach = max([REACH, *(1 + _stretch(text) * 11 // 10 for text in texts.values())])

    def ranked(self, window: list[str]) -> list[tuple[str, int, int]]:
        """(template, bytes that its dictionary saves, bytes that it must save to win) for a window's words, most first."""
        raw = " ".join(window).encode()
        alone = len(self.bare.compress(raw))
        saved = [(name, alone - len(c.compress(raw)), round(FLOOR * min(self.worth[name], alone / 2))) for name, c in self.own.items()]
        return sorted(saved, key=lambda s: (-s[1], s[0]))

    def winners(self, block: str) -> list[tuple[str, int]]:
        """Templates that win in some window of the block, with their greatest saving, most first."""
        best: dict[str, int] = {}
        for window in windows([w.lower() for w in _WORD.findall(block)]):
            for name, saved, least in self.ranked(window):
                if saved >= least:
                    best[name] = max(saved, best.get(name, 0))
        return sorted(best.items(), key=lambda s: (-s[1], s[0]))


def _stretch(text: str) -> int:
    """Most words of a wording without a cue: what a block must reach over to hold it whole."""
    at = [len(_WORD.findall(text, 0, m.start())) for m in CUES.finditer(text)]
    ends = [0, *at, len(_WORD.findall(text))]
    return max(b - a for a, b in zip(ends, ends[1:], strict=False))


@lru_cache(maxsize=4)
def _compiled(texts: tuple[tuple[str, str], ...]) -> Templates:
    """One set of compressors a Python worker."""
    return Templates(dict(texts))


def _of(templates: dict[str, str] | None) -> Templates:
    return _compiled(tuple((TEMPLATES if templates is None else templates).items()))


def windows(words: list[str]) -> Iterator[list[str]]:
    """Runs of ``WINDOW`` words, each half-way over the one before, so that most of any wording lies in one of them."""
    for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
        yield words[i : i + WINDOW]


def blocks(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Code-point spans of candidate blocks: ``reach`` words either side of each cue, across line breaks, merged."""
    if not CUES.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text)]
    last = None
    k = 0
    for cue in CUES.finditer(text):
        while k < len(words) - 1 and words[k][1] <= cue.start():
            k += 1
        a, b = max(0, k - reach), min(len(words), k + reach + 1)
        if last and a <= last[1]:
            last = (last[0], b)
        else:
            if last:
                yield words[last[0]][0], words[last[1] - 1][1]
            last = (a, b)
    if last:
        yield words[last[0]][0], words[last[1] - 1][1]


def confirm(block: str, wording: list[str], tolerance: float = TOLERANCE) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Every place where the block has the template's wording but for few words: span, words missing, words added.

    A place may begin at any word of the wording. None of the words with digits may be missing.
    """
    known = set(wording)
    found = list(_WORD.finditer(block))
    words = [m.group().lower() for m in found]
    least = (1 - tolerance) * len(wording)
    before = [0, *accumulate(w in known for w in words)]  # how many words before each are of the wording

    def compared(i: int) -> tuple[int, list, list[str]]:
        part = words[i : i + len(wording) + 3]
        match = [m for m in SequenceMatcher(None, wording, part, autojunk=False).get_matching_blocks() if m.size]
        return sum(m.size for m in match), match, part

    i = 0
    while i < len(words):
        if words[i] not in known or before[min(len(words), i + len(wording) + 3)] - before[i] < least:  # no more can match
            i += 1
            continue
        matched, match, part = compared(i)
        if matched >= least:
            begin = min(m.b for m in match)
            if begin:  # words before the notice took the place of its last ones
                later = compared(i + begin)
                if later[0] >= matched:
                    i += begin
                    matched, match, part = later
                    begin = min(m.b for m in match)
            end = max(m.b + m.size for m in match)
            in_template = {k for m in match for k in range(m.a, m.a + m.size)}
            in_part = {k for m in match for k in range(m.b, m.b + m.size)}
            missing = [w for k, w in enumerate(wording) if k not in in_template]
            added = [part[k] for k in range(begin, end) if k not in in_part]
            if len(added) <= max(1, tolerance * len(wording)) and not any(map(_DIGIT.search, missing)):
                yield found[i + begin].start(), found[i + end - 1].end(), missing, added
                i += end
                continue
        i += 1


def scan_text(text: str, templates: dict[str, str] | None = None) -> list[dict]:
    """Confirmed notices of a text; where wordings overlap, the one with more words stands, then the better saving."""
    known, out = _of(templates), []
    for a, b in blocks(text, known.reach):
        block = text[a:b]
        hits = []
        for name, saved in known.winners(block):
            for start, end, missing, added in confirm(block, known.words[name]):
                hits.append({"start": a + start, "end": a + end, "license": name, "saved": float(saved), "missing": missing, "added": added})
        taken: list[dict] = []
        for hit in sorted(hits, key=lambda h: (len(h["missing"]) + len(h["added"]), h["start"] - h["end"], -h["saved"])):
            if all(hit["end"] <= t["start"] or hit["start"] >= t["end"] for t in taken):
                taken.append(hit)
        out += sorted(taken, key=lambda t: t["start"])
    return out


def scan(docs: DataFrame, text_col: str, out_col: str = "licenses", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with an array of confirmed notices (code points, end exclusive); ``saved`` is in bytes.

    ``templates`` are names and wordings (``TEMPLATES``); whole licence texts may be given too, and travel with the tasks.
    Null and empty texts have none. Repeated rows get the same notices; wordings that fit a place equally well are told by
    the longer one, then the better saving. An empty table stays empty. A column of the name ``out_col`` is replaced. The
    work grows linearly with a text's candidate blocks, however long.
    """

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([scan_text(t, templates) if t else [] for t in batch], dtype=object)

    return docs.withColumn(out_col, scanned(F.col(text_col)))


def names(licenses: Column) -> Column:
    """Distinct licences of a scan, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(licenses["license"])), ",")
