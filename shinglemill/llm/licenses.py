"""License notices by conditional compression.

Candidate blocks are the lines, and the paragraphs of several lines, that hold a word of licensing. A block is compressed by
zstandard on its own and with each notice as a raw dictionary; the notices that save most are its likely contents. In that
order all are confirmed by the exact differences in wording: the fewest words to insert, drop or replace between the notice
and some stretch of the block. What lies between confirmed stretches is searched again until nothing more is found.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.memory import small_batches

#: Names of licenses and the usual wording of their notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
SIGNS = r"(?i)licen[sc]e|rights reserved|permission (?:is|to) |redistribut|public domain|public license|free software|cc by"

_SIGN, _WORD, _PARAGRAPH = re.compile(SIGNS), re.compile(r"[^\W_]+(?:[.-][^\W_]+)*"), re.compile(r"\n[ \t]*\n")
#: Characters of a line or paragraph on each side of a sign; longer blocks are cut there, but not below four times the longest notice.
_REACH = 1_600


def _words(text: str):
    found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return [w for w, _, _ in found], [(a, b) for _, a, b in found]


def _alignments(notice: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end the fewest edits that turn a stretch of ``block`` that ends there into ``notice``, and the stretch's start."""
    width = len(block) + 1
    cost, start = np.zeros(width, np.int64), np.arange(width)
    steps = np.arange(width)
    words = np.array(block, object)
    for i, word in enumerate(notice, 1):
        same = np.r_[False, words == word] if len(block) else np.array([False])
        diagonal = np.r_[i, cost[:-1] + ~same[1:]]
        above = cost + 1
        best = np.where(diagonal <= above, diagonal, above)
        origin = np.where(diagonal <= above, np.r_[0, start[:-1]], start)
        # Runs of words that only the block has: the least of cost so far plus one each.
        reach = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == reach, steps, 0))
        cost, start = reach + steps, origin[source]
    return cost, start


def word_differences(notice: list[str], block: list[str]) -> tuple[int, int, int]:
    """The fewest edits that turn some stretch of ``block`` into ``notice``, and that stretch as ``[start, end)``; of several
    the one that ends first."""
    cost, start = _alignments(notice, block)
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _apart(hits: list[tuple]) -> list[tuple]:
    """Of ``(name, start, end, ...)`` in the order of preference those that overlap no earlier one."""
    starts, ends, kept = [], [], []
    for hit in hits:
        at = bisect.bisect_left(starts, hit[2])
        if at == 0 or ends[at - 1] <= hit[1]:
            starts.insert(at, hit[1])
            ends.insert(at, hit[2])
            kept.append(hit)
    return kept


class Scanner:
    def __init__(self, notices=NOTICES, level: int = 3, tolerance: float = 0.15):
        self.notices, self.tolerance = notices, tolerance
        self.reach = max(_REACH, 4 * max(len(text) for _, text in notices))
        self.words = [_words(text)[0] for _, text in notices]
        self.counts = [Counter(words) for words in self.words]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.primed = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in notices]
        self.memo: dict = {}

    def rank(self, block: str) -> list[tuple[float, int]]:
        """Notices by the share of the block's compressed size that they save as a dictionary, the best first. The share
        sinks with the text around a notice, so it only orders."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        gains = [(round((alone - len(c.compress(raw))) / alone, 6), i) for i, c in enumerate(self.primed)]
        return sorted(gains, key=lambda g: (-g[0], g[1]))

    def block(self, block: str) -> list[tuple]:
        """``(license, start, end, gain, differences, words)`` of the notices confirmed in a block, none overlapping."""
        if block in self.memo:
            return self.memo[block]
        words, spans = _words(block)
        ranked = self.rank(block)
        kept, todo = [], [(0, len(words))]
        while todo:
            low, high = todo.pop()
            taken = sorted(_apart(sorted(self._confirmed(words[low:high], ranked), key=lambda h: (h[4] / h[5], -h[5], -h[3], h[0], h[2]))), key=lambda h: h[1])
            kept += [(name, spans[low + a][0], spans[low + b - 1][1], *rest) for name, a, b, *rest in taken]
            if taken:  # what lies between confirmed stretches may hold other notices
                todo += zip([low, *(low + h[2] for h in taken)], [*(low + h[1] for h in taken), high])
        kept.sort(key=lambda h: h[1])
        if len(self.memo) < 10_000:
            self.memo[block] = kept
        return kept

    def _confirmed(self, words: list[str], ranked: list) -> list[tuple]:
        """Every stretch of words that is a notice up to the tolerated differences, with notices in the order of ``ranked``. A notice
        with more words that the block doesn't hold at all is out without an alignment."""
        held, found = Counter(words), []
        for gain, i in ranked:
            size = len(self.words[i])
            most = int(self.tolerance * size)
            if sum(n - held[w] for w, n in self.counts[i].items() if held[w] < n) > most:
                continue
            cost, start = _alignments(self.words[i], words)
            found += [(self.notices[i][0], int(start[b]), b, gain, int(cost[b]), size) for b in np.flatnonzero(cost <= most).tolist() if b > start[b]]
        return found

    def __call__(self, text: str) -> list[tuple]:
        """Notices in a whole text, with offsets in characters; a stretch found in a line and in its paragraph counts once."""
        blocks = set()
        for sign in _SIGN.finditer(text):
            low, high = max(0, sign.start() - self.reach), min(len(text), sign.end() + self.reach)
            line = max(text.rfind("\n", low, sign.start()) + 1, low), text.find("\n", sign.end(), high)
            blocks.add((line[0], line[1] if line[1] >= 0 else high))
            breaks = [m.span() for m in _PARAGRAPH.finditer(text, low, high)]
            blocks.add((max([low, *(b for _, b in breaks if b <= sign.start())]), min([high, *(a for a, _ in breaks if a >= sign.end())])))
        found = {(h[0], a + h[1], a + h[2], h[3], h[4], h[5]) for a, b in blocks for h in self.block(text[a:b])}
        kept = _apart(sorted(found, key=lambda h: (h[4] / h[5], -h[5], -h[3], h[1], h[0])))
        return sorted(kept, key=lambda h: h[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """``(id, license, start, end, gain, differences, notice_words, wording)`` for every notice found in the whole texts.

    Offsets count characters from 0, end excluded. Documents without a word of licensing are filtered out on the JVM side; null
    and empty texts have no notices. Very long texts are read whole, in blocks around each word of licensing. Of stretches
    that overlap the one of fewer differences, then of more words, is kept. Repeated rows give repeated findings; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    marked = docs.select(F.col(id_col), F.col(text).alias("_text")).filter(F.col("_text").rlike(SIGNS))

    def run(parts):
        scanner = Scanner(notices)
        for part in parts:
            rows = []
            for ident, body in zip(part[id_col], part["_text"]):
                rows += [(ident, *hit, body[hit[1] : hit[2]]) for hit in scanner(body)]
            yield pd.DataFrame(rows, columns=[id_col, "license", "start", "end", "gain", "differences", "notice_words", "wording"])

    return marked.mapInPandas(run, f"`{id_col}` {kind}, license string, start int, end int, gain double, differences int, notice_words int, wording string")


def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_license_notices": op7_license_notices}
