"""License scans by conditional compression (operator 6).

Regions are the lines that hold a cue word, with as many words before and after each cue as a notice can take, so that
wrapped notices are whole. They are cut into short overlapping candidate blocks, for each template
one at every place where it may begin, of as many words as a confirmed notice can take. A block is compressed alone and
with its template as a raw zstandard dictionary; what that saves ranks the templates, and the exact differences in
wording confirm them: template words that the block lacks, and words that it has in between. A version number must be
there. No notice is rejected by the bytes saved, which say little in long texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "CC0-1.0": "Released under CC0 1.0",
}
CUES = ("license", "licence", "licensed", "permission", "redistribution", "public domain", "cc by", "cc0", "mozilla public")

#: A cue may be wrapped, and marks of comments may stand between its words.
_CUE = re.compile("|".join(r"[\W_]+".join(map(re.escape, c.split())) for c in CUES), re.IGNORECASE)
_CUE_WORDS = tuple({c.split()[0] for c in CUES})
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+(?:-[^\W\d_]+)*")
#: Share of a template's words that may be missing, and be in between, for a modified notice.
LOOSE = 0.2


def regions(text: str, reach: int) -> list[list[re.Match]]:
    """The words of each line that holds a cue, and ``reach`` words before and after each cue; what touches is one."""
    low = text.lower()
    if not any(c in low for c in _CUE_WORDS):
        return []
    words = starts = None
    found, line = [], (0, -1)
    for m in _CUE.finditer(text):
        if words is None:
            words = list(_WORD.finditer(text))
            starts = [w.start() for w in words]
        if m.start() > line[1]:
            end = text.find("\n", m.start())
            line = (text.rfind("\n", 0, m.start()) + 1, len(text) if end < 0 else end)
        a = max(0, min(bisect_left(starts, line[0]), bisect_left(starts, m.start()) - reach))
        b = max(bisect_left(starts, line[1]), bisect_left(starts, m.end()) + reach)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return [words[a:b] for a, b in found]


class Template:
    def __init__(self, name: str, wording: str):
        self.name, self.words = name, [w.lower() for w in _WORD.findall(wording)]
        self.bag, spare = Counter(self.words), int(LOOSE * len(self.words))
        #: Words that a notice has of the template at least, and words that it takes at most.
        self.need, self.width = len(self.words) - spare, len(self.words) + spare
        raw = zstandard.ZstdCompressionDict(wording.lower().encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False, write_dict_id=False).compress

    def shares(self, words: list[str]) -> bool:
        """Whether so many of the words are the template's as any notice has."""
        left, have = dict(self.bag), 0
        for w in words:
            if left.get(w):
                left[w] -= 1
                have += 1
        return have >= self.need


class Scanner:
    def __init__(self, templates: dict[str, str]):
        # Sequences are coded with the literals that the template leaves; a low level is enough for short blocks.
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False).compress
        self.templates = [Template(*t) for t in templates.items()]
        self.reach = max((t.width for t in self.templates), default=0)

    def confirmed(self, text: str, region: list[re.Match]) -> list[tuple]:
        """(key, first word, end, row) of each confirmed place of each template, the best first: one that holds
        exactly the template, then the one that saves most bytes, then the one that lacks least, then the longest."""
        words, found = [w[0].lower() for w in region], []
        for t in self.templates:
            if not t.shares(words):
                continue
            seen = set()
            for i, word in enumerate(words):
                if word not in t.bag or not t.shares(words[i : i + t.width]):
                    continue
                missing, extra, version, first, end = differences(t.words, words[i : i + t.width])
                place = (i + first, i + end)
                if not version or missing > LOOSE * len(t.words) or extra > LOOSE * len(t.words) or place in seen:
                    continue
                seen.add(place)
                block = region[place[0] : place[0] + t.width]
                raw = " ".join(text[block[0].start() : block[-1].end()].lower().split()).encode()
                gain = len(self.plain(raw)) - len(t.compress(raw))
                found.append(((missing + extra > 0, -gain, missing + extra, -len(t.words), t.name, place), *place, (block[0].start(), t.name, gain, len(raw), missing, extra, missing == extra == 0)))
        return sorted(found)

    def scan(self, text: str) -> list[tuple]:
        """(offset, license, saved bytes, block bytes, missing, extra, exact) of each confirmed notice, but of a
        template those that overlap a better place of it, and of others those within a better place. The offset is
        that of the notice's first word."""
        out = []
        for region in regions(text, self.reach):
            rows, own, longest = [], {}, {}
            for _, first, end, row in self.confirmed(text, region):
                # Places of one template don't overlap, so only the neighbours count.
                mine = own.setdefault(row[1], [])
                at = bisect_left(mine, (first, end))
                if (at and mine[at - 1][1] > first) or (at < len(mine) and mine[at][0] < end):
                    continue
                if any(longest.get(a, 0) >= end for a in range(first - self.reach, first + 1)):
                    continue
                mine.insert(at, (first, end))
                longest[first] = max(end, longest.get(first, 0))
                rows.append(row)
            out += sorted(rows)
        return out


def differences(template: list[str], words: list[str]) -> tuple[int, int, bool, int, int]:
    """(template words that are missing, words in between, whether all numbers of the template are there, first word
    and end of what is the template's)."""
    same = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return len(template), 0, False, 0, 0
    size = sum(m.size for m in same)
    kept = {template[m.a + k] for m in same for k in range(m.size)}
    first, end = same[0].b, same[-1].b + same[-1].size
    return len(template) - size, end - first - size, all(w in kept for w in template if w[0].isdigit()), first, end


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed notice: ``id_col``, offset, license, saved_bytes, block_bytes, missing, extra, exact.

    Null and empty texts, and texts without a cue, give none. Rows aren't joined or grouped: repeated rows repeat
    their notices, null ids stay; only the two columns are read. Templates go to the workers; they don't grow with the data.
    """
    templates = TEMPLATES if templates is None else templates
    kind = df.schema[id_col].dataType
    names = ["id", "offset", "license", "saved_bytes", "block_bytes", "missing", "extra", "exact"]

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1)):
                for row in scanner.scan((text.as_py() or b"").decode("utf-8", "replace")):
                    rows.append(row)
                    at.append(i)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {kind.simpleString()}, offset long, license string, saved_bytes long, block_bytes long, missing long, extra long, exact boolean")
    return out.withColumnRenamed("id", id_col)
