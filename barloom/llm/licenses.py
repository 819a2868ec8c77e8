"""License scans by conditional compression.

Where a text holds a licensing word, a window is taken for each template and each of its own licensing words, as many
telling words as the template has, on whichever lines. It is compressed by itself and with the template as zstandard
raw dictionary; what that saves is measured against the template's own compressed size, so neither prose nor other
notices nearby weaken it. Every template above the threshold is confirmed by its exact wording differences: no word that
tells licences apart (names, numbers, conditions) may be missing, changed or added; other words may.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import rows_of, text_batches

#: Short notices and opening clauses of public licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A text that holds one of these, in either case, may speak of a licence there.
TRIGGERS = ("licen", "copyright", "spdx", "redistribut", "permission is", "permission to use", "public domain", "free software")
#: Words that may be missing or changed without making it another licence.
COMMON = frozenset("a all and any are as at be by can code do following for form forms free from hereby in is it library of on or or/and program software source such that the this to use used with work you your".split())
#: Least part of a template's own compressed size that it saves of a window, and least part of its words found.
LEAST_SAVED, LEAST_FOUND = 0.15, 0.85
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
#: the words of one trigger may stand on two lines
_TRIGGER = re.compile("|".join("[^A-Za-z0-9]+".join(map(re.escape, t.split())) for t in TRIGGERS), re.IGNORECASE)
_JOINED = re.compile(r"[A-Za-z0-9.\-]")


@dataclass(frozen=True)
class Found:
    license: str
    start: int  # code points
    end: int
    saved: float
    differences: tuple[str, ...]


class Detector:
    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates = [(name, [w.lower() for w in _WORD.findall(text)]) for name, text in templates]
        self.telling = [[w for w in words if w not in COMMON] for _, words in self.templates]
        self.gaps = [_gaps(words) for _, words in self.templates]
        self.places = [_places(words) for _, words in self.templates]
        self.reach = 1 + max(map(len, self.telling), default=0)
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode() + b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, words in self.templates]
        self.own = [len(self.plain.compress((" ".join(words) + " ").encode())) for _, words in self.templates]
        #: windows repeat in a text and across documents; what one saves is the same for all
        self.saved = lru_cache(maxsize=20_000)(self._saved)

    def find(self, text: str | None) -> list[Found]:
        """Licences of a text, by place."""
        found = [x for start, end, places in self.regions(text or "") for x in self._licenses(text, start, end, places)]
        return sorted(found, key=lambda x: (x.start, x.end, x.license))

    def regions(self, text: str) -> list[tuple[int, int, list[int]]]:
        """(start, end, places of triggers): whole words within reach of triggers; they do not overlap."""
        spans: list[tuple[int, int, list[int]]] = []
        for m in _TRIGGER.finditer(text):
            start, end = self._before(text, m.start()), self._after(text, m.start())
            if spans and start <= spans[-1][1]:
                last = spans.pop()
                spans.append((min(start, last[0]), max(end, last[1]), last[2]))
            else:
                spans.append((start, end, []))
            spans[-1][2].append(m.start())
        return spans

    def _before(self, text: str, at: int) -> int:
        """Where a stretch begins that holds as many telling words before ``at`` as any window needs."""
        size = 1024
        while True:
            start = max(0, at - size)
            while start and _JOINED.match(text[start - 1]):
                start -= 1
            if not start or sum(w.lower() not in COMMON for w in _WORD.findall(text, start, at)) > self.reach:
                return start
            size *= 2

    def _after(self, text: str, at: int) -> int:
        left = self.reach + 1
        for m in _WORD.finditer(text, at):
            left -= m[0].lower() not in COMMON
            if left < 0:
                return m.end()
        return len(text)

    def _saved(self, k: int, window: str) -> float:
        """The part of a template's own compressed size that it saves of the window."""
        data = window.encode()
        return (len(self.plain.compress(data)) - len(self.given[k].compress(data))) / self.own[k]

    def _licenses(self, text: str, start: int, end: int, places: list[int]) -> list[Found]:
        """All notices of a region: of those that share words the one with most words found."""
        words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text, start, end)]
        begins = [w[1] for w in words]
        telling = [i for i, w in enumerate(words) if w[0] not in COMMON]
        plain, names = [w[0] for w in words], [words[i][0] for i in telling]
        numbers = {bisect_left(telling, bisect_right(begins, at) - 1) for at in places}
        hits: dict[tuple[int, int, int], tuple] = {}
        for k, wanted in enumerate(self.telling):
            for j in sorted({n - x for n in numbers for x in self.places[k] if 0 <= n - x <= len(telling) - len(wanted)}):
                upto = j + len(wanted)
                window = plain[telling[j - 1] + 1 if j else 0 : telling[upto] if upto < len(telling) else len(plain)]
                saved = self.saved(k, " ".join(window) + " ")
                match = self.aligned(k, plain, telling, j) if saved >= LEAST_SAVED and names[j:upto] == wanted else None
                if match:
                    hits[k, *match[:2]] = (saved, *match[2:])
        found, taken = [], []
        for (k, first, last), (saved, _, differences) in sorted(hits.items(), key=lambda x: (-x[1][1], -x[1][0], x[0])):
            if all(last <= a or b <= first for a, b in taken):
                taken.append((first, last))
                found.append(Found(self.templates[k][0], words[first][1], words[last - 1][2], round(saved, 4), differences))
        return found

    def aligned(self, k: int, words: list[str], telling: list[int], j: int):
        """(first, last, words found, differences) of a template whose telling words are those from the j-th on; None if too few of its other words are there."""
        upto = j + len(self.telling[k])
        marks = [telling[j - 1] if j else -1, *telling[j:upto], telling[upto] if upto < len(telling) else len(words)]
        first, last, found, differences = marks[1], marks[-2] + 1, upto - j, []
        for g, (gap, a, b) in enumerate(zip(self.gaps[k], marks, marks[1:], strict=False)):
            there = words[a + 1 : b]
            if g == 0:  # from the first telling word backwards
                runs = [(len(gap) - r.a - r.size, len(there) - r.b - r.size, r.size) for r in _same(gap[::-1], there[::-1])][::-1]
                skip = runs[0][1] if runs else len(there)
                first, there, runs = first - (len(there) - skip), there[skip:], [(x, y - skip, n) for x, y, n in runs]
            else:
                runs = [(r.a, r.b, r.size) for r in _same(gap, there)]
                if g == len(self.gaps[k]) - 1:
                    there = there[: runs[-1][1] + runs[-1][2]] if runs else []
                    last += len(there)
            x, y = 0, 0
            for p, q, n in [*runs, (len(gap), len(there), 0)]:
                differences += [f"-{w}" for w in gap[x:p]] + [f"+{w}" for w in there[y:q]]
                x, y, found = p + n, q + n, found + n
        return (first, last, found, tuple(differences)) if found >= LEAST_FOUND * len(self.templates[k][1]) else None


def _places(words: list[str]) -> list[int]:
    """Which of a template's telling words begin a trigger; without any, all."""
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    begin = {bisect_right(starts, m.start()) - 1 for m in _TRIGGER.finditer(" ".join(words))}
    telling = [i for i, w in enumerate(words) if w not in COMMON]
    return [x for x, i in enumerate(telling) if i in begin] or list(range(len(telling)))


def _same(a: list[str], b: list[str]):
    return [r for r in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if r.size]


def _gaps(words: list[str]) -> list[list[str]]:
    """The common words before each telling word, and after the last."""
    gaps: list[list[str]] = [[]]
    for w in words:
        if w in COMMON:
            gaps[-1].append(w)
        else:
            gaps.append([])
    return gaps


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("saved", T.DoubleType()), T.StructField("differences", T.ArrayType(T.StringType()))]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row (id, licenses) for each row of docs: license, start, end, saved, differences, by place.

    A null or empty text has none. Shuffles nothing; reads two columns of each row; repeated rows repeat their
    result. A text is searched whole; only windows around licensing words are compressed.
    """
    text_batches(docs.sparkSession)
    import pyarrow as pa

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("licenses", FOUND)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("differences", pa.list_(pa.string()))]))

    def scan(batches):
        detector = Detector(templates)
        for batch in batches:
            found = [[{"license": x.license, "start": x.start, "end": x.end, "saved": x.saved, "differences": list(x.differences)} for x in detector.find(text)] for (text,) in rows_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
