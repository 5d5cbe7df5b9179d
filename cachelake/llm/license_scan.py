"""License scans: patience alignment of license texts with documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import _SPACE, chunks, hash_spans, text_buffer, word_spans

# Notices and permission texts of common licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "BSD text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
}

# What isn't a letter or digit ends a word; bytes of other scripts are letters.
_BETWEEN = _SPACE.copy()
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def scan_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and each row's first; words are runs of letters and digits."""
    data, offsets = text_buffer(texts)
    plain = np.where(_BETWEEN[data], np.uint8(32), data)
    starts, ends, rows = word_spans(plain, offsets)
    return hash_spans(plain, starts, ends), rows


def patience(text: list[int], template: list[int], t0: int = 0, p0: int = 0) -> list[tuple[int, int]]:
    """Aligned (text, template) positions.

    Words that are unique in both are anchors; their longest increasing
    subsequence stays, and the gaps between are aligned in the same way.
    Equal words at a gap's ends are taken before.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        there, here = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if here[w] == 1 and there.get(w) == 1}
        pairs = [(i, at[w]) for i, w in enumerate(text[a:b], a) if w in at]
        if not pairs:
            continue
        tails: list[int] = []
        links: list[tuple[int, int]] = []  # the pile's pair before
        tops: list[int] = []
        for k, (_, j) in enumerate(pairs):
            pile = bisect_left(tails, j)
            if pile == len(tails):
                tails.append(j)
                tops.append(k)
            else:
                tails[pile] = j
                tops[pile] = k
            links.append((k, tops[pile - 1] if pile else -1))
        chain, k = [], tops[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = links[k][1]
        lo_t, lo_p = a, c
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((lo_t, i, lo_p, j))
            lo_t, lo_p = i + 1, j + 1
        todo.append((lo_t, b, lo_p, d))
    return sorted((t0 + i, p0 + j) for i, j in out)


def find_templates(words: np.ndarray, templates: dict[str, np.ndarray], coverage: float, slack: float) -> list[tuple[str, float, int, int]]:
    """``license, coverage, start, end`` of each place in a text's words where
    a template is covered enough.

    A place is a stretch of ``slack`` times the template's length in which so
    many of its words occur that alignment could reach the coverage; other
    stretches can't, so nothing is missed by leaving them out.
    """
    found = []
    for name, template in templates.items():
        need = int(np.ceil(coverage * len(template) - 1e-9))
        hit = np.isin(words, template)
        if int(hit.sum()) < need:
            continue
        width = max(len(template), int(slack * len(template)))
        total = np.concatenate([[0], np.cumsum(hit)])
        begin = np.flatnonzero(hit)
        end = np.minimum(begin + width, len(words))
        good = begin[total[end] - total[begin] >= need]
        while len(good):
            lo = int(good[0])
            pairs = patience(words[lo : min(lo + width, len(words))].tolist(), template.tolist(), lo)
            if len(pairs) >= need:
                found.append((name, len(pairs) / len(template), pairs[0][0], pairs[-1][0] + 1))
                good = good[good > pairs[-1][0]]
            else:
                good = good[1:]
    # Of overlapping places the one with most aligned words stays; ties go to the longer cover, then the name.
    found.sort(key=lambda x: (-round(x[1] * len(templates[x[0]])), -x[1], x[3] - x[2], x[0]))
    kept: list[tuple[str, float, int, int]] = []
    for x in found:
        if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
            kept.append(x)
    return kept


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.9, slack: float = 1.25) -> DataFrame:
    """``doc_id, n_words, licenses``: where license texts occur in each text.

    ``licenses`` is an array of (license, coverage, start, end), in word
    positions, sorted by start; it is empty for null and empty texts and those
    without licenses.  Of places that overlap, the one with most aligned words
    stays; ties go to the longer cover, then to the name.  Whole texts are
    scanned, however long; rows are independent, so repeated rows and null ids
    are no special case; other columns are ignored; an empty table gives no rows.
    """
    known = {n: scan_words(pa.array([t]))[0] for n, t in (templates or TEMPLATES).items()}
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *known.values()]))
    least = min((int(np.ceil(coverage * len(t) - 1e-9)) for t in known.values()), default=1)
    ddl = "doc_id long, n_words long, licenses array<struct<license:string,coverage:double,start:long,end:long>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, "text"):
            words, rows = scan_words(batch.column(1))
            at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
            hits = np.concatenate([[0], np.cumsum(vocabulary[at] == words)]) if len(vocabulary) else np.zeros(len(words) + 1, int)
            out: list[list[dict]] = [[] for _ in range(len(rows) - 1)]
            for r in np.flatnonzero(hits[rows[1:]] - hits[rows[:-1]] >= least):
                places = sorted(find_templates(words[rows[r] : rows[r + 1]], known, coverage, slack), key=lambda x: (x[2], x[0]))
                out[r] = [dict(zip(("license", "coverage", "start", "end"), p, strict=True)) for p in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(rows)), pa.array(out, kind)], names=["doc_id", "n_words", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, ddl)
