"""License scan: winnowed template fingerprints and banded alignment.

Templates are whole license texts (``license_texts/``), the headers that some
licenses prescribe, and short notices made by rule from the licenses' names.
Their word k-grams are winnowed into an inverted index, a constant of this
module and so of bounded size. Every k-gram of a document is looked up in it;
hits on neighbouring diagonals of one template form candidates, windows of
bounded width that overlap, so that every match lies in one of them whole. A
candidate whose words cannot cover the template in any order is passed over; a
banded alignment decides about the others, again and again without the words of
a match, until none is left.

Templates of up to ``SHORT`` words have few such k-grams or one, which an edit
breaks. Those in ``NAMES`` are looked up by a word that a match must hold, so
that the index loses no match; their other named phrases must stand in the span
too, or a notice would match another license's. The other short ones have all
their grams of ``SHORT_GRAM`` words in the index as well.

Of matches of one template that overlap the best stays; of long templates, and
of SPDX lines, that cover one another the one with the most matched words.

Defined results: null and empty texts match nothing; words are runs of ASCII
letters and digits, in lower case; a template may match several places of a
text; a document without a match has no row; repeated rows are scanned alike;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GRAM = 5
WINNOW = 4
COVERAGE = 0.8
SHORT = 20
SHORT_GRAM = 3
_WORD = re.compile(r"[a-z0-9]+")

# Wordings that licenses prescribe or that stand in common use.
HEADERS: dict[str, str] = {
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "All-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}
_GNU_HEADER = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
    "later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more "
    "details."
)
#: Work, name and versions of the licenses with that header.
GNU = [
    ("program", "General Public License", "GPL", ("2", "3")),
    ("library", "Lesser General Public License", "LGPL", ("2.1", "3")),
    ("program", "Affero General Public License", "AGPL", ("3",)),
]
#: A license's name in a notice, by identifier; a name that ends in a version has it after "version" or "v".
NOTICES: dict[str, str] = {
    "Apache-2.0": "Apache License 2.0",
    "GPL-2.0": "GNU General Public License 2",
    "GPL-3.0": "GNU General Public License 3",
    "LGPL-2.1": "GNU Lesser General Public License 2.1",
    "LGPL-3.0": "GNU Lesser General Public License 3",
    "AGPL-3.0": "GNU Affero General Public License 3",
    "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0",
    "EPL-1.0": "Eclipse Public License 1.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "CDDL-1.0": "Common Development and Distribution License 1.0",
    "BSL-1.0": "Boost Software License 1.0",
    "OFL-1.1": "SIL Open Font License 1.1",
    "Artistic-2.0": "Artistic License 2.0",
    "AFL-3.0": "Academic Free License 3.0",
    "OSL-3.0": "Open Software License 3.0",
    "EUPL-1.2": "European Union Public Licence 1.2",
    "GFDL-1.3": "GNU Free Documentation License 1.3",
    "ODbL-1.0": "Open Database License 1.0",
    "PSF-2.0": "Python Software Foundation License 2",
}
PLAIN_NOTICES: dict[str, str] = {
    "MIT": "MIT License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "Zlib": "zlib License",
    "Unlicense": "Unlicense",
    "NCSA": "NCSA Open Source License",
    "PostgreSQL": "PostgreSQL License",
    "MS-PL": "Microsoft Public License",
}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["3.0", "4.0"]
CC_TITLES = ["Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives",
             "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives"]
_SPDX_MORE = [
    "0BSD", "BSD-4-Clause", "CC0-1.0", "CECILL-2.1", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "MIT-0", "WTFPL", "X11",
]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else _ascii_lower(text))


def _templates() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Templates, and the phrases that a match of a notice holds word by word.

    The first word of the first phrase is the notice's key.
    """
    out: dict[str, str] = {}
    names: dict[str, tuple[str, ...]] = {}
    for at in sorted(files("glyphmill.llm").joinpath("license_texts").iterdir(), key=lambda x: x.name):
        if at.name.endswith(".txt"):
            out[at.name.removesuffix(".txt")] = at.read_text("utf-8")
    out |= HEADERS
    for work, name, short, versions in GNU:
        for version in versions:
            full = version if "." in version else f"{version}.0"
            out[f"{short}-{full}-header"] = _GNU_HEADER.format(work=work, name=name, version=version)

    def phrase(text: str) -> str:
        return " ".join(words_of(text))

    def add(name: str, text: str, *held: str) -> None:
        out[name], names[name] = text, tuple(map(phrase, held))

    for spdx, title in PLAIN_NOTICES.items():
        own = title.removesuffix(" License")
        licensed, released = ("licensed", "notice") if spdx == "MIT" else ("notice", "released")
        add(f"{spdx}-{licensed}", f"Licensed under the {title}.", own, "licensed")
        add(f"{spdx}-{released}", f"Released under the {title}.", own, "released")
    for spdx, title in NOTICES.items():
        own, version = title.rsplit(" ", 1)
        key = own.removesuffix(" License") if spdx == "Apache-2.0" else own
        for verb in ("Licensed", "Released"):
            tag = "notice" if verb == "Licensed" else "released"
            add(f"{spdx}-{tag}", f"{verb} under the {own}, version {version}.", key, version, verb)
            add(f"{spdx}-{tag}-v", f"{verb} under the {own} v{version}.", key, f"v{version}", verb)
    for kind, title in zip(CC_KINDS, CC_TITLES, strict=True):
        for version in CC_VERSIONS:
            add(f"CC-{kind}-{version}-notice", f"Licensed under CC {kind} {version}.", f"CC {kind} {version}")
            line = f"This work is licensed under a Creative Commons {title} {version} International License."
            add(f"CC-{kind}-{version}-line", line, f"{title} {version}")
    every = [*PLAIN_NOTICES, *NOTICES, *_SPDX_MORE, *(f"CC-{k}-{v}" for k in CC_KINDS for v in CC_VERSIONS)]
    for spdx in every:
        line = f"SPDX-License-Identifier: {spdx}"
        add(f"SPDX-{spdx}", line, line)
    return out, names


def _ascii_lower(text: str) -> str:
    """A-Z to lower case and nothing else, so that offsets hold."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
TEMPLATES, NAMES = _templates()


def gram_hashes(ids: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash for each k-gram of word numbers."""
    if len(ids) < gram:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        h = (h ^ ids[k : len(ids) - gram + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnowed(hashes: np.ndarray) -> set[int]:
    """Positions picked: the last least hash of every window."""
    picked = set()
    for at in range(max(1, len(hashes) - WINNOW + 1)):
        part = hashes[at : at + WINNOW][::-1]
        if len(part):
            picked.add(at + len(part) - 1 - int(part.argmin()))
    return picked


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        split = [words_of(t) for t in templates.values()]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.words = [np.asarray([self.vocabulary[w] for w in s]) for s in split]
        self.bags = [np.unique(ids, return_counts=True) for ids in self.words]
        self.names_held = [[[self.vocabulary[w] for w in p.split()] for p in NAMES.get(n, ())] for n in self.names]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {1: {}, SHORT_GRAM: {}, GRAM: {}}
        for t, (ids, held) in enumerate(zip(self.words, self.names_held, strict=True)):
            if held:
                singles = gram_hashes(ids, 1)
                picked = [(1, singles, p) for p in np.flatnonzero(ids == held[0][0]).tolist()]
            else:
                hashes = gram_hashes(ids)
                picked = [(GRAM, hashes, p) for p in winnowed(hashes)]
            if not held and len(ids) <= SHORT:
                hashes = gram_hashes(ids, SHORT_GRAM)
                picked += [(SHORT_GRAM, hashes, p) for p in range(len(hashes))]
            for gram, of, p in picked:
                self.postings[gram].setdefault(int(of[p]), []).append((t, p))
        self.keys = {g: np.asarray(sorted(p), np.uint64) for g, p in self.postings.items()}

    def holds_names(self, t: int, part: list[int]) -> bool:
        """Whether the named phrases of a template all stand in a document's words."""
        return all(any(part[i : i + len(n)] == n for i in range(len(part))) for n in self.names_held[t])

    def can_cover(self, t: int, ids: np.ndarray, low: int, high: int, least: float) -> bool:
        """Whether the words that an alignment may meet hold ``least`` of the template's, in any order."""
        band, size = band_of(len(self.words[t])), len(self.words[t])
        part = ids[max(0, low - band) : max(0, high + band + size)]
        kinds, counts = self.bags[t]
        met = np.bincount(part, minlength=len(self.vocabulary) + 1)[kinds]
        return np.minimum(met, counts).sum() >= least

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(template, lowest diagonal, highest diagonal)``: windows of clustered hits."""
        diagonals: dict[int, set[int]] = {}
        known = ids > 0
        for gram, keys in self.keys.items():
            if len(ids) < gram or not len(keys):
                continue
            at_words = np.flatnonzero(np.convolve(known, np.ones(gram, int), "valid") == gram)
            hashes = gram_hashes(ids, gram)[at_words]
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            for k in np.flatnonzero(keys[at] == hashes).tolist():
                for t, p in self.postings[gram][int(hashes[k])]:
                    diagonals.setdefault(t, set()).add(int(at_words[k]) - p)
        for t, found in sorted(diagonals.items()):
            for low, high in windows(sorted(found), band_of(len(self.words[t]))):
                yield t, low, high


def windows(diagonals: list[int], band: int) -> Iterator[tuple[int, int]]:
    """Windows up to twice the band wide; hits within one band of each other share one."""
    start: int | None = None
    for d in diagonals:
        if start is None or d > start + band:
            start = d
            yield d, diagonals[bisect_right(diagonals, d + 2 * band) - 1]


def band_of(length: int) -> int:
    return max(4, 2 + length // 10)


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """``(matched words, first, last)`` of the best alignment between two diagonals.

    The whole template is aligned, the document's ends are free; a match counts
    3 and a gap or mismatch costs 1. Positions are the document's words. A row
    of the matrix is one step; runs of further words in the document are a
    running maximum along it.
    """
    band = band_of(len(template))
    low, high = low - band, high + band
    width = high - low + 1
    none = -(1 << 40)
    at = np.arange(width)
    inside = (low + at >= 0) & (low + at <= len(ids))
    score = np.where(inside, 0, none)
    matched, first, last = np.zeros(width, int), np.full(width, -1), np.full(width, -1)
    # the document's words beside the band, with a word that no template has beyond its ends
    begin, end = low, low + len(template) + width
    beside = np.full(end - begin, -1)
    held = slice(max(0, begin), min(len(ids), end))
    if held.start < held.stop:
        beside[held.start - begin : held.stop - begin] = ids[held]
    for i, w in enumerate(template.tolist()):
        part = beside[i : i + width]
        pos = low + i + at
        ok = (part >= 0) & (score > none)
        same = ok & (part == w)
        best = np.where(ok, score + np.where(same, 3, -1), none)
        m = np.where(same, matched + 1, np.where(ok, matched, 0))
        f = np.where(same & (first < 0), pos, np.where(ok, first, -1))
        e = np.where(same, pos, np.where(ok, last, -1))
        # the template's word is missing in the document
        skip = np.append(score[1:] - 1, none)
        missing = skip > best
        best = np.where(missing, skip, best)
        m = np.where(missing, np.append(matched[1:], 0), m)
        f = np.where(missing, np.append(first[1:], -1), f)
        e = np.where(missing, np.append(last[1:], -1), e)
        # the document has words more, within its bounds
        a, b = max(0, -1 - low - i), min(width, len(ids) - low - i)
        if a < b:
            raised = best[a:b] + at[a:b]
            top = np.maximum.accumulate(raised)
            source = np.maximum.accumulate(np.where(raised == top, at[a:b], -1))
            best[a:b] = top - at[a:b]
            m[a:b], f[a:b], e[a:b] = m[source], f[source], e[source]
        score, matched, first, last = best, m, f, e
    j = int(score.argmax())
    return (int(matched[j]), int(first[j]), int(last[j])) if matched[j] else None


@lru_cache(maxsize=1)
def _index() -> TemplateIndex:
    return TemplateIndex(TEMPLATES)


def verbatim(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> Iterator[int]:
    """Where the template stands word for word, at diagonals between two."""
    n, end = len(template), -1
    starts = ids[max(0, low) : max(0, high + 1)]
    for first in (np.flatnonzero(starts == template[0]) + max(0, low)).tolist():
        if first > end and np.array_equal(ids[first : first + n], template):
            yield first
            end = first + n - 1


def matches(ids: np.ndarray, index: TemplateIndex, coverage: float = COVERAGE) -> Iterator[tuple[int, int, int, int]]:
    """``(template, matched words, first, last)`` of all candidates' matches, copies of one place included."""
    own, of = ids, None
    for t, low, high in index.candidates(ids):
        if t != of:
            ids, of = own, t
        least = coverage * len(index.words[t])
        for first in verbatim(index.words[t], ids, low, high):
            last = first + len(index.words[t]) - 1
            yield t, len(index.words[t]), first, last
            # nothing fits these words better, in this window or another one
            if ids is own:
                ids = own.copy()
            ids[first : last + 1] = 0
        left = ids
        while index.can_cover(t, left, low, high, least):
            hit = align(index.words[t], left, low, high)
            if not hit or hit[0] < least:
                break
            m, first, last = hit
            if index.holds_names(t, left[first : last + 1].tolist()):
                yield t, m, first, last
            left = left.copy()
            left[first : last + 1] = 0


def settled(found: list[tuple[int, int, int, int]], index: TemplateIndex) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches of one template the best; of long templates and SPDX lines no covered ones."""
    kept: dict[int, list[tuple[int, int]]] = {}
    alone = []
    for t, m, first, last in sorted(set(found), key=lambda x: (x[0], -x[1], x[2], x[3])):
        taken = kept.setdefault(t, [])
        at = bisect_left(taken, (first, last))
        if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
            continue
        taken.insert(at, (first, last))
        alone.append((t, m, first, last))

    def family(t: int) -> str:
        if index.names[t].startswith("SPDX-"):
            return "spdx"
        return "long" if not index.names_held[t] and len(index.words[t]) > SHORT else ""

    out = []
    open_: list[tuple[int, int, str]] = []
    for t, m, first, last in sorted(alone, key=lambda x: (x[2], -x[3], -x[1])):
        open_ = [x for x in open_ if x[0] >= first]
        kind = family(t)
        if not kind or not any(x[0] >= last and x[1] > m and x[2] == kind for x in open_):
            out.append((t, m, first, last))
        open_.append((last, m, kind))
    return out


def scan(text: str | None, index: TemplateIndex, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """``(template, coverage, start, end)`` by template and start; offsets in code points."""
    text = text or ""
    words = words_of(text)
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.int64, len(words))
    found = list(matches(ids, index, coverage))
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(_ascii_lower(text))]
    rows = [
        (t, spans[first][0], spans[last][1], m / len(index.words[t])) for t, m, first, last in settled(found, index)
    ]
    return [(index.names[t], c, a, b) for t, a, b, c in sorted(rows)]


def _scan(coverage: float):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index()
        for block in blocks:
            for at in range(0, block.num_rows, 1000):
                some = block.slice(at, 1000)
                rows = [
                    (d, *hit)
                    for d, text in zip(*(c.to_pylist() for c in some.columns), strict=True)
                    for hit in scan(text, index, coverage)
                ]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "license", "coverage", "start", "end"],
                )

    return run


def scan_documents(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each template found in each document; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan(coverage), "doc_id long, license string, coverage double, start long, end long"
    )


def query(docs: DataFrame) -> DataFrame:
    return scan_documents(docs)
