import numpy as np
import pytest

from glyphmill.llm import licenses

INDEX = licenses.TemplateIndex(licenses.TEMPLATES)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_templates_find_themselves(name):
    text = "Some words before.\n" + licenses.TEMPLATES[name].upper() + "\nand some after é"
    hit = [x for x in licenses.scan(text, INDEX) if x[0] == name]
    assert hit and hit[0][1] == 1.0
    _, _, a, b = hit[0]
    assert licenses.words_of(text[a:b]) == licenses.words_of(licenses.TEMPLATES[name])


def test_edits_and_places():
    words = licenses.TEMPLATES["MIT"].split()
    edited = " ".join(words[:20] + ["kindly"] + words[20:40] + words[43:])  # one more, three missing
    found = [x for x in licenses.scan(f"{edited} filler {' '.join(words)}", INDEX) if x[0] == "MIT"]
    assert len(found) == 2 and 0.9 < found[0][1] < 1.0 and found[1][1] == 1.0
    half = " ".join(words[: len(words) // 2])
    assert not [x for x in licenses.scan(half, INDEX) if x[0] == "MIT"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_against_full_matrix():
    rng = np.random.default_rng(2)
    for _ in range(30):
        template = rng.integers(1, 50, 60)
        doc = np.concatenate([rng.integers(60, 90, 10), np.delete(template, rng.integers(0, 60, 4)), rng.integers(60, 90, 5)])
        matched, first, last = licenses.align(template, doc, 10, 10)
        assert matched >= lcs(template, doc) - 1 and first >= 10 and last < len(doc) - 5


def test_query(docs, none, spark):
    assert licenses.query(docs).count() == 0 and licenses.query(none).count() == 0
    table = spark.createDataFrame([(1, None), (2, "Released under the MIT License."), (2, "Released under the MIT License.")], "doc_id long, text string")
    got = licenses.query(table).collect()
    assert [(r.doc_id, r.license, r.start, r.end) for r in got] == [(2, "MIT-notice", 0, 30)] * 2


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the terms of the MIT License.", {"MIT-notice"}),
        ("Licensed under a CC BY 4.0 license", {"CC-BY-4.0-notice"}),
        ("Licensed under the Apache Software License, Version 2.0.", {"Apache-2.0-notice"}),
        ("Licensed under the terms of the BSD 3-Clause License", {"BSD-3-Clause-notice"}),
        ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0-notice"}),
        ("Licensed under the Foo License.", set()),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0-notice"}),
        ("Licensed under the GNU Lesser General Public License v2.1", {"LGPL-2.1-notice-v"}),
        ("released under the GNU Affero General Public License, version 3", {"AGPL-3.0-released"}),
        ("Licensed under the BSD 2-Clause License", {"BSD-2-Clause-notice"}),
        ("# SPDX-License-Identifier: Apache-2.0", {"SPDX-Apache-2.0"}),
        ("SPDX-License-Identifier: MIT-0", {"SPDX-MIT-0"}),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", set()),
    ],
)
def test_edited_notices(text, names):
    found = licenses.scan(f"before {text} after", INDEX)
    assert {x[0] for x in found} == names and all(x[1] == 1.0 for x in found)


def test_one_word_less_of_a_short_notice():
    assert [(x[0], x[1]) for x in licenses.scan("Released under MIT License", INDEX)] == [("MIT-notice", 0.8)]
    text = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License"
    assert [x[0] for x in licenses.scan(text, INDEX)] == ["CC-BY-SA-4.0-line"]


def test_many_common_licenses():
    whole = [n for n in licenses.TEMPLATES if n not in licenses.NAMES and not n.endswith("-header")]
    assert len(whole) >= 24 and len(licenses.TEMPLATES) >= 150
    # two whole texts with fragments between them, and a text beside a longer one that holds its words
    words = licenses.TEMPLATES["MIT"].split()
    between = " x ".join(" ".join(words[i : i + 9]) for i in range(0, 90, 9))
    found = [x for x in licenses.scan(" ".join(words) + f" {between} " + " ".join(words), INDEX) if x[0] == "MIT"]
    assert [x[1] for x in found] == [1.0, 1.0]
    edited = "The Software " + licenses.TEMPLATES["BSD-3-Clause"].replace("HOLDERS", "OWNERS")
    assert [x[0] for x in licenses.scan(edited, INDEX)] == ["BSD-3-Clause"]


def test_notices_in_a_row():
    text = "\n".join(["Licensed under the MIT License."] * 7)
    assert [x[2:] for x in licenses.scan(text, INDEX)] == [(32 * i, 32 * i + 30) for i in range(7)]


def without_index(ids):
    """Every template aligned with the whole document."""
    out = []
    for t, template in enumerate(INDEX.words):
        if len(template) > 250:
            continue
        left, least = ids, licenses.COVERAGE * len(template)
        while True:
            hit = licenses.align(template, left, -len(template), len(left))
            if not hit or hit[0] < least:
                break
            if INDEX.holds_names(t, left[hit[1] : hit[2] + 1].tolist()):
                out.append((t, *hit))
            left = left.copy()
            left[hit[1] : hit[2] + 1] = 0
    return licenses.settled(out, INDEX)


def test_scan_against_alignment_without_the_index():
    rng = np.random.default_rng(8)
    small = [t for t, w in enumerate(INDEX.words) if len(w) <= 250]
    missed = total = 0
    for _ in range(12):
        doc = []
        for t in rng.choice(small, 4):
            part = INDEX.words[t].tolist()
            for _ in range(int(rng.integers(0, len(part) // 12 + 1))):
                part[int(rng.integers(0, len(part)))] = int(rng.integers(0, len(INDEX.vocabulary)))
            doc += rng.integers(0, 40, 15).tolist() + part
        ids = np.asarray(doc)
        got = licenses.settled(list(licenses.matches(ids, INDEX)), INDEX)
        for t, m, first, last in without_index(ids):
            total += 1
            missed += not any(g[0] == t and g[1] >= m and g[2] <= last and first <= g[3] for g in got)
        for t, m, first, last in got:
            if len(INDEX.words[t]) <= 250:
                assert m >= licenses.COVERAGE * len(INDEX.words[t]) and last < len(ids) and first >= 0
    assert total >= 40 and missed <= 0.02 * total


def test_recall_of_short_templates_without_the_index():
    rng = np.random.default_rng(4)
    for t, template in enumerate(INDEX.words):
        for _ in range(20 if len(template) <= licenses.SHORT else 0):
            doc = template.tolist()
            for _ in range(int(rng.integers(0, len(template) // 5 + 1))):
                doc.pop(int(rng.integers(0, len(doc))))
            doc.insert(int(rng.integers(0, len(doc))), 0)
            ids = np.asarray([0] * 6 + doc + [0] * 6)
            hit = licenses.align(template, ids, 6, 6)
            if hit[0] < licenses.COVERAGE * len(template) or not INDEX.holds_names(t, ids[hit[1] : hit[2] + 1].tolist()):
                continue
            got = [licenses.align(template, ids, a, b) for u, a, b in INDEX.candidates(ids) if u == t]
            assert hit[0] in [g[0] for g in got if g], (INDEX.names[t], doc)
