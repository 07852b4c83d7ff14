import re

import numpy as np
import pytest
import xxhash

from glyphmill.llm import simhash


def naive_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_roots(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(rows, monkeypatch):
    texts = [r[1] for r in rows] + ["A b\x85c d", "Q " * 700 + "r s"]
    expected = [naive_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == expected
    monkeypatch.setattr(simhash, "BLOCK", 5)
    assert [simhash.fingerprint(t) for t in texts] == expected


def test_query(docs, rows, none):
    fps = {r[0]: naive_fingerprint(r[1]) for r in rows}
    got = {r.doc_id: r for r in simhash.query(docs).collect()}
    ids = sorted(k for k in fps if k is not None)
    roots = naive_roots([fps[i] for i in ids])
    for i, root in zip(ids, roots):
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == ids[root]
    assert len(set(roots)) < len(ids) - 10
    assert simhash.query(docs).count() == len(rows) and simhash.query(none).count() == 0


@pytest.mark.parametrize("heavy", [16_384, 2])
def test_links_lose_nothing(spark, heavy):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:20].tolist():  # balls and chains round each centre
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    distinct = spark.createDataFrame(signed, "fp long")
    roots = simhash.components(simhash.links(distinct, len(fps), heavy)).collect()
    name = {x: x for (x,) in signed} | {r.node: r.root for r in roots}
    parts = naive_roots(fps)
    by_root, by_brute = {}, {}
    for i, (x,) in enumerate(signed):
        by_root.setdefault(name[x], set()).add(i)
        by_brute.setdefault(parts[i], set()).add(i)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


def test_large_groups_split_exactly():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 256, 8, dtype=np.uint8)
    raw = np.tile(centre, (3000, 1))
    raw[:, 3:] ^= (rng.random((3000, 5)) < 0.5) * rng.integers(0, 32, (3000, 5), dtype=np.uint8)
    fps = np.unique(np.ascontiguousarray(raw).view(np.uint64)[:, 0])[:2500]
    assert len(fps) > 2048

    def parts(pairs):
        parent = {int(x): int(x) for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(b)] = find(a)
        out = {}
        for x in parent:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    split = parts(simhash.trees(fps))
    left, pairs = list(fps), []
    for i, x in enumerate(left):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ x) <= 3) + i + 1
        pairs += [(int(x), int(fps[j])) for j in near]
    assert split == parts(pairs)
    assert all((int(a) ^ int(b)) for a, b in simhash.trees(fps[:50]))


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 1000 for i in range(1, 300))


def test_one_row_of_each_component_survives(docs, rows, none, spark):
    left = simhash.surviving(docs)
    assert left.columns == docs.columns
    roots = naive_roots([naive_fingerprint(r[1]) for r in rows])
    best = {}
    for r, root in zip(rows, roots):
        best[root] = min(best.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    got = [(r.doc_id is None, r.doc_id or 0) for r in left.collect()]
    assert sorted(got) == sorted(best.values()) and len(got) < len(rows)
    assert simhash.surviving(none).count() == 0
    twice = "one two three four five six"
    table = [(1, twice), (1, twice), (1, twice.upper()), (None, "alone here"), (None, twice), (1, "quite another text")]
    kept = simhash.surviving(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(r.text.lower() for r in kept) == ["alone here", twice, "quite another text"]
