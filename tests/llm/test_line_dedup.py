import random
import zlib
from collections import defaultdict

from glyphmill.llm import line_dedup

PASSAGE = [f"passage line {i} with several words in it" for i in range(8)]


def lines_of(tag, n):
    return [f"{tag} own line {i} of this text" for i in range(n)]


def run(spark, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup.line_dedup(table).collect()}


def test_shared_passage(spark):
    a, b, c = lines_of("a", 3), lines_of("b", 4), lines_of("c", 2)
    texts = ["\n".join(a + PASSAGE), "\n".join(b[:2] + PASSAGE + b[2:]), "\n".join(PASSAGE[:4] + c + PASSAGE[4:]), "\n".join(a)]
    got = run(spark, *texts)
    assert got[0].text == texts[0] and got[0].removed == []
    assert got[1].text == "\n".join(b) and got[1].removed == list(range(2, 10))
    assert got[2].text == "\n".join(c)
    assert got[3].text == "" and got[3].n_lines == 3


def test_short_matches_stay(spark):
    got = run(spark, "Share this\n" + "\n".join(lines_of("a", 3)), "Share this\n" + "\n".join(lines_of("b", 3)))
    assert got[1].removed == []


def test_moved_blocks_and_repeats(spark):
    swapped = "\n".join(PASSAGE[4:] + PASSAGE[:4])
    repeated = "\n".join(PASSAGE + ["", "  "] + PASSAGE)
    got = run(spark, "\n".join(PASSAGE), swapped, None, "")
    assert len(got[1].removed) == 4  # the alignment keeps one of two blocks that cross
    assert got[2].text == "" and got[3].removed == []
    got = run(spark, "\n".join(PASSAGE), repeated)
    assert got[1].removed == list(range(8))  # one copy is aligned with one copy
    # the swapped document aligns with the end of the first copy and the start of the second
    got = run(spark, "\n".join(PASSAGE), swapped, repeated)
    assert got[2].removed == [*range(8), *range(10, 14)]


def test_longest_alignment():
    points = [(0, 5), (1, 0), (2, 1), (3, 2), (4, 9)]
    assert line_dedup.increasing(points) == [(1, 0), (2, 1), (3, 2), (4, 9)]
    assert line_dedup.increasing([]) == []
    assert line_dedup.blocks_of([(1, 0), (2, 1), (3, 2), (4, 9)], [0, 9, 9, 9, 3]) == {1, 2, 3}
    assert line_dedup.patience(list("xabcy"), list("abzc")) == [(1, 0), (2, 1), (3, 3)]


def test_query(docs, rows, none):
    got = line_dedup.query(docs).collect()
    assert len(got) == len(rows)
    first = {}
    for r in rows:
        if r[0] is not None:
            first.setdefault(r[1] or "", r[0])
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        assert r.n_lines == text.count("\n") + 1
        copy = first.get(text) not in (r.doc_id, None) and len(text.split()) >= line_dedup.MIN_WORDS
        assert (r.n_removed > 0) == copy
        if not r.n_removed:
            assert r.text_crc32 == zlib.crc32(text.encode())
    assert line_dedup.query(none).count() == 0


def test_common_lines_stay_linear(spark):
    texts = ["\n".join([*PASSAGE, *lines_of(f"d{i}", 2)]) for i in range(300)]
    got = run(spark, *texts)
    assert got[0].removed == [] and all(len(got[i].removed) == 8 for i in range(1, 300))


def test_short_lines_of_several_owners(spark):
    block = [f"short line {i}" for i in range(6)]
    owners = [f"{x}\n" + "\n".join(lines_of(f"o{i}", 2)) for i, x in enumerate(block)]
    b, c = lines_of("b", 3), lines_of("c", 3)
    got = run(spark, *owners, "\n".join(b + block), "\n".join(c[:1] + block + c[1:]))
    assert got[6].removed == []
    assert got[7].text == "\n".join(c)


def test_gap_between_lines_of_several_owners(spark):
    x, y = "first of two lines here", "second of two lines here"
    got = run(spark, f"{x}\na", f"{y}\nb", f"{x}\nc\n{y}", f"d\n{x}\ne\n{y}")
    assert got[2].removed == [] and got[3].text == "d\ne"


def test_query_deletes_every_copy(spark):
    quoted = "four five six\nelse\none two three\nfour five six\nseven eight nine ten"
    texts = [
        "\n".join(PASSAGE),
        "\n".join(PASSAGE[4:] + PASSAGE[:4]),
        "\n".join(PASSAGE + ["", "x"] + PASSAGE + PASSAGE),
        "one two three\nfour five six\nseven eight nine ten",
        quoted,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_dedup.query(table).collect()}
    assert got[0] == got[3] == ""
    assert got[1] == "0,1,2,3,4,5,6,7"
    assert got[2] == ",".join(str(i) for i in range(26) if i not in (8, 9))
    assert got[4] == "2,3,4"


def all_pairs(rows, min_words=line_dedup.MIN_WORDS):
    """Removed line numbers by document: every diagonal block of every pair of documents."""
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})
    held = [(i, line_dedup.lines_of(t)) for i, t in docs]
    held = [(i, line_dedup.cut(h), w, n) for i, (h, w, n) in held]
    out = defaultdict(set)
    for k, (did, a, words, lines) in enumerate(held):
        for _, b, _, _ in held[:k]:
            places = defaultdict(list)
            for j, x in enumerate(b):
                places[x].append(j)
            found = sorted((j - i, i, j) for i, x in enumerate(a) for j in places.get(x, ()))
            by_diagonal = defaultdict(list)
            for d, i, j in found:
                by_diagonal[d].append((i, j))
            for chain in by_diagonal.values():
                out[did] |= {lines[i] for i in line_dedup.blocks_of(chain, words, min_words)}
    return {k: v for k, v in out.items() if v}


def scattered(rng, n):
    """Documents of short common lines, passages, copies and gaps."""
    common = [f"common {i} " + "w " * rng.randint(0, 3) for i in range(12)]
    passages = [[f"p{i} l{j} " + "v " * rng.randint(0, 6) for j in range(rng.randint(3, 9))] for i in range(15)]
    out = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else rng.choices(common, k=rng.randint(1, 5))
            for i in range(len(part)):
                if rng.random() < 0.1:
                    part[i] = f"own {d} {rng.random()}"
            lines += part + [f"own {d} {rng.random()}"] * rng.randint(0, 2)
        out.append("\n".join(lines))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(11)
    rows = list(enumerate(scattered(rng, 60)))
    expected = all_pairs(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(map(len, expected.values())) > 200

    def found(rare):
        got = line_dedup.line_dedup(table, every_copy=True, rare=rare).collect()
        return {r.doc_id: set(r.removed) for r in got if r.removed}

    assert found(60) == expected
    some = found(4)
    assert all(some[d] <= expected[d] for d in some)
    assert sum(map(len, some.values())) >= 0.9 * sum(map(len, expected.values()))


def test_lines_first_seen_in_several_documents(spark):
    own = [f"line {i} of a passage" for i in range(8)]
    owners = [f"{x}\nalone {i}" for i, x in enumerate(own)]
    b = "\n".join(y for i, x in enumerate(own) for y in (x, f"b {i}"))
    c = "\n".join(y for i, x in enumerate(own) for y in (x, f"c {i}"))
    got = run(spark, *owners, b, c)
    assert got[8].removed == [] and got[9].text == "\n".join(f"c {i}" for i in range(8))


def test_long_repeats_stay_linear(spark):
    text = "\n".join(["la la la"] * 20_000 + [f"x {i % 50}" for i in range(20_000)])
    got = run(spark, text, "head\n" + text + "\ntail", "\n".join(["x 1"] * 30_000))
    assert len(got[1].removed) == 40_000 and got[2].removed == []
