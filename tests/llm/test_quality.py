import re

from glyphmill.llm import quality


def naive(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, twice = set(), set()
    for x in wins:
        (twice if x in seen else seen).add(x)
    covered = {p for i, x in enumerate(wins) if x in twice for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def host_rates(rows):
    hosts = {}
    for r in rows:
        if r[3] is not None:
            hosts.setdefault(r[3], []).append(naive(r[1])[-1])
    raw = [sum(h) / len(h) for h in hosts.values()]
    mean = sum(raw) / len(raw)
    var = sum((x - mean) ** 2 for x in raw) / (len(raw) - 1) if len(raw) > 1 else 0
    w = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else 1.0
    return {k: (sum(h) + mean * w) / (len(h) + w) for k, h in hosts.items()}


def test_against_brute_force(docs, rows, none):
    rates = host_rates(rows)
    assert rates["bad"] > rates["src1"]
    got = quality.quality_rules(docs, max_rate=0.5 * (rates["bad"] + sorted(rates.values())[-2])).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        source = by_id[r.doc_id][3]
        assert tuple(r[c] for c in quality.MEASURES) + (r.base_failed,) == naive(by_id[r.doc_id][1])
        assert (r.host_rate is None) == (source is None)
        assert source is None or abs(r.host_rate - rates[source]) < 1e-9
        assert r.kept == (not r.base_failed and source != "bad")
    assert quality.query(none).count() == 0


def test_windows(spark):
    texts = ["a b c d e f g h", "a b c d e f g h " * 2, "x " * 9, "a b c d e f g h q a b c d e f g h", "#a\n#a\n \n \n|"]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality.query(table).collect():
        assert tuple(r[c] for c in quality.MEASURES) == naive(texts[r.doc_id])[:-1]


def test_passing_keeps_columns(docs, rows):
    out = quality.passing(docs)
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in quality.query(docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == kept
    assert {r.n_words for r in out.select("n_words").distinct().collect()} == {"x"}


def test_plan_is_native(docs):
    plan = quality.query(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
