import hashlib
import pathlib
import random
import re

import pytest

from glyphmill.llm import secrets

KEY = "q7Gk2LmZp9Xw4TbVr8Yc"
CASES = {
    f'password = "{KEY}"': [("assign", 0, 32)],
    "ApI_KEY:abcdefgh tok": [("assign", 0, 16)],
    "token=short": [],
    "AKIA" + "Z" * 12: [("access", 0, 16)],
    "AKIA" + "Z" * 11: [],
    "x" + "0a" * 16: [("hex", 1, 33)],
    "é secret: " + "f" * 40: [("assign", 2, 50), ("hex", 10, 50)],
    "ſecret=abcdefghij": [],
}


def naive(text):
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_patterns():
    for text, spans in CASES.items():
        assert [x for x in secrets.scan(text) if x[0] != "novel"] == spans == naive(text)


def test_novelty():
    found = secrets.scan(f"Authorization header with Bearer {KEY}{KEY[::-1]} goes here")
    assert [k for k, _, _ in found] == ["novel"]
    _, a, b = found[0]
    assert b - a == 40
    for plain in (
        "bearer token " + "abcabcabcabc1abcabcabcabc1",  # regular
        f"nothing near {KEY}",  # no context
        "credential getElementByIdapplication1",  # identifiers
        f"secret: {KEY} and the token before was {KEY}",  # a pattern's span; then known from its surroundings
    ):
        assert not [x for x in secrets.scan(plain) if x[0] == "novel"]
    far = "credential " + "word " * 30 + KEY
    assert secrets.scan(far) == []


def test_query(docs, rows, none, spark):
    table = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    texts = list(CASES)
    for r in secrets.query(table).collect():
        base = secrets.joined(naive(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert r.n_assign + r.n_access + r.n_hex == len(naive(texts[r.doc_id]))
    assert secrets.query(docs).count() == len(rows) and secrets.query(docs).where("spans <> ''").count() == 0
    assert secrets.query(none).count() == 0


def test_long_keys_are_novel():
    rng = random.Random(5)
    upper = "0123456789ABCDEF"
    base32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for letters, length in ((upper, 64), (upper, 128), (upper, 1000), (base32, 256), (base62, 1024), (base62, 5000)):
        for _ in range(20):
            key = "".join(rng.choices(letters, k=length))
            assert secrets.scan(f"Authorization: Bearer {key} end") == [("novel", 22, 22 + length)]
    assert secrets.scan("bearer token " + "xyzxyzxyzxyz1" * 100) == []


def test_keys_that_stand_twice():
    key = "Zk4TbVr8YcQ2nLmZp9Xw7Gd5HsJ3fUa6"
    found = secrets.scan(f"client-id {key} and again, the signature {key} too")
    assert found == [("novel", 10, 42), ("novel", 68, 100)]
    lines = f"authorization_a={key}\nauthorization_b={key}\n"
    assert len(secrets.scan(lines)) == 2
    cut = f"credential {key}" + " word" * 48 + f" credential {key}"
    assert [a for _, a, _ in secrets.scan(cut)] == [11, len(cut) - 32]
    assert len(secrets.scan("bearer " + f"{key} " * 5)) >= 2
    assert secrets.scan(f"bearer {key.lower()[:8]}1" + " getElementByIdapplication1" * 2) == []


ALPHABETS = {
    "upper hex": "0123456789ABCDEF",
    "lower hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
PLACES = [
    'def connect(host, credential="%s", timeout=30):\n    return Client(host, credential)\n',
    'headers = {"Authorization": "Bearer %s"}\nresponse = requests.get(url, headers=headers)\n',
    'const privateKey = "%s";\nmodule.exports = { privateKey };\n',
    "client_id: %s\nregion: eu-west-1\n",
]


@pytest.mark.parametrize("name", list(ALPHABETS))
def test_recall_of_planted_keys(name):
    words = b" ".join(b"response headers timeout client connect module exports region import return".split() * 3)
    for length in (16, 20, 24, 32, 40, 64, 88, 128, 256):
        rng = random.Random(length)
        for how in (secrets.Novelty(), secrets.Novelty(words=words), secrets.Novelty(around=None)):
            found = 0
            for i in range(40):
                key = "".join(rng.choices(ALPHABETS[name], k=length))
                text = "import os\nimport sys\n\n" + PLACES[i % 4] % key + '\nprint("done")\n'
                at = text.index(key)
                found += any(a < at + length and b > at for _, a, b in secrets.scan(text, how))
            assert found >= 36, (length, how)


def test_clean_code_has_few_findings():
    files = [f for f in pathlib.Path(re.__file__).parents[1].glob("*.py")]
    texts = [f.read_text(errors="replace") for f in files]
    found = sum(k == "novel" for t in texts for k, _, _ in secrets.scan(t))
    assert sum(map(len, texts)) > 2_000_000 and found <= 1.5 * sum(map(len, texts)) / 1e6


def test_surroundings_are_a_parameter():
    key = "Identifier7WithSomeLetters42AndMore"
    text = f"{key[:17]} {key[17:]} " + "word " * 80 + f"credential {key}"
    near = secrets.Novelty(novel=0.5)
    assert [x[0] for x in secrets.scan(text, near)] == ["novel"]
    assert secrets.scan(text, secrets.Novelty(novel=0.5, around=None)) == []


def test_words_of_the_corpus(spark):
    key = "zq7Gkabcdefgh2LmZp9Xw4TbVr8Yc"
    code = [f"token = load_settings(region{i}, timeout)" for i in range(9)]
    rows = [(i, f"{c}\ncredential {key}\n") for i, c in enumerate(code)] + [(50, None), (51, "unrelated words timeout")]
    words = secrets.common_words(spark.createDataFrame(rows, "doc_id long, text string")).decode().split()
    # the key's line is one line, however many documents hold it
    assert set(words) == {"token", "load", "settings", "region", "timeout"}
    assert secrets.common_words(spark.createDataFrame(rows, "doc_id long, text string").limit(0)) == b""
    how = secrets.Novelty(words=" ".join(words).encode())
    assert [x[0] for x in secrets.scan(f"credential {key}", how)] == ["novel"]
