import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, digest int, kept string, lic int"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def sample_rows():
    """A small corpus with every awkward case: nulls, copies, near copies, long texts, repeated rows."""
    rng = random.Random(3)
    syllables = ["ta", "re", "mo", "lin", "qu", "ser", "vo", "ké", "zu", "an"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []

    def add(text, lang="en", source="src1"):
        rows.append((len(rows), text, lang, source, len(text or ""), "x", 7, "y", 1))

    for i in range(60):
        add(words(rng, rng.randint(25, 120), vocabulary), rng.choice(["en", "fr", None]), f"src{i % 5}")
    for i in range(12):
        add(rows[3][1], "en", "src0")  # exact copies
    base = words(rng, 300, vocabulary).split()
    for i in range(14):  # near copies
        own = list(base)
        own[7 * i + 3] = "changed"
        add(" ".join(own), "fr", "src0")
    for text in (None, "", " \t\n", "42 !!", "one", "two words", "Ünïcode ‘quotes’ 😀 " * 30, "la " * 200, None):
        add(text, None, None)
    add(words(rng, 9000, vocabulary), "en", "src2")  # very long
    add("line one has a word\n" * 40 + words(rng, 40, vocabulary), "en", "bad")
    rows.append(rows[5])  # wholly repeated rows
    rows.append(rows[60])
    rows.append((None, "a row without an id but with text", "en", "src1", 3, "x", 7, "y", 1))
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
