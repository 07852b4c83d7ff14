import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import distance, lexicon, normalize, stem, stopwords, tokenize
from glyphmill.plans import oracles, stem_sql
from glyphmill.streaming.text import tokenized_stream

TEXT = [
    (normalize.lowercase, "HeLLo ÉCOLE", "hello école"),
    (normalize.strip_accents, "Café Ñandú Ÿ œ ß é", "Cafe Nandu Ÿ œ ß e"),
    (normalize.normalize_whitespace, "  a \t\n b\x0bc  ", "a b c"),
    (normalize.normalize_whitespace, "a  b", "a  b"),
    (normalize.strip_punctuation, "a_b-c! “d”", "abc “d”"),
    (lambda c: normalize.replace_numbers(c), "v1.2.3", "v.."),
    (lambda c: normalize.replace_numbers(c, "$1\\"), "a12b", "a$1\\b"),
    (normalize.strip_html, '<p class="a>b">x</p> 1 < 2 <b', "x 1 < 2 <b"),
    (normalize.strip_html, "a<!-- c --><?x?>b", "ab"),
    (normalize.replace_urls, "see http://a.b/c?d. and www.x.y, ok", "see <url>. and <url> ok"),
    (normalize.replace_urls, "www.", "<url>."),
    (normalize.replace_emails, "mail a.b+c@d.co.uk. or x@y", "mail <email>. or x@y"),
    (normalize.expand_contractions, "Don't they’ve DON'T dog's", "Do not they have Do not dog's"),
    (normalize.custom(F.reverse), "abc", "cba"),
    (normalize.custom(F.reverse), "", ""),
    (normalize.chain(normalize.strip_punctuation, normalize.lowercase), "A.B", "ab"),
    (normalize.TextPipeline(), "As is", "As is"),
    (normalize.TextPipeline(normalize.lowercase).add_step(normalize.TextPipeline(normalize.strip_accents)), "É", "e"),
]


@pytest.mark.parametrize("i", range(len(TEXT)))
def test_normalizers(apply, i):
    fn, value, expected = TEXT[i]
    assert apply(fn, value) == expected
    assert apply(fn, None) is None


ARRAYS = [
    (tokenize.word_tokens, "Café naïve x_y 42!", ["caf", "na", "ve", "x", "y", "42"]),
    (lambda c: tokenize.word_tokens(c, False, 2), "A bC d", ["bC"]),
    (tokenize.whitespace_tokens, "A b  Çd", ["a b", "çd"]),
    (lambda c: tokenize.whitespace_tokens(c, True, 3), "é éa abc", ["éa", "abc"]),
    (lambda c: tokenize.pattern_tokens(c, "[aeiou]"), "queue", ["ueue"]),
    (lambda c: tokenize.pattern_tokens(c, r"\d+"), "a12b3", ["12", "3"]),
    (lambda c: tokenize.pattern_tokens(c, "[a-c]"), "a-b", ["a-"]),
    (lambda c: tokenize.pattern_tokens(c, "^]"), "a^]b", ["^]"]),
    (lambda c: tokenize.char_ngrams(c, 2), "AB😀", ["ab", "b😀"]),
    (lambda c: tokenize.char_ngrams(c, 5), "abc", []),
    (lambda c: tokenize.char_ngrams(c, 0), "abc", []),
    (tokenize.sentences, "Hi. Is 3.5 ok?  Yes!", ["Hi.", "Is 3.5 ok?", "Yes!"]),
    (lambda c: tokenize.sentences(c, False), "Hello. ", ["Hello.", ""]),
    (lambda c: tokenize.sentences(c, False), "", [""]),
    (tokenize.sentences, "", []),
]


@pytest.mark.parametrize("i", range(len(ARRAYS)))
def test_tokenizers(apply, i):
    fn, value, expected = ARRAYS[i]
    assert apply(fn, value) == expected
    assert apply(fn, None) is None


def test_ngrams(apply):
    tokens = ["a b", "c", "d"]
    kind = "array<string>"
    assert apply(tokenize.bigrams, tokens, kind) == [["a b", "c"], ["c", "d"]]
    assert apply(lambda c: tokenize.ngrams(c, 4), tokens, kind) == []
    assert apply(lambda c: tokenize.ngrams(c, 0), tokens, kind) == []
    assert apply(lambda c: tokenize.join_grams(tokenize.ngram_range(c, 2, 3)), tokens, kind) == ["a b c", "c d", "a b c d"]
    assert apply(lambda c: tokenize.ngram_range(c, 3, 2), tokens, kind) == []
    assert apply(lambda c: tokenize.is_sentence_boundary(c, F.lit(1)), "a. b") is True
    assert apply(lambda c: tokenize.is_sentence_boundary(c, F.lit(1)), 'a."') is False


def test_stopwords(apply, spark):
    kind = "array<string>"
    assert apply(lambda c: stopwords.remove_stop_words(c, "English"), ["The", "cat", "IS"], kind) == ["cat"]
    assert apply(lambda c: stopwords.remove_stop_words(c, "xx"), ["the"], kind) == ["the"]
    assert apply(lambda c: stopwords.remove_stop_words(c, stopwords={"THE", "a"}), ["The", "A"], kind) == ["The"]
    assert apply(lambda c: stopwords.is_stop_word(c, "DE"), "Und") is True
    assert apply(lambda c: stopwords.is_stop_word(c, "klingon"), "und") is False
    assert stopwords.stopword_table(spark).count() == 174 + 104 + 163 + 230


STEMS = [
    ("smart", "cities", "citi"), ("smart", "flies", "fly"), ("smart", "houses", "hous"), ("smart", "went", "go"),
    ("smart", "children", "child"), ("smart", "leaves", "leaf"), ("smart", "species", "species"), ("smart", "IS", "is"),
    ("porter", "agreed", "agreed"), ("porter", "relational", "rel"), ("porter", "national", "nat"),
    ("porter", "rational", "rat"), ("porter", "CAFÉS", "café"), ("porter", "", ""), ("porter", "By", "by"),
]


@pytest.mark.parametrize("kind,word,expected", STEMS)
def test_stems(kind, word, expected):
    assert stem.STEMMERS[kind](word) == expected


def test_consonants_of_y_runs():
    for word in (b"y", b"yy", b"yyy", b"ay", b"ayy", b"byy", b"tyyya"):
        def naive(i, s=word):
            if s[i] in b"aeiou":
                return False
            return True if s[i] != 0x79 or i == 0 else not naive(i - 1)

        assert [stem._consonant(word, i) for i in range(len(word))] == [naive(i) for i in range(len(word))]


def test_stem_columns(apply, spark):
    assert apply(lambda c: stem.stem_tokens(c, "smart"), ["running", None, "geese"], "array<string>")[0] == "run"
    assert apply(lambda c: stem.stem_word(c), "ponies") == "poni"
    assert apply(stem.irregular_base, "geese") == "goose"
    rows = spark.createDataFrame([(1, "cats"), (2, "cats")], "doc_id long, term string")
    assert {r.stem for r in stem.stem_postings(rows).collect()} == {"cat"}


def test_distances(apply2):
    assert apply2(distance.levenshtein, "kitten", "sitting") == 3
    assert apply2(distance.levenshtein, "café", "cafe") == 1
    assert apply2(distance.levenshtein_similarity, "", "") == 1.0
    assert apply2(distance.levenshtein_similarity, "", "abc") == 0.0
    assert apply2(distance.levenshtein_similarity, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert apply2(distance.jaro, "martha", "marhta") == pytest.approx(0.9444444444444445)
    assert apply2(distance.jaro, "dixon", "dicksonx") == pytest.approx(0.7666666666666666)
    assert apply2(distance.jaro, "abcxxxxx", "bcaxxxxx") == pytest.approx(0.9375)
    assert apply2(distance.jaro, None, "a") is None
    assert apply2(distance.jaro_winkler, "martha", "marhta") == pytest.approx(0.9611111111111111)
    assert apply2(distance.jaro_winkler, "", "") == 1.0
    assert apply2(distance.ngram_distance, "night", "nacht") == pytest.approx(1 - 1 / 7)
    assert apply2(distance.ngram_distance, "a", "b") == 1.0
    assert apply2(distance.ngram_distance, "a", "a") == 0.0
    for bad in ({"prefix_weight": -0.1}, {"max_prefix": -1}):
        with pytest.raises(ValueError):
            distance.jaro_winkler(F.lit("a"), F.lit("b"), **bad)


STAGES = [
    (stem.step1ab, "caresses", "caress"), (stem.step1ab, "ponies", "poni"), (stem.step1ab, "cats", "cat"),
    (stem.step1ab, "hopping", "hop"), (stem.step1ab, "agreed", "agreed"), (stem.step1c, "happy", "happi"),
    (stem.step1c, "sky", "sky"), (stem.step2, "relational", "relate"), (stem.step3, "electrical", "electric"),
    (stem.step4, "conditional", "condition"), (stem.step5ab, "probate", "probat"), (stem.step5ab, "controll", "control"),
    (stem.smart_step_ed_ing, "hopping", "hop"), (stem.smart_step_ed_ing, "talked", "talk"),
    (stem.smart_step3, "relational", "relate"), (stem.smart_step4, "electrical", "electric"),
    (stem.smart_step5, "happy", "happi"), (stem.smart_step_final_e, "probate", "probat"),
    (stem.smart_step_double_l, "fall", "fal"),
]


@pytest.mark.parametrize("stage,word,expected", STAGES)
def test_stem_stages(stage, word, expected):
    assert stage(word.encode()).decode() == expected


def test_plurals_and_irregular_forms():
    assert stem.smart_step_y(b"happy", b"happy") == b"happi" and stem.smart_step_y(b"city", b"cities") == b"city"
    found = {w: stem.lookup_irregular(w) for w in ("mice", "went", "cat")}
    assert found == {"mice": (True, "mouse"), "went": (True, "go"), "cat": (False, "cat")}
    plurals = {"cats": "cat", "cities": "city", "wolves": "wolf", "sheep": "sheep", "children": "child"}
    assert {w: stem.detect_plural(w) for w in plurals} == plurals


def test_stemmers_against_sql():
    """The stages in SQL, with suffix tables of their own, on words that reach every rule."""
    duckdb = pytest.importorskip("duckdb")
    bases = ["rate", "plot", "hop", "fall", "happ", "y", "yy", "syzyg", "toy", "agre", "oper", "relat", "sens", "b"]
    ends = [s for t in (stem_sql.PORTER_2, stem_sql.STEP_3, stem_sql.SMART_5) for s, _ in t]
    words = {b + e for b in bases for e in ["", "s", "ies", "ves", "oes", "sses", "eed", "ll", "logi", "e", *ends]}
    words = sorted(words | set(lexicon.IRREGULAR_VERBS) | set(lexicon.IRREGULAR_PLURALS) | lexicon.NO_CHANGE)
    words = [w for w in words if w.isascii() and w.isalpha()]
    con = duckdb.connect()
    listed = f"words AS (SELECT unnest({words!r}) AS term)"
    porter = con.sql(f"WITH {listed}, {stem_sql.porter('words')} SELECT term, stem FROM porter").fetchall()
    smart = stem_sql.smart("words", oracles.IRREGULAR, oracles.in_list(lexicon.NO_CHANGE))
    smart = con.sql(f"WITH {listed}, {smart} SELECT term, stem FROM smart").fetchall()
    assert dict(porter) == {w: stem.porter_stem(w) for w in words}
    assert dict(smart) == {w: stem.smart_stem(w) for w in words}


def test_word_tables_are_in_order():
    for table in (lexicon.IRREGULAR_PLURALS, lexicon.IRREGULAR_VERBS, lexicon.CONTRACTIONS):
        assert list(table) == sorted(table)


def test_pattern_members_beyond_ascii(apply):
    def bytewise(text, members):
        found, run = [], b""
        for x in [*(bytes([b]) for b in text.encode()), b""]:
            if x and x in members.encode():
                run += x
            elif run:
                found, run = [*found, run.decode("utf-8", "replace")], b""
        return found

    for pattern in ("[é]", "[éa]", "[èx]"):
        for text in ("caféè naïve", "éé e", "日本é", ""):
            assert apply(lambda c, p=pattern: tokenize.pattern_tokens(c, p), text) == bytewise(text, pattern[1:-1])
    assert apply(lambda c: tokenize.pattern_tokens(c, "[É]", lower=True, min_length=3), "É ÉÉ") == ["éé"]


def test_boundaries_by_byte(spark):
    text = "é. Hi. x."
    raw = text.encode()
    table = spark.createDataFrame([(text, i) for i in range(-1, 12)], "t string, i int")
    got = [r[0] for r in table.select(tokenize.is_sentence_boundary(F.col("t"), F.col("i"))).collect()]
    assert got == [0 <= i < len(raw) and raw[i] in b".!?" and raw[i + 1 : i + 2] in (b"", b" ") for i in range(-1, 12)]


def test_drained(spark):
    row = spark.sql("SELECT array('a') AS t, 'ÉB' AS r, '' AS e")
    assert row.select(tokenize.drained(F.col("t"), F.col("r"))).first()[0] == ["a", "éb"]
    assert row.select(tokenize.drained(F.col("t"), F.col("r"), False, 4)).first()[0] == ["a"]
    assert row.select(tokenize.drained(F.col("t"), F.col("e"), min_length=0)).first()[0] == ["a"]


def test_emails_in_odd_and_long_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab.@-% ", k=rng.randint(1, 30))) for _ in range(3000)] + ["a@b.c.@x.y", "a@..c", "@a.b"]
    plain = re.compile("[A-Za-z0-9_.+%-]+@[A-Za-z0-9_.+%-]+[.][A-Za-z0-9_.+%-]*[A-Za-z0-9_+%-]")
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in table.select(normalize.replace_emails(F.col("t"))).collect()]
    assert got == [plain.sub("<email>", t) for t in texts]
    long = spark.createDataFrame([("a" * 1_000_000,), ("a@" + "." * 1_000_000,), ("a@b" * 300_000,)], "t string")
    began = time.perf_counter()
    assert long.select(F.length(normalize.replace_emails(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 2_900_002
    assert time.perf_counter() - began < 20


def test_any_function_of_a_column_is_a_tokenizer(spark):
    """The protocol: a column of text to a column of tokens, in projections and in streams alike."""
    def commas(c):
        return F.split(c, ",")

    for tokenizer in (commas, tokenize.word_tokens, lambda c: tokenize.char_ngrams(c, 2), tokenize.sentences):
        rows = spark.createDataFrame([("a,bc",), (None,)], "text string")
        got = tokenized_stream(rows, "text", tokenizer, normalize.lowercase)
        assert got.columns == ["text", "tokens"] and got.schema["tokens"].dataType.simpleString() == "array<string>"
        assert got.first().tokens and got.where("text IS NULL").first().tokens is None
