import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import normalize, sql, stopwords, tokenize
from glyphmill.operators import similarity
from glyphmill.streaming.text import running_term_counts, tokenized_stream, windowed_term_counts


def test_sql_functions(spark):
    assert "word_tokens" in sql.register(spark)
    row = spark.sql(
        r"SELECT word_tokens('A b-C') t, strip_accents('é\\x') a, strip_punctuation('a\'b!') p, normalize_whitespace(' a  b ') w, "
        "word_ngrams(array('a','b','c'), 2) g, word_ngrams(array('a'), 2) e, token_jaccard(array('a'), array('a','b')) j, "
        "levenshtein_similarity('', '') s, porter_stem('ponies') q, smart_stems(array('geese')) m, jaro('martha', 'marhta') r, remove_numbers('a12') n"
    ).first()
    assert row.t == ["a", "b", "c"] and row.a == "e\\x" and row.p == "ab" and row.w == "a b"
    assert row.g == [["a", "b"], ["b", "c"]] and row.e == [] and row.j == 0.5 and row.s == 1.0
    assert row.q == "poni" and row.m == ["goose"] and round(row.r, 4) == 0.9444 and row.n == "a"


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    texts = ["<b>See</b> http://x.org/a. or mail a.b@c.de, The U.S. is. Fine? e.g. é", "", "la la the der IS", None]
    table = spark.createDataFrame([(t, l) for t, l in zip(texts, ["en", "EN", "german", "xx"])], "x string, l string")
    c, tokens = F.col("x"), tokenize.whitespace_tokens(F.col("x"))
    other = F.array(F.lit("la"), F.lit("the"), F.lit("the"))
    pairs = [
        ("strip_html(x)", normalize.strip_html(c)),
        (r"replace_urls(x, '$1\\')", normalize.replace_urls(c, "$1\\")),
        ("replace_emails(x, '<m>')", normalize.replace_emails(c, "<m>")),
        ("whitespace_tokens(x)", tokens),
        ("char_ngrams(x, 3)", tokenize.char_ngrams(c, 3)),
        ("sentence_list(x)", tokenize.sentences(c)),
        ("is_stop_word('Der', l)", stopwords.is_stop_word(F.lit("Der"), F.col("l"))),
        ("remove_stop_words(whitespace_tokens(x), l)", stopwords.remove_stop_words(tokens, F.col("l"))),
        ("token_overlap(whitespace_tokens(x), array('la', 'the', 'the'))", similarity.overlap(tokens, other)),
        ("token_cosine(whitespace_tokens(x), array('la', 'the', 'the'))", similarity.cosine_bags(tokens, other)),
    ]
    got = table.select(*[F.expr(e).alias(f"a{i}") for i, (e, _) in enumerate(pairs)], *[f.alias(f"b{i}") for i, (_, f) in enumerate(pairs)])
    for r in got.collect():
        for i, (name, _) in enumerate(pairs):
            a, b = r[f"a{i}"], r[f"b{i}"]
            assert a == pytest.approx(b) if isinstance(b, float) else a == b or name.startswith("token_"), name


def _drain(frame, mode, tmp_path, name):
    run = (
        frame.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "Été à la plage"), ("2024-01-01 00:01:00", "la la LAND"), ("2024-01-01 02:00:00", None)]
    table = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    pipeline = normalize.TextPipeline(normalize.strip_accents, normalize.lowercase)
    tokens = tokenized_stream(stream, "text", tokenize.word_tokens, pipeline)
    _drain(tokens.select("ts", "tokens"), "append", tmp_path, "rows_out")
    batch = tokenized_stream(table, "text", tokenize.word_tokens, pipeline).select("ts", "tokens")
    assert sorted(map(str, spark.table("rows_out").collect())) == sorted(map(str, batch.collect()))
    _drain(running_term_counts(tokens.select("tokens")), "complete", tmp_path, "counts_out")
    counts = {r.term: (r.cf, r.df) for r in spark.table("counts_out").collect()}
    assert counts["la"] == (3, 2) and counts["ete"] == (1, 1)
    _drain(windowed_term_counts(tokens, "ts"), "append", tmp_path, "windows_out")
    windows = {(r.window.start.minute, r.term): r.cf for r in spark.table("windows_out").collect()}
    # the watermark, ten minutes before 02:00, has closed the first window
    assert windows == {(0, "ete"): 1, (0, "a"): 1, (0, "la"): 3, (0, "plage"): 1, (0, "land"): 1}


def test_many_distinct_terms_in_one_document(spark):
    words = [f"w{i % 50_000}" for i in range(100_000)]
    table = spark.createDataFrame([(words,)], "tokens array<string>")
    began = time.perf_counter()
    got = running_term_counts(table).agg(F.sum("cf").alias("cf"), F.count("*").alias("n")).first()
    assert (got.cf, got.n) == (100_000, 50_000) and time.perf_counter() - began < 20
