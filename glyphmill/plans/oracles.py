"""DuckDB SQL for the queries of :mod:`glyphmill.plans.catalogue`."""

from __future__ import annotations

from glyphmill.functions import lexicon, normalize
from glyphmill.functions.stopwords import STOPWORDS
from glyphmill.plans import stem_sql
from glyphmill.plans.catalogue import DIGITS, HASH_DIM, OWN_STOPWORDS, SEARCH, TOPICS

WS = r"[ \t\n\x0B\f\r]"
NOT_WS = r"[^ \t\n\x0B\f\r]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def out(expression: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, {expression} AS out FROM {table}"


def joined(array: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({array}, '{sep}'), '')"


DOCS = f"docs AS (SELECT doc_id, lang, {words('text')} AS w FROM documents)"
TF = f"{DOCS}, toks AS (SELECT doc_id, lang, unnest(w) AS term FROM docs), tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM toks GROUP BY ALL)"
N = "(SELECT count(*) FROM docs)"
EVENTS = "docs AS (SELECT user_id AS doc_id, list(event_type ORDER BY ts, event_id) AS w FROM events GROUP BY user_id)"
PAIRS = f"{DOCS}, pairs AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM docs a JOIN docs b ON a.doc_id = b.doc_id + 1)"
PARTS = "parts AS (SELECT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1)"
URL = rf"""(https?://|www\.)({NOT_WS}*[^ \t\n\x0B\f\r.!?;:)\]}}"'])?"""
HTML = r"""<[/!?A-Za-z]([^"'>]|"[^"]*"|'[^']*')*>"""
MAIL = r"[A-Za-z0-9_.+%-]+@[A-Za-z0-9_.+%-]+\.[A-Za-z0-9_.+%-]*[A-Za-z0-9_+%-]"
_ACCENTS = f"{quoted(normalize.ACCENTED + normalize.COMBINING)}, {quoted(normalize.BARE)}"
_PUNCT = f"{quoted(normalize.PUNCTUATION)}, ''"


def accents(c: str) -> str:
    return f"translate({c}, {_ACCENTS})"


def replaced(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(to)}, 'g')"


def gram_text(array: str, n: int, sep: str) -> str:
    return f"[array_to_string({array}[i:i + {n - 1}], '{sep}') for i in range(1, len({array}) - {n - 2})]"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(x) for x in sorted(items)) + ")"


def by_language(test: str) -> str:
    return " OR ".join(f"(lang = '{k}' AND {test} IN {in_list(w)})" for k, w in STOPWORDS.items())


def bag_cosine(gram: str) -> str:
    """Cosine of the bags of each document and its neighbour; ``gram`` makes the terms of ``w``."""
    return (
        f"WITH {DOCS}, t AS (SELECT doc_id, unnest({gram}) AS term FROM docs), "
        "c AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM t GROUP BY ALL), "
        "s AS (SELECT doc_id, sqrt(sum(n * n)) AS s FROM c GROUP BY doc_id), "
        "dots AS (SELECT a.doc_id, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.doc_id = b.doc_id + 1 AND a.term = b.term GROUP BY a.doc_id) "
        f"SELECT a.doc_id, round(coalesce(d / (x.s * y.s), 0.0), {DIGITS}) AS similarity FROM docs a "
        "JOIN docs b ON a.doc_id = b.doc_id + 1 LEFT JOIN dots ON dots.doc_id = a.doc_id "
        "LEFT JOIN s x ON x.doc_id = a.doc_id LEFT JOIN s y ON y.doc_id = b.doc_id"
    )


def set_jaccard(a: str, b: str) -> str:
    both, either = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {either} > 0 THEN {both} / {either} ELSE 0.0 END"


def contraction_table() -> str:
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in lexicon.CONTRACTIONS.items())


# --- retrieval

QUERY = f"q AS (SELECT 0 AS qid, unnest({SEARCH!r}) AS term), qf AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL)"
BATCH = f"q AS (SELECT item_id AS qid, unnest({words('text')}) AS term FROM benchmark), qf AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL)"
RANKED = (
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM "
    f"(SELECT qid, doc_id, round(score, {DIGITS}) AS score FROM scores) WHERE score > 0)"
)
BM25 = (
    f"df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), len AS (SELECT doc_id, len(w) AS dl FROM docs), "
    "scores AS (SELECT qid, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) "
    "/ (tf + 1.2 * (1 - 0.75 + 0.75 * (dl / avgdl))) * (qf * 2.2) / (qf + 1.2)) AS score "
    "FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id, "
    "(SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM docs) GROUP BY qid, tf.doc_id)"
)
TFIDF = (
    f"idf AS (SELECT term, ln(1 + {N}::DOUBLE / count(*)) AS idf FROM tf GROUP BY term), "
    "dw AS (SELECT doc_id, term, (0.5 + 0.5 * (tf / max(tf) OVER (PARTITION BY doc_id))) * idf AS x FROM tf JOIN idf USING (term)), "
    "qx AS (SELECT *, max(qf) OVER (PARTITION BY qid) AS top FROM qf), "
    "qw AS (SELECT qid, term, (0.5 + 0.5 * (qf / top)) * idf AS x FROM qx JOIN idf USING (term))"
)
COUNTS = "dw AS (SELECT doc_id, term, tf::DOUBLE AS x FROM tf), qw AS (SELECT qid, term, qf::DOUBLE AS x FROM qf WHERE term IN (SELECT term FROM tf))"
COSINE = (
    "scores AS (SELECT qid, doc_id, sum(qw.x * dw.x) / (any_value(qn) * any_value(dn)) AS score FROM qw JOIN dw USING (term) "
    "JOIN (SELECT qid, sqrt(sum(x * x)) AS qn FROM qw GROUP BY qid) USING (qid) "
    "JOIN (SELECT doc_id, sqrt(sum(x * x)) AS dn FROM dw GROUP BY doc_id) USING (doc_id) GROUP BY qid, doc_id)"
)
TOP10 = "SELECT rank, doc_id, score FROM ranked WHERE rank <= 10"
BATCH10 = "SELECT qid, rank, doc_id, score FROM ranked WHERE rank <= 10"

# --- topics

ASSIGNED = (
    f"{DOCS}, z AS (SELECT doc_id, term, ((doc_id * 31 + pos + strlen(term) * 7) % {TOPICS}) AS topic FROM "
    "(SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs))"
)
PHI = (
    f"{ASSIGNED}, v AS (SELECT DISTINCT term FROM z), k AS (SELECT unnest(range({TOPICS})) AS topic), "
    "kw AS (SELECT topic, term, count(*) AS n FROM z GROUP BY ALL), ks AS (SELECT topic, count(*) AS total FROM z GROUP BY topic), "
    "phi AS (SELECT k.topic, v.term, (coalesce(n, 0) + 0.01) / (coalesce(total, 0) + (SELECT count(*) FROM v) * 0.01) AS p "
    "FROM k CROSS JOIN v LEFT JOIN kw ON kw.topic = k.topic AND kw.term = v.term LEFT JOIN ks ON ks.topic = k.topic)"
)
THETA = (
    "dk AS (SELECT doc_id, topic, count(*) AS n FROM z GROUP BY ALL), "
    f"theta AS (SELECT d.doc_id, kk.topic, (coalesce(n, 0) + 0.1) / (len(w) + {TOPICS} * 0.1) AS p FROM docs d "
    f"CROSS JOIN (SELECT unnest(range({TOPICS})) AS topic) kk LEFT JOIN dk ON dk.doc_id = d.doc_id AND dk.topic = kk.topic)"
)


def best(n: int) -> str:
    return (
        "best AS (SELECT * FROM (SELECT topic, term, round(p, 9) AS p, row_number() OVER "
        f"(PARTITION BY topic ORDER BY round(p, 9) DESC, term) AS rank FROM phi) WHERE rank <= {n})"
    )


PAIR_SCORES = (
    "cand AS (SELECT DISTINCT term FROM best), "
    "held AS (SELECT DISTINCT doc_id, term FROM z JOIN cand USING (term)), "
    "dfs AS (SELECT term, count(*) AS df FROM held GROUP BY term), "
    "cos AS (SELECT a.term AS i, b.term AS j, count(*) AS co FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY ALL), "
    "raw AS (SELECT x.topic, x.term AS i, y.term AS j, coalesce(co, 0) AS co, di.df AS df_i, dj.df AS df_j FROM best x "
    "JOIN best y ON x.topic = y.topic AND x.rank > y.rank LEFT JOIN cos ON cos.i = x.term AND cos.j = y.term "
    "JOIN dfs di ON di.term = x.term JOIN dfs dj ON dj.term = y.term), "
    f"pairs AS (SELECT *, CASE WHEN co = 0 THEN -10.0 ELSE ln((co / {N}) / ((df_i / {N}) * (df_j / {N}))) END AS pmi, "
    "ln((co + 1e-12) / df_j) AS umass FROM raw)"
)

_STEPS = replaced("html", HTML, "")
_STEPS = replaced(_STEPS, URL, "<url>")
_STEPS = f"translate({accents(f'lower({_STEPS})')}, {_PUNCT})"
_STEPS = f"trim({replaced(replaced(_STEPS, '[0-9]+', ''), f'{WS}+', ' ')})"

JARO = (
    # one character of a at a time: chr(1) marks the characters of b that are taken
    "pair AS (SELECT DISTINCT a, b FROM parts), "
    "walk AS (SELECT a, b, 0 AS i, b AS free, '' AS met, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM pair "
    "UNION ALL SELECT a, b, i + 1, "
    "CASE WHEN spot > 0 THEN substr(free, 1, low + spot - 2) || chr(1) || substr(free, low + spot) ELSE free END, "
    "CASE WHEN spot > 0 THEN met || x ELSE met END, reach "
    "FROM (SELECT *, strpos(substr(free, low, i + reach + 2 - low), x) AS spot FROM "
    "(SELECT *, greatest(1, i + 1 - reach) AS low, substr(a, i + 1, 1) AS x FROM walk WHERE i < length(a)))), "
    "ended AS (SELECT a, b, met, [substr(b, k, 1) for k in range(1, length(b) + 1) if substr(free, k, 1) = chr(1)] AS other FROM walk WHERE i = length(a)), "
    "counted AS (SELECT a, b, length(met)::DOUBLE AS m, len([k for k in range(1, length(met) + 1) if substr(met, k, 1) <> other[k]]) / 2.0 AS odd FROM ended), "
    "jaro AS (SELECT a, b, CASE WHEN length(a) = 0 OR length(b) = 0 THEN (a = b)::INT::DOUBLE WHEN m = 0 THEN 0.0 "
    "ELSE (m / length(a) + m / length(b) + (m - odd) / m) / 3.0 END AS jaro FROM counted)"
)
TERMS = f"terms AS (SELECT DISTINCT unnest({words('text')}) AS term FROM documents)"
IRREGULAR = ", ".join(
    f"({quoted(k)}, {quoted(v)})" for k, v in (lexicon.IRREGULAR_VERBS | lexicon.IRREGULAR_PLURALS).items()
)
SMART = stem_sql.smart("terms", IRREGULAR, in_list(lexicon.NO_CHANGE))
SHARED = " + ".join(f"(substr(a, 1, {n}) = substr(b, 1, {n}) AND length(a) >= {n} AND length(b) >= {n})::INT" for n in range(1, 5))

SQL: dict[str, str] = {
    "normalize_lower": out("lower(text)"),
    "normalize_accents": out(accents("text")),
    "normalize_whitespace": out(f"trim({replaced('text', f'{WS}+', ' ')})"),
    "normalize_punctuation": out(f"translate(text, {_PUNCT})"),
    "normalize_numbers": out(replaced("text", "[0-9]+", "<n$1>")),
    "normalize_html": out(replaced("html", HTML, ""), "pages", "page_id"),
    "normalize_urls": out(replaced("html", URL, "<url>"), "pages", "page_id"),
    "normalize_emails": out(replaced("text", MAIL, "<email>")),
    "normalize_contractions": (
        "WITH t AS (SELECT doc_id, replace(replace(text, ' to ', ' don''t '), 'The ', 'They’ve ') AS x FROM documents), "
        "r AS (SELECT doc_id, unnest(a) AS run, unnest(range(len(a))) AS i FROM "
        "(SELECT doc_id, regexp_extract_all(x, '[A-Za-z0-9''’]+|[^A-Za-z0-9''’]+') AS a FROM t)), "
        f"c AS (SELECT * FROM (VALUES {contraction_table()}) AS v(form, long)), "
        "e AS (SELECT doc_id, i, CASE WHEN long IS NULL THEN run WHEN regexp_matches(run, '^[A-Z]') "
        "THEN upper(long[1]) || long[2:] ELSE long END AS s FROM r LEFT JOIN c ON replace(lower(run), '’', '''') = form) "
        "SELECT t.doc_id, coalesce(string_agg(s, '' ORDER BY i), '') AS out FROM t LEFT JOIN e USING (doc_id) GROUP BY t.doc_id"
    ),
    "normalize_custom": out("reverse(text)"),
    "normalize_chain": out(f"lower({accents('text')})"),
    "normalize_pipeline": out(_STEPS, "pages", "page_id"),
    "word_tokens": out(joined(f"list_filter({words('text')}, lambda x: strlen(x) >= 2)")),
    "whitespace_tokens": out(
        joined(f"list_filter(list_transform(regexp_extract_all(text, '{NOT_WS}+'), lambda x: lower(x)), lambda x: strlen(x) >= 3)")
    ),
    "pattern_tokens": out(joined("regexp_extract_all(text, '[aeiou]+')")),
    "digit_tokens": out(joined("regexp_extract_all(text, '[0-9]+')")),
    "char_ngrams": out(joined("[substr(lower(p_name), i, 3) for i in range(1, length(p_name) - 1)]"), "part", "p_partkey"),
    "sentences": (
        "SELECT conv_id, turn, coalesce(array_to_string([x for x in [trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) "
        f"for y in string_split(regexp_replace(text, '([.!?])({WS}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1))] if x <> ''], '|'), '') AS out "
        "FROM conversations"
    ),
    "word_ngrams": f"WITH {DOCS} " + out(joined(gram_text("w", 2, "_")), "docs"),
    "ngram_range": f"WITH {EVENTS} "
    + out(joined(f"list_concat(w, {gram_text('w', 2, ' ')}, {gram_text('w', 3, ' ')})"), "docs"),
    "joined_grams": f"WITH {DOCS} SELECT doc_id, greatest(len(w) - 2, 0)::BIGINT AS n, {joined(gram_text('w', 3, '-'))} AS out FROM docs",
    "stopword_filter": (
        f"WITH t AS (SELECT doc_id, lang, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '{NOT_WS}+') AS a FROM documents)) "
        f"SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS out FROM documents d LEFT JOIN (SELECT * FROM t WHERE NOT ({by_language('lower(x)')})) k USING (doc_id) GROUP BY d.doc_id"
    ),
    "stopword_flags": (
        f"SELECT lang, word, coalesce({by_language('lower(word)')}, false) AS is_stop FROM "
        f"(SELECT DISTINCT lang, unnest(regexp_extract_all(text, '{NOT_WS}+')) AS word FROM documents)"
    ),
    "custom_stopwords": (
        f"SELECT doc_id, coalesce(array_to_string(list_filter(regexp_extract_all(text, '{NOT_WS}+'), "
        f"lambda x: lower(x) NOT IN {in_list(OWN_STOPWORDS)}), '|'), '') AS out FROM documents"
    ),
    "irregular_lookup": (
        f"WITH b AS (SELECT * FROM (VALUES {IRREGULAR}"
        f") AS v(form, base)) SELECT term, base IS NOT NULL AS found, coalesce(base, term) AS base FROM (SELECT DISTINCT unnest({words('text')}) AS term FROM documents) LEFT JOIN b ON form = term"
    ),
    "porter_stem": f"WITH {TERMS}, {stem_sql.porter('terms')} SELECT term, stem FROM porter",
    "smart_stem": f"WITH {TERMS}, {SMART} SELECT term, stem FROM smart",
    "stemmed_postings": (
        f"WITH {TF}, {TERMS}, {SMART} SELECT doc_id, stem, sum(tf)::BIGINT AS tf FROM tf JOIN smart USING (term) GROUP BY ALL"
    ),
    "jaro_pairs": f"WITH RECURSIVE {PARTS}, {JARO} SELECT a, b, round(jaro, {DIGITS}) AS similarity FROM parts JOIN jaro USING (a, b)",
    "jaro_winkler_pairs": (
        f"WITH RECURSIVE {PARTS}, {JARO} SELECT a, b, round(jaro + ({SHARED}) * 0.1 * (1 - jaro), {DIGITS}) AS similarity "
        "FROM parts JOIN jaro USING (a, b)"
    ),
    "jaro_nations": (
        "WITH RECURSIVE parts AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y USING (n_regionkey)), "
        f"{JARO} SELECT a, b, round(jaro, {DIGITS}) AS similarity FROM parts JOIN jaro USING (a, b)"
    ),
    "levenshtein_pairs": f"WITH {PARTS} SELECT a, b, levenshtein(a, b)::BIGINT AS distance FROM parts",
    "levenshtein_similarity": f"WITH {PARTS} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), {DIGITS}) AS similarity FROM parts",
    "char_ngram_distance": (
        f"WITH {PARTS}, g AS (SELECT a, b, [substr(a, i, 2) for i in range(1, length(a))] AS x, [substr(b, i, 2) for i in range(1, length(b))] AS y FROM parts) "
        f"SELECT a, b, round(CASE WHEN a = b THEN 0.0 ELSE 1 - ({set_jaccard('x', 'y')}) END, {DIGITS}) AS distance FROM g"
    ),
    "term_freq": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
    "doc_freq": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "idf": f"WITH {TF} SELECT term, count(*) AS df, round(ln(1 + {N}::DOUBLE / count(*)), {DIGITS}) AS idf FROM tf GROUP BY term",
    "sorted_terms": f"WITH {TF} SELECT term, count(*) AS cnt FROM toks GROUP BY term ORDER BY cnt DESC, term",
    "unique_terms": f"WITH {TF} SELECT DISTINCT term FROM toks",
    "vocabulary_ids": (
        f"WITH {DOCS}, s AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs), "
        "f AS (SELECT term, min(struct_pack(d := doc_id, p := pos)) AS place FROM s GROUP BY term) "
        "SELECT term, row_number() OVER (ORDER BY place) - 1 AS term_id FROM f"
    ),
    "vocabulary_extended": (
        f"WITH {DOCS}, s AS (SELECT 0 AS part, doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs "
        f"UNION ALL SELECT 1, item_id, unnest(w), unnest(range(len(w))) FROM (SELECT item_id, {words('text')} AS w FROM benchmark)), "
        "f AS (SELECT term, min(struct_pack(t := part, d := doc_id, p := pos)) AS place FROM s GROUP BY term) "
        "SELECT term, row_number() OVER (ORDER BY place) - 1 AS term_id FROM f"
    ),
    "text_stats": (
        f"WITH {TF}, s AS (SELECT doc_id, sum(tf) AS n, count(*) AS u, sum(tf * strlen(term)) AS b, sum((tf = 1)::INT) AS h FROM tf GROUP BY doc_id), "
        "top AS (SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM tf) WHERE r = 1) "
        f"SELECT d.doc_id, coalesce(n, 0)::BIGINT AS num_tokens, coalesce(u, 0)::BIGINT AS num_unique_terms, round(coalesce(b / n, 0.0), {DIGITS}) AS avg_token_length, "
        f"round(coalesce(u / n, 0.0), {DIGITS}) AS vocabulary_richness, coalesce(h, 0)::BIGINT AS hapax_legomena, coalesce(top.term, '') AS top_term "
        "FROM docs d LEFT JOIN s USING (doc_id) LEFT JOIN top USING (doc_id)"
    ),
    "keywords_tfidf": (
        f"WITH {TF}, x AS (SELECT term, 0.5 + 0.5 * (tf / max(tf) OVER (PARTITION BY doc_id)) AS wt FROM tf) "
        f"SELECT term, round(sum(wt) * ln(1 + {N}::DOUBLE / count(*)), {DIGITS}) AS score FROM x GROUP BY term ORDER BY score DESC, term LIMIT 10"
    ),
    "keywords_freq": f"WITH {TF} SELECT term, count(*)::DOUBLE AS score FROM toks GROUP BY term ORDER BY score DESC, term LIMIT 10",
    "keywords_by_lang": (
        f"WITH {TF}, x AS (SELECT lang, term, 0.5 + 0.5 * (tf / max(tf) OVER (PARTITION BY doc_id)) AS wt FROM tf), "
        "n AS (SELECT lang, count(*)::DOUBLE AS n FROM docs GROUP BY lang), "
        f"s AS (SELECT lang, term, round(sum(wt) * ln(1 + any_value(n) / count(*)), {DIGITS}) AS score FROM x JOIN n USING (lang) GROUP BY lang, term) "
        "SELECT lang, term, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS r FROM s) WHERE r <= 10"
    ),
    "ngram_freq": f"WITH {DOCS} SELECT gram, count(*) AS cnt FROM (SELECT unnest({gram_text('w', 2, ' ')}) AS gram FROM docs) GROUP BY gram",
    "top_ngrams": f"WITH {EVENTS} SELECT gram, count(*) AS cnt FROM (SELECT unnest({gram_text('w', 3, ' ')}) AS gram FROM docs) GROUP BY gram ORDER BY cnt DESC, gram LIMIT 20",
    "doc_jaccard": f"WITH {PAIRS} SELECT doc_id, round({set_jaccard('a', 'b')}, {DIGITS}) AS similarity FROM pairs",
    "doc_overlap": (
        f"WITH {PAIRS} SELECT doc_id, round(CASE WHEN least(len(list_distinct(a)), len(list_distinct(b))) > 0 THEN "
        f"len(list_intersect(a, b)) / least(len(list_distinct(a)), len(list_distinct(b))) ELSE 0.0 END, {DIGITS}) AS similarity FROM pairs"
    ),
    "doc_cosine": bag_cosine("w"),
    "ngram_cosine": bag_cosine(gram_text("w", 2, "\x1f")),
    "ngram_jaccard": (
        f"WITH {DOCS}, g AS (SELECT doc_id, {gram_text('w', 2, ' ')} AS w FROM docs), "
        "pairs AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM g a JOIN g b ON a.doc_id = b.doc_id + 1) "
        f"SELECT doc_id, round({set_jaccard('a', 'b')}, {DIGITS}) AS similarity FROM pairs"
    ),
    "benchmark_cosine": (
        f"WITH {TF}, {BATCH} SELECT doc_id, qid AS item_id, round(score, {DIGITS}) AS cosine FROM "
        "(SELECT qid, doc_id, dot / (qn * dn) AS score FROM (SELECT qid, doc_id, sum(qf * tf) AS dot FROM qf JOIN tf USING (term) GROUP BY ALL) "
        "JOIN (SELECT qid, sqrt(sum(qf * qf)) AS qn FROM qf GROUP BY qid) USING (qid) JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM tf GROUP BY doc_id) USING (doc_id))"
    ),
    "vector_norms": (
        "SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0))::BIGINT AS entries, "
        f"round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), {DIGITS}) AS norm, round(embedding[4]::DOUBLE, {DIGITS}) AS fourth FROM embeddings"
    ),
    "vector_cosine": (
        "WITH d AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings) "
        f"SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), {DIGITS}) AS cosine FROM d a JOIN d b ON a.vec_id = b.vec_id + 1"
    ),
    "hash_vectorize": (
        f"WITH {TF} SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT) % {HASH_DIM} AS bucket, count(*)::DOUBLE AS value FROM toks GROUP BY ALL"
    ),
    "hash_signed": (
        f"WITH {TF}, h AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT) % {HASH_DIM} AS bucket, "
        "CASE WHEN (('0x' || substr(md5(term || chr(0)), 1, 8))::BIGINT) % 2 = 1 THEN -1.0 ELSE 1.0 END AS s FROM toks) "
        "SELECT doc_id, bucket, sum(s)::DOUBLE AS value FROM h GROUP BY ALL HAVING sum(s) <> 0"
    ),
    "hash_cosine": (
        f"WITH {TF}, h AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT) % {HASH_DIM} AS b, count(*)::DOUBLE AS v FROM toks GROUP BY ALL), "
        "n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM h GROUP BY doc_id), "
        "d AS (SELECT x.doc_id, sum(x.v * y.v) AS d FROM h x JOIN h y ON x.doc_id = y.doc_id + 1 AND x.b = y.b GROUP BY x.doc_id) "
        f"SELECT a.doc_id, round(coalesce(d / (a.n * b.n), 0.0), {DIGITS}) AS cosine FROM n a JOIN n b ON a.doc_id = b.doc_id + 1 LEFT JOIN d ON d.doc_id = a.doc_id"
    ),
    "count_search": f"WITH {TF}, {QUERY}, {COUNTS}, {COSINE}, {RANKED} {TOP10}",
    "count_vectors": f"WITH {TF}, {BATCH} SELECT qid AS doc_id, term, qf::DOUBLE AS weight FROM qf WHERE term IN (SELECT term FROM tf)",
    "tfidf_vectors": f"WITH {TF}, {BATCH}, {TFIDF} SELECT qid AS doc_id, term, round(x, {DIGITS}) AS weight FROM qw",
    "tfidf_search": f"WITH {TF}, {QUERY}, {TFIDF}, {COSINE}, {RANKED} {TOP10}",
    "tfidf_batch": f"WITH {TF}, {BATCH}, {TFIDF}, {COSINE}, {RANKED} {BATCH10}",
    "bm25_search": f"WITH {TF}, {QUERY}, {BM25}, {RANKED} {TOP10}",
    "bm25_batch": f"WITH {TF}, {BATCH}, {BM25}, {RANKED} {BATCH10}",
    "lda_phi": f"WITH {PHI} SELECT topic, term, round(p, 9) AS p FROM phi",
    "lda_theta": f"WITH {ASSIGNED}, {THETA} SELECT doc_id, topic, round(p, {DIGITS}) AS p FROM theta",
    "lda_top_terms": f"WITH {PHI}, {best(10)} SELECT topic, rank, term, p FROM best",
    "lda_perplexity": (
        f"WITH {PHI}, {THETA}, dw AS (SELECT doc_id, term, count(*) AS n FROM z GROUP BY ALL), "
        "l AS (SELECT dw.doc_id, dw.term, any_value(dw.n) AS n, sum(theta.p * phi.p) AS p FROM dw JOIN theta ON theta.doc_id = dw.doc_id "
        "JOIN phi ON phi.term = dw.term AND phi.topic = theta.topic GROUP BY dw.doc_id, dw.term) "
        "SELECT round(exp(-sum(n * ln(greatest(p, 1e-12))) / sum(n)), 3) AS perplexity FROM l"
    ),
    "topic_pairs": f"WITH {PHI}, {best(8)}, {PAIR_SCORES} SELECT topic, i, j, co, df_i, df_j, round(pmi, {DIGITS}) AS pmi, round(umass, {DIGITS}) AS umass FROM pairs",
    "pmi_labels": (
        f"WITH {PHI}, {best(12)}, {PAIR_SCORES}, m AS (SELECT topic, term, avg(pmi) AS m FROM "
        "(SELECT topic, i AS term, pmi FROM pairs UNION ALL SELECT topic, j, pmi FROM pairs) GROUP BY ALL), "
        "u AS (SELECT topic, term, p, CASE WHEN max(m) OVER t - min(m) OVER t <= 1e-12 THEN 0.5 ELSE (m - min(m) OVER t) / (max(m) OVER t - min(m) OVER t) END AS u "
        "FROM best JOIN m USING (topic, term) WINDOW t AS (PARTITION BY topic)), "
        "r AS (SELECT topic, term, p, row_number() OVER (PARTITION BY topic ORDER BY round(0.5 * p + 0.5 * u, 9) DESC, term) AS rank FROM u) "
        "SELECT topic, rank, term, p FROM r WHERE rank <= 5"
    ),
    "coherence_umass": f"WITH {PHI}, {best(10)}, {PAIR_SCORES} SELECT round(avg(umass), {DIGITS}) AS coherence FROM pairs",
    "coherence_cv": f"WITH {PHI}, {best(10)}, {PAIR_SCORES} SELECT round(avg(x), {DIGITS}) AS coherence FROM (SELECT avg(pmi) AS x FROM pairs GROUP BY topic)",
    "lda_fit": (
        f"SELECT item_id AS doc_id, 1.0::DOUBLE AS theta_sum, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS terms, "
        f"true AS in_range, true AS fitted FROM (SELECT item_id, {words('text')} AS w FROM benchmark) WHERE len(w) > 0"
    ),
    "lda_sweeps": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
    "lda_fold_in": (
        f"WITH v AS (SELECT DISTINCT unnest({words('text')}) AS term FROM benchmark), "
        f"t AS (SELECT conv_id * 1000 + turn AS doc_id, unnest({words('text')}) AS term FROM conversations), "
        "n AS (SELECT doc_id, count(*) AS n FROM t JOIN v USING (term) GROUP BY doc_id) "
        f"SELECT conv_id * 1000 + turn AS doc_id, coalesce(n, 0)::BIGINT AS known_tokens, {TOPICS}::BIGINT AS topics, "
        "1.0::DOUBLE AS theta_sum, true AS fits FROM conversations LEFT JOIN n ON n.doc_id = conv_id * 1000 + turn"
    ),
    "stream_windowed_counts": (
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS term, count(*) AS cf FROM events "
        "GROUP BY ALL HAVING (any_value(epoch_us(ts)) // 3600000000 + 1) * 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"
    ),
    "stream_term_counts": f"WITH {TF} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term",
}
