"""DuckDB SQL of the two stemmers, for oracles: a query step for each stage.

A step reads ``w`` (the word) and ``s`` (its stem so far); words are ASCII.
Suffix tables stand here once more, so that an entry that is wrong in the
library shows.
"""

from __future__ import annotations

# The suffixes and replacements of the stages, the longest first.
PORTER_2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"),
    ("enci", "ence"), ("izer", "ize"), ("eli", "e"),
]
SMART_3 = [*PORTER_2, ("logi", "log")]
STEP_3 = [
    ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
PORTER_4 = [(x, "") for x in (
    "ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous",
    "al", "er", "ic", "ou",
)]
SMART_5 = [
    ("ement", "e"), ("able", ""), ("ible", ""), ("ment", ""), ("ant", ""), ("ate", ""), ("ent", ""), ("ing", ""),
    ("ion", ""), ("ism", ""), ("iti", ""), ("ive", ""), ("ize", ""), ("ous", ""), ("al", ""), ("ed", ""), ("er", ""),
    ("ly", ""), ("y", "i"),
]


def ends(s: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"suffix({s}, '{x}')" for x in suffixes) + ")"


def less(s: str, n: int) -> str:
    return f"substr({s}, 1, length({s}) - {n})"


def mask(s: str) -> str:
    """``c`` for consonants and ``v`` for vowels; a y after a consonant is a vowel."""
    step = "acc || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND suffix(acc, 'c')) THEN 'v' ELSE 'c' END"
    return f"list_reduce(list_concat([''], string_split({s}, '')), lambda acc, x: {step})"


def vowels_after(m: str) -> str:
    return f"len(regexp_extract_all({m}, 'cv'))"


def runs(s: str) -> str:
    return f"len(regexp_extract_all({s}, '[^aeiou]+'))"


def porter_closed(s: str, m: str) -> str:
    return f"(suffix({m}, 'ccv') AND NOT {ends(s, 'w', 'x', 'y')})"


def porter_double(s: str, m: str) -> str:
    return f"(length({s}) > 1 AND substr({s}, -1, 1) = substr({s}, -2, 1) AND suffix({m}, 'c'))"


def smart_closed(s: str) -> str:
    return f"regexp_matches({s}, '[^aeiou][aeiou][^aeiouwxy]$')"


def smart_double(s: str) -> str:
    return f"(length({s}) > 1 AND substr({s}, -1, 1) = substr({s}, -2, 1) AND NOT {ends(s, *'aeiou')})"


def undoubled(stem: str, double: str, measure: str, closed: str) -> str:
    return (
        f"CASE WHEN {ends(stem, 'at', 'bl', 'iz')} THEN {stem} || 'e' "
        f"WHEN {double} AND NOT {ends(stem, *'lsz')} THEN {less(stem, 1)} "
        f"WHEN {measure} = 1 AND {closed} THEN {stem} || 'e' ELSE {stem} END"
    )


def _porter_rules(rules: list[tuple[str, str]], least: int) -> str:
    out = f"CASE WHEN length(s) < 3 OR {vowels_after(less('m', 1))} < {least} THEN s"
    for suffix, to in rules:
        stem = less("s", len(suffix))
        kept = f"WHEN {ends('s', suffix)} AND NOT {ends(stem, 's', 't')} THEN s " if suffix == "ion" else ""
        out += f" {kept}WHEN {ends('s', suffix)} THEN {stem} || '{to}'"
    return out + " ELSE s END"


def _smart_rules(rules: list[tuple[str, str]]) -> str:
    out = "CASE"
    for suffix, to in rules:
        stem = less("s", len(suffix))
        fits = f"length({stem}) > 0 AND {runs(stem)} > {1 if suffix == 'y' else 0}"
        if suffix == "ion":
            fits += f" AND {ends(stem, 's', 't')}"
        out += f" WHEN {ends('s', suffix)} THEN CASE WHEN {fits} THEN {stem} || '{to}' ELSE s END"
    return out + " ELSE s END"


def _stepped(start: str, steps: list[tuple[str, str]], name: str) -> str:
    """A chain of queries from ``start (w, s)``; a step is ``(helper columns, new stem)``."""
    parts, source = [], start
    for i, (helpers, expression) in enumerate(steps):
        inner = f"(SELECT *, {helpers} FROM {source})" if helpers else source
        parts.append(f"{name}{i} AS (SELECT w, {expression} AS s FROM {inner})")
        source = f"{name}{i}"
    return ", ".join(parts)


def porter(words: str) -> str:
    """CTEs that end in ``porter (term, stem)`` for the table ``words (term)``."""
    m = f"{mask('s')} AS m"
    plural = (
        f"CASE WHEN {ends('s', 'sses', 'ies')} THEN {less('s', 2)} "
        f"WHEN {ends('s', 's')} AND NOT {ends('s', 'ss')} THEN {less('s', 1)} ELSE s END"
    )
    past = f"CASE WHEN {ends('s', 'eed')} THEN CASE WHEN {vowels_after(less('m', 3))} > 0 THEN {less('s', 1)} ELSE s END"
    for end in ("ed", "ing"):
        stem, own = less("s", len(end)), less("m", len(end))
        new = undoubled(stem, porter_double(stem, own), vowels_after(own), porter_closed(stem, own))
        past += f" WHEN {ends('s', end)} THEN CASE WHEN contains({own}, 'v') THEN {new} ELSE s END"
    past += " ELSE s END"
    final_y = f"CASE WHEN {ends('s', 'y')} AND contains({less('m', 1)}, 'v') THEN {less('s', 1)} || 'i' ELSE s END"
    rest, rest_m = less("s", 1), less("m", 1)
    final_e = (
        f"CASE WHEN {ends('s', 'e')} AND ({vowels_after(rest_m)} > 1 OR ({vowels_after(rest_m)} = 1 "
        f"AND NOT {porter_closed(rest, rest_m)})) THEN {rest} ELSE s END"
    )
    final_l = f"CASE WHEN {ends('s', 'l')} AND {porter_double('s', 'm')} AND {vowels_after('m')} > 1 THEN {rest} ELSE s END"
    steps = [
        ("", plural), (m, past), (m, final_y), (m, _porter_rules(PORTER_2, 1)), (m, _porter_rules(STEP_3, 1)),
        (m, _porter_rules(PORTER_4, 2)), (m, final_e), (m, final_l),
    ]
    start = f"pw AS (SELECT term AS w, term AS s FROM {words} WHERE length(term) > 2)"
    last = f"porter AS (SELECT w AS term, s AS stem FROM p7 UNION ALL SELECT term, term FROM {words} WHERE length(term) <= 2)"
    return f"{start}, {_stepped('pw', steps, 'p')}, {last}"


def smart(words: str, irregular: str, unchanging: str) -> str:
    """CTEs that end in ``smart (term, stem)``; ``irregular`` is VALUES of form and base, ``unchanging`` a list."""
    singular = (
        f"CASE WHEN length(s) > 4 AND {ends('s', 'ies')} AND NOT {ends(less('s', 3), *'aeiou')} THEN {less('s', 3)} || 'y' "
        f"WHEN length(s) > 4 AND {ends('s', 'ves')} THEN {less('s', 3)} || "
        f"CASE WHEN {ends(less('s', 3), 'ni', 'li', 'ri')} THEN 'fe' ELSE 'f' END "
        f"WHEN length(s) > 4 AND {ends('s', 'oes', 'ches', 'shes', 'xes', 'zes', 'sses')} THEN {less('s', 2)} "
        f"WHEN length(s) > 3 AND {ends('s', 's')} AND NOT {ends('s', 'ss')} THEN {less('s', 1)} ELSE s END"
    )
    past = f"CASE WHEN {ends('s', 'eed')} THEN CASE WHEN {runs(less('s', 3))} > 0 THEN {less('s', 1)} ELSE s END"
    for end in ("ed", "ing"):
        stem = less("s", len(end))
        new = undoubled(stem, smart_double(stem), runs(stem), smart_closed(stem))
        past += f" WHEN {ends('s', end)} THEN CASE WHEN regexp_matches({stem}, '[aeiou]') THEN {new} ELSE s END"
    past += " ELSE s END"
    rest = less("s", 1)
    final_y = (
        f"CASE WHEN {ends('w', 'y')} AND {ends('s', 'y')} AND regexp_matches({rest}, '[aeiou]') "
        f"THEN {rest} || 'i' ELSE s END"
    )
    final_e = (
        f"CASE WHEN {ends('s', 'e')} AND ({runs(rest)} > 1 OR ({runs(rest)} = 1 AND NOT {smart_closed(rest)})) "
        f"THEN {rest} ELSE s END"
    )
    final_l = f"CASE WHEN {ends('s', 'll')} AND {runs('s')} > 1 THEN {rest} ELSE s END"
    steps: list[tuple[str, str]] = [("", x) for x in (
        singular, past, final_y, _smart_rules(SMART_3), _smart_rules(STEP_3), _smart_rules(SMART_5), final_e, final_l,
    )]
    fixed = (
        f"irr AS (SELECT * FROM (VALUES {irregular}) AS v(form, base)), "
        f"known AS (SELECT term, coalesce(base, term) AS stem FROM {words} LEFT JOIN irr ON form = term AND length(term) > 2 "
        f"WHERE length(term) <= 2 OR base IS NOT NULL OR term IN {unchanging})"
    )
    start = f"sw AS (SELECT term AS w, term AS s FROM {words} WHERE term NOT IN (SELECT term FROM known))"
    last = "smart AS (SELECT w AS term, s AS stem FROM s7 UNION ALL SELECT term, stem FROM known)"
    return f"{fixed}, {start}, {_stepped('sw', steps, 's')}, {last}"
