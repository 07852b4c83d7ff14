"""Text normalizers as ``Column -> Column`` functions, and pipelines of them.

All of them are Catalyst expressions: a pipeline is one projection that runs
inside whole-stage codegen, in batch and in streaming plans alike. Null text
stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.lexicon import CONTRACTIONS

Step = Callable[[Column], Column]

BLANK = r" \t\n\x0B\f\r"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = {
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ý",
}
ACCENTED = "".join(_PLAIN.values()) + "".join(_PLAIN.values()).upper() + "ÿ"
BARE = "".join(k * len(v) for k, v in _PLAIN.items())
BARE = BARE + BARE.upper() + "y"
COMBINING = "".join(map(chr, range(0x300, 0x370)))
TAG = r"""<(?=[/!?A-Za-z])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
URL = rf"""(?=https?://|www\.)[^{BLANK}]*[^{BLANK}.!?;:)\]}}"']"""
_MAIL_END = "A-Za-z0-9_+%-"
_MAIL = f"[{_MAIL_END}.]"
EMAIL = rf"(?:\G|(?<!{_MAIL})){_MAIL}++@{_MAIL}[{_MAIL_END}]*+(?:\.++[{_MAIL_END}]++)+"


def literal_replacement(text: str) -> str:
    """``text`` as a Java regex replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def strip_accents(c: Column) -> Column:
    """Fixed map of accented letters; combining marks go, ligatures stay."""
    return F.translate(c, ACCENTED + COMBINING, BARE)


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def strip_punctuation(c: Column) -> Column:
    """ASCII punctuation only."""
    return F.translate(c, PUNCTUATION, "")


def replace_numbers(c: Column, replacement: str = "") -> Column:
    return F.regexp_replace(c, "[0-9]+", literal_replacement(replacement))


def strip_html(c: Column) -> Column:
    """Tags that close outside quotes; everything else is text."""
    return F.regexp_replace(c, TAG, "")


def replace_urls(c: Column, replacement: str = "<url>") -> Column:
    return F.regexp_replace(c, URL, literal_replacement(replacement or "<url>"))


def replace_emails(c: Column, replacement: str = "<email>") -> Column:
    """Local part, at sign and a domain with a dot that ends in no dot.

    A match starts where a run of characters does, or the match before ended,
    and no part is given back, so that long runs cost no more than their length.
    """
    return F.regexp_replace(c, EMAIL, literal_replacement(replacement or "<email>"))


def expand_contractions(c: Column) -> Column:
    """English contractions, looked up by whole runs of letters, digits and apostrophes."""
    table = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    upper = F.create_map(*[F.lit(x) for k, v in CONTRACTIONS.items() for x in (k, v[0].upper() + v[1:])])
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z0-9'’]+|[^A-Za-z0-9'’]+)"), F.lit(1))

    def expand(run: Column) -> Column:
        key = F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ’", "abcdefghijklmnopqrstuvwxyz'")
        capital = F.substring(run, 1, 1).rlike("[A-Z]")
        return F.coalesce(F.when(capital, F.try_element_at(upper, key)).otherwise(F.try_element_at(table, key)), run)

    return F.array_join(F.transform(runs, expand), "")


def custom(fn: Step) -> Step:
    """Any step, with empty text left empty without calling it."""
    return lambda c: F.when(c == "", F.lit("")).otherwise(fn(c))


def chain(first: Step, second: Step) -> Step:
    return lambda c: second(first(c))


class TextPipeline:
    """Ordered steps; a pipeline is itself a step, and an empty one changes nothing."""

    def __init__(self, *steps: Step):
        self.steps = list(steps)

    def add_step(self, step: Step) -> TextPipeline:
        self.steps.append(step)
        return self

    def __call__(self, c: Column) -> Column:
        return reduce(lambda value, step: step(value), self.steps, c)

    normalize = __call__
