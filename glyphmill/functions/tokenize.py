"""Tokenizers and word n-grams as ``Column -> Column`` functions, all native."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.normalize import BLANK

_NO_STRINGS = "array<string>"
_NO_GRAMS = "array<array<string>>"


class Tokenizer(Protocol):
    def __call__(self, c: Column) -> Column: ...


def _runs(c: Column, members: str, lower: bool, min_length: int) -> Column:
    """Maximal runs of a character class; lengths are bytes, after lowering."""
    out = F.regexp_extract_all(c, F.lit(f"({members}+)"), F.lit(1))
    if lower:
        out = F.transform(out, F.lower)
    return F.filter(out, lambda t: F.octet_length(t) >= min_length) if min_length > 1 else out


def word_tokens(c: Column, lower: bool = True, min_length: int = 1) -> Column:
    """ASCII letters and digits; anything else separates."""
    return _runs(c, "[A-Za-z0-9]", lower, min_length)


def whitespace_tokens(c: Column, lower: bool = True, min_length: int = 1) -> Column:
    return _runs(c, f"[^{BLANK}]", lower, min_length)


def pattern_tokens(c: Column, pattern: str, lower: bool = False, min_length: int = 0) -> Column:
    r"""``\w+``, ``\d+``, ``\s+``, ``[chars]`` (members as they stand), else any character of ``pattern``.

    Members are bytes: with one beyond ASCII the text is matched byte by byte,
    and a token that cuts a character has U+FFFD for what is left of it.
    """
    named = {r"\w+": "[A-Za-z0-9]", r"\d+": "[0-9]", r"\s+": f"[{BLANK}]"}
    if pattern in named:
        return _runs(c, named[pattern], lower, min_length)
    chars = pattern[1:-1] if pattern.startswith("[") and pattern.endswith("]") else pattern
    if not chars:
        return F.when(c.isNotNull(), F.array().cast(_NO_STRINGS))
    if chars.isascii():
        members = "".join(re.escape(x) if not x.isalnum() else x for x in dict.fromkeys(chars))
        return _runs(c, f"[{members}]", lower, min_length)
    # one character a byte, so that a class of bytes is a class of characters
    members = "".join(f"\\x{b:02x}" for b in sorted(set(chars.encode())))
    found = _runs(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), f"[{members}]", False, 1)
    whole = F.transform(found, lambda t: F.encode(t, "ISO-8859-1"))
    tokens = F.transform(whole, lambda t: F.make_valid_utf8(t.cast("string")))
    tokens = F.transform(tokens, F.lower) if lower else tokens
    return F.filter(tokens, lambda t: F.octet_length(t) >= min_length) if min_length > 1 else tokens


def char_ngrams(c: Column, n: int, lower: bool = True) -> Column:
    """Code-point n-grams."""
    text = F.lower(c) if lower else c
    if n <= 0:
        return F.when(c.isNotNull(), F.array().cast(_NO_STRINGS))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, grams).when(text.isNotNull(), F.array().cast(_NO_STRINGS))


def sentences(c: Column, discard_empty: bool = True) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before a blank or the end."""
    pieces = F.split(c, rf"(?<=[.!?])(?=[{BLANK}]|\z)")
    pieces = F.transform(F.filter(pieces, lambda s: s != ""), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")))
    if discard_empty:
        return F.filter(pieces, lambda s: s != "")
    return F.when(c == "", F.array(F.lit(""))).otherwise(pieces)


def is_sentence_boundary(c: Column, at: Column) -> Column:
    """Whether the byte at 0-based ``at`` ends a sentence; false beyond the text.

    A byte inside a character is no terminator, and a character after one is no blank.
    """
    raw = F.encode(c, "UTF-8")
    byte = F.substring(raw, at + 1, F.lit(1))
    after = F.substring(raw, at + 2, F.lit(1))
    ends = byte.isin(*[F.lit(x.encode()) for x in ".!?"])
    blank = after.isin(*[F.lit(x.encode()) for x in " \t\n\x0b\f\r"])
    return F.when(c.isNotNull() & at.isNotNull(), (at >= 0) & ends & (blank | (F.octet_length(after) == 0)))


def drained(tokens: Column, run: Column, lower: bool = True, min_length: int = 1) -> Column:
    """``tokens`` with one more run of characters, if it is long enough in bytes and not empty."""
    token = F.lower(run) if lower else run
    fits = (F.octet_length(run) > 0) & (F.octet_length(token) >= min_length)
    return F.when(fits, F.concat(tokens, F.array(token))).otherwise(tokens)


def windows(items: Column, n: int, empty: str = _NO_GRAMS) -> Column:
    """Sliding windows of ``n`` items."""
    none = F.array().cast(empty)
    if n <= 0:
        return F.when(items.isNotNull(), none)
    cut = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, n))
    return F.when(F.size(items) >= n, cut).when(items.isNotNull(), none)


def ngrams(tokens: Column, n: int) -> Column:
    return windows(tokens, n)


def bigrams(tokens: Column) -> Column:
    return windows(tokens, 2)


def trigrams(tokens: Column) -> Column:
    return windows(tokens, 3)


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    """n-grams of all orders from ``low`` to ``high``, shorter ones first."""
    orders = [n for n in range(low, high + 1) if n > 0]
    if not orders:
        return windows(tokens, 0)
    return F.concat(*[windows(tokens, n) for n in orders])


def join_grams(grams: Column, sep: str = " ") -> Column:
    return F.transform(grams, lambda g: F.array_join(g, sep))
