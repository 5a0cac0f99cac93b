"""String operators of the record cleaner and tokenisers, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Literal replacements in their order; those of a title and those of a feature's value.
TITLE_UNITS = (('"', " inch"), ("inches", "inch"), ("-inch", "inch"), ("lb.", "lb"), ("lbs.", "lb"), ("pounds", "lb"), (" lbs", "lb"), (" lb", "lb"), (" inch", "inch"))
FEATURE_UNITS = (("inches", "inch"), ('"', "inch"), ("-inch", " inch"), (" inch", "inch"), ("lbs.", "lb"), ("lb.", "lb"), ("pounds", "lb"), ("lbs", "lb"), (" lb", "lb"))
# Fixed value: the model-word pattern; its class holds U+02C6, digits, comma and blank.
MODEL_WORD = "([a-zA-Z0-9]*(([0-9]+[ˆ0-9, ]+)|([ˆ0-9, ]+[0-9]+))[a-zA-Z0-9]*)"
# Features whose whole value is a word, and those whose first token is.
WHOLE_VALUES = ("Maximum Resolution", "Dynamic Contrast Ratio", "Speaker Output Power")
FIRST_TOKENS = ("TV Type",)


def replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def clean_title(c: Column) -> Column:
    """Lower case, units joined to their numbers; null gives an empty text."""
    return replaced(F.lower(F.coalesce(c, F.lit(""))), TITLE_UNITS)


def clean_value(c: Column) -> Column:
    """Lower case, units joined to their numbers, by the rules for feature values."""
    return replaced(F.lower(F.coalesce(c, F.lit(""))), FEATURE_UNITS)


def compact(c: Column) -> Column:
    """Lower case without blanks, commas, slashes and double quotes."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), ' ,/"', ""))


def model_words(c: Column, pattern: str = MODEL_WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def tokens(c: Column) -> Column:
    """Tokens between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def mixed_tokens(values: Column) -> Column:
    """Tokens of an array of texts that are neither all letters nor all numerals; repeats are kept."""
    return F.filter(F.flatten(F.transform(values, tokens)), lambda t: ~t.rlike(r"^\p{L}+$") & ~t.rlike(r"^\p{N}+$"))


def qgrams(c: Column, q: int = 3) -> Column:
    """Substrings of q characters in order; a shorter text is its own only one.

    The text is split once and its shifted lists are zipped, so the cost is
    linear in the length.
    """
    chars = F.split(c, "")
    out = chars
    for k in range(2, q + 1):
        out = F.zip_with(out, F.slice(chars, F.lit(k), F.greatest(F.length(c), F.lit(1))), lambda x, y: F.concat(x, y))
    return F.when(F.length(c) < q, F.array(c)).otherwise(F.array_compact(out))


def without_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}", "")


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")
