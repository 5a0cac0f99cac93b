"""Similarities of texts and word lists, as Column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions.strings import only_digits, qgrams, tokens, without_digits


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def gram_distance(a: Column, b: Column) -> Column:
    """Tokens of either list that the other lacks; repeats count, membership decides."""
    return F.size(F.filter(a, lambda x: ~F.array_contains(b, x))) + F.size(F.filter(b, lambda x: ~F.array_contains(a, x)))


def gram_similarity(a: Column, b: Column) -> Column:
    """Share of common grams of two gram lists."""
    n = F.size(a) + F.size(b)
    return (n - gram_distance(a, b)) / n


def text_similarity(a: Column, b: Column, q: int = 3) -> Column:
    return gram_similarity(qgrams(a, q), qgrams(b, q))


def overlap(c: Column, d: Column) -> Column:
    """Equal pairs of words over the words of the first list; 0 if either is empty.  Not symmetric, may exceed 1."""
    pairs = F.aggregate(c, F.lit(0), lambda s, x: s + F.size(F.filter(d, lambda y: y == x)))
    return F.when((F.size(c) > 0) & (F.size(d) > 0), pairs / F.size(c)).otherwise(0.0)


def edit_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for equal texts."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of word counts; 0 if either text has no word."""
    x, y = tokens(a), tokens(b)
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w)).cast("double")
    dot = lambda p, q: _sum(F.transform(F.array_distinct(p), lambda w: count(p, w) * count(q, w)))
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def word_edit_similarity(a: Column, b: Column, near: float = 0.5) -> Column:
    """Length-weighted edit similarity over the pairs of words with near letters and equal digits; 0 if there are none."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    like = F.filter(pairs, lambda p: (edit_share(without_digits(p["x"]), without_digits(p["y"])) < near) & (only_digits(p["x"]) == only_digits(p["y"])))
    weight = lambda p: (F.length(p["x"]) + F.length(p["y"])).cast("double")
    total = _sum(F.transform(like, weight))
    gain = _sum(F.transform(like, lambda p: (1 - edit_share(p["x"], p["y"])) * weight(p)))
    return F.when(total > 0, gain / total).otherwise(0.0)


def clash(a: Column, b: Column, near: float = 0.5) -> Column:
    """Whether some pair of words has near letters while some pair has different digits."""
    close = F.exists(a, lambda x: F.exists(b, lambda y: edit_share(without_digits(x), without_digits(y)) < near))
    differ = F.size(F.array_distinct(F.transform(F.concat(a, b), only_digits))) > 1
    return close & differ & (F.size(a) > 0) & (F.size(b) > 0)


def title_similarity(title_a: Column, title_b: Column, a: Column, b: Column, alpha: float, beta: float, delta: float) -> Column:
    """Decision list over titles and their word lists: 1 if the titles' cosine exceeds alpha, -1 on a clash, else a blend."""
    cos = word_cosine(title_a, title_b)
    s = beta * cos + (1 - beta) * (1 - edit_share(title_a, title_b))
    words = word_edit_similarity(a, b)
    return F.when(cos > alpha, 1.0).when(clash(a, b), -1.0).when(words > 0, delta * words + (1 - delta) * s).otherwise(s)
