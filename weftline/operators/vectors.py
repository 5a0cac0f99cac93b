"""Sparse binary vectors: which words of the vocabulary a record's texts contain as substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def contained(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct ``id, word_id`` of ``id, text``: the words that occur anywhere in the text.

    Every distinct text is cut into its substrings of those lengths that words
    have, and these meet the words in an equi-join, so no text is held against
    the whole vocabulary.  The distinct lengths, at most the longest word's,
    are read on the driver.
    """
    lengths = [r[0] for r in vocab.select(F.length("word").alias("n")).filter("n > 0").distinct().collect()]
    if not lengths:
        return texts.select("id", F.lit(None).cast("long").alias("word_id")).filter("false")
    text = F.col("text")

    def cut_to(n: int):
        places = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cut = [cut_to(n) for n in sorted(lengths)]
    values = texts.select("text").filter("text is not null").distinct()
    hits = values.select("text", F.explode(F.array_distinct(F.flatten(F.array(*cut)))).alias("word")).join(vocab, "word").select("text", "word_id")
    return texts.join(hits, "text").select("id", "word_id").distinct()


def title_vectors(records: DataFrame, vocab: DataFrame) -> DataFrame:
    return contained(records.select(F.col("rid").alias("id"), F.col("title").alias("text")), vocab).withColumnRenamed("id", "rid")


def feature_vectors(records: DataFrame, vocab: DataFrame) -> DataFrame:
    return contained(records.select(F.col("rid").alias("id"), F.explode(F.map_values("features")).alias("text")), vocab).withColumnRenamed("id", "rid")


def binary_vectors(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """``rid, word_ids``: sorted ids of all words in title or feature values; an empty array for none."""
    texts = F.concat(F.array("title"), F.coalesce(F.map_values("features"), F.array().cast("array<string>")))
    hits = contained(records.select(F.col("rid").alias("id"), F.explode(texts).alias("text")), vocab)
    sets = hits.groupBy(F.col("id").alias("rid")).agg(F.array_sort(F.collect_list("word_id")).alias("word_ids"))
    return records.select("rid").distinct().join(sets, "rid", "left").select("rid", F.coalesce("word_ids", F.array().cast("array<bigint>")).alias("word_ids"))
