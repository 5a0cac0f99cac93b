"""Cleaning and tokenising of records, one row per value or word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftline.functions import strings as S
from weftline.sources.records import ordinals


def clean(records: DataFrame) -> DataFrame:
    """Titles and feature values cleaned; feature names and other fields stay."""
    return records.withColumn("title", S.clean_title(F.col("title"))).withColumn("features", F.transform_values("features", lambda k, v: S.clean_value(v)))


def feature_rows(records: DataFrame) -> DataFrame:
    return records.select("rid", F.posexplode("features").alias("pos", "key", "value"))


def key_values(records: DataFrame) -> DataFrame:
    """``rid, kv`` with kv an array of {key, value}: title, other scalars and features in order, values compacted.

    A feature named like a scalar keeps the scalar's place and gives its value.
    """
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = lambda m: F.coalesce(F.map_entries(m), empty)
    title = F.when(F.col("title").isNotNull(), F.array(F.struct(F.lit("title").alias("key"), F.col("title").alias("value")))).otherwise(empty)
    scalars = F.concat(title, entries("attrs"))
    features = entries("features")
    both = F.concat(
        F.transform(scalars, lambda s: F.struct(s["key"].alias("key"), F.coalesce(F.try_element_at(F.col("features"), s["key"]), s["value"]).alias("value"))),
        F.filter(features, lambda f: ~F.exists(scalars, lambda s: s["key"] == f["key"])),
    )
    return records.select("rid", F.transform(both, lambda e: F.struct(e["key"].alias("key"), S.compact(e["value"]).alias("value"))).alias("kv"))


def title_words(records: DataFrame) -> DataFrame:
    """``rid, word``: distinct model words of each title."""
    return records.select("rid", F.explode(F.array_distinct(S.model_words(F.col("title")))).alias("word")).filter("word <> ''")


def feature_words(records: DataFrame, whole: Sequence[str] = S.WHOLE_VALUES, first: Sequence[str] = S.FIRST_TOKENS) -> DataFrame:
    """``rid, word``: whole values and first tokens of the listed features; empty ones are left out."""
    words = [F.try_element_at("features", F.lit(k)) for k in whole] + [F.try_element_at(S.tokens(F.try_element_at("features", F.lit(k))), F.lit(1)) for k in first]
    return records.select("rid", F.explode(F.array_distinct(F.array_compact(F.array(*words)))).alias("word")).filter("word <> ''")


def vocabulary(words: DataFrame) -> DataFrame:
    """``word_id, word``: distinct words numbered from 0 in their order."""
    return ordinals(words.select("word").distinct(), "word", name="word_id").select("word_id", "word")
