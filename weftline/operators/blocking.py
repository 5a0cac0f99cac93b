"""Brand of a title by the lexicon's last entry that it contains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators.vectors import contained


def lexicon(brands: DataFrame) -> DataFrame:
    """``brand_pos, brand`` in lower case, the later of equal entries kept."""
    return brands.select("brand_pos", F.lower("brand").alias("brand")).groupBy("brand").agg(F.max("brand_pos").alias("brand_pos"))


def extract_brand(records: DataFrame, brands: DataFrame) -> DataFrame:
    """``rid, brand``: the entry with the largest position that the title contains, else an empty text."""
    words = lexicon(brands)
    hits = contained(records.select(F.col("rid").alias("id"), F.col("title").alias("text")), words.select(F.col("brand_pos").alias("word_id"), F.col("brand").alias("word")))
    last = hits.groupBy(F.col("id").alias("rid")).agg(F.max("word_id").alias("brand_pos")).join(words, "brand_pos").select("rid", "brand")
    return records.select("rid").join(last, "rid", "left").select("rid", F.coalesce("brand", F.lit("")).alias("brand"))
