"""Registered queries of the operators on text and near-copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import canonical, encode, language, lookalike, mixing, nearcopies, products
from weftline.session import durable, table


def p2_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title row's brand with its distance and how many entries were as near."""
    titles = table(spark, sf_dir, "records").withColumn("features", F.lit(None).cast("map<string,string>"))
    return canonical.map_titles(durable(lookalike.to_one_form(titles).select("rid", "title")), table(spark, sf_dir, "brands"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with several rows that differ takes the nearest entry, so a known brand before none."""
    return canonical.nearest(p2_brands(spark, sf_dir)).select("rid", F.col("entry").alias("brand_id"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without a listed brand."""
    titles = table(spark, sf_dir, "records").groupBy("rid").agg(F.max("title").alias("title"))
    return p2_found(spark, sf_dir).filter("brand_id = 0").join(titles, "rid").select("rid", "title")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.rid_pairs(*nearcopies.near_copies(table(spark, sf_dir, "records")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(*nearcopies.near_copies(table(spark, sf_dir, "records")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.odd_texts(lookalike.to_one_form(table(spark, sf_dir, "records")))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.to_one_form(table(spark, sf_dir, "records"))


def p6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.same_products(table(spark, sf_dir, "records"), table(spark, sf_dir, "brands"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_pairs(p6_products(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of times it is taken, those without a source by their posterior."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), unlabelled=True)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block and document with its language, confidence and whether it is ambiguous."""
    documents, languages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "languages")
    return language.segments(documents, language.fit(documents, languages))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(p10_segments(spark, sf_dir), table(spark, sf_dir, "languages"))


QUERIES = {
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_found": p6_found,
    "p6_products": p6_products,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}
ORACLE: dict[str, str] = {}
