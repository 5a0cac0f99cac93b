"""Registered queries of the record-shaping operators (nested records, wide tables, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import dewey, units, wide
from weftline.session import durable, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dewey.shred(dewey.latest_deliveries(table(spark, sf_dir, "tvs_all_merged")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dewey.children(_nodes(spark, sf_dir))


def _part(path: str, columns: dict[str, str]):
    """The table of a schema path, its columns by expression and name; columns that the data lack are null."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = durable(_nodes(spark, sf_dir).filter(F.col("path") == path))
        rows = dewey.tables(nodes).get(path)
        if rows is None:
            rows = nodes.select("file_id", "label", "keys", F.col("label").alias("parent"), F.lit("").alias("outer_key"), F.lit(0).alias("item_pos"))
        for name in ("rid", "title", "shop", "value", "price", "currency", "place", "qty"):
            rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
        return rows.select(*(F.expr(e).alias(n) for n, e in columns.items()))

    return query


_ADDRESS = {"file_id": "file_id", "label": "array_join(label, '.')"}
_CHILD = {**_ADDRESS, "parent": "array_join(parent, '.')"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cells(p3_wide(spark, sf_dir))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.pivot_wide(table(spark, sf_dir, "feature_rows"), table(spark, sf_dir, "attribute_catalog"))


def p7_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.convert_units(table(spark, sf_dir, "records"))


def p7_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units found by the mixture for the statements of every fifth listing, whose own units are hidden from it."""
    return units.inferred_units(durable(units.statements(table(spark, sf_dir, "records"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_amounts(spark, sf_dir).filter(F.col("unit_source") == "stated").select("rid", "field", "quantity", "amount").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_products": _part("product", {**_ADDRESS, "outer_key": "outer_key", "item_pos": "item_pos", "rid": "rid", "title": "title", "shop": "shop"}),
    "p1_features": _part("product.featuresMap", {**_CHILD, "name": "array_join(slice(keys, 4, size(keys)), ' > ')", "value": "value"}),
    "p1_offers": _part("product.offers", {**_CHILD, "offer_pos": "element_at(label, -1)", "price": "price", "currency": "currency"}),
    "p1_stock": _part("product.offers.stock", {**_CHILD, "stock_pos": "element_at(label, -1)", "place": "place", "qty": "qty"}),
    "p3_found": p3_found,
    "p3_wide": p3_wide,
    "p7_found": p7_found,
    "p7_amounts": p7_amounts,
    "p7_inferred": p7_inferred,
}
