"""Records ``rid, entity_id, title, attrs, features`` from nested catalogues and from flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import durable


def ordinals(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of ``keys``, without gathering it in one task.

    Range partitions are sorted each by itself; their sizes, one number per
    partition, give the offsets.  Ties of the keys are numbered arbitrarily.
    """
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = durable(parts.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())
    start, offsets = 0, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(start)]
        start += n
    first = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0)
    return placed.withColumn(name, (first + F.col("__row")).cast("long")).drop("__part", "__row")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON files ``{entity: [product, ...]}`` as records; ``rid`` follows file, entity and item order.

    A product's ``title`` and ``featuresMap`` are taken out, its other scalars
    become ``attrs``.  Files that are no such JSON give no rows.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return flatten_catalogue(text)


def flatten_catalogue(text: DataFrame) -> DataFrame:
    """Records of ``file, value`` with one nested catalogue per row."""
    tree = text.select("file", F.from_json("value", "map<string,array<map<string,string>>>").alias("tree"))
    entities = tree.select("file", F.posexplode("tree").alias("entity_pos", "entity_id", "items"))
    products = entities.select("file", "entity_pos", "entity_id", F.posexplode("items").alias("item_pos", "p"))
    flat = products.filter("p is not null").select(
        "file",
        "entity_pos",
        "item_pos",
        "entity_id",
        F.col("p")["title"].alias("title"),
        F.map_filter("p", lambda k, v: ~k.isin("title", "featuresMap")).alias("attrs"),
        F.from_json(F.col("p")["featuresMap"], "map<string,string>").alias("features"),
    )
    return ordinals(flat, "file", "entity_pos", "item_pos", name="rid").select("rid", "entity_id", "title", "attrs", "features")


def from_parts(part: DataFrame) -> DataFrame:
    """Records from a parts table; brand, name and type together label the entity."""
    size = F.col("p_size").cast("string")
    return part.select(
        F.col("p_partkey").alias("rid"),
        F.concat_ws("|", "p_brand", "p_name", "p_type").alias("entity_id"),
        F.concat_ws(" ", "p_brand", "p_name", "p_type", size, F.lit("inches")).alias("title"),
        F.create_map().cast("map<string,string>").alias("attrs"),
        F.create_map(
            F.lit("Type"), F.col("p_type"), F.lit("Size"), F.concat(size, F.lit('"')), F.lit("Weight"), F.concat(size, F.lit(" lbs")), F.lit("Price"), F.format_string("%.2f", "p_retailprice")
        ).alias("features"),
    )


def sample_rows(n: int, seed: int, spark: SparkSession) -> DataFrame:
    """Bootstrap sample ``rid, prod_idx``: n draws with replacement from 0..n-1 by an integer hash of the draw's number."""
    mask = (1 << 32) - 1
    draws = spark.range(n).select(F.col("id").alias("rid"))
    h = F.expr(f"(rid * 2654435761 + {seed * 40503 % mask}) & {mask}")
    mixed = draws.withColumn("h", h).withColumn("h", F.expr(f"((h ^ shiftright(h, 16)) * 73244475) & {mask}")).withColumn("h", F.expr(f"((h ^ shiftright(h, 16)) * 73244475) & {mask}"))
    return mixed.select("rid", (F.col("h") % n).alias("prod_idx"))


def gather(products: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled products, repeats kept; the draw's number becomes ``rid``.  ``products`` has ``prod_idx``."""
    return sample.join(products.drop("rid"), "prod_idx")
