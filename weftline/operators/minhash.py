"""MinHash signatures by seeded affine permutations, and banded buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.config import DedupConfig
from weftline.session import durable, spread


def affine(x: Column, a: int, b: int, prime: int) -> Column:
    """a + b x modulo the prime, in 64-bit arithmetic."""
    return F.pmod(F.lit(a) + F.lit(b) * x.cast("long"), F.lit(prime))


def affine_hashes(vocab: DataFrame, config: DedupConfig) -> DataFrame:
    """``word_id, hash_no, h`` of every word and permutation."""
    each = [F.struct(F.lit(i).alias("hash_no"), affine(F.col("word_id"), a, b, config.prime).alias("h")) for i, (a, b) in enumerate(config.coefficients())]
    return vocab.select("word_id", F.explode(F.array(*each)).alias("x")).select("word_id", "x.hash_no", "x.h")


def signatures(vectors: DataFrame, config: DedupConfig) -> DataFrame:
    """``rid, sig``: per permutation the word that comes last (or first); ``empty_value`` throughout for no word.

    Row-local.  All permutations of a row are placed at once in
    64-bit arithmetic; as an expression they would be worked out again for
    every band that reads them.
    """
    rows = vectors.filter(F.size("word_ids") > 0) if config.drop_empty else vectors
    coefficients = np.array(config.coefficients(), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients[:, :1], coefficients[:, 1:]
        pick = np.argmax if config.order == "last" else np.argmin
        nothing = np.full(config.n, config.empty_value, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                sigs = []
                for words in part.column(1).to_pylist():
                    w = np.array(words or [], dtype=np.int64)
                    sigs.append(w[pick((a + b * w) % config.prime, axis=1)] if len(w) else nothing)
                ends = pa.array(np.arange(len(sigs) + 1) * config.n, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs), pa.int64()))], names=["rid", "sig"])

    rid = vectors.schema["rid"].dataType.simpleString()
    return spread(rows.select("rid", F.col("word_ids").cast("array<long>"))).mapInArrow(run, f"rid {rid}, sig array<long>")


def bands(sigs: DataFrame, config: DedupConfig) -> DataFrame:
    """``rid, band, bucket``; hashes beyond the last whole band are unused."""
    r = config.band_rows
    buckets = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda k: F.array_join(F.transform(F.slice("sig", k * r + 1, F.lit(r)), lambda v: v.cast("string")), config.delimiter))
    return sigs.select("rid", F.posexplode(buckets).alias("band", "bucket"))


def vector_classes(vectors: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """``rid, rep, word_ids`` and, with a ``block`` (``rid, block``), ``block``: rep is the smallest rid with the same words and block.

    Records of one class have one signature, so classes rather than records
    meet in the buckets.
    """
    rows, keys = vectors.select("rid", "word_ids"), ["word_ids"]
    if block is not None:
        rows, keys = rows.join(block, "rid"), ["word_ids", "block"]
    return rows.join(rows.groupBy(*keys).agg(F.min("rid").alias("rep")), keys)


def candidates(buckets: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Distinct ``rid_i, rid_j`` (i < j) that share a bucket.

    With ``block`` (``rid, block``), only pairs of one block: the block joins
    the key, so a hot bucket is split before pairs arise.

    Buckets are never broadcast: their size is estimated from the records
    before they are cut into bands, far too low.
    """
    keys = ["band", "bucket"]
    if block is not None:
        buckets, keys = buckets.join(block.hint("merge"), "rid"), [*keys, "block"]
    left, right = buckets.withColumnRenamed("rid", "rid_i"), buckets.withColumnRenamed("rid", "rid_j")
    return left.join(right.hint("merge"), keys).filter("rid_i < rid_j").select("rid_i", "rid_j").distinct()


def class_candidates(classes: DataFrame, config: DedupConfig) -> DataFrame:
    """Distinct ``rep_i, rep_j`` (i < j) of the classes that share a bucket, in one block where the classes have one."""
    reps = classes.filter("rid = rep")
    block = reps.select("rid", "block") if "block" in classes.columns else None
    return candidates(bands(signatures(reps, config), config), block).select(F.col("rid_i").alias("rep_i"), F.col("rid_j").alias("rep_j"))


def class_members(classes: DataFrame, pairs: DataFrame, config: DedupConfig) -> DataFrame:
    """``rid_i, rid_j`` (i < j) of all records in one class or in two classes of a pair.

    With ``drop_empty`` records without a word are in no pair.
    """
    rows = with_words(classes, config)
    return record_pairs(_ordered(rows, pairs), rows, "rep")


def with_words(classes: DataFrame, config: DedupConfig) -> DataFrame:
    """The classes whose records may be in a pair."""
    return classes.filter(F.size("word_ids") > 0) if config.drop_empty else classes


def _ordered(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rep_i, rep_j``: the pairs of classes either way, and every class with itself."""
    same = classes.select(F.col("rep").alias("rep_i")).distinct().withColumn("rep_j", F.col("rep_i"))
    return pairs.select("rep_i", "rep_j").unionByName(pairs.select(F.col("rep_j").alias("rep_i"), F.col("rep_i").alias("rep_j"))).unionByName(same)


#: Records of a class that one row names, at most.
CHUNK = 256


def record_pairs(pairs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rid_i, rid_j`` (i < j) and the other columns of ordered pairs ``{key}_i, {key}_j``, for the records of both classes.

    ``classes`` has ``rid`` and ``key``.  A row of a class names up to
    ``CHUNK`` records, so what is shuffled are pairs of classes, not of records.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("rid"))
    named = classes.select(key, "rid", F.floor((place - 1) / CHUNK).alias("chunk")).groupBy(key, "chunk").agg(F.array_sort(F.collect_list("rid")).alias("rids"))
    rows = durable(named.select(key, "rids", F.element_at("rids", 1).alias("lo"), F.element_at("rids", -1).alias("hi")))
    side = lambda s: rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns)).hint("merge")
    rest = [c for c in pairs.columns if c not in (f"{key}_i", f"{key}_j")]
    met = pairs.join(side("i"), f"{key}_i").join(side("j"), f"{key}_j").filter("lo_i < hi_j")
    left = met.select(F.explode("rids_i").alias("rid_i"), "rids_j", *rest)
    return left.select("rid_i", F.explode("rids_j").alias("rid_j"), *rest).filter("rid_i < rid_j")


def contents(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """``rid, rep, cid``: cid is the smallest rid of those records of a class that agree in all ``fields`` beside ``rid``.

    Records of one content score alike against any other.
    """
    columns = [c for c in fields.columns if c != "rid"]
    rows = classes.select("rid", "rep").join(fields.hint("merge"), "rid")
    return rows.select("rid", "rep", F.min("rid").over(Window.partitionBy("rep", *columns)).alias("cid"))


def content_pairs(contents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered pairs ``cid_i, cid_j`` of the contents of one class or of two classes of a pair, where a record of the first comes before one of the second."""
    ends = durable(contents.groupBy("rep", "cid").agg(F.max("rid").alias("hi")))
    side = lambda s: ends.select(*(F.col(c).alias(f"{c}_{s}") for c in ends.columns)).hint("merge")
    return _ordered(ends, pairs).join(side("i"), "rep_i").join(side("j"), "rep_j").filter("cid_i < hi_j").select("cid_i", "cid_j")
