"""Quality of candidates and clusters against entity labels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.config import DedupConfig
from weftline.session import durable


def found(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row: ``comparisons`` and ``dups_found``, the candidates with equal labels."""
    e = lambda s: records.select(F.col("rid").alias(f"rid_{s}"), F.col("entity_id").alias(f"e_{s}"))
    rows = candidates.join(e("i"), "rid_i").join(e("j"), "rid_j")
    return rows.agg(F.count("*").alias("comparisons"), F.count_if(F.col("e_i") == F.col("e_j")).alias("dups_found"))


def to_find(records: DataFrame) -> DataFrame:
    """One row: ``records`` and ``dups_to_find``, the pairs of equal labels; null labels have none."""
    per = records.groupBy("entity_id").agg(F.count("*").alias("c"))
    pairs = F.when(F.col("entity_id").isNotNull(), F.expr("c * (c - 1) div 2")).otherwise(0)
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("records"), F.coalesce(F.sum(pairs), F.lit(0)).alias("dups_to_find"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Quotient as a double; null where the divisor is 0."""
    return F.try_divide((F.col(a) if isinstance(a, str) else a).cast("double"), (F.col(b) if isinstance(b, str) else b).cast("double"))


def found_by_class(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row as of ``found``, of all records in one class or in two classes of a pair, without naming the pairs.

    ``members`` has ``rid, rep, entity_id``, ``pairs`` has ``rep_i, rep_j``.
    """
    cells = members.groupBy("rep", "entity_id").agg(F.count("*").alias("c"))
    sizes = cells.groupBy("rep").agg(F.sum("c").alias("n"))
    two = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("x"))
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
    across = pairs.join(side(sizes, "i"), "rep_i").join(side(sizes, "j"), "rep_j")
    alike = pairs.join(side(cells, "i"), "rep_i").join(side(cells, "j"), "rep_j").filter("entity_id_i = entity_id_j")
    comparisons = total(total(sizes, two("n")).unionByName(total(across, F.col("n_i") * F.col("n_j"))), "x")
    dups = total(total(cells.filter("entity_id is not null"), two("c")).unionByName(total(alike, F.col("c_i") * F.col("c_j"))), "x")
    return comparisons.withColumnRenamed("x", "comparisons").join(dups.withColumnRenamed("x", "dups_found"))  # one row each


#: Classes of a block; a task holds two blocks against each other.
BLOCK = 2048


def found_by_rows(members: DataFrame, sigs: DataFrame, config: DedupConfig, grid: Sequence[int]) -> DataFrame:
    """``r, comparisons, dups_found`` as of ``found_by_class`` for each number of rows per band, of signatures ``rid, sig`` of the classes.

    With few rows a band nearly all classes meet, in many bands each.  So
    their pairs are bits, of two blocks of classes at a time: every class
    takes over the bits of its bucket, band by band, and no pair is a row.
    """
    cells = durable(members.groupBy("rep", "entity_id").agg(F.count("*").alias("c")))
    label = F.when(F.col("entity_id").isNotNull(), F.struct(F.col("entity_id").alias("e"), "c"))
    per = cells.groupBy("rep").agg(F.sum("c").alias("n"), F.collect_list(label).alias("labels"))
    number = max(1, -(-sigs.count() // BLOCK))
    placed = sigs.select(F.col("rid").alias("rep"), F.col("sig").cast("array<int>").alias("sig")).join(per.hint("merge"), "rep").withColumn("block", F.expr(f"pmod(xxhash64(rep), {number})"))
    twice = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<bigint>"))).select("sig", "n", "labels", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    widths = [(r, config.n // (config.n // r), config.n // r) for r in grid]
    total = config.n

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(-1, total).astype(np.int64)
        block, n, labels = rows["block"].to_numpy(), rows["n"].to_numpy().astype(np.float64), rows["labels"].to_pylist()
        left, right = np.flatnonzero(block == key[0].as_py()), np.flatnonzero(block == key[1].as_py())
        values = int(sig.max()) + 1
        at = defaultdict(list)
        for j, x in enumerate(right):
            for y in labels[x]:
                at[y["e"]].append((j, y["c"]))
        alike = [(i, j, y["c"] * c) for i, x in enumerate(left) for y in labels[x] for j, c in at.get(y["e"], ())]
        ai, aj, ac = (np.array(x, dtype=np.int64) for x in (zip(*alike, strict=True) if alike else ((), (), ())))
        place, words = np.arange(len(right)), -(-len(right) // 64)
        word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)

        def buckets(part: np.ndarray) -> np.ndarray:
            code, top = part[:, 0], values
            for c in range(1, part.shape[1]):
                if top > 2**62 // values:
                    code, top = np.unique(code, return_inverse=True)[1].reshape(-1), len(part)
                code, top = code * values + part[:, c], top * values
            return np.unique(code, return_inverse=True)[1].reshape(-1)

        out = []
        for r, width, count in widths:
            bits = np.zeros((len(left), words), dtype=np.uint64)
            for k in range(count):
                code = buckets(sig[:, k * width : (k + 1) * width])
                filled = np.zeros((int(code.max()) + 1, words), dtype=np.uint64)
                np.bitwise_or.at(filled, (code[right], word), bit)
                bits |= filled[code[left]]
            near = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
            near = np.triu(near, 1) if same else near
            out.append((r, int(n[left] @ (near.astype(np.float64) @ n[right])), int((near[ai, aj] * ac).sum())))
        return pa.table({"r": pa.array([x[0] for x in out], pa.int32()), "x": pa.array([x[1] for x in out], pa.int64()), "y": pa.array([x[2] for x in out], pa.int64())})

    across = twice.groupBy("a", "b").applyInArrow(meet, "r int, x long, y long")
    two = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    within = per.agg(F.coalesce(F.sum(two("n")), F.lit(0)).alias("x")).join(cells.filter("entity_id is not null").agg(F.coalesce(F.sum(two("c")), F.lit(0)).alias("y")))  # one row each
    every = within.select(F.explode(F.array(*map(F.lit, grid))).alias("r"), "x", "y")
    return durable(every.unionByName(across).groupBy("r").agg(F.sum("x").alias("comparisons"), F.sum("y").alias("dups_found")))


def pair_quality(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row: comparisons, duplicates found and to find, PQ, PC, fraction of comparisons and F1*."""
    return quality(found(candidates, records), records)


def quality(counts: DataFrame, records: DataFrame) -> DataFrame:
    """A row of rates from each of ``comparisons, dups_found`` and the records with their labels."""
    both = counts.join(to_find(records))  # one row of the records
    rates = both.select(
        *(c for c in counts.columns if c not in ("comparisons", "dups_found")),
        "comparisons",
        "dups_found",
        "dups_to_find",
        ratio("dups_found", "comparisons").alias("pq"),
        ratio("dups_found", "dups_to_find").alias("pc"),
        ratio("comparisons", F.expr("records * (records - 1) div 2")).alias("fraction"),
    )
    return rates.withColumn("f1_star", ratio(2 * F.col("pq") * F.col("pc"), F.col("pq") + F.col("pc")))


def cluster_count(clusters: DataFrame) -> DataFrame:
    """One row: how many clusters there are, and how many have more than one record."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("of_several"))


def cluster_pairs(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """One row: TP, FP, FN, precision, recall, the recall as first coded (TP over FP and FN) and F1."""
    rows = clusters.join(records.select("rid", "entity_id"), "rid")
    two = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    cells = rows.groupBy("cluster_id", "entity_id").agg(F.count("*").alias("c"))
    tp = F.sum(F.when(F.col("entity_id").isNotNull(), two("c")).otherwise(0))
    per = cells.groupBy("cluster_id").agg(F.sum("c").alias("s"), tp.alias("tp")).agg(F.coalesce(F.sum(two("s")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    counts = per.join(to_find(records)).select("tp", (F.col("pairs") - F.col("tp")).alias("fp"), (F.col("dups_to_find") - F.col("tp")).alias("fn"))
    rates = counts.select("tp", "fp", "fn", ratio("tp", F.expr("tp + fp")).alias("precision"), ratio("tp", F.expr("tp + fn")).alias("recall"), ratio("tp", F.expr("fp + fn")).alias("recall_as_written"))
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
