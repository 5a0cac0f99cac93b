"""Connected components and complete-linkage clusters, as repeated joins of edge tables.

Components shrink labels over edges.  Complete linkage never leaves a
component; components of few pairs, their number checked, are clustered each
by itself in a task.  In larger ones, which no task may gather, all mutually
nearest clusters of a round merge at once by joins, which gives the same
clusters as merging the nearest pair one by one, since complete linkage never
brings a merged cluster nearer to a third one than its parts were.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.operators.minhash import record_pairs
from weftline.session import discard, durable


def both_ways(edges: DataFrame) -> DataFrame:
    """``u, v`` of edges ``u, v`` and their reverses."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``u, label`` of every node of symmetric edges ``u, v``: label is the component's smallest node.

    Every round takes the smallest label of the neighbours and then that
    label's own label, so long chains shrink fast.  Each round is written to
    the shared checkpoint folder.
    """
    labels = durable(edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("label"), F.lit(None).cast(edges.schema["u"].dataType).alias("old")))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = labels.select("u", "label").join(near, "u").select("u", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
        new = durable(step.join(jump, "label", "left").select("u", F.coalesce(F.least("up", "label"), "label").alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            return labels.select("u", "label")
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


#: Pairs of a component up to which a task clusters it by itself.
FEW = 20_000


def link_small(pairs: list[tuple[int, int, float]]) -> dict[int, int]:
    """Cluster of each record by complete linkage of ``(a, b, distance)``, nearest pair first, ties by the smaller ids."""
    near: dict[int, dict[int, float]] = {}
    for a, b, d in pairs:
        near.setdefault(a, {})[b] = d
        near.setdefault(b, {})[a] = d
    into = {x: x for x in near}
    heap = [(d, a, b) for a, b, d in pairs]
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        if near.get(a, {}).get(b) != d:
            continue
        into[b] = a
        of_a, of_b = near.pop(a), near.pop(b)
        for c in {*of_a, *of_b} - {a, b}:
            near[c].pop(a, None)
            near[c].pop(b, None)
        merged = {c: max(x, of_b[c]) for c, x in of_a.items() if c in of_b}
        for c, x in merged.items():
            near[c][a] = x
            heapq.heappush(heap, (x, min(a, c), max(a, c)))
        near[a] = merged
    out = {}
    for x in into:
        top = x
        while into[top] != top:
            top = into[top]
        out[x] = top
    return out


def _linked_alone(edges: DataFrame) -> DataFrame:
    """``rid, cluster_id`` of the records in ``a, b, d, label``, each label's pairs clustered by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, []

        def done() -> pa.RecordBatch:
            found = link_small(pairs)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["rid", "cluster_id"])

        for batch in batches:
            for label, a, b, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if label != now and pairs:
                    yield done()
                    pairs = []
                now = label
                pairs.append((a, b, d))
        if pairs:
            yield done()

    return edges.select("label", "a", "b", "d").repartition("label").sortWithinPartitions("label").mapInArrow(run, "rid long, cluster_id long")


def complete_linkage(distances: DataFrame, epsilon: float, nodes: DataFrame, few: int = FEW) -> DataFrame:
    """``rid, cluster_id`` of ``nodes`` by complete linkage of ``rid_i, rid_j, dist`` below epsilon; the id is the smallest rid.

    A pair that is not given is infinitely far.  Ties go to the pair with the
    smaller rids.  Null distances count as infinite.  Components of at most
    ``few`` pairs are clustered each in a task.
    """
    pairs = distances.filter(F.col("dist") < epsilon).select(F.least("rid_i", "rid_j").cast("long").alias("a"), F.greatest("rid_i", "rid_j").cast("long").alias("b"), "dist")
    edges = durable(pairs.filter("a <> b").groupBy("a", "b").agg(F.max("dist").alias("d")))
    labels = components(both_ways(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    placed = durable(edges.join(labels.withColumnRenamed("u", "a"), "a"))
    large = durable(placed.groupBy("label").count().filter(F.col("count") > few).select("label"))
    alone = _linked_alone(placed.join(large, "label", "left_anti"))
    if large.limit(1).count():
        alone = alone.unionByName(_linked_by_rounds(placed.join(large, "label", "left_semi").select("a", "b", "d")))
    return nodes.select("rid").join(alone, "rid", "left").select("rid", F.coalesce("cluster_id", "rid").alias("cluster_id"))


def _linked_by_rounds(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``rid, cluster_id`` of the records in ``a, b, d``, all mutually nearest clusters of a round merging at once."""
    edges = durable(edges)
    label = durable(edges.select(F.explode(F.array("a", "b")).alias("rid")).distinct().withColumn("cluster_id", F.col("rid")))
    merges: list[DataFrame] = []
    for _ in range(most_rounds):
        rank = F.struct("d", "a", "b")
        ends = edges.select(F.col("a").alias("c"), rank.alias("r")).unionByName(edges.select(F.col("b").alias("c"), rank.alias("r"))).groupBy("c").agg(F.min("r").alias("r"))
        mutual = ends.groupBy("r").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("r.b").alias("c"), F.col("r.a").alias("into"))
        mutual = durable(mutual)
        if not mutual.limit(1).count():
            break
        merges.append(mutual)
        parts = mutual.select("c", "into").unionByName(mutual.select(F.col("into").alias("c"), "into"))
        at = lambda s: parts.select(F.col("c").alias(s), F.col("into").alias(f"{s}2"))
        moved = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"), "d", F.col("a2").isNotNull().alias("am"), F.col("b2").isNotNull().alias("bm"))
        # a merged cluster has two parts, and every part of either side must reach every part of the other
        need = F.when(F.col("xm"), 2).otherwise(1) * F.when(F.col("ym"), 2).otherwise(1)
        flag = lambda low: F.when((F.col("x") < F.col("y")) == F.lit(low), F.col("am")).otherwise(F.col("bm"))
        edges = durable(
            moved.filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d", flag(True).alias("xm"), flag(False).alias("ym"))
            .groupBy("a", "b", "xm", "ym")
            .agg(F.max("d").alias("d"), F.count("*").alias("n"))
            .filter(F.col("n") == need)
            .select("a", "b", "d")
        )
    for i, m in enumerate(merges):
        label = label.join(m.withColumnRenamed("c", "cluster_id"), "cluster_id", "left").select("rid", F.coalesce("into", "cluster_id").alias("cluster_id"))
        if i % 10 == 9:
            label = durable(label)
    return label


def _cross(scores: DataFrame) -> DataFrame:
    """``cid, dist`` of both contents of each score between two contents."""
    between = scores.filter("cid_i <> cid_j")
    return between.select(F.col("cid_i").alias("cid"), "dist").unionByName(between.select(F.col("cid_j").alias("cid"), "dist"))


def content_edges(scores: DataFrame, contents: DataFrame, epsilon: float) -> DataFrame:
    """Edges ``u, v`` that connect the same records as all pairs of records nearer than epsilon, from scores ``cid_i, cid_j, dist`` of ordered pairs.

    Where every ordered pair of two contents is near, all their records are
    connected, and edges to each other's first record say as much.  Where only
    one of two orders is near, the pairs of records are named.
    """
    near = F.coalesce(F.col("dist") < epsilon, F.lit(False))
    rows = scores.select("cid_i", "cid_j", near.alias("near"))
    of = rows.groupBy(F.least("cid_i", "cid_j").alias("a"), F.greatest("cid_i", "cid_j").alias("b")).agg(F.bool_and("near").alias("all"), F.bool_or("near").alias("any"))
    whole = durable(of.filter("all").select("a", "b"))
    each = contents.select("rid", "cid")
    to = whole.unionByName(whole.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a content near itself is connected by its own star, so that others need reach its first record only
    own = whole.filter("a = b").select(F.col("a").alias("cid"), F.lit(True).alias("own"))
    ends = each.join(own.hint("merge"), "cid", "left").filter("own is null or rid = cid").select("rid", F.col("cid").alias("a"))
    star = each.join(own.hint("merge"), "cid").filter("rid <> cid").select(F.col("cid").alias("u"), F.col("rid").alias("v"))
    across = ends.join(to.filter("a <> b").hint("merge"), "a").select(F.col("rid").alias("u"), F.col("b").alias("v"))
    mixed = of.filter("any and not all").select("a", "b")
    half = rows.filter("near").withColumn("a", F.least("cid_i", "cid_j")).withColumn("b", F.greatest("cid_i", "cid_j")).join(mixed.hint("merge"), ["a", "b"]).select("cid_i", "cid_j")
    named = record_pairs(half, contents, "cid").select(F.col("rid_i").alias("u"), F.col("rid_j").alias("v"))
    return star.unionByName(across).unionByName(named)


def linkage_of_contents(scores: DataFrame, contents: DataFrame, epsilon: float, few: int = FEW) -> DataFrame:
    """``rid, cluster_id`` of the records by complete linkage, from scores ``cid_i, cid_j, dist`` of ordered pairs of their contents.

    A content whose records are nearer to each other than to all others merges
    first, so it goes in as one node, with the largest distance of the orders
    that occur.  The records of other contents are nodes each.
    """
    own = scores.filter("cid_i = cid_j").select(F.col("cid_i").alias("cid"), F.coalesce("dist", F.lit(float("inf"))).alias("own"))
    other = _cross(scores).groupBy("cid").agg(F.min("dist").alias("other"))
    loose = own.join(other.hint("merge"), "cid", "left").filter((F.col("own") >= epsilon) | F.coalesce(F.col("other") <= F.col("own"), F.lit(False))).select("cid", F.lit(True).alias("loose"))
    placed = contents.select("rid", "cid").join(durable(loose).hint("merge"), "cid", "left").select("rid", "cid", F.when(F.col("loose"), F.col("rid")).otherwise(F.col("cid")).alias("node"))
    placed = durable(placed)
    nodes = durable(placed.groupBy("node", "cid").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")))
    side = lambda s: nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in nodes.columns)).hint("merge")
    met = scores.join(side("i"), "cid_i").join(side("j"), "cid_j").filter("node_i <> node_j and lo_i < hi_j")
    far = F.max(F.coalesce("dist", F.lit(float("inf")))).alias("dist")
    pairs = met.groupBy(F.least("node_i", "node_j").alias("rid_i"), F.greatest("node_i", "node_j").alias("rid_j")).agg(far)
    linked = complete_linkage(pairs, epsilon, nodes.select(F.col("node").alias("rid")), few)
    return placed.select("rid", "node").join(linked.withColumnRenamed("rid", "node").hint("merge"), "node").select("rid", "cluster_id")


def members(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """``cluster_id, entity_ids``: the entity labels of each cluster's records in order of rid."""
    rows = clusters.join(records.select("rid", "entity_id"), "rid")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rid", "entity_id"))).alias("m")).select("cluster_id", F.col("m.entity_id").alias("entity_ids"))
