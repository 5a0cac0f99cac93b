"""The whole duplicate search: records to candidates, distances, clusters and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from weftline.config import DedupConfig
from weftline.functions import strings as S
from weftline.operators import blocking, cluster, evaluate, grids, minhash, score, tokens, vectors
from weftline.session import durable
from weftline.sources.records import gather, ordinals, sample_rows


@dataclass
class Result:
    candidates: DataFrame
    pair_distance: DataFrame
    clusters: DataFrame
    metrics: DataFrame


def word_sets(records: DataFrame, whole: Sequence[str] = S.WHOLE_VALUES, first: Sequence[str] = S.FIRST_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned records, their vocabulary and their vectors; ``whole`` and ``first`` name the features that give words."""
    cleaned = tokens.clean(records)
    vocab = tokens.vocabulary(tokens.title_words(cleaned).unionByName(tokens.feature_words(cleaned, whole, first)))
    return cleaned, vocab, vectors.binary_vectors(cleaned, vocab)


def candidate_pairs(vector_rows: DataFrame, config: DedupConfig, block: DataFrame | None = None) -> DataFrame:
    """``rid_i, rid_j`` that share a bucket; records with the same words meet once."""
    classes = durable(minhash.vector_classes(vector_rows, block))
    return minhash.class_members(classes, minhash.class_candidates(classes, config), config)


def found(vector_rows: DataFrame, records: DataFrame, config: DedupConfig) -> DataFrame:
    """One row as of ``evaluate.found`` for the candidates, which are counted by class and not named."""
    classes = durable(minhash.vector_classes(vector_rows))
    near = durable(minhash.class_candidates(minhash.with_words(classes, config), config))
    return evaluate.found_by_class(_labelled(classes, records, config), near)


def _labelled(classes: DataFrame, records: DataFrame, config: DedupConfig) -> DataFrame:
    """``rid, rep, entity_id`` of the records that may be in a pair."""
    return durable(minhash.with_words(classes, config).join(records.select("rid", "entity_id"), "rid").select("rid", "rep", "entity_id"))


class Contents:
    """Candidates, as pairs ``rep_i, rep_j`` of ``classes`` and all pairs within a class.

    Scores come from grids, so that no pair is written before it is scored.
    What needs rows of pairs takes ordered pairs ``cid_i, cid_j`` of contents,
    of which every record has one (``rid, rep, cid``): a pair of records is
    scored by its contents alone, so repeated records are scored once and only
    named, or counted, in the end.
    """

    def __init__(self, classes: DataFrame, near: DataFrame, cleaned: DataFrame):
        self.classes, self.near, self.cleaned = classes, near, cleaned

    @cached_property
    def of(self) -> DataFrame:
        return durable(minhash.contents(self.classes, score.fields(self.cleaned)))

    @cached_property
    def pairs(self) -> DataFrame:
        return durable(minhash.content_pairs(self.of, self.near))

    def scored(self, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``cid_i, cid_j, ...`` by a function of pairs ``rid_i, rid_j`` and their records."""
        one = self.of.filter("rid = cid").select("rid")
        rows = score(self.pairs.select(F.col("cid_i").alias("rid_i"), F.col("cid_j").alias("rid_j")), self.cleaned.join(one.hint("merge"), "rid", "left_semi"))
        return durable(rows.withColumnsRenamed({"rid_i": "cid_i", "rid_j": "cid_j"}))

    def named(self, scores: DataFrame) -> DataFrame:
        """``rid_i, rid_j, ...`` of all pairs of records."""
        return minhash.record_pairs(scores, self.of, "cid")

    def grids(self, **kind) -> grids.Layout:
        """The candidates dealt to tasks that score them."""
        return grids.Layout(self.classes, self.near, score.fields(self.cleaned), **kind)

    def distances(self, config: DedupConfig, rounded: bool = False) -> DataFrame:
        """``rid_i, rid_j, dist`` of all pairs of records."""
        if config.score_mode == "as_written":
            return self.named(self.pairs).withColumn("dist", F.lit(0.0))
        return self.grids().pairs("pair_distance", config, rounded)

    def clusters(self, config: DedupConfig, rounded: bool = False) -> DataFrame:
        """``rid, cluster_id`` by complete linkage: a block in one task, but for blocks of too many pairs."""
        if config.score_mode == "as_written":
            return self._clusters_by_rows(config, rounded)
        whole = self.grids(most=grids.WHOLE)
        linked = whole.clusters(config, rounded)
        if not whole.large.limit(1).count():
            return linked
        classes = self.classes.join(whole.large, "block", "left_semi") if "block" in self.classes.columns else self.classes
        near = self.near.join(classes.select(F.col("rid").alias("rep_i")), "rep_i", "left_semi")
        return linked.unionByName(Contents(durable(classes), near, self.cleaned)._clusters_by_rows(config, rounded))

    def _clusters_by_rows(self, config: DedupConfig, rounded: bool) -> DataFrame:
        dist = lambda d: d.withColumn("dist", F.round("dist", 6)) if rounded else d
        return cluster.linkage_of_contents(self.scored(lambda p, r: dist(score.pair_distance(p, r, config))), self.of, config.epsilon)


def candidate_contents(vector_rows: DataFrame, cleaned: DataFrame, config: DedupConfig, block: DataFrame | None = None) -> Contents:
    """The candidates, as those of ``candidate_pairs``, for their scores."""
    classes = durable(minhash.with_words(minhash.vector_classes(vector_rows, block), config))
    return Contents(classes, durable(minhash.class_candidates(classes, config)), cleaned)


def find_duplicates(records: DataFrame, brands: DataFrame, config: DedupConfig | None = None, whole: Sequence[str] = S.WHOLE_VALUES, first: Sequence[str] = S.FIRST_TOKENS) -> Result:
    """Candidates of equal brand, their distances, complete-linkage clusters and one row of metrics."""
    config = config or DedupConfig()
    cleaned, _, vecs = word_sets(records, whole, first)
    brand = blocking.extract_brand(cleaned, brands).select("rid", F.col("brand").alias("block"))
    by = candidate_contents(durable(vecs), cleaned, config, brand)
    linked = by.clusters(config)
    clusters = durable(records.select("rid").join(linked.hint("merge"), "rid", "left").select("rid", F.coalesce("cluster_id", F.col("rid").cast("long")).alias("cluster_id")))
    labelled = durable(by.classes.join(records.select("rid", "entity_id").hint("merge"), "rid").select("rid", "rep", "entity_id"))
    metrics = evaluate.quality(evaluate.found_by_class(labelled, by.near), records).join(evaluate.cluster_pairs(clusters, records))  # one row each
    return Result(minhash.record_pairs(minhash._ordered(by.classes, by.near), by.classes, "rep"), by.distances(config), clusters, metrics)


def metrics_by_rows(vecs: DataFrame, records: DataFrame, config: DedupConfig, rows: Sequence[int]) -> DataFrame:
    """Candidate metrics for each number of rows per band, as rows ``r, ...``, of vectors and labelled records.

    Pairs are counted by class, not named: at one row per band nearly all
    records are compared.
    """
    classes = durable(minhash.vector_classes(vecs))
    members = classes.join(records.select("rid", "entity_id"), "rid").select("rid", "rep", "entity_id")
    members = durable(members.join(classes.filter(F.size("word_ids") > 0).select("rid"), "rid", "left_semi") if config.drop_empty else members)
    sigs = durable(minhash.signatures(classes.filter("rid = rep"), config))
    if config.delimiter:
        return evaluate.quality(evaluate.found_by_rows(members, sigs, config, rows), records)
    parts = []
    for r in rows:  # buckets whose names are ambiguous meet by name
        near = minhash.candidates(minhash.bands(sigs, replace(config, rows=r))).select(F.col("rid_i").alias("rep_i"), F.col("rid_j").alias("rep_j"))
        parts.append(evaluate.quality(evaluate.found_by_class(members, durable(near)), records).select(F.lit(r).alias("r"), "*"))
    return reduce(DataFrame.unionByName, parts)


def bootstrap_metrics(records: DataFrame, vecs: DataFrame, config: DedupConfig, rows: Sequence[int], repeats: int) -> DataFrame:
    """Means over bootstrap samples of the candidate metrics per number of rows, F1* of the means.

    ``vecs`` are the vectors of all records, so the vocabulary is that of the
    whole collection.  Every repeat draws its own sample of as many records as
    there are, with its own permutations.
    """
    numbered = durable(ordinals(records.select("rid", "entity_id").join(vecs, "rid"), "rid", name="prod_idx"))
    n = numbered.count()
    parts = []
    for k in range(repeats):
        sample = durable(gather(numbered, sample_rows(n, config.seed + k, records.sparkSession)))
        parts.append(metrics_by_rows(sample.select("rid", "word_ids"), sample.select("rid", "entity_id"), replace(config, seed=config.seed + k), rows))
    means = reduce(DataFrame.unionByName, parts).groupBy("r").agg(*(F.avg(c).alias(c) for c in ("comparisons", "dups_found", "dups_to_find", "pq", "pc", "fraction")))
    return means.withColumn("f1_star", evaluate.ratio(2 * F.col("pq") * F.col("pc"), F.col("pq") + F.col("pc")))


def top_similar(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest partners of every record, by (distance, rid): a top-k report."""
    from pyspark.sql import Window

    both = distances.select(F.col("rid_i").alias("rid"), F.col("rid_j").alias("partner"), "dist").unionByName(distances.select(F.col("rid_j").alias("rid"), F.col("rid_i").alias("partner"), "dist"))
    order = Window.partitionBy("rid").orderBy("dist", "partner")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
