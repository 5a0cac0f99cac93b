"""Distance of candidate pairs over titles, attribute names and attribute values.

All parts of a pair's score are expressions over one row, which holds both
records' cleaned titles and key-value lists; the only joins bring these to the
pair.  Scoring is bound by CPU, so the pairs are dealt evenly to tasks first, as many as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.config import DedupConfig
from weftline.functions import similarity as sim
from weftline.functions.strings import mixed_tokens, qgrams
from weftline.operators.tokens import key_values
from weftline.session import durable


#: Pairs that a task scores, about.
PAIRS = 50_000
#: Tasks of the scores, at most: the driver keeps track of each.
MOST_TASKS = 2000


def fields(records: DataFrame) -> DataFrame:
    """``rid, title, kv``: all of a record that its scores depend on."""
    return key_values(records).join(records.select("rid", F.coalesce("title", F.lit("")).alias("title")).hint("merge"), "rid").select("rid", "title", "kv")


def paired(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with ``title``, ``kv`` (names and values with their grams) and ``words`` of both sides."""
    grams = F.transform("kv", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), qgrams(e["key"]).alias("kg"), qgrams(e["value"]).alias("vg")))
    side = fields(records).select("rid", "title", grams.alias("kv"), mixed_tokens(F.transform("kv", lambda e: e["value"])).alias("words"))
    named = lambda s: side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)).hint("merge")
    pairs = durable(candidates)
    tasks = min(MOST_TASKS, max(candidates.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS))
    return pairs.join(named("i"), "rid_i").join(named("j"), "rid_j").repartition(tasks)


def key_matches(pairs: DataFrame, gamma: float) -> DataFrame:
    """``matches``: for each right name with a left name above gamma, the first such, with both similarities.

    ``rest_i`` and ``rest_j`` are the entries that no match took.  Each name
    and each matched value is compared once: what a lambda uses again is bound
    to a variable of it, as an expression it would be worked out at every use.
    """

    def match(r: Column) -> Column:
        scored = F.transform("kv_i", lambda q, i: F.struct(i.alias("q_pos"), sim.gram_similarity(q["kg"], r["kg"]).alias("w"), q["vg"].alias("vg"), q["key"].alias("q_key")))
        first = F.slice(F.filter(scored, lambda s: s["w"] > gamma), 1, 1)
        return F.transform(first, lambda s: F.struct(s["q_pos"].alias("q_pos"), s["q_key"].alias("q_key"), r["key"].alias("r_key"), s["w"].alias("w"), sim.gram_similarity(s["vg"], r["vg"]).alias("v")))

    matched = pairs.withColumn("matches", F.flatten(F.transform("kv_j", match)))
    taken = matched.withColumn("taken_i", F.transform("matches", lambda m: m["q_key"])).withColumn("taken_j", F.transform("matches", lambda m: m["r_key"]))
    rest = taken.withColumn("rest_i", F.filter("kv_i", lambda e: ~F.array_contains("taken_i", e["key"]))).withColumn("rest_j", F.filter("kv_j", lambda e: ~F.array_contains("taken_j", e["key"])))
    return rest.drop("taken_i", "taken_j")


def weighted_values() -> Column:
    """Similarity of the matched values, weighted by that of their names; 0 without a match."""
    total = F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["w"])
    gain = F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["w"] * m["v"])
    return F.when(total > 0, gain / total).otherwise(0.0)


def rest_overlap() -> Column:
    words = lambda c: mixed_tokens(F.transform(c, lambda e: e["value"]))
    return sim.overlap(words("rest_i"), words("rest_j"))


def pair_distance(candidates: DataFrame, records: DataFrame, config: DedupConfig) -> DataFrame:
    """``rid_i, rid_j, dist`` of candidates of one brand; a missing pair is infinitely far.

    Distances may leave [0, 1], as matches can outnumber the smaller list; a
    pair without any attribute on one side has a null distance.

    The distances are written to the shared checkpoint folder: a filter on
    them would otherwise be pushed below the projection that computes them,
    which repeats the whole score in every place where it is used.
    """
    if config.score_mode == "as_written":
        return candidates.select("rid_i", "rid_j", F.lit(0.0).alias("dist"))
    rows = key_matches(paired(candidates, records), config.gamma)
    few = F.least(F.size("kv_i"), F.size("kv_j"))
    parts = rows.select(
        "rid_i",
        "rid_j",
        F.try_divide(F.size("matches").cast("double"), few.cast("double")).alias("share"),
        weighted_values().alias("avg"),
        rest_overlap().alias("rest"),
        sim.title_similarity(F.col("title_i"), F.col("title_j"), F.col("words_i"), F.col("words_j"), config.alpha, config.beta, config.delta).alias("t"),
    )
    mu = config.mu
    without = F.col("share") * F.col("avg") + (1 - F.col("share")) * F.col("rest")
    theta = (1 - mu) * F.col("share")
    blended = theta * F.col("avg") + (1 - mu - theta) * F.col("rest") + mu * F.col("t")
    return durable(parts.select("rid_i", "rid_j", (1 - F.when(F.col("t") == -1, without).otherwise(blended)).alias("dist")))


def normal_distances(distances: DataFrame) -> DataFrame:
    """One row: how many pairs lie strictly between 0 and 1."""
    return distances.agg(F.count_if((F.col("dist") > 0) & (F.col("dist") < 1)).alias("pairs"))
