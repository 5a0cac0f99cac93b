"""Scores in grids: no pair is a row before it is scored, and all agree with the scores by rows."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.config import DedupConfig
from weftline.functions import similarity as sim
from weftline.operators import cluster, grids, minhash, score
from weftline.plans import pipeline, reference

SMALL = "/root/testdata/sf0.001"
CONFIG = DedupConfig(n=16, rows=4)
SCORES = ["min_features", "mw_overlap", "mw_levenshtein", "title_cosine", "title_mw_similarity", "greedy_key_match", "leftover_model_words", "pair_distance"]
CLUSTERS = ["cluster_pair_counts", "cluster_count", "complete_linkage", "components", "normal_distances"]


@pytest.fixture(scope="module")
def odd(spark):
    """Candidates of records with different names, repeats, empty titles, long words and no attribute at all."""
    rng = random.Random(5)
    word = lambda: rng.choice(["led tv", "40inch", "x40", "120hz", "sony", "", "a🙂b9", "1,920 x 1,080", "q" * 70 + "7", "40 40"])
    rows = []
    for i in range(50):
        features = {k: word() for k in rng.sample(["size", "sizes", "Screen Size", "type", "title", "hz"], rng.randint(0, 4))}
        rows.append((i, str(i % 7), f"{word()} {word()} {word()}" if i % 9 else "", {"shop": word()} if i % 3 else {}, features))
    rows += [(100 + i, *rows[i % 6][1:]) for i in range(25)]
    records = spark.createDataFrame(rows, "rid long, entity_id string, title string, attrs map<string,string>, features map<string,string>")
    vecs = spark.createDataFrame([(r[0], [len(r[2]) % 3]) for r in rows], "rid long, word_ids array<long>")
    brand = spark.createDataFrame([(r[0], "ab"[r[0] % 25 % 2]) for r in rows], "rid long, block string")
    return pipeline.candidate_contents(vecs, records, CONFIG, brand)


def by_rows(by, name):
    """The score of that name from one row a pair."""
    six = lambda c, n: F.round(c, 6).alias(n)
    matches = lambda p: score.key_matches(p, CONFIG.gamma)
    columns = {
        "min_features": lambda p: p.select("rid_i", "rid_j", F.least(F.size("kv_i"), F.size("kv_j"))),
        "mw_overlap": lambda p: p.select("rid_i", "rid_j", six(sim.overlap(F.col("words_i"), F.col("words_j")), "x")),
        "mw_levenshtein": lambda p: p.select("rid_i", "rid_j", six(sim.word_edit_similarity(F.col("words_i"), F.col("words_j")), "x")),
        "title_cosine": lambda p: p.select("rid_i", "rid_j", six(sim.word_cosine(F.col("title_i"), F.col("title_j")), "x")),
        "title_mw_similarity": lambda p: p.select("rid_i", "rid_j", six(sim.title_similarity(F.col("title_i"), F.col("title_j"), F.col("words_i"), F.col("words_j"), CONFIG.alpha, CONFIG.beta, CONFIG.delta), "x")),
        "greedy_key_match": lambda p: matches(p).select("rid_i", "rid_j", F.size("matches").alias("m"), six(score.weighted_values(), "x")),
        "leftover_model_words": lambda p: matches(p).select("rid_i", "rid_j", F.size("rest_i").alias("a"), F.size("rest_j").alias("b"), six(score.rest_overlap(), "x")),
    }
    if name == "pair_distance":
        return by.named(by.scored(lambda p, r: score.pair_distance(p, r, CONFIG).withColumn("dist", F.round("dist", 6))))
    return by.named(by.scored(lambda p, r: score.paired(p, r).transform(columns[name])))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("rid_i", "rid_j", *(F.col(c).cast("string") for c in df.columns[2:])).collect())


@pytest.mark.parametrize("name", SCORES)
def test_grids_equal_rows(odd, monkeypatch, name):
    for limit, value in (("PIECE", 4), ("CELLS", 40), ("TABLE", 30), ("ROWS", 7)):
        monkeypatch.setattr(grids, limit, value)
    got = rows_of(odd.grids(group=9).pairs(name, CONFIG))
    assert got == rows_of(by_rows(odd, name)) and len(got) > 500


@pytest.mark.parametrize("rounded", [False, True])
def test_clusters_equal_rows(odd, monkeypatch, rounded):
    monkeypatch.setattr(grids, "PIECE", 4)
    want = sorted(map(tuple, odd._clusters_by_rows(CONFIG, rounded).collect()))
    assert sorted(map(tuple, odd.clusters(CONFIG, rounded).collect())) == want
    monkeypatch.setattr(grids, "WHOLE", 800)  # one block is too large for a task
    assert sorted(map(tuple, odd.clusters(CONFIG, rounded).collect())) == want
    dist = odd.distances(CONFIG, rounded)
    near = dist.filter(F.col("dist") < CONFIG.epsilon).select(F.col("rid_i").alias("u"), F.col("rid_j").alias("v"))
    label = lambda e: sorted(tuple(r) for r in cluster.components(cluster.both_ways(e)).select("u", "label").collect())
    assert label(odd.grids(group=9).near(CONFIG, rounded)) == label(near)
    assert odd.grids(group=9).normal(CONFIG, rounded).collect() == score.normal_distances(dist).collect()


@pytest.mark.parametrize("name", SCORES + CLUSTERS)
def test_no_pair_is_written_before_its_score(spark, monkeypatch, name):
    """At 60 times sf0.1 the rows of pairs filled the disk."""
    for module, f in ((minhash, "content_pairs"), (minhash, "record_pairs"), (score, "paired")):
        monkeypatch.setattr(module, f, lambda *a: pytest.fail("pairs become rows"))
    assert reference.QUERIES[name](spark, SMALL).count() >= 1


def test_rates_of_clusters_are_rounded(spark):
    row = reference.QUERIES["cluster_pair_counts"](spark, "/root/testdata/sf0.01").first()
    assert row.precision == round(row.precision, 6)


def test_rounding_is_that_of_decimals(spark):
    values = [0.0078125, 0.1234565, 0.1234575, -0.5, 1 / 3, 0.9999995, 0.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6)).collect()]
    assert grids.six(grids.np.array(values)).tolist() == want
