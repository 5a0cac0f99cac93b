"""The duplicate search: formulas by hand, SQL parity, and properties of clustering and MinHash."""

import itertools
import random
from dataclasses import replace

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.config import DedupConfig
from weftline.functions import similarity as sim, strings as S
from weftline.operators import cluster, evaluate, minhash, score, tokens, vectors
from weftline.plans import pipeline, reference
from weftline.sources import records as R

SMALL = "/root/testdata/sf0.001"
REC = "rid long, entity_id string, title string, attrs map<string,string>, features map<string,string>"


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr).first()[0]


@pytest.mark.parametrize(("text", "want"), [('40"', "40inch"), ("40-inch", "40inch"), ("40  inch", "40 inch"), ("120 Hz", "120 hz"), ("10lbs", "10lbs"), ("10 lbs.", "10lb"), (None, "")])
def test_clean_title(spark, text, want):
    assert one(spark, S.clean_title(F.col("t").cast("string")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [('40"', "40inch"), ("40-inch", "40inch"), ("10lbs", "10lb"), ("bulb. 5", "bulb 5")])
def test_clean_value(spark, text, want):
    assert one(spark, S.clean_value(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("samsung 40inch led tv", ["samsung 40inch"]), ("x5y", []), ("1,920 x 1,080", ["1,920", "x 1,080"])])
def test_model_words(spark, text, want):
    assert [w.strip() for w in one(spark, S.model_words(F.col("t")), t=text)] == want


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcd", "äöüß", "a🙂bc"])
def test_qgrams(spark, text):
    want = [text[i : i + 3] for i in range(len(text) - 2)] or [text]
    assert one(spark, S.qgrams(F.col("t")), t=text) == want


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similarities_against_plain_python(spark):
    rng = random.Random(3)
    words = lambda: ["".join(rng.choice("ab12") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4))]
    rows = [(words(), words()) for _ in range(150)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", sim.overlap(a, b), sim.word_edit_similarity(a, b), sim.clash(a, b)).collect()
    nld = lambda x, y: lev(x, y) / max(len(x), len(y), 1)
    letters = lambda w: "".join(c for c in w if not c.isdigit())
    digits = lambda w: "".join(c for c in w if c.isdigit())
    for x, y, over, edit, clash in got:
        assert over == (sum(p == q for p in x for q in y) / len(x) if x and y else 0)
        near = [(p, q) for p in x for q in y if nld(letters(p), letters(q)) < 0.5 and digits(p) == digits(q)]
        weight = sum(len(p) + len(q) for p, q in near)
        want = sum((1 - nld(p, q)) * (len(p) + len(q)) for p, q in near) / weight if weight else 0
        assert abs(edit - want) < 1e-9
        close = any(nld(letters(p), letters(q)) < 0.5 for p in x for q in y)
        assert clash == (close and any(digits(p) != digits(q) for p in x + y for q in x + y))


def test_key_values_keep_place_and_take_feature(spark):
    df = spark.createDataFrame([(1, "e", 'A "b"', {"x": "1, 2", "y": "3"}, {"y": "F/4", "z": ""})], REC)
    assert [tuple(e) for e in tokens.key_values(df).first().kv] == [("title", "ab"), ("x", "12"), ("y", "f4"), ("z", "")]


def test_containment_is_substring(spark):
    texts = spark.createDataFrame([(1, "abc1"), (2, None), (3, ""), (1, "abc1")], "id long, text string")
    vocab = spark.createDataFrame([(0, "bc"), (1, "c1"), (2, "zz"), (3, "abc1x")], "word_id long, word string")
    assert {tuple(r) for r in vectors.contained(texts, vocab).collect()} == {(1, 0), (1, 1)}


def test_signature_matches_plain_loop(spark):
    config = DedupConfig(n=6, rows=2)
    rng = random.Random(1)
    rows = [(i, sorted(rng.sample(range(50), rng.randint(0, 8)))) for i in range(40)]
    got = dict(minhash.signatures(spark.createDataFrame(rows, "rid long, word_ids array<long>"), config).collect())
    for rid, words in rows:
        assert got[rid] == [max(words, key=lambda w: (a + b * w) % config.prime) if words else 10000 for a, b in config.coefficients()]


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=20, max_size=60), st.sets(st.integers(0, 400), min_size=20, max_size=60))
def test_collision_rate_is_jaccard(a, b):
    coefficients = DedupConfig(n=1050, rows=1).coefficients()
    h = lambda s: [max(s, key=lambda w: (x + y * w) % 2147483647) for x, y in coefficients]
    rate = sum(p == q for p, q in zip(h(a), h(b), strict=True)) / len(coefficients)
    assert abs(rate - len(a & b) / len(a | b)) < 0.09


def test_band_parameters():
    assert (DedupConfig(n=10, rows=4).bands, DedupConfig(n=10, rows=4).band_rows) == (2, 5)
    with pytest.raises(ValueError):
        DedupConfig(n=4, rows=5)


def greedy(n, dist, eps):
    """Complete linkage one nearest pair at a time; ties by the smaller ids."""
    groups = {i: [i] for i in range(n)}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            d = max(dist.get((min(x, y), max(x, y)), 9e9) for x in groups[a] for y in groups[b])
            if d < eps and (best is None or (d, a, b) < best):
                best = (d, a, b)
        if best is None:
            return {x: g for g, xs in groups.items() for x in xs}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("seed", range(2))
def test_complete_linkage_equals_greedy(spark, seed, few):
    rng = random.Random(seed)
    n = 16
    dist = {(i, j): (rng.choice([0.0, 0.1, 0.2, 0.6]) if seed % 2 else rng.random()) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6}
    df = spark.createDataFrame([(i, j, d) for (i, j), d in dist.items()], "rid_i long, rid_j long, dist double")
    got = {r.rid: r.cluster_id for r in cluster.complete_linkage(df, 0.5, spark.range(n).withColumnRenamed("id", "rid"), few).collect()}
    assert got == greedy(n, dist, 0.5)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.u: r.label for r in cluster.components(cluster.both_ways(edges)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_cluster_counts(spark):
    rec = spark.createDataFrame([(i, e, "", {}, {}) for i, e in enumerate("aabbc")], REC)
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)], "rid long, cluster_id long")
    r = evaluate.cluster_pairs(clusters, rec).first()
    assert (r.tp, r.fp, r.fn, r.recall, r.recall_as_written) == (1, 2, 1, 0.5, 1 / 3)


def test_catalogue_keeps_order(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"M2": [{"title": "t", "shop": "s", "featuresMap": {"b": "1", "a": "2"}}], "M1": [{"title": "u"}, {"title": "v"}]}')
    rows = R.read_catalogue(spark, str(tmp_path)).withColumn("names", F.map_keys("features")).orderBy("rid").collect()
    assert [(r.rid, r.entity_id, r.title) for r in rows] == [(0, "M2", "t"), (1, "M1", "u"), (2, "M1", "v")]
    assert rows[0].attrs == {"shop": "s"} and rows[0].names == ["b", "a"] and rows[1].features is None


def test_pipeline_and_bootstrap(spark):
    rec = R.from_parts(spark.read.parquet(f"{SMALL}/part.parquet"))
    res = pipeline.find_duplicates(rec, reference._lexicon(spark, SMALL), DedupConfig(n=16, rows=4))
    assert res.clusters.count() == rec.count() and res.metrics.count() == 1
    config, vecs = DedupConfig(n=8), pipeline.word_sets(rec)[2]
    boot = pipeline.bootstrap_metrics(rec, vecs, config, (2, 4), 2).collect()
    assert len(boot) == 2 and all(0 < r.pc <= 1 for r in boot)
    words, labels = {r.rid: frozenset(r.word_ids) for r in vecs.collect()}, {r.rid: r.entity_id for r in rec.collect()}
    order, n = sorted(labels), len(labels)
    for r in boot:
        want = []
        for k in range(2):
            one = replace(config, seed=1 + k, rows=r.r)
            drawn = [order[x.prod_idx] for x in R.sample_rows(n, 1 + k, spark).collect()]
            sig = {p: [max(words[p], key=lambda w, a=a, b=b: (a + b * w) % one.prime) if words[p] else 10000 for a, b in one.coefficients()] for p in set(drawn)}
            cut = {p: {(i, tuple(v[i : i + one.band_rows])) for i in range(0, one.bands * one.band_rows, one.band_rows)} for p, v in sig.items()}
            near = [(x, y) for x, y in itertools.combinations(drawn, 2) if cut[x] & cut[y]]
            want.append((len(near), sum(labels[x] == labels[y] for x, y in near)))
        assert (r.comparisons, r.dups_found) == (sum(w[0] for w in want) / 2, sum(w[1] for w in want) / 2)


def test_stream_matches_batch(spark, tmp_path):
    from weftline.streaming.match import match_stream

    rec = R.from_parts(spark.read.parquet(f"{SMALL}/part.parquet"))
    config = DedupConfig(n=8, rows=4)
    cleaned, vocab, vecs = pipeline.word_sets(rec)
    buckets = minhash.bands(minhash.signatures(vecs, config), config)
    rec.select("rid", "title", "features").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("rid long, title string, features map<string,string>").parquet(str(tmp_path / "in"))
    query = match_stream(stream, vocab, buckets, config)(lambda m, _: seen.extend(tuple(r) for r in m.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {p for r in minhash.candidates(buckets).collect() for p in ((r.rid_i, r.rid_j), (r.rid_j, r.rid_i))}
    assert set(seen) == want and len(seen) == len(want)


@pytest.mark.parametrize("name", ["lsh_candidates", "brand_block", "pair_distance", "key_similarity", "bootstrap_sample", "metrics_by_rows", "cluster_pair_counts", "flatten_records", "find_duplicates"])
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in ("part", "customer", "documents"):
        con.sql(f"create view {t} as from '{SMALL}/{t}.parquet'")
    df = reference.QUERIES[name](spark, SMALL)
    sql = con.sql(reference.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, sql.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_registered_search_has_all_hashes(spark):
    """Signatures and candidates of the registered queries against brute force with the operator's own settings."""
    c = DedupConfig()
    vecs = {r.rid: r.word_ids for r in reference._vectors(spark, SMALL).collect()}
    want = {rid: [max(w, key=lambda x, a=a, b=b: (a + b * x) % c.prime) for a, b in c.coefficients()] if w else [c.empty_value] * c.n for rid, w in vecs.items()}
    got = {r.rid: [int(x) for x in r.sig.split("-")] for r in reference.QUERIES["minhash_signatures"](spark, SMALL).collect()}
    assert got == want and {len(s) for s in got.values()} == {1050}
    cut = {rid: {(k, tuple(s[k : k + c.rows])) for k in range(0, c.n, c.rows)} for rid, s in want.items()}
    near = {(i, j) for i in cut for j in cut if i < j and cut[i] & cut[j]}
    assert {tuple(r) for r in reference.QUERIES["lsh_candidates"](spark, SMALL).collect()} == near


def test_buckets_are_not_broadcast(spark):
    """Buckets are many times larger than the records whose size the optimizer knows."""
    sigs = spark.createDataFrame([(i, [i % 3, i % 5]) for i in range(40)], "rid long, sig array<long>")
    block = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "rid long, block string")
    for b in (None, block):
        pairs = minhash.candidates(minhash.bands(sigs, DedupConfig(n=2, rows=1)), b)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in pairs.collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if (i % 3 == j % 3 or i % 5 == j % 5) and (b is None or i % 2 == j % 2)}


def test_members_of_classes_come_in_pieces(spark, monkeypatch):
    """Pairs of records come from rows that name a few records of a class, of large classes and small."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rep = {i: (0, 1, 1, 3)[i % 4] if i > 3 else (0, 1, 1, 3)[i] for i in range(23)}
    classes = spark.createDataFrame([(i, r, [1]) for i, r in rep.items()], "rid long, rep long, word_ids array<long>")
    got = [tuple(r) for r in minhash.class_members(classes, spark.createDataFrame([(0, 1)], "rep_i long, rep_j long"), DedupConfig()).collect()]
    want = {(i, j) for i in rep for j in rep if i < j and (rep[i] == rep[j] or {rep[i], rep[j]} == {0, 1})}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("drop_empty", [False, True])
def test_candidates_are_counted_by_class(spark, drop_empty):
    config = DedupConfig(n=8, rows=2, drop_empty=drop_empty)
    vecs = spark.createDataFrame([(i, [i % 3, 7] if i % 4 else []) for i in range(30)], "rid long, word_ids array<long>")
    rec = spark.createDataFrame([(i, None if i % 7 == 0 else str(i % 5), "", {}, {}) for i in range(30)], REC)
    assert pipeline.found(vecs, rec, config).collect() == evaluate.found(pipeline.candidate_pairs(vecs, config), rec).collect()


def test_greedy_match_is_worked_out_once(spark):
    """The chosen match is bound to a variable, not repeated for every gram that it is held against."""
    rows = spark.createDataFrame([(1, {"aaaa": "x y", "b": "1", "aaaab": "2"}), (2, {"aaaa": "x z", "c": "3"})], "rid long, features map<string,string>")
    rec = rows.selectExpr("rid", "string(rid) entity_id", "'t' title", "map() attrs", "features").withColumn("attrs", F.create_map().cast("map<string,string>"))
    got = score.key_matches(score.paired(spark.createDataFrame([(1, 2)], "rid_i long, rid_j long"), rec), 0.75)
    r = got.select("matches", F.col("rest_i")["key"].alias("i"), F.col("rest_j")["key"].alias("j")).first()
    assert [(m.q_key, m.r_key) for m in r.matches] == [("title", "title"), ("aaaa", "aaaa")] and (r.i, r.j) == (["b", "aaaab"], ["c"])
    plan = got.select("matches")._jdf.queryExecution().analyzed().toString()
    assert plan.count("kg") <= 12


def by_content(seed):
    """Records with contents, scores of ordered contents (some not symmetric, some equal) and the scores of all pairs of records."""
    rng = random.Random(seed)
    cid = {}
    for i in range(18):
        cid[i] = rng.choice([*set(cid.values()), i]) if i else 0
    scores = {}
    for c, d in itertools.product(set(cid.values()), repeat=2):
        if c == d:
            scores[c, d] = rng.choice([0.0, 0.0, 0.0, 0.2, 0.7, None])
        elif rng.random() < 0.7:
            scores[c, d] = rng.choice([0.0, 0.1, 0.2, 0.3, 0.4, 0.6])
            scores[d, c] = scores[c, d] if rng.random() < 0.6 else rng.choice([0.1, 0.45, 0.6, None])
    ordered = {(cid[i], cid[j]) for i, j in itertools.combinations(range(18), 2)}
    pairs = {(i, j): scores[cid[i], cid[j]] for i, j in itertools.combinations(range(18), 2) if (cid[i], cid[j]) in scores}
    return cid, {k: v for k, v in scores.items() if k in ordered}, pairs


@pytest.mark.parametrize("seed", range(4))
def test_clusters_and_components_by_content(spark, seed):
    cid, scores, pairs = by_content(seed)
    of = spark.createDataFrame([(i, c, c) for i, c in cid.items()], "rid long, rep long, cid long")
    df = spark.createDataFrame([(c, d, x) for (c, d), x in scores.items()], "cid_i long, cid_j long, dist double")
    assert {(r.rid_i, r.rid_j): r.dist for r in minhash.record_pairs(df, of, "cid").collect()} == pairs
    near = {k: v for k, v in pairs.items() if v is not None}
    assert {r.rid: r.cluster_id for r in cluster.linkage_of_contents(df, of, 0.5).collect()} == greedy(18, near, 0.5)
    label = {}
    for _ in range(18):
        for (i, j), x in near.items():
            if x < 0.5:
                label[i] = label[j] = min(label.get(i, i), label.get(j, j))
    got = cluster.components(cluster.both_ways(cluster.content_edges(df, of, 0.5)))
    assert {r.u: r.label for r in got.collect()} == label


def test_repeated_records_are_scored_once(spark):
    """Ten copies of the parts: as many scores as of ordered contents, as many pairs as of records."""
    rec = R.from_parts(spark.read.parquet(f"{SMALL}/part.parquet").filter("p_partkey < 60"))
    many = rec.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("rid", F.col("rid") + 1000 * F.col("copy")).drop("copy")
    config = DedupConfig(n=16, rows=4)
    sizes = []
    for r in (rec, many):
        cleaned, _, vecs = pipeline.word_sets(r)
        by = pipeline.candidate_contents(vecs, cleaned, config)
        sizes.append((by.of.select("cid").distinct().count(), by.pairs.count(), by.named(by.pairs).count(), pipeline.candidate_pairs(vecs, config).count()))
    (n, p, q, c), (n10, p10, q10, c10) = sizes
    assert n == n10 and p10 == n + 2 * p and (q, q10) == (c, c10) and q10 == 100 * q + n * 45


@pytest.mark.parametrize("drop_empty", [False, True])
def test_grid_of_rows_is_counted_in_blocks(spark, monkeypatch, drop_empty):
    """Counts by bits of blocks against joins of buckets, with several blocks and no pair as a row."""
    monkeypatch.setattr(evaluate, "BLOCK", 5)
    monkeypatch.setattr(minhash, "candidates", lambda *a: pytest.fail("pairs become rows"))
    rng = random.Random(2)
    words = {i: sorted(rng.sample(range(12), rng.randint(0, 3))) for i in range(40)}
    label = {i: rng.choice(["x", "y", "z", None]) for i in words}
    vecs = spark.createDataFrame(list(words.items()), "rid long, word_ids array<long>")
    rec = spark.createDataFrame([(i, e, "", {}, {}) for i, e in label.items()], REC)
    config = DedupConfig(n=24, drop_empty=drop_empty)
    got = {r.r: (r.comparisons, r.dups_found) for r in pipeline.metrics_by_rows(vecs, rec, config, (1, 3, 10)).collect()}
    sig = {i: [max(w, key=lambda x, a=a, b=b: (a + b * x) % config.prime) if w else 10000 for a, b in config.coefficients()] for i, w in words.items() if w or not drop_empty}
    for r in (1, 3, 10):
        one = replace(config, rows=r)
        cut = {i: {(k, tuple(v[k : k + one.band_rows])) for k in range(0, one.bands * one.band_rows, one.band_rows)} for i, v in sig.items()}
        near = [(i, j) for i, j in itertools.combinations(sorted(sig), 2) if cut[i] & cut[j]]
        assert got[r] == (len(near), sum(label[i] == label[j] is not None for i, j in near))
