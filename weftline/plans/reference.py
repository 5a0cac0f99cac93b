"""Registered queries of the duplicate search, on records made of the parts table, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.config import DedupConfig
from weftline.functions import similarity as sim, strings as S
from weftline.operators import blocking, cluster, evaluate, minhash, tokens, vectors
from weftline.plans import pipeline
from weftline.session import durable, table
from weftline.sources.records import flatten_catalogue, from_parts, gather, ordinals, sample_rows

#: The operator's own settings, with all hashes; the SQL follows them.
CONFIG = DedupConfig()
#: Rows per band and bootstrap repeats of the metrics.
GRID, REPEATS = tuple(range(1, 11)), 5
#: Features of the parts records that give words to the vocabulary.
WHOLE, FIRST = ("Size", "Weight"), ("Type",)
#: Records of a group where each task returns no pairs: most brands are one group.
WHOLE_BLOCK = 65_536


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_parts(table(spark, sf_dir, "part"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.clean(_records(spark, sf_dir))


def _vocab(cleaned: DataFrame) -> DataFrame:
    return tokens.vocabulary(tokens.title_words(cleaned).unionByName(tokens.feature_words(cleaned, WHOLE, FIRST)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _clean(spark, sf_dir)
    return vectors.binary_vectors(cleaned, _vocab(cleaned))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.signatures(_vectors(spark, sf_dir), CONFIG)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.candidate_pairs(_vectors(spark, sf_dir), CONFIG)


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct brands of the parts, in order of their text."""
    names = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("brand")).filter("brand is not null").distinct()
    return ordinals(names, "brand", name="brand_pos").select("brand_pos", "brand")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.extract_brand(_clean(spark, sf_dir), _lexicon(spark, sf_dir))


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = _brands(spark, sf_dir).select("rid", F.col("brand").alias("block"))
    return pipeline.candidate_pairs(_vectors(spark, sf_dir), CONFIG, block)


def _contents(spark: SparkSession, sf_dir: str) -> pipeline.Contents:
    block = _brands(spark, sf_dir).select("rid", F.col("brand").alias("block"))
    return pipeline.candidate_contents(_vectors(spark, sf_dir), _clean(spark, sf_dir), CONFIG, block)


def _six(c, name: str):
    return F.round(c, 6).alias(name)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, records = _contents(spark, sf_dir), _records(spark, sf_dir)
    linked = by.clusters(CONFIG, rounded=True)
    return durable(records.select("rid").join(linked.hint("merge"), "rid", "left").select("rid", F.coalesce("cluster_id", F.col("rid").cast("long")).alias("cluster_id")))


def clean_features(spark, sf_dir):
    return tokens.feature_rows(_clean(spark, sf_dir)).select("rid", "key", "value")


def kv_compact(spark, sf_dir):
    return tokens.key_values(_clean(spark, sf_dir)).select("rid", F.posexplode("kv").alias("pos", "x")).select("rid", "pos", "x.key", "x.value")


def attr_model_words(spark, sf_dir):
    kv = tokens.key_values(_clean(spark, sf_dir))
    return kv.select("rid", F.explode(S.mixed_tokens(F.transform("kv", lambda e: e["value"]))).alias("word")).groupBy("rid", "word").agg(F.count("*").alias("n"))


def qgrams(spark, sf_dir):
    """How often each gram of three characters occurs over all documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and text <> ''")
    return docs.select(F.explode(S.qgrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def digit_split(spark, sf_dir):
    words = _vocab(_clean(spark, sf_dir))
    return words.select("word", S.without_digits(F.col("word")).alias("letters"), S.only_digits(F.col("word")).alias("digits"))


def title_vectors(spark, sf_dir):
    cleaned = _clean(spark, sf_dir)
    return vectors.title_vectors(cleaned, _vocab(cleaned))


def feature_vectors(spark, sf_dir):
    cleaned = _clean(spark, sf_dir)
    return vectors.feature_vectors(cleaned, _vocab(cleaned))


def lsh_params(spark, sf_dir):
    rows = [(n, r, n // r, n // (n // r), (1 / (n // r)) ** (1 / r)) for n in (1050,) for r in range(1, 11)]
    out = spark.createDataFrame(rows, "n int, rows int, bands int, band_rows int, t double")
    return out.select("n", "rows", "bands", "band_rows", (F.col("n") - F.col("bands") * F.col("band_rows")).alias("unused"), _six(F.col("t"), "threshold"))


def bootstrap_sample(spark, sf_dir):
    products = _records(spark, sf_dir)
    n = products.count()
    numbered = products.withColumn("prod_idx", F.col("rid"))  # parts are numbered from 0
    return gather(numbered, sample_rows(n, 1, spark)).select("rid", "prod_idx", "entity_id", "title")


def qgram_similarity(spark, sf_dir):
    """Similarity of the distinct part names that share a first word or a last word."""
    names = table(spark, sf_dir, "part").select("p_name").filter("p_name is not null").distinct()
    ends = names.select("p_name", F.explode(F.array_distinct(F.array(F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)))).alias("w"))
    pairs = ends.select(F.col("p_name").alias("a"), "w").join(ends.select(F.col("p_name").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", _six(sim.text_similarity(F.col("a"), F.col("b")), "similarity"))


def normalized_levenshtein(spark, sf_dir):
    """Between each customer's name and that of the next customer of the nation."""
    c = table(spark, sf_dir, "customer")
    after = F.lead("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = c.select("c_custkey", "c_name", after.alias("other")).filter("other is not null")
    return rows.select("c_custkey", _six(sim.edit_share(F.col("c_name"), F.col("other")), "distance"))


def key_similarity(spark, sf_dir):
    keys = tokens.key_values(_clean(spark, sf_dir)).select(F.explode(F.transform("kv", lambda e: e["key"])).alias("key")).distinct()
    grams = keys.select("key", F.explode(S.qgrams(F.lower("key"))).alias("g"))
    pairs = grams.join(grams.select(F.col("key").alias("other"), "g"), "g").select("key", "other").distinct()
    return pairs.select("key", "other", _six(sim.text_similarity(F.col("key"), F.col("other")), "similarity"))


def _scored(name: str):
    """Pairs of candidates of one brand with their score of that name."""
    return lambda spark, sf_dir: _contents(spark, sf_dir).grids().pairs(name, CONFIG)


def pair_distance(spark, sf_dir):
    return _contents(spark, sf_dir).distances(CONFIG, rounded=True)


def components(spark, sf_dir):
    """Components of the pairs nearer than epsilon, isolated records left out."""
    near = durable(_contents(spark, sf_dir).grids(group=WHOLE_BLOCK).near(CONFIG))
    return cluster.components(cluster.both_ways(near)).select(F.col("u").alias("rid"), "label")


def cluster_members(spark, sf_dir):
    return cluster.members(_clusters(spark, sf_dir), _records(spark, sf_dir)).select("cluster_id", F.size("entity_ids").alias("n"), F.array_join("entity_ids", ",").alias("entity_ids"))


def cluster_pair_counts(spark, sf_dir):
    return _rounded(evaluate.cluster_pairs(_clusters(spark, sf_dir), _records(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def metrics_by_rows(spark, sf_dir):
    return _rounded(pipeline.metrics_by_rows(_vectors(spark, sf_dir), _records(spark, sf_dir), CONFIG, GRID))


def bootstrap_metrics(spark, sf_dir):
    """The whole grid: means over the bootstrap samples for every number of rows per band; without SQL."""
    return _rounded(pipeline.bootstrap_metrics(_records(spark, sf_dir), _vectors(spark, sf_dir), CONFIG, GRID, REPEATS))


def flatten_records(spark, sf_dir):
    """Nested catalogues, one file a part, flattened to records."""
    parts = table(spark, sf_dir, "part").select(F.format_string("%012d", "p_partkey").alias("file"), "p_brand", "p_name", F.col("p_size").cast("string").alias("size"), "p_type")
    product = F.struct(F.col("p_name").alias("title"), F.col("size"), F.create_map(F.lit("Type"), F.col("p_type"), F.lit("Size"), F.col("size")).alias("featuresMap"))
    text = parts.select("file", F.to_json(F.create_map("p_brand", F.array(product, product))).alias("value"))
    flat = flatten_catalogue(text)
    return flat.select("rid", "entity_id", "title", F.col("attrs")["size"].alias("size"), F.col("features")["Type"].alias("type"), F.size("features").alias("n_features"))


def find_duplicates(spark, sf_dir):
    """The whole search in one: metrics of its candidates and of its clusters."""
    res = pipeline.find_duplicates(_records(spark, sf_dir), _lexicon(spark, sf_dir), CONFIG, WHOLE, FIRST)
    return _rounded(res.metrics)


def pair_distance_as_written(spark, sf_dir):
    """Distances under ``score_mode="as_written"``, 0 for every candidate of one brand."""
    return _contents(spark, sf_dir).distances(replace(CONFIG, score_mode="as_written"))


def lsh_bands_undelimited(spark, sf_dir):
    """Bucket names without delimiter, under which different bands of values may fall together."""
    return minhash.bands(_signatures(spark, sf_dir), replace(CONFIG, delimiter=""))


def minhash_empty_records(spark, sf_dir):
    """Signatures where every third record has no word, which all get the empty value."""
    vecs = _vectors(spark, sf_dir).withColumn("word_ids", F.when(F.col("rid") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.col("word_ids")))
    return minhash.signatures(vecs, CONFIG).select("rid", F.array_join("sig", "-").alias("sig"))


QUERIES = {
    "clean_titles": lambda s, d: _clean(s, d).select("rid", "title"),
    "clean_features": clean_features,
    "kv_compact": kv_compact,
    "title_model_words": lambda s, d: tokens.title_words(_clean(s, d)),
    "feature_model_words": lambda s, d: tokens.feature_words(_clean(s, d), WHOLE, FIRST),
    "vocabulary": lambda s, d: _vocab(_clean(s, d)),
    "attr_model_words": attr_model_words,
    "qgrams": qgrams,
    "digit_split": digit_split,
    "title_vectors": title_vectors,
    "feature_vectors": feature_vectors,
    "binary_vectors": lambda s, d: _vectors(s, d).select("rid", F.array_join("word_ids", "-").alias("word_ids")),
    "affine_hash": lambda s, d: minhash.affine_hashes(_vocab(_clean(s, d)), CONFIG),
    "minhash_signatures": lambda s, d: _signatures(s, d).select("rid", F.array_join("sig", "-").alias("sig")),
    "lsh_params": lsh_params,
    "lsh_bands": lambda s, d: minhash.bands(_signatures(s, d), CONFIG),
    "lsh_candidates": _candidates,
    "dups_found": lambda s, d: pipeline.found(_vectors(s, d), _records(s, d), CONFIG),
    "dups_to_find": lambda s, d: evaluate.to_find(_records(s, d)),
    "pair_quality": lambda s, d: _rounded(evaluate.quality(pipeline.found(_vectors(s, d), _records(s, d), CONFIG), _records(s, d))),
    "bootstrap_sample": bootstrap_sample,
    "brand_extract": _brands,
    "brand_block": _blocked,
    "qgram_similarity": qgram_similarity,
    "normalized_levenshtein": normalized_levenshtein,
    "mw_overlap": _scored("mw_overlap"),
    "min_features": _scored("min_features"),
    "mw_levenshtein": _scored("mw_levenshtein"),
    "title_cosine": _scored("title_cosine"),
    "title_mw_similarity": _scored("title_mw_similarity"),
    "key_similarity": key_similarity,
    "greedy_key_match": _scored("greedy_key_match"),
    "leftover_model_words": _scored("leftover_model_words"),
    "pair_distance": pair_distance,
    "normal_distances": lambda s, d: _contents(s, d).grids().normal(CONFIG),
    "components": components,
    "complete_linkage": _clusters,
    "cluster_members": cluster_members,
    "cluster_pair_counts": cluster_pair_counts,
    "metrics_by_rows": metrics_by_rows,
    "bootstrap_metrics": bootstrap_metrics,
    "cluster_count": lambda s, d: evaluate.cluster_count(_clusters(s, d)),
    "find_duplicates": find_duplicates,
    "flatten_records": flatten_records,
    "pair_distance_as_written": pair_distance_as_written,
    "lsh_bands_undelimited": lsh_bands_undelimited,
    "minhash_empty_records": minhash_empty_records,
    "top_similar": lambda s, d: pipeline.top_similar(pair_distance(s, d), 3).select("rid", "partner", "dist", "place"),
}


def _fold(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = "replace({}, '{}', '{}')".format(expr, a.replace("'", "''"), b.replace("'", "''"))
    return expr


def _sql(config: DedupConfig) -> dict[str, str]:
    """DuckDB SQL of the queries, put together from named steps."""
    coefficients = ", ".join(f"({i}, {a}::bigint, {b}::bigint)" for i, (a, b) in enumerate(config.coefficients()))
    p, r, nb = config.prime, config.band_rows, config.bands
    grams = lambda c: f"(case when length({c}) < 3 then [{c}] else list_transform(range(1, length({c}) - 1), lambda gi: substring({c}, gi, 3)) end)"
    gsim = lambda a, b: (
        f"((len({a}) + len({b}) - len(list_filter({a}, lambda gx: not list_contains({b}, gx))) - len(list_filter({b}, lambda gy: not list_contains({a}, gy))))::double / (len({a}) + len({b})))"
    )
    nld = lambda a, b: f"(case when {a} = {b} then 0.0 else levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end)"
    steps = {
        "rec": """select p_partkey rid, concat_ws('|', p_brand, p_name, p_type) entity_id, concat_ws(' ', p_brand, p_name, p_type, p_size::varchar, 'inches') title,
            p_type f_type, p_size::varchar || '"' f_size, p_size::varchar || ' lbs' f_weight, printf('%.2f', p_retailprice) f_price from part""",
        "ct": f"select rid, entity_id, {_fold('lower(title)', S.TITLE_UNITS)} title from rec",
        "fr": f"""select rid, pos, key, {_fold('lower(v)', S.FEATURE_UNITS)} as value from (select rid, 0 pos, 'Type' as key, f_type v from rec union all select rid, 1, 'Size', f_size from rec
            union all select rid, 2, 'Weight', f_weight from rec union all select rid, 3, 'Price', f_price from rec)""",
        "kv": """select rid, pos, key, lower(translate(v, ' ,/"', '')) as value from (select rid, 0 pos, 'title' as key, title v from ct union all select rid, pos + 1, key, value from fr)""",
        "tw": f"select distinct rid, unnest(regexp_extract_all(title, '{S.MODEL_WORD}', 1)) word from ct",
        "fw": "select distinct rid, case when key = 'Type' then split_part(value, ' ', 1) else value end word from fr where key in ('Size', 'Weight', 'Type')",
        "voc": "select (row_number() over (order by word) - 1)::bigint word_id, word from (select word from tw union select word from fw) where word <> ''",
        "tv": "select rid, word_id from ct join voc on contains(title, word)",
        "fv": "select distinct rid, word_id from fr join voc on contains(value, word)",
        "hits": "select rid, word_id from tv union select rid, word_id from fv",
        "coef": f"select * from (values {coefficients}) t(hash_no, a, b)",
        "sig1": f"select rid, hash_no, arg_max(word_id, (a + b * word_id) % {p}) w from hits, coef group by rid, hash_no",
        "sig": f"select ct.rid, hash_no, coalesce(w, {config.empty_value}) w from ct cross join coef left join sig1 using (rid, hash_no)",
        "bk": f"select rid, hash_no // {r} band, string_agg(w::varchar, '{config.delimiter}' order by hash_no) bucket from sig where hash_no < {r * nb} group by rid, hash_no // {r}",
        "cand": "select distinct x.rid rid_i, y.rid rid_j from bk x join bk y on x.band = y.band and x.bucket = y.bucket and x.rid < y.rid",
        "lex": "select row_number() over (order by brand) - 1 brand_pos, brand from (select distinct lower(p_brand) brand from part where p_brand is not null)",
        "br": "select ct.rid, coalesce(max_by(brand, brand_pos), '') brand from ct left join lex on contains(title, brand) group by ct.rid",
        "blk": "select rid_i, rid_j from cand join br x on x.rid = rid_i join br y on y.rid = rid_j where x.brand = y.brand",
        "gkv": f"select rid, pos, key, value, {grams('key')} kg, {grams('value')} vg from kv",
        "mw": r"""select rid, list(w order by pos) words from (select rid, pos, unnest(string_split_regex(value, '\s+')) w from kv)
            where w <> '' and not regexp_full_match(w, '\p{L}+') and not regexp_full_match(w, '\p{N}+') group by rid""",
        "pr": """select rid_i, rid_j, a.title title_i, b.title title_j, coalesce(x.words, []) words_i, coalesce(y.words, []) words_j
            from blk join ct a on a.rid = rid_i join ct b on b.rid = rid_j left join mw x on x.rid = rid_i left join mw y on y.rid = rid_j""",
        "km": f"""select rid_i, rid_j, q_pos, r_pos, w, v from (select rid_i, rid_j, q.pos q_pos, s.pos r_pos, {gsim('q.kg', 's.kg')} w, {gsim('q.vg', 's.vg')} v
            from blk join gkv q on q.rid = rid_i join gkv s on s.rid = rid_j) where w > {config.gamma} qualify row_number() over (partition by rid_i, rid_j, r_pos order by q_pos) = 1""",
        "kmi": "select rid_i, rid_j, pos, value from blk join kv on kv.rid = rid_i where not exists (from km where km.rid_i = blk.rid_i and km.rid_j = blk.rid_j and km.q_pos = kv.pos)",
        "kmj": "select rid_i, rid_j, pos, value from blk join kv on kv.rid = rid_j where not exists (from km where km.rid_i = blk.rid_i and km.rid_j = blk.rid_j and km.r_pos = kv.pos)",
        "avgs": "select rid_i, rid_j, count(km.w) m, coalesce(sum(km.w * v) / sum(km.w), 0.0) avg_sim from blk left join km using (rid_i, rid_j) group by rid_i, rid_j",
        "wi": r"select rid_i, rid_j, value w from kmi where value <> '' and not regexp_full_match(value, '\p{L}+') and not regexp_full_match(value, '\p{N}+')",
        "wj": r"select rid_i, rid_j, value w from kmj where value <> '' and not regexp_full_match(value, '\p{L}+') and not regexp_full_match(value, '\p{N}+')",
        "rest": """select blk.rid_i, blk.rid_j, coalesce(li, 0) left_i, coalesce(lj, 0) left_j, case when coalesce(ni, 0) > 0 and coalesce(nj, 0) > 0 then coalesce(eq, 0)::double / ni else 0.0 end overlap from blk
            left join (select rid_i, rid_j, count(*) li from kmi group by all) using (rid_i, rid_j) left join (select rid_i, rid_j, count(*) lj from kmj group by all) using (rid_i, rid_j)
            left join (select rid_i, rid_j, count(*) ni from wi group by all) using (rid_i, rid_j) left join (select rid_i, rid_j, count(*) nj from wj group by all) using (rid_i, rid_j)
            left join (select rid_i, rid_j, count(*) eq from wi join wj using (rid_i, rid_j, w) group by all) using (rid_i, rid_j)""",
        "tok": r"""select distinct title, unnest(list_filter(string_split_regex(title, '\s+'), lambda z: z <> '')) w from ct""",
        "cnt": r"""select title, w, count(*) n from (select title, unnest(list_filter(string_split_regex(title, '\s+'), lambda z: z <> '')) w from (select distinct title from ct)) group by title, w""",
        "nrm": "select title, sum(n * n)::double nn from cnt group by title",
        "cosn": """select pr.rid_i, pr.rid_j, coalesce(dot / sqrt(x.nn * y.nn), 0.0) cosine from pr left join (select t.title_i, t.title_j, sum(a.n * b.n)::double dot
            from (select distinct title_i, title_j from pr) t join cnt a on a.title = t.title_i join cnt b on b.title = t.title_j and a.w = b.w group by all) d using (title_i, title_j)
            left join nrm x on x.title = pr.title_i left join nrm y on y.title = pr.title_j""",
        "wp": r"""select rid_i, rid_j, x, y, regexp_replace(x, '[0-9]', '', 'g') ax, regexp_replace(y, '[0-9]', '', 'g') ay, regexp_replace(x, '[^0-9]', '', 'g') dx, regexp_replace(y, '[^0-9]', '', 'g') dy
            from (select rid_i, rid_j, x, unnest(words_j) y from (select rid_i, rid_j, unnest(words_i) x, words_j from pr))""",
        "mlv": f"""select pr.rid_i, pr.rid_j, coalesce(g / nullif(t, 0), 0.0) similarity, coalesce(close and differ, false) clash from pr left join (select rid_i, rid_j,
            sum(case when {nld('ax', 'ay')} < 0.5 and dx = dy then (1 - {nld('x', 'y')}) * (length(x) + length(y)) end) g, sum(case when {nld('ax', 'ay')} < 0.5 and dx = dy then length(x) + length(y) end) t,
            bool_or({nld('ax', 'ay')} < 0.5) as close, count(distinct dx) > 1 or count(distinct dy) > 1 or bool_or(dx <> dy) differ from wp group by all) using (rid_i, rid_j)""",
        "tms": f"""select rid_i, rid_j, case when cosine > {config.alpha} then 1.0 when clash then -1.0 when similarity > 0 then {config.delta} * similarity + {1 - config.delta} * s else s end similarity
            from (select *, {config.beta} * cosine + {1 - config.beta} * (1 - {nld('title_i', 'title_j')}) s from pr join cosn using (rid_i, rid_j) join mlv using (rid_i, rid_j))""",
        "mf": "select rid_i, rid_j, least(a.n, b.n) n from blk join (select rid, count(*) n from kv group by rid) a on a.rid = rid_i join (select rid, count(*) n from kv group by rid) b on b.rid = rid_j",
        "dist": f"""select rid_i, rid_j, round(1 - case when t = -1 then share * avg_sim + (1 - share) * overlap
            else {1 - config.mu} * share * avg_sim + ({1 - config.mu} - {1 - config.mu} * share) * overlap + {config.mu} * t end, 6) dist
            from (select rid_i, rid_j, m::double / n share, avg_sim, overlap, tms.similarity t from avgs join mf using (rid_i, rid_j) join rest using (rid_i, rid_j) join tms using (rid_i, rid_j))""",
        "pq0": "select count(*) comparisons, count(*) filter (where x.entity_id = y.entity_id) dups_found from cand join rec x on x.rid = rid_i join rec y on y.rid = rid_j",
        "tf": "select sum(c)::bigint records, sum(c * (c - 1) // 2)::bigint dups_to_find from (select count(*) c from rec group by entity_id)",
    }
    order = list(steps)

    def upto(*last: str) -> str:
        """The steps that the named ones need."""
        need: list[str] = []
        todo = list(last)
        import re

        while todo:
            name = todo.pop()
            if name not in need:
                need.append(name)
                todo += [k for k in order if k != name and re.search(rf"\b(?:from|join)\s+{k}\b|,\s*{k}\b(?=\s+group|\s*$)", steps[name])]
        return "with " + ", ".join(f"{k} as ({steps[k]})" for k in order if k in need) + " "

    quality = """comparisons, dups_found, dups_to_find, round(dups_found / nullif(comparisons, 0)::double, 6) pq, round(dups_found / nullif(dups_to_find, 0)::double, 6) pc,
        round(comparisons / nullif(records * (records - 1) // 2, 0)::double, 6) fraction, round(2 * (dups_found / nullif(comparisons, 0)::double) * (dups_found / nullif(dups_to_find, 0)::double)
        / nullif(dups_found / nullif(comparisons, 0)::double + dups_found / nullif(dups_to_find, 0)::double, 0), 6) f1_star"""

    def banded(rows: int) -> str:
        """Metrics with so many rows per band; hashes beyond the last whole band are unused."""
        width = config.n // (config.n // rows)
        bucket = f"(select rid, hash_no // {width} band, string_agg(w::varchar, '-' order by hash_no) bucket from sig where hash_no < {width * (config.n // rows)} group by all)"
        return (
            f"select {rows} r, {quality} from (select count(*) comparisons, count(*) filter (where x.entity_id = y.entity_id) dups_found from (select distinct x.rid rid_i, y.rid rid_j from {bucket} x "
            f"join {bucket} y on x.band = y.band and x.bucket = y.bucket and x.rid < y.rid) join rec x on x.rid = rid_i join rec y on y.rid = rid_j), tf"
        )

    # each round merges every two clusters that are nearest to each other; a pair of clusters counts if all their pairs of records are given
    linkage = f"""near as (select least(rid_i, rid_j) a, greatest(rid_i, rid_j) b, max(dist) d from dist where dist < {config.epsilon} group by all),
        st(it, rid, c) as (select 0, rid, rid from rec union all (with sizes as (select c, count(*) k from st group by c),
            pd as (select least(x.c, y.c) a, greatest(x.c, y.c) b, max(d) d, count(*) n from near join st x on x.rid = near.a join st y on y.rid = near.b where x.c <> y.c group by all),
            full_ as (select a, b, d from pd join sizes s on s.c = a join sizes t on t.c = b where n = s.k * t.k),
            best as (select c, min({{'d': d, 'a': a, 'b': b}}) r from (select a c, * from full_ union all select b, * from full_) group by c),
            mutual as (select r.b c, r.a into_ from best group by r having count(*) = 2)
            select it + 1, rid, coalesce(into_, st.c) from st left join mutual on mutual.c = st.c where exists (from mutual))),
        cl as (select rid, c cluster_id from st where it = (select max(it) from st)) """
    clustered = upto("dist", "rec", "tf").replace("with ", "with recursive ", 1).rstrip() + ", " + linkage
    counted = """, pc as (select sum(c * (c - 1) // 2) filter (where entity_id is not null) tp from (select cluster_id, entity_id, count(*) c from cl join rec using (rid) group by all)),
        ps as (select sum(c * (c - 1) // 2) p from (select count(*) c from cl group by cluster_id)), ct3 as (select tp::bigint tp, (p - tp)::bigint fp, (dups_to_find - tp)::bigint fn from pc, ps, tf)
        """
    cluster_rates = """tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) recall, round(tp / nullif(fp + fn, 0)::double, 6) recall_as_written,
        round(2 * (tp / nullif(tp + fp, 0)::double) * (tp / nullif(tp + fn, 0)::double) / nullif(tp / nullif(tp + fp, 0)::double + tp / nullif(tp + fn, 0)::double, 0), 6) f1"""
    mask = (1 << 32) - 1
    return {
        "clean_titles": upto("ct") + "select rid, title from ct",
        "clean_features": upto("fr") + "select rid, key, value from fr",
        "kv_compact": upto("kv") + "select rid, pos, key, value from kv",
        "title_model_words": upto("tw") + "select rid, word from tw where word <> ''",
        "feature_model_words": upto("fw") + "select rid, word from fw where word <> ''",
        "vocabulary": upto("voc") + "select word_id, word from voc",
        "attr_model_words": upto("mw") + "select rid, word, count(*) n from (select rid, unnest(words) word from mw) group by rid, word",
        "qgrams": """with c as (select string_split(text, '') c from documents where text is not null and text <> '')
            select gram, count(*) n from (select unnest(case when len(c) < 3 then [array_to_string(c, '')] else list_transform(list_zip(c, c[2:], c[3:])[:len(c) - 2], lambda z: z[1] || z[2] || z[3]) end) gram from c) group by gram""",
        "digit_split": upto("voc") + "select word, regexp_replace(word, '[0-9]', '', 'g') letters, regexp_replace(word, '[^0-9]', '', 'g') digits from voc",
        "title_vectors": upto("tv") + "select rid, word_id from tv",
        "feature_vectors": upto("fv") + "select rid, word_id from fv",
        "binary_vectors": upto("hits") + "select ct.rid, coalesce(string_agg(word_id::varchar, '-' order by word_id), '') word_ids from ct left join hits using (rid) group by ct.rid",
        "affine_hash": upto("voc", "coef") + f"select word_id, hash_no, (a + b * word_id) % {p} h from voc, coef",
        "minhash_signatures": upto("sig") + "select rid, string_agg(w::varchar, '-' order by hash_no) sig from sig group by rid",
        "lsh_params": """select 1050 n, r::int as "rows", (1050 // r)::int bands, (1050 // (1050 // r))::int band_rows, (1050 - (1050 // r) * (1050 // (1050 // r)))::int unused,
            round(pow(1.0::double / (1050 // r), 1.0::double / r), 6) threshold from range(1, 11) t(r)""",
        "lsh_bands": upto("bk") + "select rid, band, bucket from bk",
        "lsh_candidates": upto("cand") + "select rid_i, rid_j from cand",
        "dups_found": upto("pq0") + "select comparisons, dups_found from pq0",
        "dups_to_find": upto("tf") + "select records, dups_to_find from tf",
        "pair_quality": upto("pq0", "tf") + f"select {quality} from pq0, tf",
        "bootstrap_sample": upto("rec")
        + f""", n as (select count(*) n from rec), d as (select range rid, (range * 2654435761 + {40503 % mask}) & {mask} h from range((select n from n)))
            , e as (select rid, (xor(h, h >> 16) * 73244475) & {mask} h from d), g as (select rid, ((xor(h, h >> 16) * 73244475) & {mask}) % (select n from n) prod_idx from e)
            select g.rid, prod_idx, entity_id, title from g join rec on rec.rid = prod_idx""",
        "brand_extract": upto("br") + "select rid, brand from br",
        "brand_block": upto("blk") + "select rid_i, rid_j from blk",
        "qgram_similarity": f"""with w as (select distinct p_name, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', -1)]) w from part where p_name is not null),
            pairs as (select distinct x.p_name a, y.p_name b from w x join w y on x.w = y.w and x.p_name < y.p_name), g as (select a, b, {grams('a')} ga, {grams('b')} gb from pairs)
            select a, b, round({gsim('ga', 'gb')}, 6) similarity from g""",
        "normalized_levenshtein": f"""select c_custkey, round({nld('c_name', 'other')}, 6) distance from (select c_custkey, c_name, lead(c_name) over (partition by c_nationkey order by c_custkey) other from customer)
            where other is not null""",
        "mw_overlap": upto("pr")
        + """select rid_i, rid_j, round(case when len(words_i) > 0 and len(words_j) > 0 then list_sum(list_transform(words_i, lambda x: len(list_filter(words_j, lambda y: y = x))))::double / len(words_i) else 0.0 end, 6) overlap from pr""",
        "min_features": upto("mf") + "select rid_i, rid_j, n::int min_features from mf",
        "mw_levenshtein": upto("mlv") + "select rid_i, rid_j, round(similarity, 6) similarity from mlv",
        "title_cosine": upto("cosn") + "select rid_i, rid_j, round(cosine, 6) cosine from cosn",
        "title_mw_similarity": upto("tms") + "select rid_i, rid_j, round(similarity, 6) similarity from tms",
        "key_similarity": upto("gkv")
        + f""", k as (select distinct key, kg from gkv), l as (select distinct key, unnest({grams('lower(key)')}) g from k), pairs as (select distinct x.key, y.key other from l x join l y using (g))
            select pairs.key, other, round({gsim('a.kg', 'b.kg')}, 6) similarity from pairs join k a on a.key = pairs.key join k b on b.key = other""",
        "greedy_key_match": upto("avgs") + "select rid_i, rid_j, m::int m, round(avg_sim, 6) avg_sim from avgs",
        "leftover_model_words": upto("rest") + "select rid_i, rid_j, left_i::int left_i, left_j::int left_j, round(overlap, 6) overlap from rest",
        "pair_distance": upto("dist") + "select rid_i, rid_j, dist from dist",
        "normal_distances": upto("dist") + "select count(*) pairs from dist where dist > 0 and dist < 1",
        "components": upto("dist").replace("with ", "with recursive ", 1)
        + f""", e as (select rid_i u, rid_j v from dist where dist < {config.epsilon} union select rid_j, rid_i from dist where dist < {config.epsilon}),
            reach(u, l) as (select u, u from e union select e.v, reach.l from reach join e using (u)) select u rid, min(l) label from reach group by u""",
        "metrics_by_rows": upto("sig", "tf", "rec") + " union all ".join(f"({banded(k)})" for k in GRID),
        "complete_linkage": clustered + "select rid, cluster_id from cl",
        "cluster_members": clustered + "select cluster_id, count(*)::int n, string_agg(entity_id, ',' order by rid) entity_ids from cl join rec using (rid) group by cluster_id",
        "cluster_pair_counts": clustered + counted + f"select {cluster_rates} from ct3",
        "cluster_count": clustered + "select count(*) clusters, count(*) filter (where n > 1) of_several from (select count(*) n from cl group by cluster_id)",
        "find_duplicates": clustered
        + counted
        + f""", bq as (select count(*) comparisons, count(*) filter (where x.entity_id = y.entity_id) dups_found from blk join rec x on x.rid = rid_i join rec y on y.rid = rid_j)
            select {quality}, {cluster_rates} from bq, tf, ct3""",
        "flatten_records": """select row_number() over (order by p_partkey, i) - 1 rid, p_brand entity_id, p_name title, p_size::varchar size, p_type "type", 2 n_features from part, range(2) t(i)""",
        "pair_distance_as_written": upto("blk") + "select rid_i, rid_j, 0.0::double dist from blk",
        "lsh_bands_undelimited": upto("bk").replace(f"string_agg(w::varchar, '{config.delimiter}'", "string_agg(w::varchar, ''") + "select rid, band, bucket from bk",
        "minhash_empty_records": upto("sig") + f"select rid, string_agg((case when rid % 3 = 0 then {config.empty_value} else w end)::varchar, '-' order by hash_no) sig from sig group by rid",
        "top_similar": upto("dist")
        + """, b as (select rid_i rid, rid_j partner, dist from dist union all select rid_j, rid_i, dist from dist)
            select rid, partner, dist, place from (select *, row_number() over (partition by rid order by dist, partner) place from b) where place <= 3""",
    }


ORACLE = _sql(CONFIG)
