"""Text and near-copy operators against brute force, exact round trips and hand-made cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from weftline.llm import canonical, encode, language, lookalike, mixing, nearcopies, products

SMALL = "/root/testdata/sf0.001"
REC = "rid long, title string, features map<string,string>"


# canonical names


def test_distance_is_a_metric():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    for a, b, c in itertools.product(words[:14], repeat=3):
        assert canonical.distance(a, c) <= canonical.distance(a, b) + canonical.distance(b, c)
    assert canonical.distance("ca", "abc") == 2 and canonical.distance("ab", "ba") == 1 and canonical.distance("", "ab") == 2


def test_tree_finds_all_within():
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(200)})
    tree = canonical.BKTree((w, i) for i, w in enumerate(words))
    queries = words[:60] + ["", "zzzz", "a" * 12, "ba9c"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    for most in (0, 1, 2):
        want = [sorted((d, w, i) for i, w in enumerate(words) if (d := canonical.distance(q, w)) <= most) for q in queries]
        assert tree.search(queries, most) == want and [tree.within(q, most) for q in queries] == want
    assert canonical.BKTree([]).within("abc", 2) == []


def test_names_in_any_place(spark):
    """A name at a title's end, after unknown words and in the middle; sounds alike aren't the same name."""
    titles = ["40 inch LED TV by Karvolin", "Refurbished Karvolin 40", "Used Karvolin TV", "Superb display, Halden Vire, 40 inch", "TV replaces Karvolin", "Zzyzx TV fits Karvolin and more", "old stock tv karvolim", "Wega 40", "Vega 40"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "rid long, title string")
    brands = spark.createDataFrame([*BRANDS, (7, "Wega"), (8, "Vega")], "brand_id int, brand string")
    got = {r.rid: (r.entry, r.distance) for r in canonical.map_titles(df, brands).collect()}
    assert [got[i][0] for i in range(len(titles))] == [1, 1, 1, 2, 0, 0, 1, 7, 8] and got[7][1] == got[8][1] == 0
    both = spark.createDataFrame([(1, "nothing here"), (1, "Vegs 40"), (1, "Karvolin 40")], "rid long, title string")
    assert [tuple(r)[:3] for r in canonical.nearest(canonical.map_titles(both, brands)).collect()] == [(1, 1, 0)]


BRANDS = [(1, "Karvolin"), (2, "Halden Vire"), (3, "Ixel"), (4, "Éluvique"), (5, None), (6, "--")]


@pytest.mark.parametrize("shard", [2, 50_000])
def test_map_titles(spark, monkeypatch, shard):
    monkeypatch.setattr(canonical, "SHARD", shard)
    titles = ["Karvolin 40 inch", "KAR VOLIN TV", "Karvlon tv", "Karvol. tv", "Haldenvire x", "Halden-Vire", "ixl tv", "eluwique", "40 inch TV fits Karvolin", "New Karvolin-Electronics", "Pixel Boost TV", None, "", "x" * 50_000] + ["40 inch TV Pixel Boost"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "rid long, title string")
    got = {r.rid: r.entry for r in canonical.map_titles(df, spark.createDataFrame(BRANDS, "brand_id int, brand string")).collect()}
    assert [got[i] for i in range(len(titles))] == [1, 1, 1, 1, 2, 2, 3, 4, 0, 1, 0, 0, 0, 0] + [0] * 20
    empty = spark.createDataFrame([], "brand_id int, brand string")
    assert {r.entry for r in canonical.map_titles(df, empty).collect()} == {0}


# look-alikes


def test_one_form(spark):
    rows = [
        (1, "Ｆｕｌｌ 40", None),
        (2, "Café ﬁne", {"Brand": "Тelevision"}),
        (3, "Новинка Café TV™ 5®", {"x": "τηλεόραση"}),
        (4, "a b​c 65‑in", {"Wi­dth": "1"}),
        (5, None, None),
        (6, "", {}),
        (7, "Café", {"k": None}),
    ]
    forms = lookalike.to_one_form(spark.createDataFrame(rows + rows, REC))
    assert {(r.rid, r.field) for r in lookalike.odd_texts(forms).collect()} == {(1, "title"), (2, "title"), (2, "features"), (4, "title"), (4, "features"), (7, "title")}
    by = {r.rid: r for r in forms.collect()}
    assert (by[1].title, by[2].title, by[4].title, by[7].title, by[5].title) == ("Full 40", "Café fine", "a bc 65-in", "Café", None)
    assert by[2].features[0].value == "Television" and by[3].title == rows[2][1]
    assert lookalike.to_one_form(spark.createDataFrame([], REC)).count() == 0


# near copies


def jaccard_pairs(sets, s):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("size", [(1, 9), (8, 33), (28, 90)])
def test_near_copies_lose_no_pair(spark, size):
    rng = random.Random(size[1])
    sets, rows = {}, []
    for i in range(0, 120, 4):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(*size))]
        for k in range(4):
            words = [w for w in base if rng.random() > 0.08 * k] + [f"n{rng.randint(0, 99)}" for _ in range(k)]
            sets[i + k] = set(words)
            rows.append((i + k, " ".join(words), None))
    rows += [(500, None, None), (501, "", {}), (502, "--", None), rows[0]]
    classes, pairs = nearcopies.near_copies(spark.createDataFrame(rows, REC), 0.75)
    assert {tuple(r) for r in nearcopies.rid_pairs(classes, pairs).collect()} == jaccard_pairs(sets, 0.75)
    links = {r.rid: r.links for r in nearcopies.groups(classes, pairs).collect()}
    assert links == {r: sum(r in p for p in jaccard_pairs(sets, 0.75)) for r in sets if sets[r]}


def test_near_copies_with_words_replaced(spark):
    """Pairs whose words differ one for one, up to the threshold, in every chunk."""
    assert all(nearcopies.most_apart(s, high - 1, high - 1) // m <= 1 for s in (0.5, 0.75, 0.9, 1.0) for _, high, m in nearcopies.bands(s))
    rng = random.Random(11)
    sets = {}
    for i in range(0, 160, 2):
        n = rng.randint(42, 100) if i % 4 else rng.randint(100, 200)
        base = rng.sample(range(10_000), n)
        sets[i] = {f"w{x}" for x in base}
        sets[i + 1] = {f"w{x}" for x in base[n // 7 :]} | {f"n{i}x{k}" for k in range(n // 7)}
    rows = [(i, " ".join(sorted(words)), None) for i, words in sets.items()]
    classes, pairs = nearcopies.near_copies(spark.createDataFrame(rows, REC), 0.75)
    want = jaccard_pairs(sets, 0.75)
    assert len(want) == 80 and {tuple(r) for r in nearcopies.rid_pairs(classes, pairs).collect()} == want


def test_near_copies_of_long_records(spark):
    """Keys grow with the words, so that records of thousands of them are found like others."""
    long = [f"w{i}" for i in range(6000)]
    rows = [(1, " ".join(long), None), (2, " ".join(long[:5200] + [f"x{i}" for i in range(800)]), None), (3, " ".join(long[:4400]), None), (4, None, {"a": " ".join(long[:4600])}), (5, "w1 w2 w3", None)]
    classes, pairs = nearcopies.near_copies(spark.createDataFrame(rows, REC), 0.75)
    sets = {r: set((t or f["a"]).split()) for r, t, f in rows}
    want = jaccard_pairs(sets, 0.75)
    assert {(1, 2), (1, 4), (3, 4)} <= want and {tuple(r) for r in nearcopies.rid_pairs(classes, pairs).collect()} == want


def test_near_copies_of_nothing(spark):
    classes, pairs = nearcopies.near_copies(spark.createDataFrame([], REC))
    assert nearcopies.rid_pairs(classes, pairs).count() == 0


# products


def test_trade_numbers():
    assert products.valid_trade_number("4006381333931") == "04006381333931"
    assert products.valid_trade_number("4006381333932") is None and products.valid_trade_number(None) is None and products.valid_trade_number("0" * 13) is None


def test_same_products(spark):
    rows = [
        (1, "Karvolin ZF48-K6M2V-EU2 48 inch TV", {"EAN": "4006381333931"}),
        (2, "karvlin 48\" TV best price", {"GTIN": "4006381333931"}),
        (3, "Karvolin K6M2V 1219 mm", None),
        (4, "Karvolin ZF48K6M2VA", None),
        (5, "Karvolin ZF50 K6M2V", None),
        (6, "Karvolin TV 48 inches", {"Contrast": "5000:1", "Brightness": "300 nits"}),
        (7, "Karvolin 48in", {"Contrast Ratio": "5,000 to 1", "Luminance": "300 cd/m2"}),
        (8, None, None),
        (9, None, None),
        (1, "Karvolin ZF48-K6M2V-EU2 48 inch TV", {"EAN": "4006381333931"}),
    ]
    brands = spark.createDataFrame(BRANDS, "brand_id int, brand string")
    others = [(1000 + i, f"Orvo TV {20 + i % 60} inch", {"Contrast": f"{1000 + 7 * i}:1", "Brightness": f"{300 + i} nits"}) for i in range(2000)]  # show how seldom figures agree
    got = {r.rid: r.product for r in products.same_products(spark.createDataFrame(rows + others, REC), brands).filter("rid < 1000").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    alone = {r.rid: r.product for r in products.same_products(spark.createDataFrame(rows, REC), brands).collect()}
    assert alone == got | {7: 7}  # figures of which nothing tells how seldom they agree are no key


def test_model_numbers():
    assert products.models("Karvolin ZF48-K6M2V-EU2") == [("ZF48K6M2V", 48, "K6M2V")] and products.models("JW 46 WWH7XA tv") == [("JW46WWH7XA", 46, "WWH7XA")]
    assert products.models("Samson UN55NU8000FXZA LED") == [("UN55NU8000FXZA", 55, "NU8000FXZA")] and products.models("OLED55C8PUA") == [("OLED55C8PUA", 55, "C8PUA")]
    assert products.models("QX100-K6M2V") == [("QX100K6M2V", 100, "K6M2V")]
    assert products.models("TV 50 inches HDTV 40in 120HZ") == []


def test_only_conflicting_links_are_cut(spark):
    """A bridge between two products, and one mistyped model number, leave the other links in place."""
    ean = {"EAN": "4006381333931"}
    fig = {"Contrast": "5000:1", "Brightness": "300 nits"}
    long = "48 inch television for rooms large or small " + " ".join(f"{a}o{b}e" for a in "bdfg" for b in "klmnp")
    rows = [
        (1, "Karvolin ZF48-K6M2V 48 inch TV silver edition", ean),
        (2, "karvolin 48 inch screen, stock item", {**ean, **fig}),
        (3, f"Karvolin {long}", fig),
        (4, f"Karvolin {long} new", None),
        (5, f"Karvolin ZF48-T7R3X {long}", None),
        (6, "Karvolin ZF50K6M2VA alpha", {"EAN": "96385074"}),
        (7, "Karvolin ZF50K6M2VA beta gamma", {"EAN": "96385074"}),
        (8, "Karvolin ZF50K6M2VK delta words", {"EAN": "96385074"}),
        (9, "no model, other words here", {"EAN": "96385074"}),
    ]
    got = {r.rid: r.product for r in products.same_products(spark.createDataFrame(rows, REC), spark.createDataFrame(BRANDS, "brand_id int, brand string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8, 9: 6}


# encoding

TEXTS = [None, "", " ", "a", "<|endoftext|> a", "é ü  \n\n x", "word " * 500, "x" * 5000, "日本語のテキスト " * 40, "🙂🙂 don't 12 345", "\r\n \t\r\nA  B", "naïve " * 3 + "\n"]


def test_encoding_round_trip_and_agreement(spark):
    import tokenizers

    rng = random.Random(2)
    mixed = ["".join(rng.choice(["word ", "  ", "\n", "é", "12", "'s ", ".", " Zeit", " ", "x"]) for _ in range(60)) for _ in range(150)]
    texts = TEXTS + mixed + mixed[:5]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df).collect()}
    t = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/{encode.TOKENIZER}.json")
    t.encode_special_tokens = True
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == want
        assert t.decode(got[i], skip_special_tokens=False) == (text or "")
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encode_texts(df.limit(0)).count() == 0


def test_chunks_in_any_cut(spark):
    enc = encode.encoder()
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    import pyarrow as pa

    raw, offsets = encode._texts(pa.array(docs, pa.string()))
    for every in (1, 2, 7, 64):
        ids, n = encode.encode_buffer(raw, offsets, encode.Chunks(enc), every)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [enc(d or "") for d in docs]


# mixing


def test_mixing_meets_targets(spark):
    rows = [(i, "a" if i % 3 else "b", "word " * (5 + i % 40)) for i in range(3000)] + [(9000 + i, None, "some words here") for i in range(5)] + [(9100, "a", None), (9101, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix(docs, targets)
    out = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert abs(out["a"].actual_share - 0.3) < 0.002 and abs(out["b"].actual_share - 0.7) < 0.002 and out["gone"].tokens == 0
    assert out["a"].most_copies <= 1 and out["b"].most_copies <= 3 and mix.count() == len(rows)
    assert mixing.expand(mix).count() == mix.groupBy().sum("copies").first()[0]
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_mixing_takes_unlabelled_by_posterior(spark):
    """A third of the labels is missing; these tokens count by their posterior."""
    text = {"a": "alpha beta gamma ", "b": "zwei drei vier "}
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], text["ab"[i % 2]] * (3 + i % 20)) for i in range(1800)]
    rows += [(5000 + i, "other", text["a"] * 5) for i in range(50)] + [(6000, None, None), (6001, " ", ""), (6002, " ", text["b"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix(docs, targets, unlabelled=True)
    got = mix.collect()
    assert len(got) == len(rows) and all(r.copies <= (1 if r.likely == "a" else 2) for r in got)
    assert {r.copies for r in got if r.source == "other"} == {0} and sum(r.copies for r in got if r.source is None) > 0
    out = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert abs(out["a"].actual_share - 0.3) < 0.01 and abs(out["b"].actual_share - 0.7) < 0.01
    assert out["a"].labelled_share < 0.3 and out["b"].soft_tokens > 0
    assert sum(r.n_tokens * r.copies for r in got) > sum(r.n_tokens * r.copies for r in mixing.mix(docs, targets).collect())


def test_registered_mixture_uses_posteriors(spark):
    from weftline.llm.queries import QUERIES

    got = QUERIES["p9_mixture"](spark, SMALL).filter("membership is not null").collect()
    assert got and all(r.rate > 0 for r in got if r.n_tokens)


def test_projected_gradient_with_soft_groups():
    tokens = np.array([[100.0, 0.0], [0.0, 50.0], [30.0, 10.0]])
    rate = mixing.projected_gradient(tokens, np.array([1.0, 2.0, 1.0]), np.array([90.0, 80.0]))
    assert np.allclose(rate @ tokens, [90, 80], atol=1e-3) and (rate >= 0).all() and (rate <= [1, 2, 1]).all()


# languages


def test_blocks():
    cut = lambda t: [t.encode()[a:b].decode() for a, b in language.blocks(t.encode())]
    assert cut("a\n\nb") == cut("a\r\n\r\nb") == cut("a\n \t\u00a0\n\nb") == ["a", "b"]
    assert cut("a\r\nb\r\n\r\nc") == ["a\r\nb", "c"]
    assert [x.strip() for x in cut("\n\n\na\n \u00a0\nb\n\n")] == ["a", "b"]
    assert cut("") == cut(" \n \n") == []


def test_languages_held_out(spark):
    docs, langs = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/languages.parquet")
    model = language.fit(docs, langs)
    held = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where lang in ('en','de','fr','es','it','nl') and length(text) > 400").fetchall()
    right = 0
    for _, text, lang in held:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        right += model.languages[int(model.losses(data, np.array([0]), np.array([len(data)]))[0].argmin())] == lang
    assert right / len(held) > 0.84  # more than a tenth of the labels are wrong


def test_foreign_block_and_labels(spark):
    docs, langs = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/languages.parquet")
    model = language.fit(docs, langs)
    en = "The court below dismissed the action because the expert had not inspected the site of the dispute."
    de = "Das Amtsgericht hat die Klage abgewiesen, weil der Gutachter das Grundstück nicht besichtigt hatte."
    rows = [(1, f"{en}\r\n\r\n{de}\r\n\r\n{en}", "en-GB"), (2, de, None), (3, de, "German"), (4, None, "en"), (5, "", None), (6, " \n\n ", "??"), (7, f"{de}\n\n{en}\n\n{de}", "en")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")
    got = {tuple(r) for r in language.wrong_labels(language.segments(df, model), langs).collect()}
    assert got == {(1, 2, "de"), (2, 0, "de"), (7, 0, "de"), (7, 2, "en")}
    long = spark.createDataFrame([(1, (en + " ") * 20_000, "en")], "doc_id long, text string, lang string")
    assert language.wrong_labels(language.segments(long, model), langs).count() == 0


def test_code_length():
    for n in (2, 6, 40):
        code = language.codewords(n)
        assert min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) >= 3
    assert re.fullmatch(r"\w+", encode.TOKENIZER)
