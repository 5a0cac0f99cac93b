"""Listings of different sellers that offer the same product.

Each listing gives keys: its model number (series, size, code and suffix
letter), a trade number with a valid check digit, a code that stands without
series together with the screen size, and combinations of technical figures
with maker and size.  A combination is a key only if its figures tell enough:
the chance that two listings agree on each is counted over all listings, and
together it must be so small that hardly any pair agrees by chance.  Listings
that share a key are linked to the key's smallest listing, so links grow with
the rows, and connected components are the products.  Guards keep components
apart: a key that meets two model numbers, two trade numbers or two makers
links nothing, but for a trade number with a clear majority model, and in a
component with two model numbers each listing without one keeps to its
strongest links.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.quantities import UNITS
from weftline.llm import canonical, lookalike, nearcopies
from weftline.operators.cluster import components
from weftline.operators.units import feature_statements, title_statements
from weftline.session import discard, durable

# Names of the features that hold identifiers and figures.
BRAND_NAMES = ("brand", "brand name", "manufacturer")
MODEL_NAMES = ("model", "model number", "mfr part number", "part number", "mpn")
TRADE_NAMES = ("ean", "gtin", "barcode", "upc")
FIGURES = {
    "contrast": ("contrast", "contrast ratio", "dynamic contrast ratio", "native contrast"),
    "brightness": ("brightness", "luminance", "peak brightness"),
    "year": ("year", "model year", "release year", "introduced"),
    "energy": ("energy class", "energy label", "energy rating"),
    "sound": ("speaker output power", "audio output", "sound output"),
}
#: Kinds of links from the strongest on.
COPY, MODEL_TIER, TRADE, CODED, NEAR, FIGURED = range(6)
#: A model number: series letters, the size in inches, a code and perhaps a suffix letter.  Blanks or hyphens may part a series of
#: two letters from its size and its code of five; in one run, series and code may have other lengths if the code has a digit.
MODEL = re.compile(
    r"(?<![A-Z0-9])(?:([A-Z]{2})[ -]?([1-9]\d|1[01]\d)[ -]?([A-Z0-9]{5}[A-Z]?)|([A-Z]{1,5})(1[01]\d|[2-9]\d)((?=[A-Z]*\d)[A-Z][A-Z0-9]{2,9}))(?![A-Z0-9])"
)
#: The code alone: no vowels but for the suffix, and no number with a unit.
CODE = re.compile(r"(?<![A-Z0-9.,])(?!\d+[A-Z]{1,2}(?![A-Z0-9]))([B-DF-HJ-NP-TV-Z0-9]{5}[A-Z]?)(?![A-Z0-9])")
_UNIT_WORDS = {w.upper() for table in UNITS.values() for u in table for w in u.split() if len(w) >= 5}
#: Most figures in a combination, and bits that it must tell beyond those that number the listings.
MOST_FIGURES, MARGIN = 3, 10.0


def valid_trade_number(text: str | None) -> str | None:
    """The number of 8, 12, 13 or 14 digits as 14 digits, if its check digit is right."""
    digits = re.sub(r"[\s-]", "", text or "")
    if not re.fullmatch(r"\d{8}|\d{12,14}", digits):
        return None
    full = digits.zfill(14)
    total = sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(full[:13]))
    return full if int(full[13]) == -total % 10 and int(full) else None


def models(text: str) -> list[tuple[str, int, str]]:
    """(model number, size, code) of each model number in a text."""
    found = [(m[1] or m[4], m[2] or m[5], m[3] or m[6]) for m in MODEL.finditer(text.upper())]
    return [("".join(x), int(x[1]), x[2]) for x in found if x[2] not in _UNIT_WORDS]


def _sound(value: str) -> str | None:
    """Watts of a statement like "2 x 10 W" or "20 watts RMS" as digits."""
    m = re.match(r"(?:(\d+)\s*[x×]\s*)?(\d+)\s*w", value.lower())
    return str(int(m[1] or 1) * int(m[2])) if m else None


_READ = frozenset(x for names in (BRAND_NAMES, MODEL_NAMES, TRADE_NAMES, *FIGURES.values()) for x in names)


@lru_cache(maxsize=100_000)
def _plain_name(name: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", name.lower()).split())


def listing_keys(title: str | None, features: list[tuple[str, str | None]]) -> dict:
    """Identifiers and figures of one listing in its one form."""
    named = [(name, " ".join((v or "").split())) for k, v in features if k and (name := _plain_name(k)) in _READ]
    first = lambda names, ok: next((x for k, v in named if k in names and (x := ok(v))), None)
    text = title or ""
    model = first(MODEL_NAMES, lambda v: next(iter(models(v)), None)) or next(reversed(models(text)), None)
    inch = model[1] if model else None
    of_features = feature_statements(features)
    base = {q: x for q, _, _, x in reversed(of_features) if x}
    if inch is None:
        stated = [s for s in [*title_statements(text), *of_features] if s[0] == "diagonal_mm" and s[3] and s[3] < MOST_MM]
        inch = round(stated[0][3] / 25.4) if stated else None
    brand = first(BRAND_NAMES, canonical.name_form)
    return {
        "model": model[0] if model else None,
        "trade": first(TRADE_NAMES, valid_trade_number),
        "inch": inch,
        "codes": [model[2]] if model else list(dict.fromkeys(m[1] for m in CODE.finditer(text.upper()))),
        "brand": brand if brand and len(brand) > 2 else None,
        "contrast": first(FIGURES["contrast"], lambda v: re.sub(r"\D", "", re.split(r":|\bto\b", v)[0])),
        "brightness": first(FIGURES["brightness"], lambda v: re.sub(r"\D", "", (re.match(r"[\d., ]+", v) or [""])[0])),
        "year": first(FIGURES["year"], lambda v: (re.search(r"\d{4}", v) or [None])[0]),
        "energy": first(FIGURES["energy"], lambda v: (re.search(r"\b[A-G]\b\+*", v.upper()) or [None])[0]),
        "sound": first(FIGURES["sound"], _sound),
        "power": str(round(base["power_mw"] / 1000)) if "power_mw" in base else None,
        "refresh": str(round(base["refresh_hz"])) if "refresh_hz" in base else None,
    }


#: A diagonal beyond this many millimetres is a code read as metres; it gives no size for keys.
MOST_MM = 10_000
#: Figures that may combine to keys.
TOLD = ("contrast", "brightness", "year", "energy", "sound", "power", "refresh")
_COLUMNS = {
    "model": pa.string(),
    "trade": pa.string(),
    "inch": pa.int32(),
    "codes": pa.list_(pa.string()),
    "brand": pa.string(),
    **dict.fromkeys(TOLD, pa.string()),
    "words": pa.list_(pa.int64()),
}
SCHEMA = "rid long, mark long, model string, trade string, inch int, codes array<string>, brand string, " + ", ".join(f"{c} string" for c in TOLD) + ", words array<long>"


def extract(forms: DataFrame) -> DataFrame:
    """Identifiers, figures and word sets of records ``rid, title, features`` in one form, one row per rid.

    Of several different rows of a rid the one with the largest hash holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                features = [(e["key"], e["value"]) for e in f or []]
                rows.append(listing_keys(t, features) | {"words": nearcopies.hashed_words(t, features)})
                marks.append(xxhash.xxh64_intdigest(repr((t, features))) - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), *(pa.array([r[c] for r in rows], k) for c, k in _COLUMNS.items())], names=["rid", "mark", *_COLUMNS])

    rows = forms.select("rid", "title", "features").mapInArrow(run, SCHEMA)
    return rows.groupBy("rid").agg(F.max_by(F.struct(*_COLUMNS), "mark").alias("x")).select("rid", "x.*")


def telling(listings: DataFrame) -> list[tuple[str, ...]]:
    """The least combinations of up to MOST_FIGURES figures that, with maker and size, tell a product from all others.

    A figure tells -log2 of the chance that two listings which give it agree,
    counted over all listings.  A combination must tell log2 of the number of
    listings and MARGIN bits more, so that of n listings about n / 2**(MARGIN
    + 1) pairs agree by chance.
    """
    given = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v"))) for c in ("maker", "inch", *TOLD))))
    counts = listings.select(F.explode(given).alias("x")).groupBy("x.f", "x.v").agg(F.count("*").cast("double").alias("c"))
    rows = counts.groupBy("f").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same")).collect()  # one row a figure
    bits = {r["f"]: math.log2(r["n"] ** 2 / r["same"]) for r in rows}
    need = math.log2(max(listings.count(), 2)) + MARGIN - bits.get("maker", 0.0) - bits.get("inch", 0.0)
    out: list[tuple[str, ...]] = []
    for k in range(1, MOST_FIGURES + 1):
        for combo in itertools.combinations([c for c in TOLD if c in bits], k):
            if sum(bits[c] for c in combo) >= need and not any(set(o) <= set(combo) for o in out):
                out.append(combo)
    return out


def keys(listings: DataFrame) -> DataFrame:
    """``rid, model, trade, maker, kind, key`` of extracted listings with their brand in ``maker``.

    Model numbers and codes give a key by themselves, of kind ``m`` and ``c``,
    and one with the maker, for those that several makers use.
    """
    part = lambda *c: F.concat_ws("|", *c)
    maker = F.coalesce("maker", F.lit("?"))
    code = lambda kind, key: F.transform("codes", lambda c: F.struct(F.lit(kind).alias("kind"), key(c).alias("key")))

    def option(kind: str, key: Column, *needed: str) -> Column:
        there = F.expr(" and ".join(f"{c} is not null" for c in needed))
        return F.when(there, F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key"))))

    options = [
        option("m", F.col("model"), "model"),
        option("mm", part("model", "maker"), "model", "maker"),
        option("t", F.col("trade"), "trade"),
        F.when(F.col("inch").isNotNull(), F.concat(code("c", lambda c: part("inch", c)), code("cm", lambda c: part("inch", c, maker)))),
        *(option("f" + "+".join(s), part("maker", "inch", *s), "maker", "inch", *s) for s in telling(listings)),
    ]
    return listings.select("rid", "model", "trade", "maker", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*options))))).alias("x")).select("rid", "model", "trade", "maker", "x.kind", "x.key")


def linked(listings: DataFrame, copies: DataFrame) -> DataFrame:
    """Edges ``u, v, tier`` between listings and their keys' smallest listings, and between near copies, both ways.

    ``copies`` has ``u, v, tier``.  A trade number that meets several model
    numbers links the listings without model to those of its clear majority
    (at least twice as many listings as have any other model); without one, and
    for the other keys, which are no identifiers, two model numbers, trade
    numbers or makers link nothing.  Copies with different model or trade numbers
    link nothing.
    """
    keyed = durable(keys(listings))
    has = F.col("model").isNotNull()
    cells = keyed.groupBy("kind", "key", "model").agg(
        F.count("*").alias("n"), F.min("rid").alias("lo"), F.min("trade").alias("t0"), F.max("trade").alias("t1"), F.min("maker").alias("k0"), F.max("maker").alias("k1")
    )
    per = cells.groupBy("kind", "key").agg(
        F.max(F.when(has, F.struct("n", "model", "lo"))).alias("top"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("modelled"),
        F.min(F.when(~has, F.col("lo"))).alias("lo"),
        F.sum("n").alias("n"),
        *(f(c).alias(c) for c, f in (("t0", F.min), ("t1", F.max), ("k0", F.min), ("k1", F.max))),
    )
    one_model = F.col("top").isNull() | (F.col("top.n") == F.col("modelled"))
    clear = F.col("top").isNull() | (F.col("top.n") >= 2 * (F.col("modelled") - F.col("top.n")))
    one_trade, one_maker = F.col("t0").isNull() | (F.col("t0") == F.col("t1")), F.col("k0").isNull() | (F.col("k0") == F.col("k1"))
    sound = F.when(F.col("kind") == "t", clear).when(F.col("kind").isin("m", "mm"), (F.col("kind") == "mm") | one_maker).otherwise(one_model & one_trade & ((F.col("kind") != "c") | one_maker))
    hubs = per.filter((F.col("n") > 1) & sound).select("kind", "key", F.least("lo", "top.lo").alias("hub"), F.col("top.model").alias("most"))
    tier = F.when(F.col("kind").startswith("m"), MODEL_TIER).when(F.col("kind") == "t", TRADE).when(F.col("kind").startswith("c"), CODED).otherwise(FIGURED)
    fit = keyed.join(hubs, ["kind", "key"]).filter("rid <> hub and (model is null or model = most)")
    by_key = fit.select(F.col("rid").alias("u"), F.col("hub").alias("v"), tier.alias("tier"))
    own = listings.select("rid", "model", "trade")
    side = lambda c: own.select(F.col("rid").alias(c), F.col("model").alias(f"m_{c}"), F.col("trade").alias(f"t_{c}"))
    clash = F.coalesce(F.col("m_u") != F.col("m_v"), F.lit(False)) | F.coalesce(F.col("t_u") != F.col("t_v"), F.lit(False))
    by_copy = copies.join(side("u"), "u").join(side("v"), "v").filter(~clash).select("u", "v", "tier")
    one_way = by_key.unionByName(by_copy)
    back = one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "tier")
    edges = durable(one_way.unionByName(back).groupBy("u", "v").agg(F.min("tier").alias("tier")))
    discard(keyed)
    return edges


def parted(mixed: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``rid, name`` of listings ``rid, model`` whose components hold several models; listings of one name stay together.

    A listing without model takes the model of its strongest links, tier by
    tier, if they agree on one.  What stays ambiguous forms components of its
    own over its links, so that copies stay together.
    """
    at = durable(mixed.select("rid", F.col("model").alias("name")))
    inside = durable(edges.join(at.select(F.col("rid").alias("u")), "u", "left_semi"))
    for tier in sorted(r[0] for r in inside.select("tier").distinct().collect()):  # at most one row a kind of link
        for _ in range(most_rounds):
            open_ = at.filter("name is null").select(F.col("rid").alias("u"))
            near = inside.filter(F.col("tier") <= tier).join(open_, "u").join(at.filter("name is not null").select(F.col("rid").alias("v"), "name"), "v")
            by_tier = near.groupBy("u", "tier").agg(F.min("name").alias("a"), F.max("name").alias("b"))
            new = durable(by_tier.groupBy("u").agg(F.min(F.struct("tier", "a", "b")).alias("x")).filter("x.a = x.b").select(F.col("u").alias("rid"), F.col("x.a").alias("taken")))
            if not new.limit(1).count():
                break
            before, at = at, durable(at.join(new, "rid", "left").select("rid", F.coalesce("name", "taken").alias("name")))
            discard(before)
            discard(new)
    rest = at.filter("name is null").select("rid")
    between = durable(inside.join(rest.select(F.col("rid").alias("u")), "u", "left_semi").join(rest.select(F.col("rid").alias("v")), "v", "left_semi").select("u", "v"))
    left = components(between).select(F.col("u").alias("rid"), "label")
    return at.join(left, "rid", "left").select("rid", F.coalesce(F.concat(F.lit("m"), "name"), F.concat(F.lit("r"), F.coalesce("label", "rid").cast("string"))).alias("name"))


def same_products(records: DataFrame, brands: DataFrame) -> DataFrame:
    """``rid, product, model, trade``: each listing's product, named by the smallest rid of its component.

    Every listing gets a row, also one without any key or with null title and
    features, which is a product of its own.  Of several different rows of a
    rid one holds, the same in every run.
    """
    forms = durable(lookalike.to_one_form(records))
    found = canonical.nearest(canonical.map_titles(forms, brands)).select("rid", "entry")
    shards, _ = canonical.reference_shards(brands, "brand_id", "brand")
    known = {form: str(entry) for shard in shards for form, entry in reversed(shard)}
    named = records.sparkSession.createDataFrame(list(known.items()), "brand string, by_feature string")
    listings = extract(forms).join(found, "rid").join(F.broadcast(named), "brand", "left")  # names bounded by reference_shards
    maker = F.when(F.col("entry") > 0, F.col("entry").cast("string")).otherwise(F.coalesce("by_feature", "brand"))
    listings = durable(listings.withColumn("maker", maker).drop("entry", "by_feature"))
    sets = listings.select("rid", "words")
    classes = durable(nearcopies.copy_classes(sets))
    pairs = nearcopies.similar_classes(sets, classes, 0.75).select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"), F.lit(NEAR).alias("tier"))
    copies = pairs.unionByName(classes.filter("rid <> rep").select(F.col("rid").alias("u"), F.col("rep").alias("v"), F.lit(COPY).alias("tier")))
    edges = linked(listings, copies)
    labels = components(edges)
    joined = listings.select("rid", "model", "trade").join(labels.withColumnRenamed("u", "rid"), "rid", "left").withColumn("product", F.coalesce("label", "rid"))
    mixed = joined.groupBy("product").agg(F.min("model").alias("m0"), F.max("model").alias("m1")).filter("m0 <> m1").select("product", F.lit(True).alias("mixed"))
    mixed = durable(mixed)
    grouped = joined.withColumn("name", F.concat(F.lit("p"), F.col("product").cast("string")))
    if mixed.limit(1).count():
        several = parted(joined.join(mixed, "product").select("rid", "model"), edges).withColumnRenamed("name", "part")
        grouped = grouped.join(several, "rid", "left").withColumn("name", F.coalesce("part", "name"))
    grouped = durable(grouped.select("rid", "model", "trade", "name"))
    smallest = grouped.groupBy("name").agg(F.min("rid").alias("product"))
    return grouped.join(smallest, "name").select("rid", "product", "model", "trade")


def product_pairs(products: DataFrame) -> DataFrame:
    """``rid_a, rid_b`` (a < b) of all listings of one product."""
    side = lambda c: products.select("product", F.col("rid").alias(f"rid_{c}"))
    return side("a").join(side("b"), "product").filter("rid_a < rid_b").select("rid_a", "rid_b")
