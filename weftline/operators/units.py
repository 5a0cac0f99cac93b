"""Stated quantities of listings in one unit each, with units inferred where none is given.

Statements are read in Arrow batches, one row each.  For numbers without any
unit, a mixture is fitted to the logarithms: every component is the same
density of the quantity, moved by the known factor of one candidate unit.  The
fit sees only a histogram per quantity, counted over all rows, so what reaches
the driver is bounded by the number of bins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.quantities import NUMBER, UNITS, number, unit_key, unit_pattern
from weftline.functions.textforms import squash
from weftline.session import durable, spread

# The quantities, their dimension, the feature names that state them and the units they are given in.
QUANTITIES = {
    "diagonal_mm": ("length_mm", ("screen size", "display size", "diagonal", "screen size class", "screen diagonal", "diagonal size"), ("mm", "cm", "m", "in")),
    "width_mm": ("length_mm", ("width", "set width", "product width", "overall width"), ("mm", "cm", "m", "in")),
    "weight_g": ("mass_g", ("weight", "net weight", "product weight", "set weight", "weight without stand"), ("g", "kg", "lb")),
    "power_mw": ("power_mw", ("power consumption", "power draw", "energy use on", "energy use", "consumption"), ("mw", "w", "kw")),
    "refresh_hz": ("frequency_hz", ("refresh rate", "screen refresh rate", "panel frequency", "picture frequency"), ("hz", "khz")),
}
# Words that make a length or mass in a title that of something beside the set.
BESIDE_BEFORE = r"(?:with|incl\.?|including|includes|plus|\+|w/|and|&|free|x|×)"
BESIDE_AFTER = r"(?:(?:hdmi|antenna|power|wall|usb)\s+)?(?:stand|soundbar|cable|lead|cord|mount|bracket|adapter|shelf)\b"
#: Share of statements that are of something else altogether (a code read as metres, say), and the natural logarithms they spread over.
STRAY, STRAY_RANGE = 1e-6, 40.0

_BY_NAME = {name: q for q, (_, names, _) in QUANTITIES.items() for name in names}
_PLAIN = re.compile(rf"(?:(?:about|approx|ca|circa)\.?\s*|~\s*)?({NUMBER})", re.IGNORECASE)
_WITH_UNIT = {d: re.compile(rf"(?<![\w.,])({NUMBER})\s*-?\s*({unit_pattern(d)})", re.IGNORECASE) for d in ("length_mm", "mass_g", "power_mw", "frequency_hz")}
_TWO_PART = {
    "length_mm": re.compile(rf"(\d+)\s*(ft|foot|feet|')[.,]?\s*(?:({NUMBER})\s*(in|inch|inches|\"|'')\.?)", re.IGNORECASE),
    "mass_g": re.compile(rf"(\d+)\s*(lbs?|pounds?)[.,]*\s*({NUMBER})\s*(oz|ounces?)\.?", re.IGNORECASE),
}
_TITLE = {
    "diagonal_mm": re.compile(rf"(?<![\w.,])({NUMBER})\s*-?\s*({unit_pattern('length_mm')})", re.IGNORECASE),
    "refresh_hz": re.compile(rf"(?<![\w.,])({NUMBER})\s*-?\s*({unit_pattern('frequency_hz')})", re.IGNORECASE),
}
_BEFORE = re.compile(rf"(?:^|\s){BESIDE_BEFORE}\s*$", re.IGNORECASE)
_AFTER = re.compile(rf"\s*{BESIDE_AFTER}", re.IGNORECASE)
_GRID = re.compile(r"\d{2,5}\s*[x×]\s*\d{2,5}(?:\s*(?:mm|pixels)\b)?", re.IGNORECASE)
_UNIT_WORDS = {w for table in UNITS.values() for u in table for w in u.split()}
_FEET = ("ft", "foot", "feet")

STATEMENT = "rid long, field string, quantity string, value double, unit string, base double"


@lru_cache(maxsize=100_000)
def _name(text: str) -> tuple[str, str | None]:
    """Feature name without punctuation, and the unit it ends with in parentheses."""
    t = squash(text).lower().replace("_", " ").replace(":", " ")
    m = re.fullmatch(r"(.*\S)\s*\(([^()]*)\)\s*", " ".join(t.split()))
    unit = unit_key(m[2]) if m else None
    if unit and any(unit in table for table in UNITS.values()):
        t = m[1]
    else:
        unit = None
    return " ".join(re.sub(r"[\W_]+", " ", t).split()), unit


def _in_base(quantity: str, value: float, unit: str) -> float:
    return value * UNITS[QUANTITIES[quantity][0]][unit_key(unit)]


def title_statements(title: str | None) -> list[tuple[str, float, str, float]]:
    """(quantity, value, unit, base) of the diagonals and refresh rates that a title states for the set."""
    text = squash(title)
    if "x" in text or "X" in text or "×" in text:
        text = _GRID.sub(";", text)
    out = []
    for quantity, pattern in _TITLE.items():
        for m in pattern.finditer(text):
            unit = unit_key(m[2])
            if quantity == "diagonal_mm" and (unit in _FEET or _BEFORE.search(text[: m.start()]) or _AFTER.match(text[m.end() :])):
                continue
            value = number(m[1])
            out.append((quantity, value, unit, _in_base(quantity, value, unit)))
    return out


def feature_statements(features) -> list[tuple[str, float, str | None, float | None]]:
    """(quantity, value, unit, base) of the features that state a quantity of the set.

    The unit stands in the value, in the name or in a feature named like it
    with "unit" behind; unit and base are None where it stands nowhere.
    """
    named = [(*_name(k), v) for k, v in features if k is not None and v is not None]
    units = {name[: -len(" unit")]: unit_key(squash(v)) for name, _, v in named if name.endswith(" unit")}
    out = []
    for name, unit, value in named:
        if quantity := _BY_NAME.get(name):
            out.extend(_stated(quantity, value, unit or units.get(name)))
    return out


@lru_cache(maxsize=200_000)
def _stated(quantity: str, text: str, named_unit: str | None) -> tuple[tuple[str, float, str | None, float | None], ...]:
    """Statements of a quantity in a feature's value; ``named_unit`` is the one its name or another feature gives."""
    value, dimension = squash(text), QUANTITIES[quantity][0]
    if not any(c.isdigit() for c in value):
        return ()
    bare = " ".join(w for w in value.split() if not w.isalpha() or w.lower() in _UNIT_WORDS)  # words that belong to no unit are passed over
    if two := _TWO_PART.get(dimension):
        if m := two.search(value) or two.search(bare):
            base = _in_base(quantity, number(m[1]), m[2]) if m[2] != "'" else number(m[1]) * UNITS["length_mm"]["ft"]
            return ((quantity, number(m[1]), unit_key(m[2]), base + _in_base(quantity, number(m[3]), m[4])),)
    found = [(number(m[1]), unit_key(m[2])) for m in _WITH_UNIT[dimension].finditer(value)]
    found = found or [(number(m[1]), unit_key(m[2])) for m in _WITH_UNIT[dimension].finditer(bare)]
    if not found and (m := _PLAIN.fullmatch(value)):
        found = [(number(m[1]), named_unit if named_unit in UNITS[dimension] else None)]
    return tuple((quantity, v, u, _in_base(quantity, v, u) if u else None) for v, u in found if v)


def statements(records: DataFrame) -> DataFrame:
    """Statements ``rid, field, quantity, value, unit, base`` of ``rid, title, features``; unit and base null where none is given.

    Null or empty titles and features give no rows; repeated records repeat
    their statements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, title, features in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend((rid, "title", *s) for s in title_statements(title))
                rows.extend((rid, "features", *s) for s in feature_statements(features or []))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "field", "quantity", "value", "unit", "base"])

    slim = records.select(F.col("rid").cast("long"), "title", "features")
    return spread(slim).mapInArrow(run, STATEMENT)


def fit_mixture(stated: list[tuple[float, float]], bare: list[tuple[float, float]], shifts: list[float], rounds: int = 60, parts: int = 3) -> dict:
    """Log-scale mixture whose components are one density moved by known factors.

    ``stated`` and ``bare`` are (log value, count) of base values and of
    numbers without unit; ``shifts`` the logarithms of the candidate units'
    factors.  The density is a mixture of ``parts`` normals, fitted to both by
    expectation-maximisation beside a thin even part for strays, so that these
    shape nothing; the units' weights are fitted to ``bare`` alone.
    """
    x = np.array([p[0] for p in stated] + [p[0] + s for s in shifts for p in bare], dtype=float)
    n = np.array([p[1] for p in stated] + [p[1] for _ in shifts for p in bare], dtype=float)
    k, m = len(stated), len(bare)
    base = x[:k] if k else x
    weight_of = n[:k] if k else n
    order = np.argsort(base)
    share = np.cumsum(weight_of[order]) / weight_of.sum()
    mu = np.array([base[order][np.searchsorted(share, (i + 0.5) / parts)] for i in range(parts)])
    middle = base[order][np.searchsorted(share, 0.16)], base[order][min(np.searchsorted(share, 0.84), len(base) - 1)]
    sd, pi = np.full(parts, max(0.1, float(middle[1] - middle[0]) / 2)), np.full(parts, 1 / parts)
    rho = np.full(len(shifts), 1 / len(shifts))

    def density(v: np.ndarray) -> np.ndarray:
        return pi * np.exp(-0.5 * ((v[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300

    for _ in range(rounds):
        d = density(x)
        inner = d / (d.sum(axis=1, keepdims=True) + STRAY / STRAY_RANGE)  # what is left belongs to none of the parts
        w = n.copy()
        if m:
            by_unit = rho[:, None] * d[k:].sum(axis=1).reshape(len(shifts), m)
            post = by_unit / by_unit.sum(axis=0)
            w[k:] *= post.ravel()
            rho = np.maximum((post * n[k : k + m]).sum(axis=1) / n[k : k + m].sum(), 1e-6)
            rho /= rho.sum()
        r = inner * w[:, None]
        total = np.maximum(r.sum(axis=0), 1e-9)
        mu = (r * x[:, None]).sum(axis=0) / total
        sd = np.maximum(np.sqrt((r * (x[:, None] - mu) ** 2).sum(axis=0) / total), 0.03)
        pi = total / total.sum()
    return {"mu": mu.tolist(), "sd": sd.tolist(), "pi": pi.tolist(), "rho": rho.tolist()}


def infer_units(rows: DataFrame, bin_width: float = 0.02, sure: float = 0.95) -> DataFrame:
    """Statements with ``unit_source``, ``posterior`` and ``amount`` (whole base units).

    Every statement is held against its quantity's mixture.  ``unit_source``
    is ``stated``, or ``doubtful`` where a stated amount lies so far out that
    it more likely is none of the quantity (see STRAY); ``inferred`` where the
    best candidate unit's posterior reaches ``sure``; else ``uncertain``, with
    the best candidate's amount.  ``posterior`` is that of the amount.  Bins
    are ``bin_width`` wide in the natural logarithm.  Where a quantity has no
    stated value at all, the numbers without unit alone shape the density.
    """
    binned = (
        rows.withColumn("bin", F.round(F.log(F.coalesce("base", "value")) / bin_width).cast("int"))
        .groupBy("quantity", F.col("unit").isNotNull().alias("stated"), "bin")
        .count()
        .collect()  # at most quantities x 2 x (range of logarithms / bin_width) rows
    )
    posterior, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    stray = F.lit(STRAY / STRAY_RANGE)
    for quantity, (dimension, _, candidates) in QUANTITIES.items():
        shifts = [math.log(UNITS[dimension][u]) for u in candidates]
        of = lambda stated: [(r["bin"] * bin_width, float(r["count"])) for r in binned if r["quantity"] == quantity and r["stated"] == stated]  # noqa: B023, E731
        given, bare = of(True), of(False)
        if not given and not bare:
            continue
        fit = fit_mixture(given, bare, shifts)

        def density(v: Column) -> Column:
            terms = [F.lit(p / sd / math.sqrt(2 * math.pi)) * F.exp(-0.5 * ((v - F.lit(mu)) / F.lit(sd)) ** 2) for mu, sd, p in zip(fit["mu"], fit["sd"], fit["pi"], strict=True)]  # noqa: B023
            return sum(terms[1:], terms[0])

        is_it, told = F.col("quantity") == quantity, F.col("unit").isNotNull()
        here = density(F.log("base"))
        posterior = F.when(is_it & told, here / (here + stray)).otherwise(posterior)
        if bare:
            dens = [F.lit(rho) * density(F.log("value") + F.lit(s)) for s, rho in zip(shifts, fit["rho"], strict=True)]
            total = sum(dens[1:], dens[0]) + stray
            best = F.array_max(F.array(*(F.struct((d / total).alias("p"), F.lit(u).alias("u")) for d, u in zip(dens, candidates, strict=True))))
            posterior, unit = F.when(is_it & ~told, best["p"]).otherwise(posterior), F.when(is_it & ~told, best["u"]).otherwise(unit)
    factors = F.create_map(*(F.lit(x) for table in UNITS.values() for pair in table.items() for x in (pair[0], float(pair[1]))))
    guessed = rows.withColumn("posterior", posterior).withColumn("guess", unit)
    source = F.when(F.col("unit").isNotNull(), F.when(F.col("posterior") >= 0.5, "stated").otherwise("doubtful")).when(F.col("posterior") >= sure, "inferred").otherwise("uncertain")
    return guessed.select(
        "rid",
        "field",
        "quantity",
        "value",
        F.coalesce("unit", "guess").alias("unit"),
        source.alias("unit_source"),
        "posterior",
        F.round(F.coalesce("base", F.col("value") * factors[F.col("guess")])).cast("long").alias("amount"),
    )


def inferred_units(rows: DataFrame, one_in: int = 5) -> DataFrame:
    """How well the mixture finds units: ``quantity, held_out, inferred, correct, uncertain`` per quantity.

    Of the statements with a unit, those of one listing in ``one_in``, taken
    by the hash of its rid, lose theirs and go through ``infer_units`` with
    all the others.  An inferred unit is correct if the amount is that of the
    stated one.  Statements of two units (pounds and ounces) stay as they are.
    """
    factors = F.create_map(*(F.lit(x) for table in UNITS.values() for pair in table.items() for x in (pair[0], float(pair[1]))))
    hidden = (F.pmod(F.xxhash64("rid"), F.lit(one_in)) == 0) & F.col("unit").isNotNull() & (F.abs(F.col("base") - F.col("value") * factors[F.col("unit")]) < 1e-6 * F.col("base"))
    nothing = lambda c: F.when(~F.coalesce(hidden, F.lit(False)), F.col(c)).alias(c)
    masked = rows.select("rid", F.concat("field", F.when(hidden, F.concat(F.lit("|"), F.col("base").cast("string"))).otherwise("")).alias("field"), "quantity", "value", nothing("unit"), nothing("base"))
    got = infer_units(masked).filter("field like '%|%'").withColumn("truth", F.round(F.substring_index("field", "|", -1).cast("double")).cast("long"))
    sure = F.col("unit_source") == "inferred"
    return got.groupBy("quantity").agg(
        F.count("*").alias("held_out"), F.count_if(sure).alias("inferred"), F.count_if(sure & (F.abs(F.col("amount") - F.col("truth")) <= 1)).alias("correct"), F.count_if(~sure).alias("uncertain")
    )


def convert_units(records: DataFrame) -> DataFrame:
    """All stated quantities of ``rid, title, features`` in base units, units inferred where missing.

    The statements, a few numbers per record, are written once to the shared
    checkpoint folder, since the fit and its use both read them.
    """
    return infer_units(durable(statements(records)))
