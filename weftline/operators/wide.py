"""Attribute-value rows to one wide row per entity with typed columns.

Names and values are dictionary-encoded, each distinct value parsed once to its
attribute's type and the rows reduced within each Arrow batch, so even an entity with a third of all rows leaves a batch with one row
per attribute.  One exchange by entity then gathers each entity; its values
are scattered by row and column index into one numpy array per column and
emitted as Arrow tables.  Numbers and truth values travel as 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftline.functions.quantities import NUMBER, UNITS, number, unit_key
from weftline.functions.textforms import squash

# Texts that stand for no value, and the words for yes and no.
PLACEHOLDERS = frozenset(["", "-", "--", "?", "n/a", "na", "n.a.", "none", "null", "unknown", "not stated", "see manual", "tbd", "tba"])
YES = frozenset(["1", "y", "yes", "true"])
NO = frozenset(["0", "n", "no", "false"])

_SPARK = {"int": "bigint", "double": "double", "boolean": "boolean", "string": "string"}
_ARROW = {"int": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_NUMERIC = re.compile(rf"(?:(?:approx|ca|about|circa)\.?\s*|~\s*)?([-+]?)({NUMBER})\s*(\D.*)?", re.IGNORECASE | re.DOTALL)


def name_key(name: str | None) -> str:
    """Attribute name without letter case, blanks and punctuation."""
    return re.sub(r"[\W_]+", "", squash(name).lower())


def _factor(unit: str | None, to: str | None) -> float | None:
    """Factor from a value's unit to the catalogue's; None if they don't go together."""
    unit, to = unit_key(unit or ""), unit_key(to or "")
    if unit in ("", to):
        return 1.0
    for table in UNITS.values():
        if unit in table and to in table:
            return table[unit] / table[to]
    return None


def typed(value: str | None, kind: str, unit: str | None):
    """Value of the attribute's type, or None.

    None for null, blank and placeholder texts, for units of another
    quantity and, where whole numbers are due, for fractions.
    """
    text = squash(value)
    if text.lower() in PLACEHOLDERS:
        return None
    if kind == "string":
        return text
    if kind == "boolean":
        return True if text.lower() in YES else False if text.lower() in NO else None
    m = _NUMERIC.fullmatch(text)
    factor = m and _factor(m[3], unit)
    if not factor:
        return None
    try:
        n = Decimal(repr(number(m[2]))) * Decimal(repr(factor)) * (-1 if m[1] == "-" else 1)
    except InvalidOperation:
        return None
    if kind == "double":
        return float(n)
    return int(n) if n == n.to_integral_value() and abs(n) < 2**63 else None


def catalog_columns(catalog: DataFrame) -> list[tuple[str, str, str | None, list[str]]]:
    """(name, type, unit, keys) of each catalogue entry, ordered by name.

    The catalogue makes the columns of the result, so it is read on the
    driver; it must hold fewer than 10 000 entries.
    """
    rows = catalog.select("attr_name", "value_type", "unit", "aliases").orderBy("attr_name").limit(10_000).collect()
    if len(rows) >= 10_000:
        raise ValueError("a catalogue of 10 000 columns or more can't be made wide")
    return [(r[0], r[1], r[2], [name_key(x) for x in [r[0], *(r[3] or [])]]) for r in rows if r[0] and r[1] in _SPARK]


def pivot_wide(df: DataFrame, catalog: DataFrame, entity: str = "rid") -> DataFrame:
    """``entity`` and one typed column per catalogue entry, one row per entity.

    ``df`` has ``entity, pos, attr_name, attr_value, loaded_at``.  An entity
    with no usable value still gets its row, all null.  Rows of a null entity
    form one row.  Where usable rows of a cell differ, the earliest by
    (loaded_at, pos, value) holds.  Attributes of no catalogue entry are left
    out; an empty input gives an empty table.
    """
    columns = catalog_columns(catalog)
    where = {k: i for i, (_, _, _, keys) in reversed(list(enumerate(columns))) for k in keys}
    kinds = [c[1] for c in columns]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        known: dict = {}
        for batch in batches:
            coded, texts = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            for name in coded.dictionary.to_pylist():
                if name not in names:
                    names[name] = where.get(name_key(name), -1)
            col = _looked_up(coded, [names[n] for n in coded.dictionary.to_pylist()], -1)
            value = _looked_up(texts, range(len(texts.dictionary)), -1)
            both = np.where((col >= 0) & (value >= 0), col * (len(texts.dictionary) + 1) + value, -1)
            pairs, at = np.unique(both, return_inverse=True)  # every attribute's value is parsed once
            words, cells = texts.dictionary.to_pylist(), []
            for pair in pairs.tolist():
                i, w = divmod(pair, len(words) + 1)
                key = (i, words[w]) if pair >= 0 else None
                if key not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[key] = _cell(typed(key[1], kinds[i], columns[i][2]), kinds[i]) if key else (0, None, False)
                cells.append(known[key])
            number, text = np.array([c[0] for c in cells], dtype=np.int64)[at], np.array([c[1] for c in cells], dtype=object)[at]
            usable = np.array([c[2] for c in cells], dtype=bool)[at]
            entity, no_entity = _filled(batch.column(0), 0)
            when, place = _filled(batch.column(3), -(2**62))[0], _filled(batch.column(4), -(2**31))[0]
            order = np.lexsort((number, place, when, col, entity, no_entity))
            order = order[usable[order]]
            first = _changes(no_entity[order], entity[order], col[order])
            take = order[first]  # the earliest usable row of each cell in this batch
            ents = np.unique(np.stack([no_entity.astype(np.int64), entity], axis=1), axis=0)
            more = len(ents)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ents[:, 1], entity[take]]), mask=np.concatenate([ents[:, 0] > 0, no_entity[take]])),
                    pa.array(np.concatenate([np.full(more, -1), col[take]]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(more, dtype=np.int64), when[take]])),
                    pa.array(np.concatenate([np.zeros(more, dtype=np.int64), place[take]]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(more, dtype=np.int64), number[take]])),
                    pa.array([None] * more + text[take].tolist(), pa.string()),
                ],
                names=["e", "col", "at", "pos", "n", "s"],
            )

    def wide(entity: np.ndarray, no_entity: np.ndarray, col: np.ndarray, number: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        """Scatter of values into one array per column by row and column index; the first of a cell holds."""
        starts = _changes(no_entity, entity)
        row = np.cumsum(starts) - 1
        count = int(starts.sum())
        use = _changes(no_entity, entity, col) & (col >= 0)
        row, col, number, text = row[use], col[use], number[use], text[use]
        arrays = [pa.array(entity[starts], pa.int64(), mask=no_entity[starts])]
        for i, kind in enumerate(kinds):
            hit = col == i
            filled = np.zeros(count, dtype=bool)
            filled[row[hit]] = True
            if kind == "string":
                out = np.full(count, None, dtype=object)
                out[row[hit]] = text[hit]
            else:
                out = np.zeros(count, dtype=np.int64)
                out[row[hit]] = number[hit]
                out = out.view(np.float64) if kind == "double" else out.astype(bool) if kind == "boolean" else out
            arrays.append(pa.array(out, _ARROW[kind], mask=~filled))
        return pa.RecordBatch.from_arrays(arrays, names=["e", *(f"c{i}" for i in range(len(kinds)))])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by entity, column and rank; the last entity of a batch waits for the next one."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = [*_filled(batch.column(0), 0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.array(batch.column(3).to_pylist(), dtype=object)]
            held = [np.concatenate(p) for p in zip(held, new, strict=True)] if held else new
            last = int(np.flatnonzero(_changes(held[1], held[0]))[-1])
            if last:
                yield wide(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        if held:
            yield wide(*held)

    slim = df.select(F.col(entity).cast("long"), "attr_name", "attr_value", F.unix_micros(F.col("loaded_at").cast("timestamp")), F.col("pos").cast("int"))
    cells = slim.mapInArrow(parse, "e long, col int, at long, pos int, n long, s string")
    gathered = cells.repartition("e").sortWithinPartitions("e", "col", "at", "pos", "n", "s").select("e", "col", "n", "s")
    out = gathered.mapInArrow(scatter, "e long" + "".join(f", c{i} {_SPARK[k]}" for i, k in enumerate(kinds)))
    return out.select(F.col("e").alias(entity), *(F.col(f"c{i}").alias(c[0]) for i, c in enumerate(columns)))


def _looked_up(coded: pa.DictionaryArray, values, missing: int) -> np.ndarray:
    """The value of each row's dictionary entry; ``missing`` for null."""
    table = np.array([*values, missing], dtype=np.int64)
    return table[pc.fill_null(coded.indices, len(table) - 1).to_numpy()]


def _filled(column: pa.Array, value: int) -> tuple[np.ndarray, np.ndarray]:
    """The column as whole numbers with nulls filled, and where they were."""
    return pc.fill_null(column, value).to_numpy().astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before; the first row does."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _cell(value, kind: str) -> tuple[int, str | None, bool]:
    """(a number's 64 bits, a text, is it usable) of a typed value."""
    if value is None:
        return 0, None, False
    if kind == "string":
        return 0, value, True
    return int(np.array(value, dtype=np.float64).view(np.int64)) if kind == "double" else int(value), None, True


def cells(wide: DataFrame, entity: str = "rid") -> DataFrame:
    """``entity, attr_name, typed_value`` of the wide table's filled cells.

    Numbers are plain decimals without grouping or trailing zeros (to twelve
    decimals), booleans ``true`` or ``false``.
    """
    shown = {
        "double": lambda c: F.regexp_replace(F.format_string("%.12f", c), r"\.?0+$", ""),
        "bigint": lambda c: c.cast("string"),
        "boolean": lambda c: c.cast("string"),
        "string": lambda c: c,
    }
    pairs = [F.struct(F.lit(c).alias("attr_name"), F.when(F.col(f"`{c}`").isNotNull(), shown[t](F.col(f"`{c}`"))).alias("typed_value")) for c, t in wide.dtypes if c != entity]
    return wide.select(entity, F.explode(F.array(*pairs)).alias("x")).select(entity, "x.attr_name", "x.typed_value").filter(F.col("typed_value").isNotNull())
