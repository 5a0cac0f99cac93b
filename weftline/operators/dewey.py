"""Nested records to related flat tables by Dewey labels.

Every node of a record's tree gets a label: the ordinals on the way from the
root.  A row's parent is its label cut short, so parent and child tables need
no generated keys and no join to find each other.  Nodes are grouped by the
*schema path*, the way with data keys and list positions left out.

One pass over the bodies in Arrow batches; the only exchange is the one that
keeps a file's latest arrival.  Tables and their columns are those of the data:
whatever fields and levels occur come out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NODE_SCHEMA = "path string, label array<int>, keys array<string>, fields map<string,string>"
_ARROW = [
    ("path", pa.string()),
    ("label", pa.list_(pa.int32())),
    ("keys", pa.list_(pa.string())),
    ("fields", pa.map_(pa.string(), pa.string())),
]


def _no_constant(_: str):
    raise ValueError("not JSON")


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


def _as_list(v) -> list:
    """A lone object counts as a list of one; anything else that is no list as an empty one."""
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def _open_map(value, label: tuple, keys: tuple):
    """Leaves of an attribute map given as object, as list of {name, value}, as JSON text or as groups of these.

    Yields (label, keys, value).  Works off a stack, so nesting is bounded by memory alone.
    """
    stack = [(value, label, keys)]
    while stack:
        v, at, way = stack.pop()
        if isinstance(v, dict):
            pairs = [(i, k, x) for i, (k, x) in enumerate(v.items())]
        else:
            pairs = []
            for i, x in enumerate(v):
                if isinstance(x, dict) and isinstance(x.get("name"), str):
                    pairs.append((i, x["name"], x.get("value")))
                elif isinstance(x, dict):
                    pairs.extend((i, k, y) for k, y in x.items())
        for i, k, x in reversed(pairs):
            if isinstance(x, dict):
                stack.append((x, (*at, i), (*way, k)))
            else:
                yield (*at, i), (*way, k), x


def _value(text: str):
    """The object or list that a text holds as JSON, else None."""
    try:
        out = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, (dict, list)) else None


def _nodes(body: str | None, item: str, keyed: frozenset[str]):
    """(path, label, keys, fields) of each node of one delivery; nothing if the body can't be read.

    An object's scalars, and its lists of scalars as JSON text, are its
    fields; its objects, and lists with an object in them, are child nodes.  A
    field in ``keyed`` holds data under free names: each leaf is a node of
    its own with the field ``value``.
    """
    try:
        root = json.loads(body, parse_constant=_no_constant)
    except (TypeError, ValueError, RecursionError):
        return
    if not isinstance(root, dict):
        return
    stack = [(item, (o, p), (outer, None), x) for o, (outer, value) in enumerate(root.items()) for p, x in enumerate(_as_list(value)) if isinstance(x, dict)]
    stack.reverse()
    while stack:
        path, at, way, node = stack.pop()
        fields: list[tuple[str, str | None]] = []
        for f, (name, inner) in enumerate(node.items()):
            below = f"{path}.{name}"
            if name in keyed:
                opened = _value(inner) if isinstance(inner, str) else inner
                if isinstance(opened, (dict, list)):
                    for label, keys, v in _open_map(opened, (*at, f), (*way, name)):
                        yield below, label, keys, [("value", _text(v))]
                    continue
            elif isinstance(inner, dict) or isinstance(inner, list) and any(isinstance(x, dict) for x in inner):
                for i, x in enumerate(_as_list(inner)):
                    if isinstance(x, dict):
                        stack.append((below, (*at, f, i), (*way, name, None), x))
                    elif x is not None:
                        yield below, (*at, f, i), (*way, name, None), [("value", _text(x))]
                continue
            fields.append((name, _text(inner)))
        yield path, at, way, fields


def latest_deliveries(df: DataFrame, id_col: str = "file_id", at_col: str = "received_at", body_col: str = "body") -> DataFrame:
    """One row per ``id_col``: the latest arrival that has a body.

    A tie of arrival times is broken by the larger body text; a null arrival
    time counts as the earliest.  Partial aggregation runs before the
    exchange, so a file sent over and over is reduced where it lies.
    """
    rank = F.struct(F.col(body_col).isNotNull().alias("has"), F.col(at_col).alias("at"), F.col(body_col).alias("body"))
    return df.groupBy(F.col(id_col).alias("file_id")).agg(F.max(rank).alias("m")).select("file_id", F.col("m.body").alias("body"))


def shred(df: DataFrame, item: str = "product", keyed: tuple[str, ...] = ("featuresMap",)) -> DataFrame:
    """Nodes ``file_id, path, label, keys, fields`` of deliveries ``file_id, body``.

    A body is an object of items under free outer keys; ``item`` names their
    path, and fields in ``keyed`` hold data under free names.  ``label`` holds
    the ordinals and ``keys`` the keys on the way (null where the step is a
    list position), so ``keys[0]`` is the outer key and ``label[1]`` the
    item's position.  Bodies that are null, empty, no valid JSON or no JSON
    object give no rows.  A null list item keeps its position and gives no
    row; a lone object counts as a list of one; for a key that an object
    repeats, the last value holds.
    """
    names = frozenset(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), *_ARROW])
        for batch in batches:
            ids, out = [], ([], [], [], [])
            for file_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in _nodes(body, item, names):
                    ids.append(file_id)
                    for column, v in zip(out, node, strict=True):
                        column.append(v)
                if len(ids) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(out, _ARROW, strict=True))], schema=schema)
                    ids, out = [], ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(out, _ARROW, strict=True))], schema=schema)

    return df.select(F.col("file_id").cast("long"), "body").mapInArrow(run, f"file_id long, {NODE_SCHEMA}")


def parent_label(label: Column, levels: int) -> Column:
    """Label of the ancestor ``levels`` steps up, by truncation."""
    return F.slice(label, F.lit(1), F.greatest(F.size(label) - F.lit(levels), F.lit(0)))


#: Schema paths and fields together that tables may have; a collection with more is keyed by data (see ``keyed``).
MOST_COLUMNS = 10_000


def schema_paths(nodes: DataFrame) -> dict[str, list[str]]:
    """Fields of each schema path that occurs, in order of their names."""
    rows = nodes.select("path", F.explode_outer(F.map_keys("fields")).alias("field")).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} fields: name those that hold data under free names in keyed")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["field"] or "")):
        out.setdefault(r["path"], []).extend([r["field"]] if r["field"] is not None else [])
    return out


def tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """A flat table per schema path that occurs, each child row with the label of its parent row.

    Every table has ``file_id, label, keys`` and its fields as columns of
    text; a child's ``parent`` is its label cut short, an item has
    ``outer_key`` and ``item_pos`` instead.  A column named like another, but
    for letter case, gets a number behind it.  Give nodes that are written
    (``durable``), since each table reads them.
    """
    out = {}
    for path, fields in schema_paths(nodes).items():
        depth, label = path.count(".") + 1, F.col("label")
        own = [F.col("keys")[0].alias("outer_key"), label[1].alias("item_pos")] if depth == 1 else [F.slice(label, 1, 2 * (depth - 1)).alias("parent")]
        taken = {"file_id", "label", "keys", "outer_key", "item_pos", "parent"}
        columns = []
        for name in fields:
            k, free = 1, name
            while free.lower() in taken:
                k += 1
                free = f"{name}_{k}"
            taken.add(free.lower())
            columns.append(F.try_element_at("fields", F.lit(name)).alias(free))
        out[path] = nodes.filter(F.col("path") == path).select("file_id", "label", "keys", *own, *columns)
    return out


def feature_name() -> Column:
    """Name as written, with the names of enclosing groups before it."""
    return F.array_join(F.slice(F.col("keys"), F.lit(4), F.size("keys")), " > ")


#: Schema paths whose nodes count as children, with the kind they are.
CHILDREN = {"product": "product", "product.featuresMap": "feature", "product.offers": "offer", "product.offers.stock": "stock"}


def children(nodes: DataFrame) -> DataFrame:
    """One row per child: ``file_id, outer_key, item_pos, child, child_key``.

    Outer key and position are read off the labels, so no table is joined.
    Features without a value (null, missing or blank) are left out.
    """
    label, path = F.col("label"), F.col("path")
    value = F.col("fields")["value"]
    blank = value.isNull() | (F.regexp_replace(value, r"[\s\p{Z}]", "") == "")
    kind = F.create_map(*(F.lit(x) for pair in CHILDREN.items() for x in pair))[path]
    key = (
        F.when(path == "product", "")
        .when(path == "product.featuresMap", feature_name())
        .when(path == "product.offers", F.element_at(label, -1).cast("string"))
        .otherwise(F.concat_ws("/", F.try_element_at(label, F.lit(-3)), F.element_at(label, -1)))
    )
    return (
        nodes.filter(path.isin(*CHILDREN) & ((path != "product.featuresMap") | ~blank))
        .select("file_id", F.col("keys")[0].alias("outer_key"), label[1].alias("item_pos"), kind.alias("child"), key.alias("child_key"))
        .distinct()
    )
