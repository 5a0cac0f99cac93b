"""Nested records, wide tables and units on small cases, edge cases and the smallest data."""

import datetime as dt
import json
import math

import duckdb

from weftline.operators import dewey, units, wide

SMALL = "/root/testdata/sf0.001"
T = dt.datetime(2024, 1, 1)


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, body string")


def test_shred_shapes(spark):
    body = {
        "A": [None, {"rid": 1, "title": "x", "featuresMap": {"W": "5", "G": {"H": [1, 2], "Z": "  "}, "N": None}, "offers": {"price": 1, "stock": {"place": "p"}}}],
        "B": {"featuresMap": json.dumps({"a > b": True}), "offers": [None, {"stock": [None, {"qty": 0}]}]},
        "C": {"featuresMap": [{"name": "n", "value": 3}, {"name": "m"}, "junk"]},
        "D": None,
        "E": ["text", 7],
    }
    nodes = dewey.shred(bodies(spark, json.dumps(body)))
    got = {tuple(r)[1:] for r in dewey.children(nodes).collect()}
    assert got == {
        ("A", 1, "product", ""),
        ("A", 1, "feature", "W"),
        ("A", 1, "feature", "G > H"),
        ("A", 1, "offer", "0"),
        ("A", 1, "stock", "0/0"),
        ("B", 0, "product", ""),
        ("B", 0, "feature", "a > b"),
        ("B", 0, "offer", "1"),
        ("B", 0, "stock", "1/1"),
        ("C", 0, "product", ""),
        ("C", 0, "feature", "n"),
    }
    t = dewey.tables(nodes)
    products = {(r.file_id, tuple(r.label)) for r in t["product"].collect()}
    offers = {(r.file_id, tuple(r.label)): (r.file_id, tuple(r.parent)) for r in t["product.offers"].collect()}
    assert set(offers.values()) <= products
    assert {(r.file_id, tuple(r.parent)) for r in t["product.offers.stock"].collect()} <= set(offers)
    assert {(r.file_id, tuple(r.parent)) for r in t["product.featuresMap"].collect()} <= products


def test_tables_of_unseen_fields(spark):
    """Every scalar and every level comes out, named by the data alone; field names that clash are kept apart."""
    body = {"A": [{"rid": 7, "Rid": "x", "label": None, "tags": ["a", 1], "seller": {"name": "s", "staff": [{"n": 1, "shifts": [{"day": "mo", "breaks": {"at": "10:00"}}, "off"]}]}}]}
    t = dewey.tables(dewey.shred(bodies(spark, json.dumps(body))))
    assert set(t) == {"product", "product.seller", "product.seller.staff", "product.seller.staff.shifts", "product.seller.staff.shifts.breaks"}
    row = t["product"].first()
    assert {"rid", "Rid_2", "label_2", "tags"} <= set(t["product"].columns) or {"Rid", "rid_2", "label_2", "tags"} <= set(t["product"].columns)
    assert row.tags == '["a", 1]' and tuple(row.label) == (0, 0) and row.outer_key == "A"
    shifts = {tuple(r.label): r for r in t["product.seller.staff.shifts"].collect()}
    assert sorted((r.day, r.value) for r in shifts.values() if r.day) == [("mo", None)] and sorted(r.value for r in shifts.values() if r.value) == ["off"]
    deep = t["product.seller.staff.shifts.breaks"].first()
    assert deep.at == "10:00" and tuple(deep.parent) in shifts and tuple(deep.parent)[:6] == tuple(t["product.seller.staff"].first().label)
    assert dewey.tables(dewey.shred(bodies(spark, "{}"))) == {}


def test_shred_unreadable_and_empty(spark):
    rows = bodies(spark, None, "", "{", "[1]", "NaN", '{"a": NaN}', "<html>", "[" * 5000)
    assert dewey.shred(rows).count() == 0
    assert dewey.children(dewey.shred(rows.limit(0))).count() == 0


def test_latest_delivery(spark):
    rows = [(1, T, '{"A": {"rid": 1}}'), (1, T + dt.timedelta(days=1), '{"B": {"rid": 1}}'), (1, T + dt.timedelta(days=2), None), (2, None, '{"C": {}}')]
    df = spark.createDataFrame(rows, "file_id long, received_at timestamp, body string")
    assert {r.outer_key for r in dewey.children(dewey.shred(dewey.latest_deliveries(df))).collect()} == {"B", "C"}


def test_long_nesting(spark):
    deep = "v"
    for i in range(300):
        deep = {f"k{i}": deep}
    out = dewey.children(dewey.shred(bodies(spark, json.dumps({"A": {"featuresMap": deep}})))).filter("child = 'feature'").collect()
    assert len(out) == 1 and out[0].child_key.count(" > ") == 299


CATALOG = [("width", "double", "cm", ["Set Width"]), ("ports", "int", None, []), ("smart", "boolean", None, None), ("colour", "string", None, ["Color"])]
CAT_SCHEMA = "attr_name string, value_type string, unit string, aliases array<string>"
ROWS_SCHEMA = "rid long, pos int, attr_name string, attr_value string, loaded_at timestamp, attr_name_2 string"


def test_wide(spark):
    rows = [
        (1, 0, "SET-WIDTH :", "approx. 1,234.50 cm", T, "x"),
        (1, 1, "ports", "3.0", T, "x"),
        (1, 2, "Ports", "4", T + dt.timedelta(days=1), "x"),
        (1, 3, "smart", "Y", T, "x"),
        (2, 0, "color", "  dark   blue ", T, "x"),
        (2, 1, "ports", "3.5", T, "x"),
        (2, 2, "smart", "maybe", T, "x"),
        (2, 3, "colour", None, T, "x"),
        (3, 0, None, None, None, None),
        (None, 0, "ports", "9", None, None),
    ]
    df = spark.createDataFrame(rows * 3, ROWS_SCHEMA)
    out = wide.pivot_wide(df, spark.createDataFrame(CATALOG, CAT_SCHEMA))
    assert {(r.rid, r.width, r.ports, r.smart, r.colour) for r in out.collect()} == {(1, 1234.5, 3, True, None), (2, None, None, None, "dark blue"), (3, None, None, None, None), (None, None, 9, None, None)}
    assert {tuple(r) for r in wide.cells(out).collect()} == {(1, "width", "1234.5"), (1, "ports", "3"), (1, "smart", "true"), (2, "colour", "dark blue"), (None, "ports", "9")}
    assert wide.pivot_wide(df.limit(0), spark.createDataFrame(CATALOG, CAT_SCHEMA)).count() == 0


def test_typed_values():
    assert wide.typed("1 490 nits", "int", "cd/m2") == 1490
    assert wide.typed("533,600:1", "int", ":1") == 533600
    assert wide.typed("12 mm", "double", "cm") == 1.2
    assert wide.typed("12 kg", "double", "cm") is None
    assert wide.typed("N/A", "string", None) is None
    assert wide.typed("x" * 100_000, "string", None) == "x" * 100_000


def test_wide_against_sql(spark):
    got = wide.pivot_wide(spark.read.parquet(f"{SMALL}/feature_rows.parquet"), spark.read.parquet(f"{SMALL}/attribute_catalog.parquet")).select("rid", "usb_ports").collect()
    sql = f"""select rid, max(try_cast(regexp_replace(attr_value, '^(approx. |ca. |~)', '') as double))::bigint from '{SMALL}/feature_rows.parquet'
        where regexp_replace(lower(attr_name), '[^a-z0-9]', '', 'g') in ('usbports', 'numberofusbports') group by rid"""
    want = dict(duckdb.sql(sql).fetchall())
    assert {r.rid: r.usb_ports for r in got if r.usb_ports is not None} == {k: v for k, v in want.items() if v is not None}


def stated(spark, title, features=None):
    df = spark.createDataFrame([(1, title, features)], "rid long, title string, features map<string,string>")
    return {(r.field, r.quantity, r.amount) for r in units.convert_units(df).filter("unit_source = 'stated'").collect()}


def test_units_of_titles(spark):
    assert stated(spark, "Ixel 32 inch 1366 x 768 165 Hz incl. 6 ft HDMI cable + wall mount 400 x 400 mm") == {("title", "diagonal_mm", 813), ("title", "refresh_hz", 165)}
    assert stated(spark, "Orvo 1 270 mm with 2 kg soundbar with 12 in stand Voice Remote") == {("title", "diagonal_mm", 1270)}
    assert stated(spark, "24-Inch Voice Remote") == {("title", "diagonal_mm", 610)}
    assert stated(spark, None) == set() and stated(spark, "") == set()


def test_statements_far_out_are_flagged_not_dropped(spark):
    rows = [(i, f"Ixel {19 + i % 60} inch", None) for i in range(300)] + [(900, "5 inch portable TV", None), (901, "220 inch TV wall", None), (902, "Halden Vire 9725M 65 Zoll", None)]
    got = {(r.rid, r.unit_source, r.amount) for r in units.convert_units(spark.createDataFrame(rows, "rid long, title string, features map<string,string>")).filter("rid >= 900").collect()}
    assert got == {(900, "stated", 127), (901, "stated", 5588), (902, "doubtful", 9725000), (902, "stated", 1651)}


def test_words_between_two_units(spark):
    assert stated(spark, None, {"Net Weight": "about 54 pounds, really 4 ounces"}) == {("features", "weight_g", round(54.25 * 453.59237))}


def test_hidden_units_are_found(spark):
    rows = [(i, None, {"Diagonal": f"{600 + 3 * (i % 90)} mm" if i % 2 else f"{60 + i % 27} cm", "Refresh Rate": f"{50 + 10 * (i % 5)} Hz"}) for i in range(600)]
    df = spark.createDataFrame(rows, "rid long, title string, features map<string,string>")
    out = {r.quantity: r for r in units.inferred_units(units.statements(df)).collect()}
    for r in out.values():
        assert r.held_out == r.inferred + r.uncertain > 50 and r.correct > 0.95 * r.held_out
    assert units.inferred_units(units.statements(df.limit(0))).count() == 0


def test_units_of_features(spark):
    f = {
        "Screen Size": "49,6 inches diagonal",
        "Set Width (cm)": "111,5",
        "Net Weight": "56 lb 15 oz",
        "Power Draw": "0.105 kW",
        "Refresh Rate:": "144",
        "Refresh Rate: Unit": "Hz",
        "Shipping Weight": "9 kg",
        "Speaker Output Power": "20 W",
    }
    assert stated(spark, None, f) == {
        ("features", "diagonal_mm", 1260),
        ("features", "width_mm", 1115),
        ("features", "weight_g", round(56 * 453.59237 + 15 * 453.59237 / 16)),
        ("features", "power_mw", 105000),
        ("features", "refresh_hz", 144),
    }


def test_missing_units_are_inferred(spark):
    rows = [(i, None, {"Diagonal": f"{600 + 40 * (i % 20)} mm"}) for i in range(200)]
    rows += [(1000 + i, None, {"Diagonal": str(60 + 4 * (i % 20))}) for i in range(40)]
    df = spark.createDataFrame(rows, "rid long, title string, features map<string,string>")
    out = units.convert_units(df).filter("rid >= 1000").collect()
    assert len(out) == 40 and {r.unit for r in out if r.unit_source == "inferred"} == {"cm"}
    assert sum(r.unit_source == "inferred" for r in out) >= 30
    assert all(r.posterior is not None and r.unit_source != "stated" for r in out)


def test_mixture_without_stated_values():
    fit = units.fit_mixture([], [(math.log(100), 5.0), (math.log(101), 5.0)], [0.0, math.log(10)])
    assert abs(sum(fit["rho"]) - 1) < 1e-9


def test_empty_records(spark):
    df = spark.createDataFrame([], "rid long, title string, features map<string,string>")
    assert units.convert_units(df).count() == 0
