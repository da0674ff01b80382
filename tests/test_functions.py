"""Column functions and incident documents on small inline rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.functions import text as X
from riskframe.functions import vectors as V
from riskframe.functions.verdicts import faithful_flag, lenient_faithful, parse_verdict_json
from riskframe.operators import incidents


def _one(spark, column, value=None, schema="x string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "value, want",
    [(None, "unknown"), ("", "unknown"), ("  \t\n", "unknown"), ("  a b　", "a b"), ("nan", "nan")],
)
def test_as_text(spark, value, want):
    assert _one(spark, C.as_text("x"), value) == want


@pytest.mark.parametrize("value, want", [(None, 0), ("12.9", 12), ("-12.9", -12), ("abc", 0), ("NaN", 0), ("7", 7)])
def test_as_int(spark, value, want):
    assert _one(spark, C.as_int("x"), value) == want


@pytest.mark.parametrize("value, want", [(None, 0.0), ("1.5", 1.5), ("x", 0.0), ("NaN", 0.0)])
def test_as_double(spark, value, want):
    assert _one(spark, C.as_double("x"), value) == want


def test_to_numeric_or_null(spark):
    assert _one(spark, C.to_numeric_or_null("x"), "bad") is None
    assert _one(spark, C.to_numeric_or_null("x"), "3") == 3.0


def test_doc_id(spark):
    want = hashlib.md5(b"dataco::7::unknown").hexdigest()
    assert _one(spark, C.doc_id("dataco", F.lit(7), F.lit("unknown")), "") == want


@pytest.mark.parametrize(
    "value, want",
    [(1.0, "1.00"), (-0.001, "-0.00"), (2.456, "2.46"), (-3.14159, "-3.14"), (0.0, "0.00"), (1e40, "1" + "0" * 40 + ".00")],
)
def test_fixed(spark, value, want):
    assert _one(spark, C.fixed(F.col("x"), 2), value, "x double") == want


@pytest.mark.parametrize(
    "late, profit, status, want",
    [
        (1, 10.0, "Shipping on time", "HIGH"),
        (0, 10.0, "Shipping canceled", "HIGH"),
        (0, 10.0, "SUSPECTED", "HIGH"),
        (0, -50.0, "Shipping on time", "MEDIUM"),
        (0, -50.01, "Shipping on time", "HIGH"),
        (0, 0.0, "Late delivery", "MEDIUM"),
        (0, 0.0, "Advance shipping", "LOW"),
    ],
)
def test_order_severity(spark, late, profit, status, want):
    assert _one(spark, C.order_severity(F.lit(late), F.lit(profit), F.lit(status)), "") == want


@pytest.mark.parametrize(
    "defect, inspection, stock, lead, want",
    [
        (3.0, "Pass", 50, 10, "MEDIUM"),
        (3.01, "Pass", 50, 10, "HIGH"),
        (0.1, "FAIL", 50, 10, "HIGH"),
        (1.0, "Pending", 20, 25, "LOW"),
        (1.0, "Pending", 19, 25, "MEDIUM"),
        (1.0, "Pending", 20, 26, "MEDIUM"),
    ],
)
def test_sku_severity(spark, defect, inspection, stock, lead, want):
    assert _one(spark, C.sku_severity(F.lit(defect), F.lit(inspection), F.lit(stock), F.lit(lead)), "") == want


@pytest.mark.parametrize("value, want", [("high", "HIGH"), ("Medium", "MEDIUM"), ("odd", "LOW"), (None, "LOW")])
def test_normalise_severity(spark, value, want):
    assert _one(spark, C.normalise_severity("x"), value) == want


def test_delay_phrase_signs(spark):
    shown = [_one(spark, C.delay_phrase(F.lit(r), F.lit(s)), "") for r, s in ((5, 3), (3, 3), (2, 4))]
    assert [p.split("(")[1] for p in shown] == ["+2 days).", "0 days).", "-2 days)."]


@pytest.mark.parametrize(
    "value, want", [("", 1), (None, 1), ("a b c", 4), (" one ", 2), ("a b", 3), ("x " * 100, 131)]
)
def test_token_estimate(spark, value, want):
    assert _one(spark, X.token_estimate("x"), value) == want


def test_tokenize(spark):
    assert _one(spark, X.tokenize("x"), "Ab-c1 ÉK x") == ["ab", "c1", "x"]
    assert _one(spark, X.tokenize("x"), None) == []


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in df.select(V.cosine("a", "b").alias("c")).collect()] == [0.0, 1.0]


def test_hashed_vector(spark):
    df = spark.createDataFrame([("b b a",), ("",), (None,)], "x string")
    vectors = [r.v for r in df.select(V.hashed_vector("x", 64).alias("v")).collect()]
    at = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 64
    assert vectors[0][at("b")] == pytest.approx(2 / 5**0.5) and vectors[0][at("a")] == pytest.approx(1 / 5**0.5)
    assert sum(vectors[1]) == 0 and sum(vectors[2]) == 0 and len(vectors[2]) == 64


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"intent": "shipment_analysis", "severity": "high", "rationale": "r"}', ("shipment_analysis", "HIGH", "r")),
        ('Sure: {"intent": "supplier_risk"} ok', ("supplier_risk", "LOW", "")),
        ("no json", ("general", "LOW", "parse-failed")),
        ("{broken", ("general", "LOW", "parse-failed")),
        ("[1, 2]", ("general", "LOW", "parse-failed")),
        (None, ("general", "LOW", "parse-failed")),
    ],
)
def test_parse_verdict(spark, raw, want):
    assert tuple(_one(spark, parse_verdict_json("x"), raw)) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Faithful: true", True),
        ("faithful is, I would say, true", False),
        ("faithful: false", False),
        ("looks good", True),
        ('{"faithful": false, "reason": "x"}', False),
        ('{"reason": "x"}', True),
        (None, True),
    ],
)
def test_faithful(spark, raw, want):
    assert _one(spark, faithful_flag("x"), raw) is want
    if raw and not raw.startswith("{"):
        assert _one(spark, lenient_faithful("x"), raw) is want


# ------------------------------------------------------------------ incidents
def test_order_incident_with_missing_cells(spark):
    df = spark.createDataFrame(
        [(10, None, "Chair", -60.5, 2.0)],
        "order_id long, order_item_id string, product string, profit double, quantity double",
    )
    row = incidents.orders_to_incidents(df).first()
    assert row.id == hashlib.md5(b"dataco::10::unknown").hexdigest()
    assert row.metadata.severity == "HIGH" and row.metadata.source == "dataco" and len(row.metadata) == 23
    assert row.text == (
        "Order 10 placed on unknown, shipped on unknown. Product: Chair (category unknown, department unknown). "
        "Customer segment unknown; destination unknown, unknown (region unknown, market unknown). "
        "Shipping mode: unknown. Delivery status: unknown. Order status: unknown. "
        "Shipment took 0 days vs 0 scheduled (0 days). No late-delivery risk was flagged. Quantity 2. "
        "Order generated profit of -60.50 (ratio 0.00); sales 0.00, discount 0.00. Severity: HIGH."
    )


def test_sku_incident(spark):
    df = spark.createDataFrame(
        [(0, "SKU0", "haircare", 69.80800554211577, 58, 7, 0.22641036, "Pending"), (1, "SKU0", "haircare", 1.0, 5, 7, 0.2, "Pass")],
        "row long, sku string, product_type string, price double, stock_levels int, lead_time int, "
        "defect_rate double, inspection string",
    )
    rows = incidents.skus_to_incidents(df, "row").collect()
    assert rows[0].id != rows[1].id and rows[0].id == hashlib.md5(b"fashion::SKU0::0").hexdigest()
    assert [r.metadata.severity for r in rows] == ["LOW", "MEDIUM"] and len(rows[0].metadata) == 19
    assert "SKU SKU0 (haircare) supplied by unknown" in rows[0].text and "Price 69.81;" in rows[0].text
    assert "defect rate 0.23%." in rows[0].text


def test_generic_incident_limits(spark):
    columns = ["key"] + [f"c{i:02d}" for i in range(35)]
    values = ["k"] + [("unknown" if i == 1 else "" if i == 2 else f"v{i}") for i in range(35)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in columns))
    row = incidents.rows_to_incidents(df, "key", text_fields=30, metadata_fields=20).first()
    parts = row.text.split("; ")
    assert len(parts) == 30 and parts[0] == "c00: v0" and parts[1] == "c03: v3"
    assert len(row.metadata) == 22 and row.metadata["source"] == "custom" and "c01" not in row.metadata
    assert row.id == hashlib.md5(f"custom::k::{row.text}".encode()).hexdigest()


def test_dispatch_splits_rejects(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "raw line")], "x string, key int, _corrupt_record string")
    docs = incidents.to_incidents(df, "custom", "key", f"{tmp_path}/bad")
    assert [r.text for r in docs.collect()] == ["x: a"]
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["raw line"]
    with pytest.raises(ValueError):
        incidents.to_incidents(df, "custom")
