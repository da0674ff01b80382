"""Dashboard figures and anomaly rules on small inline rows."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import anomaly, kpi
from riskframe.operators.anomaly import Thresholds

SCHEMA = (
    "market string, region string, shipping_mode string, category string, order_status string, "
    "late_delivery_risk int, days_real int, days_scheduled int, profit double, quantity double"
)
BASE = dict(
    market="M", region="R", shipping_mode="S", category="C", order_status="COMPLETE",
    late_delivery_risk=0, days_real=3, days_scheduled=3, profit=1.0, quantity=1.0,
)


def orders(spark, *groups):
    """Each group is (count, overrides)."""
    rows = [tuple({**BASE, **over}.values()) for n, over in groups for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def prepared(spark, *groups):
    return anomaly.prepare_orders(orders(spark, *groups))


# ------------------------------------------------------------------ dashboard
def test_summary_counts_missing_flags_out_and_missing_status_in(spark):
    df = orders(
        spark,
        (1, dict(late_delivery_risk=1)),
        (1, dict(late_delivery_risk=None)),
        (1, dict(order_status=None)),
        (1, dict(order_status="canceled", profit=None)),
    )
    row = kpi.summary(df).first()
    assert row.total_orders == 4 and row.late_delivery_rate_pct == 33.3 and row.cancellation_rate_pct == 25.0
    assert row.avg_profit_per_order == 1.0 and row.fraud_rate_pct == 0.0


def test_summary_without_columns(spark):
    row = kpi.summary(spark.createDataFrame([(1,)], "x int")).first()
    assert (row.total_orders, row.late_delivery_rate_pct, row.avg_profit_per_order) == (1, 0.0, 0.0)


def test_group_figures_drop_missing_keys(spark):
    df = orders(spark, (3, {}), (2, dict(market=None, shipping_mode=None, region=None, order_status=None)))
    assert [r.market for r in kpi.late_by_market(df).collect()] == ["M"]
    assert [(r.shipping_mode, r.order_count) for r in kpi.mode_breakdown(df).collect()] == [("S", 3)]
    assert [(r.status, r["count"]) for r in kpi.status_distribution(df).collect()] == [("COMPLETE", 3)]
    assert [r.region for r in kpi.gap_by_region(df).collect()] == ["R"]
    assert [(r.market, r.total) for r in kpi.fraud_by_market(df).collect()] == [("M", 3)]


def test_group_figures_order_and_rounding(spark):
    df = orders(spark, (1, dict(market="A", late_delivery_risk=1)), (7, dict(market="A")), (1, dict(market="B", late_delivery_risk=1)))
    assert [(r.market, r.late_rate) for r in kpi.late_by_market(df).collect()] == [("B", 100.0), ("A", 12.5)]


def test_missing_columns_give_typed_empty_results(spark):
    bare = spark.createDataFrame([(1,)], "x int")
    assert kpi.late_by_market(bare).columns == ["market", "late_rate", "order_count"]
    assert kpi.late_by_market(bare).count() == kpi.gap_by_region(bare).count() == kpi.fraud_by_market(bare).count() == 0
    empty = anomaly.run_all(anomaly.prepare_orders(bare))
    assert empty.count() == 0 and "anomaly_id" in empty.columns
    assert anomaly.late_delivery_spikes(anomaly.prepare_orders(bare)).count() == 0


# ------------------------------------------------------------------ rules
def test_segment_size_edge(spark):
    for n, found in ((49, 0), (50, 1), (51, 1)):
        df = prepared(spark, (n, dict(late_delivery_risk=1)))
        assert anomaly.late_delivery_spikes(df).count() == found


def test_rates_are_compared_strictly(spark):
    at_cut = prepared(spark, (40, dict(late_delivery_risk=1)), (60, {}))
    above = prepared(spark, (41, dict(late_delivery_risk=1)), (59, {}))
    assert anomaly.late_delivery_spikes(at_cut).count() == 0
    row = anomaly.late_delivery_spikes(above).first()
    assert (row.severity, row.metric_value, row.confidence, row.n) == ("MEDIUM", 0.41, 0.2, 100)
    assert row.supporting_data == {"segment_order_count": 100.0, "late_orders": 41.0}
    assert row.affected_segment == "Market=M, Shipping Mode=S"
    assert row.description == "Late delivery rate 41.0% exceeds 40.0% threshold for Market=M, Shipping Mode=S"
    assert row.recommendation.startswith("Audit carrier performance for S routes in M. Consider")
    at_high = prepared(spark, (60, dict(late_delivery_risk=1)), (40, {}))
    assert anomaly.late_delivery_spikes(at_high).first().severity == "MEDIUM"


def test_missing_late_flag_counts_as_zero(spark):
    df = prepared(spark, (30, dict(late_delivery_risk=1)), (30, dict(late_delivery_risk=None)))
    assert anomaly.late_delivery_spikes(df).first().metric_value == 0.5


def test_status_is_compared_exactly(spark):
    assert anomaly.cancellation_surges(prepared(spark, (100, dict(order_status="canceled")))).count() == 0
    row = anomaly.cancellation_surges(prepared(spark, (30, dict(order_status="CANCELED")), (70, dict(order_status=None)))).first()
    assert (row.metric_value, row.severity) == (0.3, "HIGH")


def test_fraud_label_and_missing_region(spark):
    df = prepared(spark, (60, dict(order_status="SUSPECTED_FRAUD", region="M")))
    assert anomaly.fraud_clusters(df).first().affected_segment == "Market=M"
    df = prepared(spark, (60, dict(order_status="SUSPECTED_FRAUD")))
    assert anomaly.fraud_clusters(df).first().affected_segment == "Market=M, Region=R"
    assert anomaly.fraud_clusters(df.drop("region")).first().affected_segment == "Market=M"


def test_profit_low_needs_lower_threshold(spark):
    df = prepared(spark, (25, dict(profit=-2.0)), (75, dict(profit=2.0)), (20, dict(profit=None, category="D")))
    assert anomaly.profit_erosion(df).count() == 0
    row = anomaly.profit_erosion(df, Thresholds(profit_negative_rate=0.2)).first()
    assert (row.severity, row.metric_value, row.supporting_data["avg_profit"]) == ("LOW", 0.25, 1.0)
    assert row.affected_segment == "Category Name=C"
    assert anomaly.profit_erosion(df.drop("category"), Thresholds(profit_negative_rate=0.2)).first().affected_segment == (
        "Shipping Mode=S"
    )


def test_gap_zscore_against_plain_formula(spark):
    import statistics

    df = prepared(spark, (60, dict(shipping_mode="slow", days_real=9)), (200, dict(days_real=3)), (40, dict(days_real=4)))
    gaps = [6] * 60 + [0] * 200 + [1] * 40
    mean, std = statistics.mean(gaps), statistics.stdev(gaps)
    z = (6 - mean) / std
    row = anomaly.shipping_gap_outliers(df, Thresholds(shipping_gap_zscore=1.0)).first()
    assert row.supporting_data["z_score"] == pytest.approx(round(z, 3))
    assert row.metric_value == 6.0 and row.threshold == pytest.approx(mean + std)
    assert anomaly.shipping_gap_outliers(df, Thresholds(shipping_gap_zscore=z + 1e-9)).count() == 0


def test_zscore_guards(spark):
    loose = Thresholds(shipping_gap_zscore=-10.0, quantity_zscore=-10.0, min_segment_orders=1)
    few = prepared(spark, (15, dict(days_real=9, quantity=9.0)), (14, {}))
    assert anomaly.shipping_gap_outliers(few, loose).count() == anomaly.demand_spikes(few, loose).count() == 0
    # equal values: no deviation, however the sum of 0.1s rounds
    flat = prepared(spark, (100, dict(quantity=0.1)))
    assert anomaly.shipping_gap_outliers(flat, loose).count() == anomaly.demand_spikes(flat, loose).count() == 0
    unknown = prepared(spark, (60, dict(shipping_mode="?", days_real=None)), (40, dict(days_real=4)), (40, {}))
    assert {r.affected_segment for r in anomaly.shipping_gap_outliers(unknown, loose).collect()} == {"Shipping Mode=S"}


def test_demand_counts_known_quantities(spark):
    t = Thresholds(quantity_zscore=0.1)
    df = prepared(spark, (49, dict(category="A", quantity=9.0)), (10, dict(category="A", quantity=None)), (200, {}))
    assert anomaly.demand_spikes(df, t).count() == 0
    df = prepared(spark, (50, dict(category="A", quantity=9.0)), (10, dict(category="A", quantity=None)), (200, {}))
    row = anomaly.demand_spikes(df, t).first()
    assert (row.n, row.metric_value) == (50, 9.0)


MIX = [
    (60, dict(market="B", late_delivery_risk=1, order_status="SUSPECTED_FRAUD", profit=-5.0)),
    (60, dict(market="A", shipping_mode="T", days_real=9, order_status="CANCELED")),
    (200, dict(category="D", quantity=3.0)),
    (30, dict(market=None, shipping_mode=None, category=None, days_real=30, quantity=50.0)),
]
LOOSE = Thresholds(shipping_gap_zscore=0.1, quantity_zscore=-0.3, profit_negative_rate=0.1)


def test_report_equals_single_detectors(spark):
    df = prepared(spark, *MIX)
    report = anomaly.run_all(df, LOOSE).collect()
    singles = [
        detector(df, LOOSE)
        for detector in (
            anomaly.late_delivery_spikes, anomaly.shipping_gap_outliers, anomaly.cancellation_surges,
            anomaly.fraud_clusters, anomaly.profit_erosion, anomaly.demand_spikes,
        )
    ]
    want = [r for d in singles for r in d.collect()]
    key = lambda r: (r.anomaly_type, r.affected_segment, r.severity, round(r.metric_value, 9), round(r.threshold, 9), r.n)
    assert sorted(map(key, report)) == sorted(map(key, want)) and len(report) >= 6
    ids = [r.anomaly_id for r in sorted(report, key=lambda r: int(r.anomaly_id[4:]))]
    assert [int(i[4:]) for i in ids] == list(range(1, len(ids) + 1))
    order = ["LDS", "SGO", "CAS", "FRC", "PRF", "DMS"]
    assert [order.index(i[:3]) for i in ids] == sorted(order.index(i[:3]) for i in ids)
    ranks = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    by_position = sorted(report, key=lambda r: r.position)
    assert [(ranks[r.severity], int(r.anomaly_id[4:])) for r in by_position] == sorted(
        (ranks[r.severity], int(r.anomaly_id[4:])) for r in report
    )


def test_report_does_not_depend_on_splits_or_hot_segments(spark):
    df = prepared(spark, *MIX, (2000, dict(market="B")))
    a = anomaly.rounded(anomaly.run_all(df.repartition(1), LOOSE)).collect()
    b = anomaly.rounded(anomaly.run_all(df.repartition(16), LOOSE)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_correlation_summary_and_header(spark):
    rows = [
        ("A_0001", "x", "MEDIUM", "s1", 1), ("B_0002", "y", "HIGH", "s1", 2), ("C_0003", "z", "LOW", "s2", 3),
        ("D_0004", "x", "LOW", "s3", 4), ("E_0005", "y", "LOW", "s3", 5),
    ]
    found = spark.createDataFrame(
        rows, "anomaly_id string, anomaly_type string, severity string, affected_segment string, position int"
    )
    got = anomaly.correlate(found).collect()
    assert [(r.segment, r.max_severity) for r in got] == [("s1", "HIGH"), ("s3", "LOW")]
    assert got[0].correlated_anomaly_ids == ["A_0001", "B_0002"] and got[0].note.startswith("2 anomaly types detected")
    assert tuple(anomaly.severity_summary(found).first()) == (1, 1, 3)
    assert tuple(anomaly.severity_summary(found.limit(0)).first()) == (0, 0, 0)
    assert [r.anomaly_id for r in anomaly.high_only(found).collect()] == ["B_0002"]
    header = anomaly.report_header(spark.createDataFrame([], "x int"), found).first()
    assert (header.total_orders_analyzed, header.anomaly_count, header.anomaly_rate) == (0, 5, 5.0)


def test_thresholds_can_be_overridden_and_listed(spark):
    types, limits = anomaly.anomaly_types(spark, Thresholds(fraud_rate=0.5))
    assert types.count() == 6 and limits.count() == 7
    assert limits.filter("threshold = 'fraud_rate'").first().value == 0.5


def test_headers_are_trimmed(spark):
    df = spark.createDataFrame([("M", 1)], "`market ` string, ` Late_delivery_risk` int")
    assert anomaly.prepare_orders(df).columns[:2] == ["market", "Late_delivery_risk"]
    assert anomaly.prepare_orders(df).select(F.col("late_delivery_risk")).first()[0] == 1.0


def test_rows_of_an_order_come_together_and_are_settled_without_another_shuffle(spark, sf):
    from riskframe.plans import fixtures as fx
    from riskframe.sources.tables import last_write_wins

    plain, gathered = (fx.order_items(spark, sf, gathered=x) for x in (False, True))
    assert gathered.columns == plain.columns and gathered.exceptAll(plain).isEmpty() and plain.exceptAll(gathered).isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        settled = last_write_wins(fx.order_items(spark, sf, gathered=True), ["order_id", "order_item_id"], ["ship_date", "sales"])
        plan = settled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(order_id" not in plan
