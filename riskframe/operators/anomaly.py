"""Segment-level anomaly detection (AN group).

All six detectors read sums over a segment, and sums over fine segments add up
to sums over coarse ones. A full report therefore scans the orders once, into
one row per (market, mode, region, category), and every detector works on
grouping sets of those few rows. A single detector aggregates straight to its
own segments. Both roads share the same rules: a rule turns the sums of one
segment into an anomaly, or into null.

Partial aggregation runs before each shuffle, so a segment that holds a large
share of all orders costs no more than any other. Windows without a partition
key run over segments and anomalies only, never over orders.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe import schemas
from riskframe.functions.columns import as_double, day_gap, severity_rank, to_numeric_or_null
from riskframe.sources.readers import empty_frame, normalise_headers


@dataclass(frozen=True)
class Thresholds:
    """Detector thresholds; pass keywords to override single values (AN12)."""

    late_delivery_rate: float = 0.40
    shipping_gap_zscore: float = 2.5
    cancellation_rate: float = 0.15
    fraud_rate: float = 0.02
    profit_negative_rate: float = 0.30
    quantity_zscore: float = 2.5
    min_segment_orders: int = 50


# Anomaly types in run order with the prefix of their ids.
ANOMALY_TYPES = {
    "late_delivery_spike": "LDS",
    "shipping_gap_outlier": "SGO",
    "cancellation_surge": "CAS",
    "fraud_cluster": "FRC",
    "profit_erosion": "PRF",
    "demand_spike": "DMS",
}

# Severity cuts (a metric above the cut has that severity), the
# severity below all cuts, and the segment size at which confidence is full.
SEVERITY_CUTS = {
    "late_delivery_spike": ((("HIGH", 0.6),), "MEDIUM", 500),
    "shipping_gap_outlier": ((("HIGH", 3.5),), "MEDIUM", 300),
    "cancellation_surge": ((("HIGH", 0.25),), "MEDIUM", 500),
    "fraud_cluster": ((("HIGH", 0.05),), "MEDIUM", 200),
    "profit_erosion": ((("HIGH", 0.50), ("MEDIUM", 0.30)), "LOW", 500),
    "demand_spike": ((("MEDIUM", 3.0),), "LOW", 300),
}

# Report texts, description first, then recommendation; each {}
# takes the next value.
REPORT_TEXTS = {
    "late_delivery_spike": (
        "Late delivery rate {} exceeds {} threshold for {}",
        "Audit carrier performance for {} routes in {}. "
        "Consider alternative carriers or upgraded shipping mode for critical orders.",
    ),
    "shipping_gap_outlier": (
        "Shipping mode '{}' has avg day gap {} days (z={}) vs overall mean {}",
        "Review carrier SLAs for '{}'. Investigate root cause of extended transit times.",
    ),
    "cancellation_surge": (
        "Cancellation rate {} exceeds {} threshold for {}",
        "Investigate cancellation drivers in {}. "
        "Check for shipping delays, out-of-stock events, or payment failures.",
    ),
    "fraud_cluster": (
        "Suspected fraud rate {} exceeds {} threshold for {}",
        "Escalate {} for fraud review. Implement additional verification for new orders in this segment.",
    ),
    "profit_erosion": (
        "{} of orders in {}='{}' are loss-making. Avg profit: {}",
        "Cost audit required for '{}'. Review pricing, discount rates, and fulfillment cost structure.",
    ),
    "demand_spike": (
        "Order quantity spike in '{}': avg {} units (z={}) vs overall {}",
        "Verify inventory levels for '{}'. Demand spike may indicate pre-positioning or promotional surge.",
    ),
}

# Fixed value: note on a segment with several anomalies.
CORRELATION_NOTE = "{} anomaly types detected in the same segment — compound risk; escalate for immediate review."

MIN_VALUES_FOR_ZSCORE = 30


def anomaly_types(spark, thresholds: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """The supported anomaly types and the thresholds in force, as two small tables."""
    types = spark.createDataFrame(list(enumerate(ANOMALY_TYPES)), "ord int, anomaly_type string")
    rows = [(f.name, float(getattr(thresholds, f.name))) for f in fields(thresholds)]
    return types, spark.createDataFrame(rows, "threshold string, value double")


# --------------------------------------------------------------------------
# preparation
# --------------------------------------------------------------------------
def prepare_orders(orders: DataFrame) -> DataFrame:
    """AN0: trimmed headers, numeric columns coerced, day gap, missing late flag counted as 0."""
    df = normalise_headers(orders)
    have = set(df.columns)
    new: dict[str, Column] = {}
    if {"days_real", "days_scheduled"} <= have:
        new["day_gap"] = day_gap("days_real", "days_scheduled")
    else:
        new["day_gap"] = F.lit(None).cast("double")
    if "late_delivery_risk" in have:
        new["late_delivery_risk"] = as_double("late_delivery_risk", 0.0)
    for name in ("profit", "quantity"):
        if name in have:
            new[name] = to_numeric_or_null(name)
    return df.withColumns(new)


_SPREADS = ("gap", "qty")
_SUMS = ["n", "late_sum", "cancel_n", "fraud_n", "loss_n", "profit_n", "profit_sum"] + [
    f"{s}_{part}" for s in _SPREADS for part in ("n", "sum", "sq")
]


def _row_sums(have: set[str]) -> list[Column]:
    """Sums over order rows; a column the table lacks contributes nothing."""

    def value(name: str) -> str:
        return f"CAST({name if name in have else 'NULL'} AS DOUBLE)"

    def status(name: str) -> str:
        return f"count_if(order_status = '{name}')" if "order_status" in have else "0L"

    sums = {
        "n": "count(1)",
        "late_sum": f"sum({value('late_delivery_risk')})",
        "cancel_n": status("CANCELED"),
        "fraud_n": status("SUSPECTED_FRAUD"),
        "loss_n": f"count_if({value('profit')} < 0)",
        "profit_n": f"count({value('profit')})",
        "profit_sum": f"sum({value('profit')})",
    }
    for name, source in (("gap", "day_gap"), ("qty", "quantity")):
        x = value(source)
        sums |= {
            f"{name}_n": f"count({x})",
            f"{name}_sum": f"sum({x})",
            f"{name}_sq": f"sum({x} * {x})",
            f"{name}_min": f"min({x})",
            f"{name}_max": f"max({x})",
        }
    return [F.expr(f"{sql} AS {name}") for name, sql in sums.items()]


def _merged_sums() -> list[Column]:
    """The same sums over rows that already are sums."""
    edges = [f"{fn}({s}_{fn}) AS {s}_{fn}" for s in _SPREADS for fn in ("min", "max")]
    return [F.expr(sql) for sql in [f"sum({c}) AS {c}" for c in _SUMS] + edges]


def _add_totals(segments: DataFrame, name: str, pick: str = "true") -> DataFrame:
    """Overall mean and sample deviation of one measure, on every segment row.

    ``pick`` marks the grand-total row; without it the segments themselves add
    up to the total. The deviation is null unless there are enough values and
    they are not all equal (min and max settle that without rounding doubt).
    """

    def total(part: str) -> str:
        fn = part if part in ("min", "max") else "sum"
        return f"{fn}(CASE WHEN {pick} THEN {name}_{part} END) OVER ()"

    totals = segments.selectExpr("*", *[f"{total(part)} AS _{part}" for part in ("n", "sum", "sq", "min", "max")])
    usable = f"_n >= {MIN_VALUES_FOR_ZSCORE} AND _max > _min"
    return totals.selectExpr(
        *segments.columns,
        f"try_divide(_sum, _n) AS {name}_mean_all",
        f"CASE WHEN {usable} THEN sqrt(greatest(_sq - _sum * _sum / _n, 0D) / (_n - 1)) END AS {name}_std_all",
    )


# --------------------------------------------------------------------------
# rules: SQL that turns the sums of one segment into an anomaly struct or null
# --------------------------------------------------------------------------
def _literal(value: str | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(value)!r}D"


def _text(template: str, *args: str) -> str:
    """``template`` with each ``{}`` replaced by the next SQL expression."""
    return f"format_string({', '.join([_literal(template.replace('%', '%%').replace('{}', '%s')), *args])})"


def _number(sql: str, digits: int, unit: str = "") -> str:
    return f"format_string('%.{digits}f{unit}', {sql})"


def _percent(sql: str, digits: int) -> str:
    return _number(f"({sql}) * 100", digits, "%%")


def _anomaly(
    kind: str,
    fires: str,
    metric: str,
    threshold: str,
    n: str,
    segment: str,
    described_by: list[str],
    advised_by: list[str],
    supporting: dict[str, str],
    graded: str | None = None,
) -> str:
    """The anomaly of a segment for which ``fires`` holds; severity grades the metric (or ``graded``)."""
    cuts, lowest, full_confidence_at = SEVERITY_CUTS[kind]
    grades = " ".join(f"WHEN {graded or metric} > {_literal(cut)} THEN '{level}'" for level, cut in cuts)
    description, recommendation = REPORT_TEXTS[kind]
    pairs = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in supporting.items())
    return f"""CASE WHEN {fires} THEN named_struct(
        'anomaly_type', '{kind}',
        'severity', CASE {grades} ELSE '{lowest}' END,
        'description', {_text(description, *described_by)},
        'affected_segment', {segment},
        'metric_value', CAST({metric} AS DOUBLE),
        'threshold', CAST({threshold} AS DOUBLE),
        'confidence', least(1D, {n} / {_literal(full_confidence_at)}),
        'recommendation', {_text(recommendation, *advised_by)},
        'supporting_data', map({pairs}),
        'n', CAST({n} AS BIGINT)) END"""


def _rate_rule(
    kind: str,
    count: str,
    limit: float,
    t: Thresholds,
    segment: str,
    digits: int,
    advised_by: list[str],
    names: tuple[str, str],
) -> str:
    """Fires where the share of orders counted in ``count`` is above ``limit``."""
    rate, cut = f"({count} / n)", _literal(limit)
    return _anomaly(
        kind,
        fires=f"n >= {t.min_segment_orders} AND {rate} > {cut}",
        metric=rate,
        threshold=cut,
        n="n",
        segment=segment,
        described_by=[_percent(rate, digits), _percent(cut, digits), segment],
        advised_by=advised_by,
        supporting={names[0]: count, names[1]: "n"},
    )


def _late_rule(t: Thresholds) -> str:
    segment = _text("Market={}, Shipping Mode={}", "market", "shipping_mode")
    names = ("late_orders", "segment_order_count")
    advised_by = ["shipping_mode", "market"]
    return _rate_rule("late_delivery_spike", "late_sum", t.late_delivery_rate, t, segment, 1, advised_by, names)


def _cancel_rule(t: Thresholds) -> str:
    segment = _text("Market={}", "market")
    names = ("canceled_orders", "total_orders")
    return _rate_rule("cancellation_surge", "cancel_n", t.cancellation_rate, t, segment, 1, ["market"], names)


def _fraud_rule(t: Thresholds, by_region: bool) -> str:
    segment = _text("Market={}", "market")
    if by_region:
        both = _text("Market={}, Region={}", "market", "region")
        segment = f"CASE WHEN region = market THEN {segment} ELSE {both} END"
    names = ("fraud_orders", "total_orders")
    return _rate_rule("fraud_cluster", "fraud_n", t.fraud_rate, t, segment, 2, [segment], names)


# How a segment column is named in labels.
SEGMENT_LABELS = {"category": "Category Name", "shipping_mode": "Shipping Mode"}


def _profit_rule(t: Thresholds, key: str) -> str:
    label, rate, mean = SEGMENT_LABELS[key], "(loss_n / n)", "try_divide(profit_sum, profit_n)"
    return _anomaly(
        "profit_erosion",
        fires=f"n >= {t.min_segment_orders} AND {rate} > {_literal(t.profit_negative_rate)}",
        metric=rate,
        threshold=_literal(t.profit_negative_rate),
        n="n",
        segment=_text(label + "={}", key),
        described_by=[_percent(rate, 1), _literal(label), key, _number(mean, 2)],
        advised_by=[key],
        supporting={"avg_profit": f"bround({mean}, 2)", "loss_order_count": "loss_n", "total_orders": "n"},
    )


def _zscore_rule(
    kind: str, spread: str, limit: float, t: Thresholds, key: str, n: str, names: tuple[str, str]
) -> str:
    """Fires where a segment mean lies more than ``limit`` overall deviations above the overall mean."""
    mean, overall, std = f"try_divide({spread}_sum, {spread}_n)", f"{spread}_mean_all", f"{spread}_std_all"
    z = f"try_divide({mean} - {overall}, {std})"
    return _anomaly(
        kind,
        fires=f"{n} >= {t.min_segment_orders} AND {z} > {_literal(limit)}",
        metric=mean,
        threshold=f"{overall} + {_literal(limit)} * {std}",
        n=n,
        segment=_text(SEGMENT_LABELS[key] + "={}", key),
        described_by=[key, _number(mean, 1), _number(z, 2), _number(overall, 1)],
        advised_by=[key],
        supporting={
            names[0]: f"bround({mean}, 2)",
            names[1]: f"bround({overall}, 2)",
            "z_score": f"bround({z}, 3)",
            "segment_order_count": n,
        },
        graded=z,
    )


def _gap_rule(t: Thresholds) -> str:
    # size counts all orders of the mode, with or without a known gap
    names = ("segment_avg_gap", "overall_avg_gap")
    return _zscore_rule("shipping_gap_outlier", "gap", t.shipping_gap_zscore, t, "shipping_mode", "n", names)


def _demand_rule(t: Thresholds, key: str) -> str:
    # size counts only orders with a known quantity
    names = ("segment_avg_qty", "overall_avg_qty")
    return _zscore_rule("demand_spike", "qty", t.quantity_zscore, t, key, "qty_n", names)


def _detect(orders: DataFrame, keys: list[str], needed: list[str], rule: str, spread: str | None = None) -> DataFrame:
    """One detector on its own: aggregate to its segments, apply its rule."""
    have = set(orders.columns)
    if not {*keys, *needed} <= have:
        return empty_frame(orders.sparkSession, schemas.ANOMALY)
    segments = orders.groupBy(*keys).agg(*_row_sums(have))
    if spread:
        segments = _add_totals(segments, spread)
    known = " AND ".join(f"{key} IS NOT NULL" for key in keys)
    return segments.filter(known).selectExpr(f"{rule} AS a").filter("a IS NOT NULL").select("a.*")


def late_delivery_spikes(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN1: market x shipping mode with too many late orders. ``orders`` comes from `prepare_orders`."""
    return _detect(orders, ["market", "shipping_mode"], ["late_delivery_risk"], _late_rule(t))


def shipping_gap_outliers(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN2: shipping modes whose mean day gap stands out against all orders."""
    return _detect(orders, ["shipping_mode"], ["day_gap"], _gap_rule(t), "gap")


def cancellation_surges(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN3: markets with too many cancelled orders."""
    return _detect(orders, ["market"], ["order_status"], _cancel_rule(t))


def fraud_clusters(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN4: market x region (market alone when there is no region) with too much suspected fraud."""
    by_region = "region" in orders.columns
    keys = ["market", "region"] if by_region else ["market"]
    return _detect(orders, keys, ["order_status"], _fraud_rule(t, by_region))


def _segment_key(columns: set[str] | list[str]) -> str:
    return "category" if "category" in columns else "shipping_mode"


def profit_erosion(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN5: categories (modes when there is no category) with too many loss-making orders."""
    key = _segment_key(orders.columns)
    return _detect(orders, [key], ["profit"], _profit_rule(t, key))


def demand_spikes(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN6: categories (modes when there is no category) whose mean quantity stands out."""
    key = _segment_key(orders.columns)
    return _detect(orders, [key], ["quantity"], _demand_rule(t, key), "qty")


# --------------------------------------------------------------------------
# the whole report
# --------------------------------------------------------------------------
def run_all(orders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """AN8: all detectors in one pass, numbered in run order, severest first.

    Adds ``anomaly_id`` (one counter over all detectors, segment keys
    ascending) and ``position`` (stable order by severity, then id).
    """
    have = set(orders.columns)
    dims = [c for c in DIMENSIONS if any(c in p[1] for p in _plan(have, t))]
    return report(orders.groupBy(*dims).agg(*_row_sums(have)), have, t)


#: Columns by which orders are summed up.
DIMENSIONS = ("market", "shipping_mode", "region", "category")


def span_cells(orders: DataFrame, span: str = "day", day: str = "order_date") -> DataFrame:
    """AN8 to be stored: the sums of prepared orders per span of days and cell of `DIMENSIONS` (those that the table has)."""
    have = set(orders.columns)
    begins = F.date_trunc(span, F.col(day).cast("date")).cast("date").cast("string").alias("span")
    return orders.groupBy(begins, *[c for c in DIMENSIONS if c in have]).agg(*_row_sums(have))


def write_cells(cells: DataFrame, path: str) -> None:
    """Store the cells of some spans in place of those spans' former ones; the files of other spans stay as they are."""
    by_span = cells.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_span.partitionBy("span").parquet(path)


def report_of_cells(cells: DataFrame, columns: set[str], t: Thresholds = Thresholds()) -> DataFrame:
    """AN8 of any spans from their stored cells, without the orders; ``columns`` are those that the prepared orders had."""
    return report(cells, set(columns), t)


def _plan(have: set[str], t: Thresholds) -> list[tuple]:
    """(rule number, grouping columns, columns the detector needs, rule) of the detectors that the columns allow."""
    key = _segment_key(have)
    by_region = "region" in have
    plan = [
        (0, ("market", "shipping_mode"), {"late_delivery_risk"}, _late_rule(t)),
        (1, ("shipping_mode",), {"day_gap"}, _gap_rule(t)),
        (2, ("market",), {"order_status"}, _cancel_rule(t)),
        (3, ("market", "region") if by_region else ("market",), {"order_status"}, _fraud_rule(t, by_region)),
        (4, (key,), {"profit"}, _profit_rule(t, key)),
        (5, (key,), {"quantity"}, _demand_rule(t, key)),
    ]
    return [p for p in plan if {*p[1], *p[2]} <= have]


def report(cells: DataFrame, have: set[str], t: Thresholds) -> DataFrame:
    """The report of orders that are summed up in cells; ``have`` are the columns of the orders."""
    plan = _plan(have, t)
    if not plan:
        ids = "anomaly_id string, position int"
        empty = empty_frame(cells.sparkSession, schemas.ANOMALY)
        return empty_frame(cells.sparkSession, ids).join(empty, F.lit(True), "left").select(
            "anomaly_id", *empty.columns, "position"
        )

    dims = [c for c in DIMENSIONS if any(c in p[1] for p in plan)]
    sets = sorted({p[1] for p in plan}) + [()]
    grouping_id = F.grouping_id(*dims)
    segments = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        grouping_id.alias("gid"), *_merged_sums()
    )

    def gid_of(grouped: tuple[str, ...]) -> int:
        return sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in grouped)

    for name in _SPREADS:
        segments = _add_totals(segments, name, f"gid = {gid_of(())}")

    candidates = []
    for number, grouped, _, rule in plan:
        applies = " AND ".join([f"gid = {gid_of(grouped)}", *[f"{c} IS NOT NULL" for c in grouped]])
        second = grouped[1] if len(grouped) > 1 else "''"
        candidates.append(
            f"CASE WHEN {applies} THEN named_struct('ord', {number}, 'k1', CAST({grouped[0]} AS STRING), "
            f"'k2', CAST({second} AS STRING), 'a', {rule}) END"
        )
    found = (
        segments.selectExpr(f"explode(array({', '.join(candidates)})) AS c")
        .filter("c.a IS NOT NULL")
        .selectExpr("c.ord", "c.k1", "c.k2", "c.a.*")
    )

    prefixes = ", ".join(_literal(p) for p in ANOMALY_TYPES.values())
    return (
        found.withColumn("_number", F.row_number().over(Window.orderBy("ord", "k1", "k2")))
        .withColumn("position", F.row_number().over(Window.orderBy(F.desc(severity_rank("severity")), "_number")))
        .selectExpr(
            f"format_string('%s_%04d', element_at(array({prefixes}), ord + 1), _number) AS anomaly_id",
            *schemas.ANOMALY.names,
            "position",
        )
    )


def rounded(anomalies: DataFrame) -> DataFrame:
    """Published form: metric, threshold and confidence rounded half-even to four decimals."""
    return anomalies.withColumns({c: F.bround(c, 4) for c in ("metric_value", "threshold", "confidence")})


def correlate(anomalies: DataFrame) -> DataFrame:
    """AN7: segments with more than one anomaly.

    At most one anomaly per detector can name a segment, so a collected list
    has six entries or fewer.
    """
    order = F.col("position")
    return (
        anomalies.groupBy(F.col("affected_segment").alias("segment"))
        .agg(
            F.sort_array(F.collect_list(F.struct(order.alias("o"), "anomaly_id", "anomaly_type"))).alias("items"),
            F.max(severity_rank("severity")).alias("_rank"),
        )
        .filter(F.size("items") > 1)
        .select(
            "segment",
            F.col("items.anomaly_id").alias("correlated_anomaly_ids"),
            F.col("items.anomaly_type").alias("anomaly_types"),
            F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("_rank")).alias("max_severity"),
            F.lit(True).alias("compound_risk"),
            F.expr(f"{_text(CORRELATION_NOTE, 'size(items)')} AS note"),
            F.col("items")[0]["o"].alias("first_position"),
        )
        .orderBy(F.desc(severity_rank("max_severity")), "first_position")
    )


def severity_summary(anomalies: DataFrame) -> DataFrame:
    """AN9: count per severity, zero-filled (one row)."""
    return anomalies.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("HIGH", "MEDIUM", "LOW")])


def report_header(orders: DataFrame, anomalies: DataFrame) -> DataFrame:
    """AN10: orders analysed, anomaly count, rate and run time (one row)."""
    total = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        anomalies.agg(F.count(F.lit(1)).alias("anomaly_count"))
        .withColumn("total_orders_analyzed", total)
        .select(
            "total_orders_analyzed",
            "anomaly_count",
            F.bround(F.col("anomaly_count") / F.greatest(F.col("total_orders_analyzed"), F.lit(1)), 4).alias(
                "anomaly_rate"
            ),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("run_timestamp"),
        )
    )


def high_only(anomalies: DataFrame) -> DataFrame:
    """AN11: the anomalies of severity HIGH."""
    return anomalies.filter(F.col("severity") == "HIGH")


def high_summary(orders: DataFrame, t: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """AN11: the short report: header, counts per severity, HIGH anomalies in full, all correlated risks."""
    report = run_all(orders, t)
    return {
        "header": report_header(orders, report),
        "summary": severity_summary(report),
        "high_severity_anomalies": high_only(report),
        "correlated_risks": correlate(report),
    }


def thresholds_as_dict(t: Thresholds = Thresholds()) -> dict[str, float]:
    return asdict(t)
