"""Dashboard aggregations (KPI group).

Each operator is one partial + final hash aggregate over a column-pruned scan.
Rates are percentages rounded half-even; null group keys and null flags are
left out as the dashboard does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.columns import flag
from riskframe.sources.readers import require


def _mean_pct(c: Column, digits: int) -> Column:
    return F.bround(F.avg(c) * 100, digits)


def _status_is(value: str) -> Column:
    return flag(F.upper("order_status") == value)


def summary(orders: DataFrame) -> DataFrame:
    """KPI1: order count, late / fraud / cancel percentages, mean profit (one row)."""
    have = set(orders.columns)
    zero = F.lit(0.0)
    status = "order_status" in have
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        (_mean_pct(F.col("late_delivery_risk"), 1) if "late_delivery_risk" in have else zero).alias(
            "late_delivery_rate_pct"
        ),
        (_mean_pct(_status_is("SUSPECTED_FRAUD"), 2) if status else zero).alias("fraud_rate_pct"),
        (_mean_pct(_status_is("CANCELED"), 1) if status else zero).alias("cancellation_rate_pct"),
        (F.bround(F.avg("profit"), 2) if "profit" in have else zero).alias("avg_profit_per_order"),
    )


@require("market", "late_delivery_risk", returns="market string, late_rate double, order_count bigint")
def late_by_market(orders: DataFrame) -> DataFrame:
    """KPI2: late percentage and count of known flags per market, worst first."""
    return (
        orders.filter(F.col("market").isNotNull())
        .groupBy("market")
        .agg(
            _mean_pct(F.col("late_delivery_risk"), 1).alias("late_rate"),
            F.count("late_delivery_risk").alias("order_count"),
        )
        .orderBy(F.desc("late_rate"), "market")
    )


@require("shipping_mode", "late_delivery_risk", returns="shipping_mode string, order_count bigint, late_rate double")
def mode_breakdown(orders: DataFrame) -> DataFrame:
    """KPI3: order count and late percentage per shipping mode, largest first."""
    return (
        orders.filter(F.col("shipping_mode").isNotNull())
        .groupBy("shipping_mode")
        .agg(F.count(F.lit(1)).alias("order_count"), _mean_pct(F.col("late_delivery_risk"), 1).alias("late_rate"))
        .orderBy(F.desc("order_count"), "shipping_mode")
    )


@require("order_status", returns="status string, count bigint")
def status_distribution(orders: DataFrame) -> DataFrame:
    """KPI4: order count per status, largest first."""
    return (
        orders.filter(F.col("order_status").isNotNull())
        .groupBy(F.col("order_status").alias("status"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "status")
    )


@require("region", "days_real", "days_scheduled", returns="region string, avg_gap_days double, order_count bigint")
def gap_by_region(orders: DataFrame, n: int = 12) -> DataFrame:
    """KPI5: the ``n`` regions with the longest mean delay."""
    gap = F.col("days_real") - F.col("days_scheduled")
    return (
        orders.filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(F.bround(F.avg(gap), 2).alias("avg_gap_days"), F.count(gap).alias("order_count"))
        .orderBy(F.desc("avg_gap_days"), "region")
        .limit(n)
    )


@require("market", "order_status", returns="market string, fraud_count bigint, total bigint, fraud_rate double")
def fraud_by_market(orders: DataFrame) -> DataFrame:
    """KPI6: suspected-fraud count, total and percentage per market."""
    return (
        orders.filter(F.col("market").isNotNull())
        .groupBy("market")
        .agg(F.sum(_status_is("SUSPECTED_FRAUD")).alias("fraud_count"), F.count(F.lit(1)).alias("total"))
        .withColumn("fraud_rate", F.bround(F.col("fraud_count") / F.col("total") * 100, 2))
        .orderBy("market")
    )


def mode_share(orders: DataFrame) -> DataFrame:
    """KPI7: each shipping mode's share of all orders, in percent.

    The unpartitioned window runs over one row per mode.
    """
    share = F.col("order_count") / F.sum("order_count").over(Window.partitionBy()) * 100
    return mode_breakdown(orders).select("shipping_mode", "order_count", share.alias("share_pct"))
