"""Maps the TPC-H-like test tables to the shapes the operators work on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.evaluation import SUITE_METRICS

INTENTS = ("supplier_risk", "shipment_analysis", "inventory_intelligence", "general")
NODES = ("orchestrator", "supplier_risk", "shipment_analysis", "inventory_intelligence", "recommendation")
GOLDEN_CATEGORIES = ("supplier_risk", "shipment", "inventory")

_MODE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class' "
    "WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END"
)
_SCHEDULED = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END"
_REAL = "pmod(datediff(l_shipdate, o_orderdate), 7)"
_STATUS = (
    "CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' AND l_linestatus = 'O' THEN 'SUSPECTED_FRAUD' "
    "WHEN o_orderstatus = 'F' AND l_returnflag = 'A' THEN 'CANCELED' WHEN o_orderstatus = 'P' THEN 'PENDING' "
    "WHEN o_orderstatus = 'O' THEN 'PROCESSING' ELSE 'COMPLETE' END"
)
_DELIVERY = (
    "CASE WHEN o_orderstatus = 'F' AND l_returnflag = 'A' THEN 'Shipping canceled' "
    f"WHEN {_REAL} > {_SCHEDULED} THEN 'Late delivery' WHEN {_REAL} < {_SCHEDULED} THEN 'Advance shipping' "
    "ELSE 'Shipping on time' END"
)
_PROFIT = "(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice)"
ORDER_ITEM_SQL = {
    "order_id": "l_orderkey",
    "order_item_id": "l_linenumber",
    "part_id": "l_partkey",
    "supplier_id": "l_suppkey",
    "product": "p_name",
    "department": "p_brand",
    "category": "p_type",
    "customer_segment": "c_mktsegment",
    "market": "r_name",
    "region": "n_name",
    "shipping_mode": _MODE,
    "days_scheduled": _SCHEDULED,
    "days_real": _REAL,
    "late_delivery_risk": f"CAST({_REAL} > {_SCHEDULED} AS INT)",
    "order_status": _STATUS,
    "delivery_status": _DELIVERY,
    "quantity": "l_quantity",
    "sales": "l_extendedprice",
    "discount": "l_extendedprice * l_discount",
    "profit": _PROFIT,
    "profit_ratio": f"CASE WHEN l_extendedprice <> 0 THEN {_PROFIT} / l_extendedprice END",
    "order_date": "date_format(o_orderdate, 'yyyy-MM-dd')",
    "ship_date": "date_format(l_shipdate, 'yyyy-MM-dd')",
}


TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the known schema saves a job that reads file footers."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that one task reads from a file at most, by Spark's default.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores dealt over the cores, unless it has a full split for each of them.

    A file of one row group is read by one task, however many splits it has;
    what moves here is less than one split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT else df


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, spread over the cores if it comes in a few splits."""
    return spread(table(spark, sf_dir, name))


def order_items(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, dealt: bool = False, gathered: bool = False
) -> DataFrame:
    """The order-item table, joining only the dimensions the wanted columns need.

    Every key of the fact table has exactly one match in each dimension, so
    leaving a dimension out changes no row. Nation and region have a fixed size
    (25 and 5 rows) and are broadcast; for the rest Spark chooses by size.
    ``dealt`` spreads a fact table of few splits over all cores, which pays
    where the work per row is large. With ``gathered`` the rows of an order
    come together: orders have their customers before they meet the fact
    table, and do so last, so what is grouped by order moves no more.
    """
    wanted = list(columns or ORDER_ITEM_SQL)
    need = set(wanted)
    facts = table(spark, sf_dir, "lineitem")

    def with_parts(items: DataFrame) -> DataFrame:
        if need & {"product", "department", "category", "profit", "profit_ratio"}:
            items = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        return items

    def with_customers(items: DataFrame) -> DataFrame:
        if need & {"market", "region", "customer_segment"}:
            items = items.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        if need & {"market", "region"}:
            nations = table(spark, sf_dir, "nation").join(
                F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
            )
            items = items.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        return items

    items, orders = spread(facts) if dealt else facts, table(spark, sf_dir, "orders")
    of_order = F.col("l_orderkey") == F.col("o_orderkey")
    if gathered:
        items = with_parts(items).join(with_customers(orders), of_order)
    else:
        items = with_parts(with_customers(items.join(orders, of_order)))
    return items.selectExpr(*[f"{ORDER_ITEM_SQL[name]} AS {name}" for name in wanted])


def sku_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as SKUs; what the table lacks is dealt out by the key."""
    kind = "element_at(array('Pass', 'Fail', 'Pending'), CAST(p_partkey % 3 + 1 AS INT))"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_key", "concat('SKU', p_partkey) AS sku", "p_type AS product_type", "p_brand AS supplier",
        "p_retailprice AS price", "p_size * 10.25D AS revenue", "p_size * 3 AS units_sold", "p_size AS stock_levels",
        "CAST(p_partkey % 40 AS INT) AS lead_time", "CAST(p_partkey % 30 AS INT) AS manufacturing_lead_time",
        "CAST(p_partkey % 9 AS INT) AS shipping_time", "concat('Carrier ', p_partkey % 3) AS carrier",
        "'Road' AS transport_mode", "p_size / 4.0D AS shipping_cost", f"{kind} AS inspection",
        "p_partkey % 50 / 10.0D AS defect_rate",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, text, source, lang); source and lang are the metadata."""
    return texts(spark, sf_dir).select("doc_id", "text", "source", "lang")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as (doc_id, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vec): every row whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec")


def cache_entries(turns: DataFrame) -> DataFrame:
    """Turns of conversations as stores and hits of an answer cache; works on batch and streaming frames."""
    stamp = (F.col("conv_id") * 1000 + F.col("turn")).cast("double")
    return turns.select(
        F.col("text").alias("query"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("payload"),
        stamp.alias("store_ts"),
        F.when(F.col("role") == "assistant", stamp + 5000).alias("hit_ts"),
    )


def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten text of a query is the text of the next item; the last wraps to the first."""
    items = search_queries(spark, sf_dir)
    last = items.agg(F.max("query_id")).scalar()
    shifted = F.when(F.col("query_id") == 0, last).otherwise(F.col("query_id") - 1)
    return items.select(shifted.alias("query_id"), F.col("text").alias("rewritten"))


def golden_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, question, ground_truth, contexts, category) from labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kind = F.element_at(F.array(*[F.lit(c) for c in GOLDEN_CATEGORIES]), (F.col("doc_id") % 3 + 1).cast("int"))
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("pos"),
            F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"),
            F.col("text").alias("ground_truth"),
            F.array("source").alias("contexts"),
            kind.alias("category"),
            F.col("quality"),
            F.col("toxic"),
        )
    )


def metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall (tool, sample_id, metric, score) table derived from the labels."""
    cases = [
        F.struct(F.lit(tool).alias("tool"), F.lit(metric).alias("metric"), F.lit(i).alias("i"))
        for tool, metrics in SUITE_METRICS.items()
        for i, metric in enumerate(metrics)
    ]
    return (
        table(spark, sf_dir, "labels")
        .select(F.col("doc_id").alias("sample_id"), "quality", F.explode(F.array(*cases)).alias("m"))
        .select(
            "m.tool",
            "sample_id",
            "m.metric",
            (((F.col("sample_id") * (7 + 13 * F.col("m.i")) + 20 * F.col("quality")) % 101) / 100.0).alias("score"),
        )
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return turns.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("string").alias("message_id"),
        F.when(F.col("turn") % 4 == 1, "up").otherwise("down").alias("rating"),
        F.lit(None).cast("string").alias("note"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"),
    )


# Event type, then node and payload; ``event_id`` deals the values out.
_TYPE = """CASE event_type
  WHEN 'view' THEN 'node_start' WHEN 'purchase' THEN 'node_end'
  WHEN 'error' THEN IF(event_id % 2 = 0, 'node_error', 'faithfulness')
  WHEN 'click' THEN IF(event_id % 4 <> 0, 'retrieval', 'crag_retry')
  ELSE element_at(array('orchestrator_decision', 'final', 'cached', 'guard_block'), CAST(event_id % 4 + 1 AS INT)) END"""


def _pick(values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST(event_id % {len(values)} + 1 AS INT))"


def run_events(events: DataFrame) -> DataFrame:
    """The click-stream table as run telemetry; works on batch and streaming frames.

    (run_id, t, event_id, type, node, elapsed_ms, docs, max_score, faithful,
    pii_redacted, intent, severity, reason)
    """
    return events.selectExpr(
        "concat_ws('/', CAST(user_id AS STRING), date_format(date_trunc('week', ts), 'yyyy-MM-dd')) AS run_id",
        "ts AS t",
        "event_id",
        f"{_TYPE} AS type",
        "value",
    ).selectExpr(
        "run_id",
        "t",
        "event_id",
        "type",
        f"IF(type IN ('node_start', 'node_end', 'node_error'), {_pick(NODES)}, NULL) AS node",
        "IF(type IN ('node_end', 'node_error', 'retrieval'), value, NULL) AS elapsed_ms",
        "IF(type = 'retrieval', CAST(floor(value) AS BIGINT) % 6, NULL) AS docs",
        "IF(type = 'retrieval', (floor(value * 100) % 101) / 100.0D, NULL) AS max_score",
        "IF(type = 'faithfulness', value < 50, NULL) AS faithful",
        "IF(type = 'faithfulness', IF(event_id % 3 = 0, array('email'), CAST(array() AS ARRAY<STRING>)), NULL) "
        "AS pii_redacted",
        f"IF(type = 'orchestrator_decision', {_pick(INTENTS)}, NULL) AS intent",
        f"IF(type IN ('final', 'cached', 'guard_block', 'orchestrator_decision'), {_pick(('HIGH', 'MEDIUM', 'LOW'))}, "
        "NULL) AS severity",
        "IF(type = 'guard_block', 'off-topic', NULL) AS reason",
    )
