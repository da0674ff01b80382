"""SQL twins of the registered queries, for an engine other than Spark.

Written from the definitions, not from the Spark code; shared parts are common
table expressions. Only fixed values (patterns, thresholds, labels) are taken
from the operators.
"""

from __future__ import annotations

from riskframe.operators import guards

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------ common parts
ITEMS = """
items0 AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, p_name AS product, p_brand AS department,
         p_type AS category, c_mktsegment AS customer_segment, r_name AS market, n_name AS region,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
              WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END
           AS days_scheduled,
         ((date_diff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS days_real,
         CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' AND l_linestatus = 'O' THEN 'SUSPECTED_FRAUD'
              WHEN o_orderstatus = 'F' AND l_returnflag = 'A' THEN 'CANCELED'
              WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'PROCESSING'
              ELSE 'COMPLETE' END AS order_status,
         l_quantity AS quantity, l_extendedprice AS sales, l_extendedprice * l_discount AS discount,
         l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
         strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
items AS (
  SELECT *, CASE WHEN days_real > days_scheduled THEN 1 ELSE 0 END AS late,
         CASE WHEN order_status = 'CANCELED' THEN 'Shipping canceled'
              WHEN days_real > days_scheduled THEN 'Late delivery'
              WHEN days_real < days_scheduled THEN 'Advance shipping' ELSE 'Shipping on time' END AS delivery_status,
         CASE WHEN sales <> 0 THEN profit / sales END AS profit_ratio
  FROM items0)"""

SEVERITY = """CASE WHEN late = 1 OR contains(lower(delivery_status), 'cancel')
       OR contains(lower(delivery_status), 'suspect') OR profit < -50 THEN 'HIGH'
     WHEN contains(lower(delivery_status), 'late') OR profit < 0 THEN 'MEDIUM' ELSE 'LOW' END"""

TOKENS = """
doc_tokens AS (
  SELECT doc_id, lower(t) AS token
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents)),
query_tokens AS (
  SELECT item_id AS query_id, lower(t) AS token
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM benchmark))"""


def _hashed(name: str, key: str, source: str, text: str = "text") -> str:
    """CTE of unit vectors as sparse rows (key, b, v)."""
    return f"""
{name}_c AS (
  SELECT {key}, ('0x' || substr(md5(lower(t)), 1, 4))::INT % 64 AS b, count(*)::DOUBLE AS c
  FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS t FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS v FROM {name}_c)"""


# ------------------------------------------------------------------ sources, tables
ORACLES["sample_orders"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity
FROM (SELECT *, md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR,
             l_suppkey::VARCHAR, l_shipdate::VARCHAR, '42')) AS h FROM lineitem)
ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 2500"""

ORACLES["corpus_upsert"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1"""

ORACLES["pending_sources"] = "SELECT DISTINCT source AS key FROM documents WHERE source >= 'src2'"

# ------------------------------------------------------------------ functions, documents
ORACLES["order_severity"] = f"""
WITH {ITEMS}
SELECT shipping_mode, delivery_status, {SEVERITY} AS severity, count(*) AS orders
FROM items GROUP BY ALL"""

def _fixed(x: str) -> str:
    """Two decimals of the number as it is written, ties away from zero."""
    rounded = f"({x})::VARCHAR::DECIMAL(38, 2)"
    return f"(CASE WHEN {x} < 0 AND {rounded} = 0 THEN '-' ELSE '' END || {rounded}::VARCHAR)"


ORDER_TEXT = f"""'Order ' || order_id || ' placed on ' || order_date || ', shipped on ' || ship_date || '. Product: '
       || product || ' (category ' || category || ', department ' || department || '). Customer segment '
       || customer_segment || '; destination unknown, unknown (region ' || region || ', market ' || market
       || '). Shipping mode: ' || shipping_mode || '. Delivery status: ' || delivery_status || '. Order status: '
       || order_status || '. Shipment took ' || days_real || ' days vs ' || days_scheduled || ' scheduled ('
       || CASE WHEN days_real > days_scheduled THEN '+' ELSE '' END || (days_real - days_scheduled) || ' days). '
       || CASE WHEN late = 1 THEN 'This order was flagged with late-delivery risk.'
               ELSE 'No late-delivery risk was flagged.' END
       || ' Quantity ' || quantity::BIGINT || '. Order generated profit of ' || {_fixed("profit")} || ' (ratio '
       || {_fixed("coalesce(profit_ratio, 0)")} || '); sales ' || {_fixed("sales")} || ', discount ' || {_fixed("discount")}
       || '. Severity: ' || {SEVERITY} || '.'"""
ORACLES["order_incidents"] = f"""
WITH {ITEMS}
SELECT md5('dataco::' || order_id || '::' || order_item_id) AS id, {ORDER_TEXT} AS text, 'dataco' AS source,
       order_id::BIGINT AS order_id, product, category, department, market, region, 'unknown' AS order_country,
       'unknown' AS order_city, customer_segment, shipping_mode, delivery_status, order_status,
       days_real::BIGINT AS days_real, days_scheduled::BIGINT AS days_scheduled,
       (days_real - days_scheduled)::BIGINT AS delay_days, late::BIGINT AS late_delivery_risk, round(sales, 4) AS sales,
       round(profit, 4) AS profit, round(coalesce(profit_ratio, 0), 6) AS profit_ratio, {SEVERITY} AS severity,
       order_date, ship_date FROM items"""

ORACLES["generic_incidents"] = """
WITH t AS (
  SELECT *, 'p_name: ' || p_name || '; p_brand: ' || p_brand || '; p_type: ' || p_type
         || '; p_size: ' || p_size || '; p_retailprice: ' || p_retailprice AS text FROM part)
SELECT md5('custom::' || p_partkey || '::' || text) AS id, text,
       concat_ws(',', 'p_brand=' || p_brand, 'p_name=' || p_name, 'p_retailprice=' || p_retailprice, 'p_size=' || p_size,
                 'p_type=' || p_type, 'row_index=' || p_partkey, 'source=custom') AS metadata FROM t"""

SKUS = """
skus AS (
  SELECT *, CASE WHEN defect_rate > 3 OR lower(inspection) = 'fail' THEN 'HIGH'
                 WHEN defect_rate > 1 OR stock_levels < 20 OR lead_time > 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT p_partkey, 'SKU' || p_partkey AS sku, p_type AS product_type, p_brand AS supplier, 'unknown' AS location,
               p_retailprice AS price, p_size * 10.25::DOUBLE AS revenue, (p_size * 3)::BIGINT AS units_sold,
               p_size::BIGINT AS stock_levels, (p_partkey % 40)::BIGINT AS lead_time,
               (p_partkey % 30)::BIGINT AS manufacturing_lead_time, (p_partkey % 9)::BIGINT AS shipping_time,
               'Carrier ' || (p_partkey % 3) AS carrier, 'Road' AS transport_mode, 'unknown' AS route,
               p_size / 4.0::DOUBLE AS shipping_cost, ['Pass', 'Fail', 'Pending'][p_partkey % 3 + 1] AS inspection,
               (p_partkey % 50) / 10.0::DOUBLE AS defect_rate FROM part))"""
ORACLES["sku_incidents"] = f"""
WITH {SKUS}
SELECT md5('fashion::' || sku || '::' || p_partkey) AS id,
       'SKU ' || sku || ' (' || product_type || ') supplied by ' || supplier || ' from ' || location || '. Price '
       || {_fixed("price")} || '; revenue ' || {_fixed("revenue")} || '; ' || units_sold || ' units sold; stock level '
       || stock_levels || '. Lead time ' || lead_time || ' days (manufacturing ' || manufacturing_lead_time
       || ' days); shipping ' || shipping_time || ' days via ' || carrier || ' (' || transport_mode || ', route ' || route
       || '); shipping cost ' || {_fixed("shipping_cost")} || '. Inspection: ' || inspection || '; defect rate '
       || {_fixed("defect_rate")} || '%. Severity: ' || severity || '.' AS text,
       'fashion' AS source, sku, product_type, supplier, location, price, revenue, stock_levels, units_sold, lead_time,
       manufacturing_lead_time, shipping_time, shipping_cost, carrier, transport_mode, route, defect_rate, inspection,
       severity FROM skus"""
ORACLES["csv_skus"] = f"""
WITH {SKUS}
SELECT sku, product_type, supplier, price, revenue, units_sold::INT AS units_sold, stock_levels::INT AS stock_levels,
       lead_time::INT AS lead_time, shipping_cost, inspection, defect_rate FROM skus"""
ORACLES["csv_orders"] = f"""
WITH {ITEMS}
SELECT order_id, order_item_id::BIGINT AS order_item_id, product, category, department, customer_segment, market, region,
       shipping_mode, delivery_status, order_status, days_real::INT AS days_real, days_scheduled::INT AS days_scheduled,
       late::INT AS late_delivery_risk, quantity, round(sales, 4) AS sales, round(discount, 4) AS discount,
       round(profit, 4) AS profit, order_date, ship_date FROM items"""
_ONE_ITEM = f"""{ITEMS},
one AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id
                                                       ORDER BY ship_date DESC, sales DESC, product DESC, department DESC) = 1)"""
ORACLES["stream_incidents"] = ORACLES["stream_store"] = ORACLES["ingest_corpus"] = f"""
WITH {_ONE_ITEM}
SELECT md5('dataco::' || order_id || '::' || order_item_id) AS id, {ORDER_TEXT} AS text, 'dataco' AS source, market,
       order_status, {SEVERITY} AS severity, ship_date, round(sales, 4) AS sales, round(profit, 4) AS profit,
       days_real::DOUBLE AS days_real FROM one"""
ORACLES["ingest_log"] = """
SELECT 'parts' AS run_key, unnest(['done', 'already_loaded']) AS state, count(*) AS rows_loaded, count(*) AS docs_built FROM part"""
ORACLES["store_upsert"] = """
SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' second edition' ELSE '' END AS text, source, 64 AS dim
FROM documents"""
ORACLES["store_cleared"] = "SELECT doc_id, text FROM documents"
ORACLES["text_cells"] = """
SELECT conv_id, turn, trim(text, E' \\t\\n\\r\\u00a0\\u3000') AS stripped,
       CASE WHEN role = 'user' THEN 'unknown' ELSE trim(text, E' \\t\\n\\r\\u00a0\\u3000') END AS cell FROM conversations"""
ORACLES["numeric_cells"] = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars % 7 WHEN 1 THEN n_chars % 7 + 0.5 WHEN 2 THEN -1
                               ELSE (n_chars % 7) * 100 END::DOUBLE AS number,
       CASE doc_id % 4 WHEN 0 THEN n_chars % 7 WHEN 1 THEN n_chars % 7 WHEN 2 THEN -1 ELSE (n_chars % 7) * 100 END::BIGINT
         AS whole FROM documents"""
ORACLES["severity_cells"] = """
SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE o_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank FROM orders"""
ORACLES["row_metadata"] = """
SELECT c_custkey, concat_ws(',', 'c_mktsegment=' || nullif(c_mktsegment, 'BUILDING'), 'c_name=' || c_name,
                            'c_nationkey=' || c_nationkey) AS metadata FROM customer"""
ORACLES["manifest_state"] = """
SELECT key, rows, docs, loaded_at FROM (
  SELECT source AS key, n_chars AS rows, doc_id AS docs, doc_id::DOUBLE AS loaded_at, doc_id % 7 = 0 AS removed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents)
WHERE r = 1 AND NOT removed"""
ORACLES["feedback_accepted"] = """
SELECT conv_id::VARCHAR AS session_id, turn::VARCHAR AS message_id, CASE WHEN turn % 4 = 1 THEN 'up' ELSE 'down' END AS rating
FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0"""
ORACLES["json_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLES["json_array"] = ORACLES["json_documents"]
ORACLES["csv_encodings"] = r"SELECT doc_id, source, trim(regexp_replace(text, '[\s\\]+', ' ', 'g')) AS text FROM documents"
ORACLES["source_listing"] = """
SELECT 'source=' || source AS folder, '.csv' AS ext, 13 * count(*) AS length, source < 'src2' AS loaded,
       CASE WHEN source < 'src2' THEN count(*) ELSE 0 END AS loaded_docs FROM documents GROUP BY source"""
ORACLES["source_choice"] = """
SELECT 'orders' AS dataset, 'source=' || arg_max(source, (n, source)) AS folder FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
UNION ALL SELECT 'skus', 'source=' || min(source) FROM documents"""
ORACLES["csv_suppliers"] = "SELECT s_suppkey::INT AS s_suppkey, * EXCLUDE (s_suppkey) FROM supplier"

# ------------------------------------------------------------------ dashboard
ORACLES["kpi_summary"] = f"""
WITH {ITEMS}
SELECT count(*) AS total_orders, round(avg(late) * 100, 1) AS late_delivery_rate_pct,
       round(count_if(order_status = 'SUSPECTED_FRAUD') * 100.0::DOUBLE / count(*), 2) AS fraud_rate_pct,
       round(count_if(order_status = 'CANCELED') * 100.0::DOUBLE / count(*), 1) AS cancellation_rate_pct,
       round(avg(profit), 2) AS avg_profit_per_order FROM items"""

ORACLES["late_by_market"] = f"""
WITH {ITEMS}
SELECT market, round(avg(late) * 100, 1) AS late_rate, count(*) AS order_count FROM items GROUP BY market"""

ORACLES["mode_breakdown"] = f"""
WITH {ITEMS}
SELECT shipping_mode, count(*) AS order_count, round(avg(late) * 100, 1) AS late_rate
FROM items GROUP BY shipping_mode"""

ORACLES["status_distribution"] = f"""
WITH {ITEMS} SELECT order_status AS status, count(*) AS count FROM items GROUP BY 1"""

ORACLES["gap_by_region"] = f"""
WITH {ITEMS}
SELECT region, round(avg(days_real - days_scheduled), 2) AS avg_gap_days, count(*) AS order_count
FROM items GROUP BY region ORDER BY 2 DESC, 1 LIMIT 12"""

ORACLES["fraud_by_market"] = f"""
WITH {ITEMS}
SELECT market, count_if(order_status = 'SUSPECTED_FRAUD')::BIGINT AS fraud_count, count(*) AS total,
       round(count_if(order_status = 'SUSPECTED_FRAUD')::DOUBLE / count(*) * 100, 2) AS fraud_rate
FROM items GROUP BY market"""

ORACLES["mode_share"] = f"""
WITH {ITEMS}
SELECT shipping_mode, count(*) AS order_count,
       round(count(*)::DOUBLE / (SELECT count(*) FROM items) * 100, 6) AS share_pct
FROM items GROUP BY shipping_mode"""


# ------------------------------------------------------------------ anomalies
def _detectors(late=0.40, gap_z=2.5, cancel=0.15, fraud=0.02, loss=0.30, qty_z=2.5, source="items", least=50) -> str:
    """CTE ``found`` with one row per anomaly; ord and keys give the run order."""
    pct = lambda x, digits=1: f"printf('%.{digits}f%%', ({x}) * 100)"
    num = lambda x, digits: f"printf('%.{digits}f', {x})"
    held = lambda *kv: " || ',' || ".join(f"'{k}=' || printf('%.3f', ({v})::DOUBLE)" for k, v in sorted(kv))
    gap_z_of = "((avg(days_real - days_scheduled) - any_value(m)) / any_value(s))"
    qty_z_of = "((avg(quantity) - any_value(qm)) / any_value(qs))"
    late_held = held(("late_orders", "sum(late)"), ("segment_order_count", "count(*)"))
    gap_held = held(
        ("segment_avg_gap", "round_even(avg(days_real - days_scheduled), 2)"),
        ("overall_avg_gap", "round_even(any_value(m), 2)"),
        ("z_score", f"round_even({gap_z_of}, 3)"),
        ("segment_order_count", "count(*)"),
    )
    qty_held = held(
        ("segment_avg_qty", "round_even(avg(quantity), 2)"),
        ("overall_avg_qty", "round_even(any_value(qm), 2)"),
        ("z_score", f"round_even({qty_z_of}, 3)"),
        ("segment_order_count", "count(quantity)"),
    )
    loss_held = held(("avg_profit", "round_even(p, 2)"), ("loss_order_count", "c"), ("total_orders", "n"))
    return f"""
d1 AS (SELECT 0 AS ord, market AS k1, shipping_mode AS k2, 'late_delivery_spike' AS anomaly_type,
         CASE WHEN avg(late) > 0.6::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         'Market=' || market || ', Shipping Mode=' || shipping_mode AS affected_segment,
         avg(late) AS metric_value, {late}::DOUBLE AS threshold, least(1.0::DOUBLE, count(*) / 500.0::DOUBLE) AS confidence,
         count(*) AS n,
         'Late delivery rate ' || {pct("avg(late)")} || ' exceeds ' || {pct(f"{late}::DOUBLE")} || ' threshold for Market='
           || market || ', Shipping Mode=' || shipping_mode AS description,
         'Audit carrier performance for ' || shipping_mode || ' routes in ' || market || '. Consider alternative carriers '
           || 'or upgraded shipping mode for critical orders.' AS recommendation, {late_held} AS supporting
       FROM {source} GROUP BY market, shipping_mode HAVING count(*) >= {least} AND avg(late) > {late}::DOUBLE),
g AS (SELECT avg(days_real - days_scheduled) AS m, stddev_samp(days_real - days_scheduled) AS s,
        avg(quantity) AS qm, stddev_samp(quantity) AS qs FROM {source}),
d2 AS (SELECT 1, shipping_mode, '', 'shipping_gap_outlier', CASE WHEN {gap_z_of} > 3.5::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END,
         'Shipping Mode=' || shipping_mode, avg(days_real - days_scheduled), any_value(m) + {gap_z}::DOUBLE * any_value(s),
         least(1.0::DOUBLE, count(*) / 300.0::DOUBLE), count(*),
         'Shipping mode ''' || shipping_mode || ''' has avg day gap ' || {num("avg(days_real - days_scheduled)", 1)}
           || ' days (z=' || {num(gap_z_of, 2)} || ') vs overall mean ' || {num("any_value(m)", 1)},
         'Review carrier SLAs for ''' || shipping_mode || '''. Investigate root cause of extended transit times.', {gap_held}
       FROM {source}, g GROUP BY shipping_mode
       HAVING count(*) >= {least} AND {gap_z_of} > {gap_z}::DOUBLE),
d3 AS (SELECT 2, market, '', 'cancellation_surge', CASE WHEN r > 0.25::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END,
         'Market=' || market, r, {cancel}::DOUBLE, least(1.0::DOUBLE, n / 500.0::DOUBLE), n,
         'Cancellation rate ' || {pct("r")} || ' exceeds ' || {pct(f"{cancel}::DOUBLE")} || ' threshold for Market=' || market,
         'Investigate cancellation drivers in ' || market || '. Check for shipping delays, out-of-stock events, or payment '
           || 'failures.', {held(("canceled_orders", "c"), ("total_orders", "n"))}
       FROM (SELECT market, avg(CASE WHEN order_status = 'CANCELED' THEN 1.0::DOUBLE ELSE 0 END) AS r, count(*) AS n,
                    count_if(order_status = 'CANCELED') AS c
             FROM {source} GROUP BY market) WHERE n >= {least} AND r > {cancel}::DOUBLE),
d4 AS (SELECT 3, market, region, 'fraud_cluster', CASE WHEN r > 0.05::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END, seg,
         r, {fraud}::DOUBLE, least(1.0::DOUBLE, n / 200.0::DOUBLE), n,
         'Suspected fraud rate ' || {pct("r", 2)} || ' exceeds ' || {pct(f"{fraud}::DOUBLE", 2)} || ' threshold for ' || seg,
         'Escalate ' || seg || ' for fraud review. Implement additional verification for new orders in this segment.',
         {held(("fraud_orders", "c"), ("total_orders", "n"))}
       FROM (SELECT market, region, avg(CASE WHEN order_status = 'SUSPECTED_FRAUD' THEN 1.0::DOUBLE ELSE 0 END) AS r,
                    count(*) AS n, count_if(order_status = 'SUSPECTED_FRAUD') AS c,
                    CASE WHEN market = region THEN 'Market=' || market ELSE 'Market=' || market || ', Region=' || region END AS seg
             FROM {source} GROUP BY market, region) WHERE n >= {least} AND r > {fraud}::DOUBLE),
d5 AS (SELECT 4, category, '', 'profit_erosion',
         CASE WHEN r > 0.5::DOUBLE THEN 'HIGH' WHEN r > 0.3::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END,
         'Category Name=' || category, r, {loss}::DOUBLE, least(1.0::DOUBLE, n / 500.0::DOUBLE), n,
         {pct("r")} || ' of orders in Category Name=''' || category || ''' are loss-making. Avg profit: ' || {num("p", 2)},
         'Cost audit required for ''' || category || '''. Review pricing, discount rates, and fulfillment cost structure.',
         {loss_held}
       FROM (SELECT category, avg(CASE WHEN profit < 0 THEN 1.0::DOUBLE ELSE 0 END) AS r, count(*) AS n,
                    avg(profit) AS p, count_if(profit < 0) AS c
             FROM {source} GROUP BY category) WHERE n >= {least} AND r > {loss}::DOUBLE),
d6 AS (SELECT 5, category, '', 'demand_spike', CASE WHEN {qty_z_of} > 3.0::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END,
         'Category Name=' || category, avg(quantity), any_value(qm) + {qty_z}::DOUBLE * any_value(qs),
         least(1.0::DOUBLE, count(quantity) / 300.0::DOUBLE), count(quantity),
         'Order quantity spike in ''' || category || ''': avg ' || {num("avg(quantity)", 1)} || ' units (z='
           || {num(qty_z_of, 2)} || ') vs overall ' || {num("any_value(qm)", 1)},
         'Verify inventory levels for ''' || category || '''. Demand spike may indicate pre-positioning or promotional surge.',
         {qty_held}
       FROM {source}, g GROUP BY category
       HAVING count(quantity) >= {least} AND {qty_z_of} > {qty_z}::DOUBLE),
found AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3
          UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY ord, k1, k2) AS num,
         CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS sev FROM found),
report AS (
  SELECT *, ['LDS', 'SGO', 'CAS', 'FRC', 'PRF', 'DMS'][ord + 1] || '_' || lpad(num::VARCHAR, 4, '0') AS anomaly_id,
         row_number() OVER (ORDER BY sev, num)::INT AS position FROM numbered)"""


LOW = dict(gap_z=0.5, cancel=0.11, loss=0.235, qty_z=0.01)
SHOWN = """anomaly_type, severity, affected_segment, round(metric_value, 6) AS metric_value,
       round(threshold, 6) AS threshold, round(confidence, 6) AS confidence, n, description, recommendation, supporting"""

for _name, _kind, _t in [
    ("late_delivery_spikes", "late_delivery_spike", {}),
    ("shipping_gap_outliers", "shipping_gap_outlier", LOW),
    ("cancellation_surges", "cancellation_surge", LOW),
    ("fraud_clusters", "fraud_cluster", {}),
    ("profit_erosion", "profit_erosion", LOW),
    ("demand_spikes", "demand_spike", LOW),
]:
    ORACLES[_name] = f"WITH {ITEMS}, {_detectors(**_t)} SELECT {SHOWN} FROM report WHERE anomaly_type = '{_kind}'"

ORACLES["anomaly_report"] = f"WITH {ITEMS}, {_detectors(**LOW)} SELECT anomaly_id, position, {SHOWN} FROM report"
ORACLES["category_filtered_report"] = f"""
WITH {ITEMS}, picked AS (SELECT * FROM items WHERE category = 'PROMO'), {_detectors(**LOW, source="picked")}
SELECT anomaly_id, position, {SHOWN} FROM report"""
ORACLES["correlated_risks"] = f"""
WITH {ITEMS}, {_detectors(loss=0.20, qty_z=0.0)}
SELECT affected_segment AS segment, string_agg(anomaly_id, ',' ORDER BY position) AS anomaly_ids,
       string_agg(anomaly_type, ',' ORDER BY position) AS anomaly_types,
       ['HIGH', 'MEDIUM', 'LOW'][min(sev) + 1] AS max_severity, true AS compound_risk,
       count(*) || ' anomaly types detected in the same segment — compound risk; escalate for immediate review.' AS note
FROM report GROUP BY affected_segment HAVING count(*) > 1"""
ORACLES["severity_summary"] = f"""
WITH {ITEMS}, {_detectors(**LOW)}
SELECT count_if(severity = 'HIGH')::BIGINT AS "HIGH", count_if(severity = 'MEDIUM')::BIGINT AS "MEDIUM",
       count_if(severity = 'LOW')::BIGINT AS "LOW" FROM report"""
ORACLES["report_header"] = f"""
WITH {ITEMS}, {_detectors(**LOW)}
SELECT (SELECT count(*) FROM items) AS total_orders_analyzed, count(*) AS anomaly_count,
       round(count(*)::DOUBLE / (SELECT count(*) FROM items), 4) AS anomaly_rate FROM report"""
ORACLES["high_severity_anomalies"] = f"""
WITH {ITEMS}, {_detectors(**LOW)} SELECT anomaly_id, {SHOWN} FROM report WHERE severity = 'HIGH'"""

ORACLES["threshold_report"] = f"""
WITH {ITEMS}, {_detectors(late=0.5, fraud=0.001, loss=0.2, least=200)} SELECT anomaly_id, position, {SHOWN} FROM report"""
ORACLES["high_risk_summary"] = f"""
WITH {ITEMS}, {_detectors(loss=0.20, qty_z=0.0)},
risks AS (SELECT affected_segment, string_agg(anomaly_id, ',' ORDER BY position) AS ids,
                 ['HIGH', 'MEDIUM', 'LOW'][min(sev) + 1] AS worst FROM report GROUP BY 1 HAVING count(*) > 1)
SELECT 'total_orders_analyzed' AS section, count(*)::VARCHAR AS item, '' AS detail FROM items
UNION ALL SELECT 'anomaly_count', count(*)::VARCHAR, '' FROM report
UNION ALL SELECT 'summary', s, count_if(severity = s)::VARCHAR FROM report, (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS s) GROUP BY s
UNION ALL SELECT 'high_severity_anomalies', anomaly_id, description FROM report WHERE severity = 'HIGH'
UNION ALL SELECT 'correlated_risks', affected_segment, worst || ': ' || ids FROM risks"""

# ------------------------------------------------------------------ guards
ORACLES["guard_length"] = """
SELECT doc_id, CASE WHEN text IS NULL OR trim(text, E' \\t\\n\\r') = '' THEN 'Empty query'
                    WHEN length(text) > 4000 THEN 'Query exceeds 4000 characters' END AS reason FROM documents"""
_INJECTION = _quote("(?i)" + "|".join(guards.INJECTION_PATTERNS))
_GREETING = _quote("(?i)" + guards.GREETING_PATTERN)
_DOMAIN = _quote(r"(?i)\b(" + "|".join(guards.DOMAIN_KEYWORDS) + r")\b")
ORACLES["guard_injection"] = f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {_INJECTION}) THEN regexp_extract(text, {_INJECTION}, 0) END AS matched
FROM documents"""
ORACLES["guard_domain"] = f"SELECT doc_id, regexp_matches(text, {_DOMAIN}) AS on_topic FROM documents"
_VERDICT = f"""
checked AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'YES' WHEN 'assistant' THEN 'NO' END AS verdict, text,
         CASE WHEN text IS NULL OR trim(text, E' \\t\\n\\r') = '' THEN 1 WHEN length(text) > 4000 THEN 2
              WHEN regexp_matches(text, {_INJECTION}) THEN 3
              WHEN regexp_matches(trim(text, E' \\t\\n\\r'), {_GREETING}) THEN 4
              WHEN regexp_matches(text, {_DOMAIN}) THEN 5 WHEN role NOT IN ('user', 'assistant') THEN 6
              WHEN role = 'assistant' THEN 7 ELSE 8 END AS rule FROM conversations),
guarded AS (
  SELECT *, rule IN (4, 5, 8) AS ok,
         CASE rule WHEN 1 THEN {_quote(guards.REASONS["empty"])} WHEN 2 THEN {_quote(guards.REASONS["long"])}
              WHEN 3 THEN 'Possible prompt injection: ''' || regexp_extract(text, {_INJECTION}, 0) || ''''
              WHEN 6 THEN {_quote(guards.REASONS["unavailable"])} WHEN 7 THEN {_quote(guards.REASONS["off_topic"])}
              ELSE '' END AS reason FROM checked)"""
ORACLES["guard_verdicts"] = f"""
WITH {_VERDICT}
SELECT conv_id, turn, ok, reason, CASE WHEN rule IN (1, 2) THEN 'MEDIUM' WHEN rule = 3 THEN 'HIGH' ELSE 'LOW' END
         AS severity, CASE WHEN rule = 4 THEN {_quote(guards.GREETING_REPLY)} ELSE '' END AS fast_reply FROM guarded"""
ORACLES["guard_outcomes"] = f"""
WITH {_VERDICT}
SELECT stage, ok, reason, count(*) AS events FROM (
  SELECT 'instant' AS stage, rule > 3 AS ok, CASE WHEN rule > 3 THEN '' ELSE reason END AS reason FROM guarded
  UNION ALL SELECT 'domain', false, reason FROM guarded WHERE rule = 7) GROUP BY ALL"""

for _category, _pattern in guards.PII_PATTERNS.items():
    ORACLES[f"pii_{_category}"] = f"""
SELECT doc_id, regexp_replace(text, {_quote(_pattern)}, '[REDACTED_{_category.upper()}]', 'g') AS clean_text
FROM documents WHERE regexp_matches(text, {_quote(_pattern)})"""

_SSN = _quote(guards.PII_PATTERNS["ssn"])
ORACLES["pii_ssn"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat_ws(' ', text, 'id', lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-'
             || lpad((n_chars % 100)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 10000)::VARCHAR, 4, '0')) ELSE text END AS text
           FROM documents)
SELECT doc_id, regexp_replace(text, {_SSN}, '[REDACTED_SSN]', 'g') AS clean_text FROM d WHERE regexp_matches(text, {_SSN})"""

_P = {k: _quote(v) for k, v in guards.PII_PATTERNS.items()}
_SCRUB = f"""
s1 AS (SELECT doc_id, source, regexp_matches(text, {_P["email"]}) AS email,
              regexp_replace(text, {_P["email"]}, '[REDACTED_EMAIL]', 'g') AS text FROM documents),
s2 AS (SELECT doc_id, source, email, regexp_matches(text, {_P["ssn"]}) AS ssn,
              regexp_replace(text, {_P["ssn"]}, '[REDACTED_SSN]', 'g') AS text FROM s1),
s3 AS (SELECT doc_id, source, email, ssn, regexp_matches(text, {_P["card"]}) AS card,
              regexp_replace(text, {_P["card"]}, '[REDACTED_CARD]', 'g') AS text FROM s2),
scrubbed AS (SELECT doc_id, source, email, ssn, card, regexp_matches(text, {_P["phone"]}) AS phone,
              regexp_replace(text, {_P["phone"]}, '[REDACTED_PHONE]', 'g') AS clean_text FROM s3)"""
ORACLES["pii_scrub"] = f"""
WITH {_SCRUB}
SELECT doc_id, clean_text,
       concat_ws(',', CASE WHEN email THEN 'email' END, CASE WHEN ssn THEN 'ssn' END,
                 CASE WHEN card THEN 'card' END, CASE WHEN phone THEN 'phone' END) AS pii_found FROM scrubbed"""
ORACLES["pii_by_source"] = f"""
WITH {_SCRUB}
SELECT source, category, count(*) AS texts FROM (
  SELECT source, 'email' AS category FROM scrubbed WHERE email UNION ALL SELECT source, 'ssn' FROM scrubbed WHERE ssn
  UNION ALL SELECT source, 'card' FROM scrubbed WHERE card UNION ALL SELECT source, 'phone' FROM scrubbed WHERE phone)
GROUP BY ALL"""

_ESTIMATE = """(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) + 1)::BIGINT"""
ORACLES["token_estimate"] = f"SELECT doc_id, {_ESTIMATE} AS tokens FROM documents"
ORACLES["context_pack"] = f"""
WITH c AS (SELECT source AS query_id, doc_id, text, {_ESTIMATE} AS tokens FROM documents),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c),
p AS (SELECT *, CASE WHEN used <= 6000 THEN text
                     WHEN used - tokens <= 6000 AND 6000 - (used - tokens) > 50
                       THEN substr(text, 1, ((6000 - (used - tokens)) * 4)::BIGINT) END AS part FROM u)
SELECT query_id, coalesce(string_agg(part, E'\\n\\n' ORDER BY doc_id), '') AS context, count(part)::INT AS chunks,
       coalesce(sum(tokens) FILTER (used <= 6000), 0)::BIGINT AS used_tokens FROM p GROUP BY query_id"""

# ------------------------------------------------------------------ retrieval
ORACLES["token_counts"] = f"""
WITH {TOKENS}
SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM doc_tokens GROUP BY token"""

BM25 = f"""{TOKENS},
lens AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS dl FROM documents),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tf AS (SELECT doc_id, token, count(*) AS tf FROM doc_tokens GROUP BY 1, 2),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT token, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs, corpus),
terms AS (SELECT token, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qtf AS (SELECT query_id, token, count(*) AS qtf FROM query_tokens GROUP BY 1, 2),
matched AS (
  SELECT query_id, doc_id,
         round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 9) AS score
  FROM qtf JOIN terms USING (token) JOIN tf USING (token) JOIN lens USING (doc_id), corpus GROUP BY 1, 2),
every AS (
  SELECT item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score
  FROM benchmark CROSS JOIN documents d LEFT JOIN matched m ON m.query_id = item_id AND m.doc_id = d.doc_id),
bm25 AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM every QUALIFY rank <= 20)"""
ORACLES["bm25_term_stats"] = f"WITH {BM25} SELECT token, df, round(idf, 6) AS idf FROM terms"
ORACLES["bm25_topk"] = f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25"

ORACLES["bm25_postings_topk"] = ORACLES["bm25_topk"]

ORACLES["hashed_embedding"] = f"""
WITH {_hashed("hv", "doc_id", "documents")} SELECT doc_id, b AS dim, round(v, 6) AS value FROM hv"""

ORACLES["cosine_pairs"] = """
SELECT a.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

_LABEL_TOPK = """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(v ORDER BY i) AS vec FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id AS doc_id, label,
             round(list_cosine_similarity(vec, embedding::DOUBLE[]), 9) AS score FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s {where})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""
ORACLES["dense_topk"] = _LABEL_TOPK.format(where="", k=20)
ORACLES["dense_topk_filtered"] = _LABEL_TOPK.format(where="WHERE label = 3", k=10)

REWRITTEN = """
rw AS (SELECT CASE WHEN item_id = 0 THEN (SELECT max(item_id) FROM benchmark) ELSE item_id - 1 END AS query_id,
              text AS rewritten FROM benchmark)"""
# every query against every document; missing overlaps score 0
DENSE = f"""
{_hashed("dv", "doc_id", "documents").strip()},
{_hashed("qv", "item_id", "benchmark").strip()},
sims AS (
  SELECT item_id AS query_id, doc_id, coalesce(round(s, 9), 0.0) AS score
  FROM (SELECT item_id, doc_id FROM benchmark CROSS JOIN documents)
  LEFT JOIN (SELECT item_id, doc_id, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (b) GROUP BY 1, 2)
  USING (item_id, doc_id)),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM sims QUALIFY rank <= 20)"""
FUSED = f"""{DENSE}, {BM25},
lists AS (SELECT query_id, doc_id, rank, score, 0 AS list FROM dense
          UNION ALL SELECT query_id, doc_id, rank, score, 1 FROM bm25),
fused0 AS (
  SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score,
         min(list * 1000 + rank) AS seen, arg_min(score, list * 1000 + rank) AS score FROM lists GROUP BY 1, 2),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen)::INT AS rank FROM fused0),
reranked0 AS (
  SELECT query_id, doc_id, fused.score, sims.score AS rerank_score,
         row_number() OVER (PARTITION BY query_id ORDER BY sims.score DESC, fused.rank)::INT AS new_rank
  FROM fused JOIN sims USING (query_id, doc_id)),
reranked AS (SELECT query_id, doc_id, score, rerank_score, new_rank AS rank FROM reranked0 WHERE new_rank <= 5)"""

ORACLES["rrf_fusion"] = f"""
WITH {FUSED}
SELECT query_id, doc_id, rank, round(rrf_score, 6) AS rrf_score, round(score, 6) AS score FROM fused"""
ORACLES["rerank_topk"] = f"""
WITH {FUSED}
SELECT query_id, doc_id, rank, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM reranked"""
ORACLES["max_scores"] = f"""
WITH {DENSE} SELECT query_id, round(max(score), 6) AS max_score FROM sims GROUP BY 1"""
ORACLES["retry_gate"] = f"""
WITH {DENSE} SELECT query_id, round(max(score), 6) AS max_score FROM sims GROUP BY 1 HAVING max(score) < 0.9::DOUBLE"""

# the second attempt of a query is the first attempt of the query whose text it borrows
_ATTEMPTS = f"""{DENSE}, {REWRITTEN},
nxt AS (SELECT item_id AS query_id, CASE WHEN item_id = (SELECT max(item_id) FROM benchmark) THEN 0 ELSE item_id + 1 END
          AS other, text FROM benchmark),
att1 AS (SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 5),
att2 AS (SELECT nxt.query_id, doc_id, score, rank FROM nxt JOIN att1 ON att1.query_id = other),
m1 AS (SELECT query_id, max(score) AS m1 FROM att1 GROUP BY 1),
m2 AS (SELECT query_id, max(score) AS m2 FROM att2 GROUP BY 1),
choice AS (SELECT *, lower(rewritten) <> lower(text) AND m2 > m1 AS swap
           FROM nxt JOIN rw USING (query_id) JOIN m1 USING (query_id) JOIN m2 USING (query_id))"""
ORACLES["best_of_two"] = f"""
WITH {_ATTEMPTS}
SELECT query_id, doc_id, rank, round(score, 6) AS score, round(CASE WHEN swap THEN m2 ELSE m1 END, 6) AS max_score,
       CASE WHEN swap THEN text END AS reformulated_from
FROM choice JOIN (SELECT *, false AS second FROM att1 UNION ALL SELECT *, true FROM att2) USING (query_id)
WHERE second = swap"""
ORACLES["response_docs"] = f"""
WITH {_ATTEMPTS},
merged AS (SELECT query_id, doc_id, rank, score FROM att1 UNION ALL SELECT query_id, doc_id, rank + 5, score FROM att2),
firsts AS (SELECT query_id, doc_id, min(rank) AS o, arg_min(score, rank) AS score FROM merged GROUP BY 1, 2)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id)::INT AS position,
       round(score, 6) AS score FROM firsts QUALIFY position <= 5"""
ORACLES["prompt_context"] = f"""
WITH {DENSE}
SELECT query_id, string_agg('[Doc ' || rank || ' | id=' || doc_id || ' | severity=? | source=' || source || E']\\n'
       || text, E'\\n\\n' ORDER BY rank) AS context
FROM dense JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id"""
ORACLES["hybrid_search"] = f"""
WITH {FUSED}, {REWRITTEN},
nxt AS (SELECT item_id AS query_id, CASE WHEN item_id = (SELECT max(item_id) FROM benchmark) THEN 0 ELSE item_id + 1 END
          AS other, text FROM benchmark),
best AS (SELECT query_id, max(rerank_score) AS m FROM reranked GROUP BY 1),
choice AS (
  SELECT query_id, other, text, a.m AS m1, b.m AS m2,
         a.m < 0.9::DOUBLE AND b.m > a.m AND lower(rewritten) <> lower(text) AS swap
  FROM nxt JOIN rw USING (query_id) JOIN best a USING (query_id) JOIN best b ON b.query_id = other)
SELECT c.query_id, doc_id, rank, round(rerank_score, 6) AS rerank_score,
       round(CASE WHEN swap THEN m2 ELSE m1 END, 6) AS max_score, CASE WHEN swap THEN text END AS reformulated_from
FROM choice c JOIN reranked r ON r.query_id = CASE WHEN swap THEN other ELSE c.query_id END"""

ORACLES["semantic_cache_hits"] = f"""
WITH conv AS (SELECT conv_id || '/' || turn AS query_id, text FROM conversations),
{_hashed("cv", "query_id", "conv").strip()},
{_hashed("ev", "item_id", "benchmark").strip()},
s AS (SELECT query_id, item_id, round(sum(cv.v * ev.v), 9) AS similarity FROM cv JOIN ev USING (b) GROUP BY 1, 2),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) = 1)
SELECT query_id, item_id AS entry_id, round(similarity, 6) AS similarity, text AS payload
FROM best JOIN benchmark USING (item_id) WHERE similarity >= 0.7::DOUBLE"""

ORACLES["cache_retain"] = """
WITH e AS (SELECT text AS query, conv_id || '/' || turn AS payload, (conv_id * 1000 + turn)::DOUBLE AS store_ts,
                  CASE WHEN role = 'assistant' THEN (conv_id * 1000 + turn + 5000)::DOUBLE END AS hit_ts FROM conversations)
SELECT query, arg_max(payload, store_ts) AS payload, greatest(min(store_ts), max(hit_ts)) AS position
FROM e GROUP BY query ORDER BY position DESC, query LIMIT 100"""

# ------------------------------------------------------------------ telemetry
RUNS = """
ev AS (
  SELECT user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_id, ts AS t, event_id, value,
         CASE event_type WHEN 'view' THEN 'node_start' WHEN 'purchase' THEN 'node_end'
              WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'node_error' ELSE 'faithfulness' END
              WHEN 'click' THEN CASE WHEN event_id % 4 <> 0 THEN 'retrieval' ELSE 'crag_retry' END
              ELSE ['orchestrator_decision', 'final', 'cached', 'guard_block'][event_id % 4 + 1] END AS type,
         ['orchestrator', 'supplier_risk', 'shipment_analysis', 'inventory_intelligence', 'recommendation'][event_id % 5 + 1] AS nd,
         ['supplier_risk', 'shipment_analysis', 'inventory_intelligence', 'general'][event_id % 4 + 1] AS it,
         ['HIGH', 'MEDIUM', 'LOW'][event_id % 3 + 1] AS sv FROM events),
runs AS (
  SELECT run_id, t, event_id, type,
         CASE WHEN type IN ('node_start', 'node_end', 'node_error') THEN nd END AS node,
         CASE WHEN type IN ('node_end', 'node_error', 'retrieval') THEN value END AS elapsed_ms,
         CASE WHEN type = 'retrieval' THEN floor(value)::BIGINT % 6 END AS docs,
         CASE WHEN type = 'retrieval' THEN (floor(value * 100)::BIGINT % 101) / 100.0::DOUBLE END AS max_score,
         CASE WHEN type = 'faithfulness' THEN value < 50 END AS faithful,
         CASE WHEN type = 'faithfulness' THEN event_id % 3 = 0 END AS pii,
         CASE WHEN type = 'orchestrator_decision' THEN it END AS intent,
         CASE WHEN type IN ('orchestrator_decision', 'final', 'cached', 'guard_block') THEN sv END AS severity,
         CASE WHEN type = 'guard_block' THEN 'off-topic' END AS reason,
         row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) AS seq FROM ev)"""

ORACLES["route_fanout"] = f"""
WITH {RUNS}
SELECT run_id, event_id, intent, unnest(CASE WHEN intent = 'general'
         THEN ['supplier_risk', 'shipment_analysis', 'inventory_intelligence'] ELSE [intent] END) AS specialist
FROM runs WHERE type = 'orchestrator_decision'"""
ORACLES["session_timeline"] = f"WITH {RUNS} SELECT run_id, seq, event_id, t, type FROM runs"
ORACLES["node_spans"] = f"""
WITH {RUNS},
n AS (SELECT *, lead(type) OVER w AS nt, lead(t) OVER w AS tt, lead(elapsed_ms) OVER w AS te FROM runs
      WHERE node IS NOT NULL WINDOW w AS (PARTITION BY run_id, node ORDER BY t, event_id))
SELECT run_id, node, t AS started_at, CASE WHEN nt <> 'node_start' THEN tt END AS finished_at,
       CASE WHEN nt <> 'node_start' THEN te END AS elapsed_ms,
       CASE nt WHEN 'node_end' THEN 'done' WHEN 'node_error' THEN 'error' ELSE 'running' END AS status
FROM n WHERE type = 'node_start'"""
ORACLES["node_latency"] = f"""
WITH {RUNS}
SELECT node, count(*) AS spans, count_if(type = 'node_error')::BIGINT AS errors, round(avg(elapsed_ms), 6) AS mean_ms,
       max(elapsed_ms) AS max_ms, quantile_disc(elapsed_ms, 0.95) AS p95_ms
FROM runs WHERE type IN ('node_end', 'node_error') GROUP BY node"""
NODE_STATUS = f"""{RUNS},
nodes AS (SELECT unnest(['orchestrator', 'supplier_risk', 'shipment_analysis', 'inventory_intelligence',
                         'recommendation']) AS node),
last_step AS (SELECT run_id, node, arg_max(type, seq) AS type,
                     arg_max(elapsed_ms, seq) FILTER (type <> 'node_start') AS elapsed_ms
              FROM runs WHERE node IS NOT NULL GROUP BY 1, 2),
left_out AS (SELECT DISTINCT r.run_id, n.node FROM runs r, nodes n
             WHERE r.type = 'orchestrator_decision' AND r.intent <> 'general' AND r.intent <> n.node
               AND n.node NOT IN ('orchestrator', 'recommendation')),
status AS (
  SELECT run_id, node,
         CASE l.type WHEN 'node_start' THEN 'running' WHEN 'node_end' THEN 'done' WHEN 'node_error' THEN 'error'
              ELSE CASE WHEN o.node IS NOT NULL THEN 'skipped' ELSE 'idle' END END AS status, elapsed_ms
  FROM (SELECT DISTINCT run_id FROM runs) CROSS JOIN nodes
  LEFT JOIN last_step l USING (run_id, node) LEFT JOIN left_out o USING (run_id, node))"""
ORACLES["node_status"] = f"WITH {NODE_STATUS} SELECT run_id, node, status, elapsed_ms FROM status"
ORACLES["skipped_nodes"] = f"WITH {NODE_STATUS} SELECT run_id, node FROM status WHERE status = 'skipped'"
# a start opens its node until that node ends or another starts
ORACLES["retrieval_by_node"] = f"""
WITH {RUNS},
starts AS (SELECT run_id, seq, node, lead(seq, 1, 1000000000) OVER (PARTITION BY run_id ORDER BY seq) AS next_start
           FROM runs WHERE type = 'node_start'),
opened AS (
  SELECT s.run_id, s.node, s.seq AS from_seq,
         least(s.next_start, coalesce(min(e.seq), 1000000000)) AS to_seq
  FROM starts s LEFT JOIN runs e ON e.run_id = s.run_id AND e.node = s.node AND e.seq > s.seq
       AND e.type IN ('node_end', 'node_error') GROUP BY s.run_id, s.node, s.seq, s.next_start)
SELECT r.run_id, r.t, r.event_id, r.type, o.node, r.docs, r.max_score, r.elapsed_ms
FROM runs r LEFT JOIN opened o ON o.run_id = r.run_id AND r.seq > from_seq AND r.seq < to_seq
WHERE r.type IN ('retrieval', 'crag_retry')"""
RUN_STATUS = f"""{RUNS},
status AS (
  SELECT run_id,
         coalesce(arg_max(CASE type WHEN 'final' THEN 'done' WHEN 'cached' THEN 'cached' ELSE 'blocked' END, seq)
           FILTER (type IN ('final', 'cached', 'guard_block')), 'running') AS status,
         arg_max(intent, seq) FILTER (intent IS NOT NULL) AS intent,
         arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity,
         arg_max(reason, seq) FILTER (type = 'guard_block') AS reason, min(t) AS started_at,
         max(t) FILTER (type IN ('final', 'cached', 'guard_block')) AS finished_at FROM runs GROUP BY run_id)"""
ORACLES["run_status"] = f"""
WITH {RUN_STATUS}
SELECT *, round(date_diff('microsecond', started_at, finished_at) / 1000.0::DOUBLE, 6) AS elapsed_ms FROM status"""
ORACLES["human_review_queue"] = f"""
WITH {RUN_STATUS} SELECT run_id, status, severity, intent FROM status WHERE severity = 'HIGH'"""
METRICS = f"""{RUNS},
metrics AS (
  SELECT run_id, arg_max(docs, seq) FILTER (type = 'retrieval') AS retrieval_docs,
         arg_max(max_score, seq) FILTER (type = 'retrieval') AS retrieval_score,
         arg_max(elapsed_ms, seq) FILTER (type = 'retrieval') AS retrieval_ms,
         count_if(type = 'crag_retry')::BIGINT AS retries,
         arg_max(faithful, seq) FILTER (type = 'faithfulness') AS faithful,
         arg_max(pii, seq) FILTER (type = 'faithfulness') AS pii_redacted,
         arg_max(type = 'cached', seq) FILTER (type IN ('cached', 'final')) AS cache_hit,
         round(date_diff('microsecond', min(t), max(t) FILTER (type = 'final')) / 1000.0::DOUBLE, 6) AS elapsed_total
  FROM runs GROUP BY run_id)"""
ORACLES["run_metrics"] = f"WITH {METRICS} SELECT * FROM metrics"
ORACLES["quality_score"] = f"""
WITH {METRICS},
scored AS (
  SELECT run_id, CASE WHEN faithful IS NOT NULL OR retrieval_score IS NOT NULL THEN
           (CASE WHEN faithful THEN 40 ELSE 0 END + coalesce(floor(retrieval_score * 30 + 0.5::DOUBLE), 0)
            + CASE WHEN retries = 0 AND retrieval_docs > 0 THEN 20 ELSE 0 END
            + CASE WHEN pii_redacted THEN 5 WHEN NOT pii_redacted THEN 10 ELSE 0 END)::INT END AS quality FROM metrics)
SELECT *, CASE WHEN quality >= 80 THEN 'green' WHEN quality >= 55 THEN 'amber' WHEN quality IS NOT NULL THEN 'red' END
         AS band FROM scored"""
ORACLES["recent_feedback"] = """
SELECT conv_id::VARCHAR AS session_id, turn::VARCHAR AS message_id,
       CASE WHEN turn % 4 = 1 THEN 'up' ELSE 'down' END AS rating, (conv_id * 1000 + turn)::DOUBLE AS ts
FROM conversations WHERE role = 'assistant' ORDER BY ts DESC, session_id, message_id LIMIT 50"""

# ------------------------------------------------------------------ streams
ORACLES["stream_dedup"] = "SELECT event_id, user_id, event_type, ts FROM events"
ORACLES["hourly_events"] = """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events,
       count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY ALL"""
ORACLES["event_sessions"] = """
WITH a AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events
FROM b GROUP BY user_id, s"""

# ------------------------------------------------------------------ evaluation
GOLDEN = """
golden AS (
  SELECT doc_id AS pos, 'What does document ' || doc_id || ' say?' AS question, text AS ground_truth, source,
         ['supplier_risk', 'shipment', 'inventory'][doc_id % 3 + 1] AS category, quality, toxic
  FROM labels JOIN documents USING (doc_id))"""
ORACLES["eval_samples"] = f"""
WITH {GOLDEN} SELECT pos, question, category, ground_truth FROM golden WHERE category = 'shipment' ORDER BY pos LIMIT 50"""
ORACLES["default_contexts"] = f"""
WITH {GOLDEN} SELECT pos, CASE WHEN quality = 1 THEN source ELSE ground_truth END AS contexts FROM golden"""
ORACLES["eval_resolve"] = f"""
WITH {GOLDEN}
SELECT pos, CASE WHEN quality = 1 THEN 'Live: ' || question ELSE ground_truth END AS answer,
       CASE WHEN quality = 1 AND toxic = 0 THEN question ELSE source END AS contexts FROM golden"""
SCORES = """
metrics(tool, metric, i, threshold, low) AS (VALUES
  ('deepeval', 'faithfulness', 0, 0.7::DOUBLE, false), ('deepeval', 'answer_relevancy', 1, 0.7::DOUBLE, false),
  ('deepeval', 'contextual_precision', 2, 0.6::DOUBLE, false), ('deepeval', 'contextual_recall', 3, 0.6::DOUBLE, false),
  ('deepeval', 'hallucination', 4, 0.4::DOUBLE, true), ('ragas', 'faithfulness', 0, 0.7::DOUBLE, false),
  ('ragas', 'answer_relevancy', 1, 0.7::DOUBLE, false), ('ragas', 'context_precision', 2, 0.6::DOUBLE, false),
  ('ragas', 'context_recall', 3, 0.6::DOUBLE, false)),
scores AS (
  SELECT tool, doc_id AS sample_id, metric, low, threshold,
         ((doc_id * (7 + 13 * i) + 20 * quality) % 101) / 100.0::DOUBLE AS score FROM labels CROSS JOIN metrics),
passes AS (SELECT *, CASE WHEN low THEN score <= threshold ELSE score >= threshold END AS passed FROM scores),
agg AS (SELECT tool, metric, avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score,
               avg(passed::INT) AS pass_rate, count(*) AS sample_count, any_value(threshold) AS threshold,
               any_value(low) AS low FROM passes GROUP BY 1, 2)"""
ORACLES["metric_pass"] = f"WITH {SCORES} SELECT tool, sample_id, metric, score, threshold, passed FROM passes"
ORACLES["metric_aggregate"] = f"""
WITH {SCORES}
SELECT tool, metric, round(mean_score, 6) AS mean_score, min_score, max_score, round(pass_rate, 6) AS pass_rate,
       sample_count, threshold FROM agg"""
ORACLES["metric_overall"] = f"""
WITH {SCORES}
SELECT tool, round(avg(pass_rate), 6) AS overall_pass_rate,
       round(avg(CASE WHEN low THEN 1 - mean_score ELSE mean_score END), 6) AS overall_mean_score FROM agg GROUP BY 1"""
ORACLES["suite_pass"] = f"""
WITH {SCORES}
SELECT tool, metric, round(mean_score, 6) AS mean_score, threshold, mean_score >= threshold AS passed,
       (mean_score >= threshold)::INT::DOUBLE AS pass_rate, round(avg(mean_score) OVER (), 6) AS overall_mean_score,
       round(avg((mean_score >= threshold)::INT) OVER (), 6) AS overall_pass_rate FROM agg WHERE tool = 'ragas'"""
ORACLES["latest_run"] = """
WITH r AS (
  SELECT 'job-' || conv_id AS job_id, CASE WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'running' END AS status,
         CASE WHEN conv_id % 2 = 0 THEN 'deepeval' ELSE 'ragas' END AS tool,
         (conv_id * 37 % 1000 + max(turn))::DOUBLE AS ran_at FROM conversations GROUP BY conv_id)
SELECT job_id, tool, ran_at, status, NULL::VARCHAR AS note FROM r WHERE status = 'completed'
ORDER BY ran_at DESC, job_id DESC LIMIT 1"""
ORACLES["compare_suites"] = f"""
WITH {SCORES},
named AS (SELECT *, CASE metric WHEN 'context_precision' THEN 'contextual_precision'
                                WHEN 'context_recall' THEN 'contextual_recall' ELSE metric END AS m FROM scores),
t AS (SELECT m AS metric, avg(score) FILTER (tool = 'deepeval') AS deepeval, avg(score) FILTER (tool = 'ragas') AS ragas,
             any_value(threshold) AS threshold, any_value(low) AS low FROM named GROUP BY 1)
SELECT metric, round(deepeval, 6) AS deepeval, round(ragas, 6) AS ragas, threshold,
       CASE WHEN low THEN deepeval <= threshold ELSE deepeval >= threshold END AS deepeval_passed,
       CASE WHEN low THEN ragas <= threshold ELSE ragas >= threshold END AS ragas_passed FROM t"""

# ------------------------------------------------------------------ output guard, verdicts, stored and streamed results
ORACLES["output_guard"] = """
SELECT doc_id,
       CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 4 = 0 THEN false WHEN doc_id % 4 = 2 THEN false ELSE true END AS faithful,
       CASE WHEN doc_id % 3 = 0 THEN 'no-context-skip' WHEN doc_id % 4 = 3 THEN 'check-skipped' END AS faithful_reason
FROM documents"""
ORACLES["verdict_json"] = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source ELSE 'general' END AS intent,
       CASE doc_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE doc_id % 4 WHEN 0 THEN 'because ' || lang WHEN 1 THEN '' ELSE 'parse-failed' END AS rationale FROM documents"""
_SCRUBBED_TURNS = _SCRUB.replace("doc_id, source", "conv_id, turn").replace("FROM documents", "FROM conversations")
ORACLES["stream_guarded"] = f"""
WITH {_VERDICT}, {_SCRUBBED_TURNS.strip()}
SELECT conv_id, turn, rule IN (4, 5) AS ok, CASE WHEN rule > 5 THEN {_quote(guards.REASONS["unavailable"])} ELSE reason END AS reason,
       clean_text, concat_ws(',', CASE WHEN email THEN 'email' END, CASE WHEN ssn THEN 'ssn' END,
                             CASE WHEN card THEN 'card' END, CASE WHEN phone THEN 'phone' END) AS pii_found
FROM guarded JOIN scrubbed USING (conv_id, turn)"""
ORACLES["stream_hourly_events"] = ORACLES["hourly_events"]
ORACLES["stream_runs"] = ORACLES["run_status"]
ORACLES["stream_sessions"] = f"""
SELECT * FROM ({ORACLES["event_sessions"]})
WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
ORACLES["bm25_stored_topk"] = ORACLES["bm25_postings_topk"]
# the sketch finds the exact top on these tables; what it may miss is tested as recall
ORACLES["dense_topk_approx"] = ORACLES["dense_topk"]

ORACLES["stream_nodes"] = ORACLES["node_status"]
ORACLES["stream_cache_retain"] = ORACLES["cache_retain"]
ORACLES["bm25_segments_topk"] = ORACLES["bm25_topk"]
ORACLES["anomaly_cells_report"] = ORACLES["anomaly_report"]
ORACLES["latency_sketch_report"] = f"""
WITH {RUNS}
SELECT node, count(*) AS spans, count_if(type = 'node_error')::BIGINT AS errors, round(avg(elapsed_ms), 6) AS mean_ms,
       max(elapsed_ms) AS max_ms, true AS p95_within
FROM runs WHERE type IN ('node_end', 'node_error') GROUP BY node"""
_ROW_TOPK = """
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label,
                  round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score
           FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s {where})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""
ORACLES["dense_topk_rows"] = _ROW_TOPK.format(where="", k=20)
ORACLES["dense_topk_rows_filtered"] = _ROW_TOPK.format(where="WHERE label = 3", k=10)
# the index finds each query's own vector; that it reaches the recall asked for is part of the result
ORACLES["vector_index_hits"] = """
SELECT vec_id AS query_id, 20::BIGINT AS hits, 1.0::DOUBLE AS best, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0"""
ORACLES["missing_columns"] = f"""
WITH {ITEMS}, n AS (SELECT count(DISTINCT market) AS markets, count(DISTINCT order_status) AS states FROM items),
c AS (SELECT unnest(['none', 'market', 'late_delivery_risk', 'order_status']) AS lacking)
SELECT lacking, 'late' AS figure, CASE WHEN lacking IN ('none', 'order_status') THEN markets ELSE 0 END AS rows FROM c, n
UNION ALL SELECT lacking, 'status', CASE WHEN lacking <> 'order_status' THEN states ELSE 0 END FROM c, n
UNION ALL SELECT lacking, 'fraud', CASE WHEN lacking IN ('none', 'late_delivery_risk') THEN markets ELSE 0 END FROM c, n"""
ORACLES["metric_thresholds"] = f"""
WITH {SCORES}
SELECT tool, metric, threshold, low AS lower_is_better, count_if(passed)::BIGINT AS met, count(*) AS scored FROM passes GROUP BY ALL"""
ORACLES["store_hybrid_search"] = ORACLES["hybrid_search"]
