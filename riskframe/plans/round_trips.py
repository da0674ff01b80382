"""Registered queries that write to the shared folder and read back: files, a stored index, streams run to completion."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schemas
from riskframe.operators import anomaly, dense, evaluation, kpi, lexical, segments, telemetry, vector_index
from riskframe.operators.incidents import ORDER_SOURCE
from riskframe.plans import fixtures as fx
from riskframe.plans import ingest, store
from riskframe.plans.hybrid import embed
from riskframe.plans.queries import DETECTOR_COLUMNS, LOW, RETRY_BELOW, query, rounded, shown_anomalies
from riskframe.session import checkpoint_dir, materialise, release
from riskframe.sources import inventory, readers
from riskframe.sources.tables import last_write_wins
from riskframe.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, renamed: dict[str, str], path: str, encoding: str, compression: str = "none") -> str:
    """Write the columns under their published headers as CSV."""
    named = df.select(*[F.col(c).alias(h) for h, c in renamed.items() if c in df.columns])
    named.write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path, compression=compression)
    return path


def _order_files(spark: SparkSession, sf: str, unique: bool = False) -> str:
    """The order items as published files: all headers, in their order; ``unique``: one row per order and item number."""
    items = fx.order_items(spark, sf, gathered=unique)
    if unique:  # item numbers repeat within an order, and which row is written last is not fixed
        items = last_write_wins(items, ["order_id", "order_item_id"], ["ship_date", "sales", "product", "department"])
    known = {h: schemas.ORDER_COLUMNS.get(h, h) for h in schemas.ORDER_FILE.names}
    full = items.select(*[F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in known.values()])
    path = _files(full, known, _folder(spark, "orders.csv"), "ISO-8859-1", "gzip")
    del items, full
    release(spark)
    return path


@query
def csv_orders(spark, sf):
    rows, _ = readers.split_rejects(readers.read_orders(spark, _order_files(spark, sf)))
    names = (
        "order_id order_item_id product category department customer_segment market region shipping_mode delivery_status "
        "order_status days_real days_scheduled late_delivery_risk quantity sales discount profit order_date ship_date"
    ).split()
    return rows.select(*names).withColumns({c: F.round(c, 4) for c in ("sales", "discount", "profit")})


@query
def csv_skus(spark, sf):
    path = _files(fx.sku_rows(spark, sf), {h: c for h, (c, _) in schemas.SKU_COLUMNS.items()}, _folder(spark, "skus.csv"), "UTF-8")
    rows, _ = readers.split_rejects(readers.read_skus(spark, path))
    names = "sku product_type supplier price revenue units_sold stock_levels lead_time shipping_cost inspection defect_rate"
    return rows.select(*names.split())


@query
def json_documents(spark, sf):
    path = _folder(spark, "documents") + ".json"
    fx.table(spark, sf, "documents").write.json(path)
    return readers.read_any(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query
def csv_suppliers(spark, sf):
    path = _folder(spark, "suppliers") + ".csv"
    spark.read.parquet(f"{sf}/supplier.parquet").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_any(spark, path)


@query
def bm25_stored_topk(spark, sf):
    path = _folder(spark, "index")
    lexical.write_index(lexical.build_bm25(fx.corpus(spark, sf), compute=True), path)
    return rounded(lexical.bm25_search(fx.search_queries(spark, sf), lexical.read_index(spark, path)), "score")


def _done(running) -> None:
    running.awaitTermination()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream; it comes in one piece, whatever its files, so nothing in it is late."""
    return jobs.event_source(spark, sf, files_per_batch=None)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as a stream, in one piece."""
    return jobs.table_source(spark, fx.TABLE_SCHEMAS["conversations"], sf, "conversations*.parquet")


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query
def stream_hourly_events(spark, sf):
    out = _folder(spark, "hourly")
    _done(jobs.stream_event_counts(_events(spark, sf), out, f"{out}-checkpoint"))
    return jobs.read_update_log(spark, out, ["window_start", "event_type"])


@query
def stream_dedup(spark, sf):
    out = _folder(spark, "dedup")
    source = _events(spark, sf)
    _done(jobs.stream_dedup(source.unionByName(source), out, f"{out}-checkpoint"))
    return _ntz(spark.read.parquet(out).select("event_id", "user_id", "event_type", "ts"), "ts")


@query
def stream_sessions(spark, sf):
    out = _folder(spark, "sessions")
    _done(jobs.stream_session_spans(_events(spark, sf), out, f"{out}-checkpoint"))
    return spark.read.parquet(out)


def _run_state(spark, sf) -> str:
    out = _folder(spark, "runs")
    _done(jobs.stream_run_state(fx.run_events(_events(spark, sf)), out, f"{out}-checkpoint"))
    return out


@query
def stream_runs(spark, sf):
    return rounded(jobs.read_run_state(spark, _run_state(spark, sf)), "elapsed_ms")


@query
def stream_nodes(spark, sf):
    return jobs.read_node_state(spark, _run_state(spark, sf))


@query
def stream_guarded(spark, sf):
    out = _folder(spark, "guarded")
    _done(jobs.stream_guard(_turns(spark, sf), out, f"{out}-checkpoint"))
    found = F.array_join("pii_found", ",").alias("pii_found")
    return spark.read.parquet(out).select("conv_id", "turn", "guard.ok", "guard.reason", "clean_text", found)


def _shown_incidents(docs: DataFrame) -> DataFrame:
    """Documents of orders with some of their metadata."""
    text = [F.col("metadata")[n].alias(n) for n in ("source", "market", "order_status", "severity", "ship_date")]
    number = [F.round(F.col("metadata")[n].cast("double"), 4).alias(n) for n in ("sales", "profit", "days_real")]
    return docs.select("id", "text", *text, *number)


@query
def stream_incidents(spark, sf):
    out = _folder(spark, "incidents")
    _done(jobs.stream_ingest(jobs.order_source(spark, _order_files(spark, sf, unique=True)), out, f"{out}-checkpoint"))
    return _shown_incidents(jobs.read_update_log(spark, out, ["id"]))


@query
def stream_store(spark, sf):
    out = _folder(spark, "store")
    _done(jobs.stream_to_store(jobs.order_source(spark, _order_files(spark, sf, unique=True)), out, f"{out}-checkpoint"))
    return _shown_incidents(store.read_corpus(spark, out))


@query
def stream_cache_retain(spark, sf):
    out = _folder(spark, "cache")
    entries = fx.cache_entries(_turns(spark, sf)).withColumn("t", F.timestamp_seconds(F.coalesce("hit_ts", "store_ts")))
    # the table comes in one piece, so nothing in it is late
    _done(jobs.stream_cache(entries, out, f"{out}-checkpoint", late="3650 days"))
    return jobs.read_cache(spark, out, 100)


# ------------------------------------------------------------------ the store
def _as_documents(docs: DataFrame) -> DataFrame:
    """Test documents in the shape of the corpus."""
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata"))


def _second_batch(docs: DataFrame) -> DataFrame:
    """A third of the documents anew, with another text."""
    return docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" second edition")))


@query
def store_upsert(spark, sf):
    root, docs = _folder(spark, "store"), fx.corpus(spark, sf)
    store.apply(spark, root, _as_documents(docs), "first", build=embed)
    store.apply(spark, root, _as_documents(_second_batch(docs)), "second", build=embed)
    return store.read_corpus(spark, root).select(
        F.col("id").cast("long").alias("doc_id"), "text", F.col("metadata")["source"].alias("source"), F.size("vec").alias("dim")
    )


@query
def store_cleared(spark, sf):
    root, docs = _folder(spark, "store"), fx.corpus(spark, sf)
    draft = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.lower("text")})
    store.apply(spark, root, _as_documents(draft), "first", build=embed)
    store.clear(spark, root)
    store.apply(spark, root, _as_documents(docs), "second", build=embed)
    return store.read_corpus(spark, root).select(F.col("id").cast("long").alias("doc_id"), "text")


@query
def store_hybrid_search(spark, sf):
    root, docs = _folder(spark, "store"), _as_documents(fx.corpus(spark, sf))
    padded = docs.withColumn("id", F.lpad("id", 12, "0"))  # texts of one length are in the order of the numbers
    store.apply(spark, root, padded, "all", build=embed)
    hits = store.search(spark, root, fx.search_queries(spark, sf), fx.rewritten_queries(spark, sf), threshold=RETRY_BELOW)
    shown = hits.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "rank", "rerank_score", "max_score", "reformulated_from")
    return rounded(shown, "rerank_score", "max_score")


@query
def bm25_segments_topk(spark, sf):
    root, docs = _folder(spark, "index"), fx.corpus(spark, sf).select("doc_id", "text")
    draft = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("early draft of "), "text"))
    segments.write_segment(docs.where("doc_id % 2 = 0 AND doc_id % 5 <> 0").unionByName(draft), f"{root}/1")
    segments.write_segment(docs.where("doc_id % 2 = 1 AND doc_id % 5 <> 0"), f"{root}/2")
    segments.write_segment(docs.where("doc_id % 5 = 0"), f"{root}/3", removed=draft)
    index = segments.read_segments(spark, [f"{root}/{n}" for n in (1, 2, 3)], [False, False, True])
    return rounded(segments.block_search(fx.search_queries(spark, sf), index), "score")


@query
def ingest_corpus(spark, sf):
    root = _folder(spark, "ingest")
    ingest.ingest(spark, ORDER_SOURCE, _order_files(spark, sf, unique=True), root, key="orders")
    return _shown_incidents(ingest.read_corpus(spark, root))


@query
def ingest_log(spark, sf):
    root, files = _folder(spark, "ingest"), _folder(spark, "parts") + ".json"
    fx.table(spark, sf, "part").write.json(files)
    for _ in range(2):  # the second time it is there already
        ingest.ingest(spark, "custom", files, root, key="parts", row_key="p_partkey")
    return spark.read.parquet(f"{root}/runs").select("run_key", "state", "rows_loaded", "docs_built")


# ------------------------------------------------------------------ stored summaries
@query
def latency_sketch_report(spark, sf):
    path = _folder(spark, "latency")
    events = fx.run_events(fx.table(spark, sf, "events"))
    telemetry.latency_sketches(events).write.partitionBy("node").parquet(path)
    found = telemetry.latency_of_sketches(spark.read.parquet(path))
    closing = events.where("type IN ('node_end', 'node_error')").join(F.broadcast(found.select("node", "p95_ms")), "node")
    below = F.avg((F.col("elapsed_ms") < F.col("p95_ms")).cast("int"))
    upto = F.avg((F.col("elapsed_ms") <= F.col("p95_ms")).cast("int"))
    room = telemetry.SKETCH_ERROR
    ranks = closing.groupBy("node").agg(((below <= 0.95 + room) & (upto >= 0.95 - room)).alias("p95_within"))
    return rounded(found.drop("p95_ms"), "mean_ms").join(ranks, "node")


@query
def anomaly_cells_report(spark, sf):
    path = _folder(spark, "cells")
    orders = anomaly.prepare_orders(fx.order_items(spark, sf, [*DETECTOR_COLUMNS, "order_date"]))
    anomaly.write_cells(anomaly.span_cells(orders, "month"), path)
    report = anomaly.report_of_cells(spark.read.parquet(path), set(orders.columns), LOW)
    return shown_anomalies(report, "anomaly_id", "position")


@query
def vector_index_hits(spark, sf):
    path, rows = _folder(spark, "vectors"), fx.vectors(spark, sf)
    vector_index.write_vector_index(rows, path)
    asked = fx.vector_queries(spark, sf)
    hits = materialise(vector_index.vector_search(asked, vector_index.read_vector_index(spark, path)))
    exact = materialise(dense.dense_search(asked, rows))
    both = exact.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    enough = both.count() >= 0.9 * exact.count()
    per_query = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 6).alias("best"))
    return per_query.withColumn("recall_reached", F.lit(enough))


# ------------------------------------------------------------------ files
@query
def json_array(spark, sf):
    path = _folder(spark, "array") + ".json"
    objects = fx.table(spark, sf, "documents").select(F.to_json(F.struct("*")).alias("value"))

    def listed(batches):
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield line("[")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(batch.column(0), ",", "")], names=["value"])
        yield line("{}]")

    # one array per file, in one line; the last object is empty
    objects.mapInArrow(listed, "value string").write.option("lineSep", " ").text(path)
    return readers.read_any(spark, path).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")


@query
def csv_encodings(spark, sf):
    path = _folder(spark, "mixed") + ".csv"
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", F.trim(F.regexp_replace("text", r"[\s\\]+", " ")).alias("text"))
    latin = F.col("text").rlike("^[\\x00-\\xff]*$") & (F.col("doc_id") % 2 == 0)
    for part, encoding in ((docs.where(latin), "ISO-8859-1"), (docs.where(~latin), "UTF-8")):
        part.write.mode("append").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return readers.read_any(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")


def _listing(spark, sf) -> DataFrame:
    """A folder with one CSV folder per source, as long as it has documents."""
    path = _folder(spark, "sources")
    docs = fx.table(spark, sf, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    docs.repartition(4, "source").write.partitionBy("source").csv(path)
    return inventory.source_inventory(spark, path, readers.empty_frame(spark, schemas.MANIFEST))


@query
def source_listing(spark, sf):
    found = _listing(spark, sf)
    known = found.where("folder < 'source=src2'").select(
        F.col("path").alias("key"), F.col("length").alias("rows"), (F.col("length") / 13).cast("long").alias("docs"), F.lit(0.0).alias("loaded_at")
    )
    base = F.regexp_replace(F.col("uri"), "/source=.*$", "")
    root = found.select(base.alias("root")).first()["root"]
    again = inventory.source_inventory(spark, root.removeprefix("file:").replace("///", "/"), known)
    return again.select("folder", "ext", "length", "loaded", "loaded_docs")


@query
def source_choice(spark, sf):
    found = _listing(spark, sf)
    orders, skus = inventory.pick_source(found, "orders"), inventory.pick_source(found, "skus")
    named = lambda df, what: df.select(F.lit(what).alias("dataset"), F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    return named(orders, "orders").unionByName(named(skus, "skus"))


@query
def missing_columns(spark, sf):
    """Dashboard figures of orders that lack a column are empty; the others are not touched by that."""
    whole = fx.order_items(spark, sf, ["market", "late_delivery_risk", "order_status"])
    out = None
    for lacking in ("none", "market", "late_delivery_risk", "order_status"):
        orders = whole.drop(lacking)
        for name, figure in (("late", kpi.late_by_market), ("status", kpi.status_distribution), ("fraud", kpi.fraud_by_market)):
            rows = figure(orders).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(lacking).alias("lacking"), F.lit(name).alias("figure"), "rows")
            out = rows if out is None else out.unionByName(rows)
    return out


@query
def metric_thresholds(spark, sf):
    """Every metric's threshold and how many scores of the table meet it."""
    scores, config = fx.metric_scores(spark, sf), evaluation.metrics_config(spark)
    meets = F.when(F.col("lower_is_better"), F.col("score") <= F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    joined = scores.join(F.broadcast(config), ["tool", "metric"])
    return joined.groupBy("tool", "metric", "threshold", "lower_is_better").agg(F.count_if(meets).alias("met"), F.count(F.lit(1)).alias("scored"))
