"""Registered queries: every operator applied to the whole test tables.

Doubles are rounded to six decimals so that two engines agree; array results
are joined to text for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.functions.text import token_estimate
from riskframe.functions.verdicts import parse_verdict_json
from riskframe.functions.vectors import hashed_vector
from riskframe.operators import anomaly, dense, evaluation, guards, incidents, kpi, lexical, ranking, telemetry
from riskframe.operators.anomaly import Thresholds
from riskframe.plans import fixtures as fx
from riskframe.plans.hybrid import embed, hybrid_search
from riskframe.session import materialise
from riskframe.sources.readers import category_filter
from riskframe.sources.sampling import sample_n
from riskframe.sources.tables import current_manifest, last_write_wins, metadata_map, pending_sources, valid_feedback
from riskframe.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Thresholds under which every detector finds something on the test tables.
LOW = Thresholds(
    shipping_gap_zscore=0.5, cancellation_rate=0.11, profit_negative_rate=0.235, quantity_zscore=0.01
)
# Thresholds under which two detectors name the same segments.
SHARED = Thresholds(profit_negative_rate=0.20, quantity_zscore=0.0)
CATEGORY = "PROMO"
RETRY_BELOW = 0.9
CACHE_FROM = 0.7


def query(fn: Query) -> Query:
    """Register under the function's name, without the underscore that tells it from an operator."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ------------------------------------------------------------------ sources, tables
ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query
def sample_orders(spark, sf):
    items = fx.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_quantity")
    return sample_n(items, 2500, ITEM_KEY)


@query
def corpus_upsert(spark, sf):
    items = fx.table(spark, sf, "lineitem").select(*ITEM_KEY, "l_quantity", "l_returnflag")
    return last_write_wins(items, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query
def pending_sources_(spark, sf):
    sources = fx.table(spark, sf, "documents").select(F.col("source").alias("key")).distinct()
    return pending_sources(sources, sources.filter(F.col("key") < "src2"))


# ------------------------------------------------------------------ functions, documents
@query
def order_severity(spark, sf):
    orders = fx.order_items(spark, sf, ["shipping_mode", "late_delivery_risk", "profit", "delivery_status"])
    severity = C.order_severity(F.col("late_delivery_risk"), F.col("profit"), F.col("delivery_status"))
    return (
        orders.groupBy("shipping_mode", "delivery_status", severity.alias("severity"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@query
def order_incidents(spark, sf):
    docs = incidents.orders_to_incidents(fx.order_items(spark, sf, dealt=True)).select("id", "text", "metadata.*")
    return docs.withColumns({"sales": F.round("sales", 4), "profit": F.round("profit", 4), "profit_ratio": F.round("profit_ratio", 6)})


@query
def generic_incidents(spark, sf):
    docs = incidents.rows_to_incidents(fx.table(spark, sf, "part"), "p_partkey")
    return docs.select("id", "text", _entries("metadata").alias("metadata"))


def _entries(name: str):
    """A map as "key=value" parts in the order of keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


@query
def sku_incidents(spark, sf):
    docs = incidents.skus_to_incidents(fx.sku_rows(spark, sf), "row_key")
    return docs.select("id", "text", "metadata.*")


@query
def text_cells(spark, sf):
    padded = F.concat(F.lit("\u3000 \t"), F.col("text"), F.lit("\n\u00a0"))
    cell = C.as_text(F.when(F.col("role") != "user", padded).otherwise(F.lit(" \t")))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", C.strip(padded).alias("stripped"), cell.alias("cell"))


@query
def numeric_cells(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in ("", ".5", "x", "e2")]), (F.col("doc_id") % 4 + 1).cast("int"))
    cell = F.concat((F.col("n_chars") % 7).cast("string"), ending)
    return fx.table(spark, sf, "documents").select("doc_id", C.as_double(cell, -1).alias("number"), C.as_int(cell, -1).alias("whole"))


@query
def severity_cells(spark, sf):
    values = F.array(*[F.lit(x) for x in ("high", "Medium", "LOW", "odd", None)])
    severity = C.normalise_severity(F.get(values, (F.col("o_custkey") % 5).cast("int")))
    return fx.table(spark, sf, "orders").select("o_orderkey", severity.alias("severity"), C.severity_rank(severity).alias("rank"))


@query
def row_metadata(spark, sf):
    named = fx.table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    kept = named.withColumn("metadata", metadata_map(named, ["c_name", "c_nationkey", "c_mktsegment"]))
    return kept.select("c_custkey", _entries("metadata").alias("metadata"))


@query
def manifest_state(spark, sf):
    marks = fx.table(spark, sf, "documents").select(
        F.col("source").alias("key"),
        F.col("n_chars").alias("rows"),
        F.col("doc_id").alias("docs"),
        F.col("doc_id").cast("double").alias("loaded_at"),
        (F.col("doc_id") % 7 == 0).alias("removed"),
    )
    return current_manifest(marks)


@query
def feedback_accepted(spark, sf):
    given = fx.feedback(spark, sf).withColumn("rating", F.when(F.col("session_id").cast("long") % 3 == 0, "meh").otherwise(F.col("rating")))
    return valid_feedback(given).select("session_id", "message_id", "rating")


# ------------------------------------------------------------------ dashboard
@query
def kpi_summary(spark, sf):
    return kpi.summary(fx.order_items(spark, sf, ["late_delivery_risk", "order_status", "profit"]))


@query
def late_by_market(spark, sf):
    return kpi.late_by_market(fx.order_items(spark, sf, ["market", "late_delivery_risk"]))


@query
def mode_breakdown(spark, sf):
    return kpi.mode_breakdown(fx.order_items(spark, sf, ["shipping_mode", "late_delivery_risk"]))


@query
def status_distribution(spark, sf):
    return kpi.status_distribution(fx.order_items(spark, sf, ["order_status"]))


@query
def gap_by_region(spark, sf):
    return kpi.gap_by_region(fx.order_items(spark, sf, ["region", "days_real", "days_scheduled"]))


@query
def fraud_by_market(spark, sf):
    return kpi.fraud_by_market(fx.order_items(spark, sf, ["market", "order_status"]))


@query
def mode_share(spark, sf):
    return rounded(kpi.mode_share(fx.order_items(spark, sf, ["shipping_mode", "late_delivery_risk"])), "share_pct")


# ------------------------------------------------------------------ anomalies
DETECTOR_COLUMNS = (
    "market region shipping_mode category days_scheduled days_real late_delivery_risk order_status quantity profit"
).split()
SHOWN = ["anomaly_type", "severity", "affected_segment", "metric_value", "threshold", "confidence", "n"]


def _prepared(spark, sf, columns=DETECTOR_COLUMNS):
    return anomaly.prepare_orders(fx.order_items(spark, sf, columns))


def shown_anomalies(found: DataFrame, *extra: str) -> DataFrame:
    pairs = F.transform(F.map_entries("supporting_data"), lambda e: F.format_string("%s=%.3f", e["key"], e["value"]))
    supporting = F.array_join(F.array_sort(pairs), ",").alias("supporting")
    shown = found.select(*extra, *SHOWN, "description", "recommendation", supporting)
    return rounded(shown, "metric_value", "threshold", "confidence")


@query
def late_delivery_spikes(spark, sf):
    orders = _prepared(spark, sf, ["market", "shipping_mode", "late_delivery_risk"])
    return shown_anomalies(anomaly.late_delivery_spikes(orders))


@query
def shipping_gap_outliers(spark, sf):
    orders = _prepared(spark, sf, ["shipping_mode", "days_real", "days_scheduled"])
    return shown_anomalies(anomaly.shipping_gap_outliers(orders, LOW))


@query
def cancellation_surges(spark, sf):
    return shown_anomalies(anomaly.cancellation_surges(_prepared(spark, sf, ["market", "order_status"]), LOW))


@query
def fraud_clusters(spark, sf):
    return shown_anomalies(anomaly.fraud_clusters(_prepared(spark, sf, ["market", "region", "order_status"])))


@query
def profit_erosion(spark, sf):
    return shown_anomalies(anomaly.profit_erosion(_prepared(spark, sf, ["category", "profit"]), LOW))


@query
def demand_spikes(spark, sf):
    return shown_anomalies(anomaly.demand_spikes(_prepared(spark, sf, ["category", "quantity"]), LOW))


@query
def anomaly_report(spark, sf):
    return shown_anomalies(anomaly.run_all(_prepared(spark, sf), LOW), "anomaly_id", "position")


@query
def category_filtered_report(spark, sf):
    orders = category_filter(_prepared(spark, sf), CATEGORY)
    return shown_anomalies(anomaly.run_all(orders, LOW), "anomaly_id", "position")


@query
def correlated_risks(spark, sf):
    found = anomaly.correlate(anomaly.run_all(_prepared(spark, sf), SHARED))
    return found.select(
        "segment",
        F.array_join("correlated_anomaly_ids", ",").alias("anomaly_ids"),
        F.array_join("anomaly_types", ",").alias("anomaly_types"),
        "max_severity",
        "compound_risk",
        "note",
    )


@query
def threshold_report(spark, sf):
    own = Thresholds(late_delivery_rate=0.5, fraud_rate=0.001, profit_negative_rate=0.2, min_segment_orders=200)
    return shown_anomalies(anomaly.run_all(_prepared(spark, sf), own), "anomaly_id", "position")


@query
def high_risk_summary(spark, sf):
    parts = anomaly.high_summary(_prepared(spark, sf), SHARED)
    c = F.col

    def line(name, section, item, detail):
        return parts[name].select(F.lit(section).alias("section"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    parts["counts"] = parts["summary"].select(F.stack(F.lit(3), *[x for s in C.SEVERITIES for x in (F.lit(s), c(s))]).alias("s", "n"))
    risks = F.concat("max_severity", F.lit(": "), F.array_join("correlated_anomaly_ids", ","))
    return (
        line("header", "total_orders_analyzed", c("total_orders_analyzed"), F.lit(""))
        .union(line("header", "anomaly_count", c("anomaly_count"), F.lit("")))
        .union(line("counts", "summary", c("s"), c("n")))
        .union(line("high_severity_anomalies", "high_severity_anomalies", c("anomaly_id"), c("description")))
        .union(line("correlated_risks", "correlated_risks", c("segment"), risks))
    )


@query
def severity_summary(spark, sf):
    return anomaly.severity_summary(anomaly.run_all(_prepared(spark, sf), LOW))


@query
def report_header(spark, sf):
    orders = _prepared(spark, sf)
    return anomaly.report_header(orders, anomaly.run_all(orders, LOW)).drop("run_timestamp")


@query
def high_severity_anomalies(spark, sf):
    return shown_anomalies(anomaly.high_only(anomaly.run_all(_prepared(spark, sf), LOW)), "anomaly_id")


# ------------------------------------------------------------------ guards
def _conversations(spark, sf):
    verdict = F.when(F.col("role") == "user", "yes").when(F.col("role") == "assistant", "NO")
    return fx.texts(spark, sf, "conversations").withColumn("verdict", verdict)


@query
def guard_length(spark, sf):
    docs = fx.texts(spark, sf)
    return docs.select("doc_id", guards.length_reason("text").alias("reason"))


@query
def guard_injection(spark, sf):
    docs = fx.texts(spark, sf)
    return docs.select("doc_id", guards.injection_match("text").alias("matched"))


@query
def guard_domain(spark, sf):
    docs = fx.texts(spark, sf)
    return docs.select("doc_id", guards.has_domain_keyword("text").alias("on_topic"))


@query
def guard_verdicts(spark, sf):
    checked = guards.validate_input(_conversations(spark, sf), verdict_col="verdict")
    return checked.select("conv_id", "turn", "guard.ok", "guard.reason", "guard.severity", "guard.fast_reply")


def _redacted(category: str) -> Query:
    def run(spark, sf):
        docs = fx.texts(spark, sf)
        if category == "ssn":  # the texts have none of their own
            parts = [("doc_id", 1000, 3), ("n_chars", 100, 2), ("doc_id", 10000, 4)]
            number = F.concat_ws("-", *[F.lpad((F.col(c) % m).cast("string"), n, "0") for c, m, n in parts])
            marked = F.concat_ws(" ", "text", F.lit("id"), number)
            docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, marked).otherwise(F.col("text")))
        docs = docs.filter(guards.contains_pii("text", category))
        return docs.select("doc_id", guards.redact("text", category).alias("clean_text"))

    return run


for _category in guards.PII_PATTERNS:
    QUERIES[f"pii_{_category}"] = _redacted(_category)


@query
def pii_scrub(spark, sf):
    docs = guards.scrub_pii(fx.texts(spark, sf))
    return docs.select("doc_id", "clean_text", F.array_join("pii_found", ",").alias("pii_found"))


@query
def pii_by_source(spark, sf):
    return guards.pii_profile(fx.texts(spark, sf), "source")


@query
def token_estimate_(spark, sf):
    return fx.texts(spark, sf).select("doc_id", token_estimate("text").alias("tokens"))


@query
def output_guard(spark, sf):
    verdicts = ('{"faithful": false}', "It is faithful: true.", "FAITHFUL? no", None)
    said = F.get(F.array(*[F.lit(v) for v in verdicts]), (F.col("doc_id") % 4).cast("int"))
    answers = fx.texts(spark, sf).withColumns({"context": F.when(F.col("doc_id") % 3 != 0, F.col("lang")), "verdict": said})
    done = guards.validate_output(answers, "text", "context", "verdict")
    return done.select("doc_id", "faithful", "faithful_reason")


@query
def verdict_json(spark, sf):
    strict = F.concat(F.lit('{"intent": "'), "source", F.lit('", "severity": "high", "rationale": "because '), "lang", F.lit('"}'))
    wrapped = F.lit('Sure: {"severity": "medium"} as asked')
    said = F.get(F.array(strict, wrapped, F.lit("no object"), F.lit(None).cast("string")), (F.col("doc_id") % 4).cast("int"))
    return fx.table(spark, sf, "documents").select("doc_id", parse_verdict_json(said).alias("v")).select("doc_id", "v.*")


@query
def context_pack(spark, sf):
    docs = fx.texts(spark, sf).select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text"
    )
    return guards.pack_context(docs)


# ------------------------------------------------------------------ retrieval
@query
def token_counts(spark, sf):
    counts = lexical.token_counts(fx.corpus(spark, sf), "doc_id")
    return counts.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query
def bm25_term_stats(spark, sf):
    return rounded(lexical.build_bm25(fx.corpus(spark, sf), compute=True).term_stats, "idf")


def _sparse(spark, sf):
    docs = fx.corpus(spark, sf)
    return lexical.bm25_scan(fx.search_queries(spark, sf), docs, lexical.build_bm25(docs, compute=True))


@query
def bm25_topk(spark, sf):
    return rounded(_sparse(spark, sf), "score")


@query
def bm25_postings_topk(spark, sf):
    index = lexical.build_bm25(fx.corpus(spark, sf), compute=True)
    return rounded(lexical.bm25_search(fx.search_queries(spark, sf), index), "score")


@query
def hashed_embedding(spark, sf):
    docs = fx.corpus(spark, sf).select("doc_id", F.posexplode(hashed_vector("text")).alias("dim", "value"))
    return rounded(docs.filter(F.col("value") > 0), "value")


def _vectors(spark, sf):
    return fx.vectors(spark, sf)


def _centroids(spark, sf):
    """One query per label: the mean of its vectors."""
    cells = _vectors(spark, sf).select("label", F.posexplode("vec").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # 64 entries per label
    gathered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    return gathered.select(F.col("label").alias("query_id"), F.col("ms.m").alias("vec"))


@query
def cosine_pairs(spark, sf):
    a = _vectors(spark, sf).select("doc_id", F.col("vec").alias("a"))
    b = _vectors(spark, sf).select((F.col("doc_id") - 1).alias("doc_id"), F.col("vec").alias("b"))
    return rounded(dense.pair_cosines(a.join(b, "doc_id")).select("doc_id", "cosine"), "cosine")


@query
def dense_topk(spark, sf):
    return rounded(dense.dense_search(_centroids(spark, sf), _vectors(spark, sf)), "score")


@query
def dense_topk_filtered(spark, sf):
    return rounded(dense.dense_search(_centroids(spark, sf), _vectors(spark, sf), 10, where={"label": 3}), "score")


@query
def dense_topk_rows(spark, sf):
    return rounded(dense.dense_search(fx.vector_queries(spark, sf), _vectors(spark, sf)), "score")


@query
def dense_topk_rows_filtered(spark, sf):
    return rounded(dense.dense_search(fx.vector_queries(spark, sf), _vectors(spark, sf), 10, where={"label": 3}), "score")


@query
def dense_topk_approx(spark, sf):
    return rounded(dense.dense_search_ann(_centroids(spark, sf), _vectors(spark, sf)), "score")


def _dense_text(spark, sf, queries=None, k=20):
    asked = embed(fx.search_queries(spark, sf) if queries is None else queries)
    return dense.dense_search(asked, embed(fx.corpus(spark, sf)), k)


def _fused(spark, sf):
    return ranking.rrf([_dense_text(spark, sf), _sparse(spark, sf)])


@query
def rrf_fusion(spark, sf):
    return rounded(_fused(spark, sf).select("query_id", "doc_id", "rank", "rrf_score", "score"), "rrf_score", "score")


@query
def rerank_topk(spark, sf):
    hits = ranking.rerank(materialise(_fused(spark, sf)), embed(fx.search_queries(spark, sf)), texts=fx.corpus(spark, sf))
    return rounded(hits.select("query_id", "doc_id", "rank", "score", "rerank_score"), "score", "rerank_score")


@query
def max_scores(spark, sf):
    best = ranking.max_scores(_dense_text(spark, sf), fx.search_queries(spark, sf), "score")
    return rounded(best, "max_score")


@query
def retry_gate(spark, sf):
    best = ranking.max_scores(_dense_text(spark, sf), fx.search_queries(spark, sf), "score")
    return rounded(ranking.retry_gate(best, RETRY_BELOW), "max_score")


def _attempts(spark, sf):
    rewritten = fx.rewritten_queries(spark, sf)
    first = _dense_text(spark, sf, k=5)
    second = _dense_text(spark, sf, rewritten.withColumnRenamed("rewritten", "text"), k=5)
    return first, second, fx.search_queries(spark, sf).join(rewritten, "query_id")


@query
def best_of_two(spark, sf):
    first, second, asked = _attempts(spark, sf)
    hits = ranking.best_of_two(first, second, asked, "score")
    return rounded(
        hits.select("query_id", "doc_id", "rank", "score", "max_score", "reformulated_from"), "score", "max_score"
    )


@query
def response_docs(spark, sf):
    first, second, _ = _attempts(spark, sf)
    hits = first.unionByName(second.withColumn("rank", F.col("rank") + 5))
    return rounded(ranking.response_docs(hits), "score")


@query
def prompt_context(spark, sf):
    hits = _dense_text(spark, sf, k=5).join(fx.corpus(spark, sf), "doc_id")
    return ranking.format_context(hits)


@query
def hybrid_search_(spark, sf):
    hits = hybrid_search(
        fx.search_queries(spark, sf),
        fx.corpus(spark, sf),
        fx.rewritten_queries(spark, sf),
        threshold=RETRY_BELOW,
    )
    shown = hits.select("query_id", "doc_id", "rank", "rerank_score", "max_score", "reformulated_from")
    return rounded(shown, "rerank_score", "max_score")


@query
def semantic_cache_hits(spark, sf):
    asked = embed(
        fx.texts(spark, sf, "conversations").select(
            F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text"
        )
    )
    entries = embed(fx.search_queries(spark, sf)).select(
        F.col("query_id").alias("entry_id"), "vec", F.col("text").alias("payload")
    )
    return rounded(dense.cache_lookup(asked, entries, CACHE_FROM), "similarity")


@query
def cache_retain(spark, sf):
    entries = fx.cache_entries(fx.table(spark, sf, "conversations"))
    return ranking.cache_retain(entries, 100)


@query
def route_fanout(spark, sf):
    decisions = _runs(spark, sf).filter(F.col("type") == "orchestrator_decision")
    return ranking.route_specialists(decisions.select("run_id", "event_id", "intent"))


# ------------------------------------------------------------------ evaluation
@query
def eval_samples(spark, sf):
    picked = evaluation.select_samples(fx.golden_samples(spark, sf), "shipment", 50)
    return picked.select("pos", "question", "category", "ground_truth")


@query
def default_contexts(spark, sf):
    golden = fx.golden_samples(spark, sf)
    some = golden.withColumn("contexts", F.when(F.col("quality") == 1, F.col("contexts")))
    return evaluation.default_contexts(some).select("pos", F.array_join("contexts", "|").alias("contexts"))


@query
def eval_resolve(spark, sf):
    golden = fx.golden_samples(spark, sf)
    live = golden.filter(F.col("quality") == 1).select(
        "pos",
        F.concat(F.lit("Live: "), "question").alias("answer"),
        F.when(F.col("toxic") == 0, F.array(F.col("question"))).otherwise(F.array().cast("array<string>")).alias("contexts"),
    )
    done = evaluation.resolve_answers(golden, live)
    return done.select("pos", "answer", F.array_join("contexts", "|").alias("contexts"))


def _scores(spark, sf):
    return evaluation.pass_flag(fx.metric_scores(spark, sf))


@query
def metric_pass(spark, sf):
    return _scores(spark, sf).select("tool", "sample_id", "metric", "score", "threshold", "passed")


@query
def metric_aggregate(spark, sf):
    table = evaluation.aggregate_scores(_scores(spark, sf), digits=None)
    return rounded(table, "mean_score", "pass_rate")


@query
def metric_overall(spark, sf):
    table = evaluation.overall(evaluation.aggregate_scores(_scores(spark, sf), digits=None), digits=None)
    return rounded(table, "overall_pass_rate", "overall_mean_score")


@query
def suite_pass(spark, sf):
    table = evaluation.suite_pass(fx.metric_scores(spark, sf), digits=None)
    return rounded(table, "mean_score", "overall_mean_score", "overall_pass_rate")


@query
def latest_run(spark, sf):
    runs = (
        fx.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last"))
        .select(
            F.concat(F.lit("job-"), F.col("conv_id").cast("string")).alias("job_id"),
            F.when(F.col("turns") % 2 == 0, "completed").otherwise("running").alias("status"),
            F.when(F.col("conv_id") % 2 == 0, "deepeval").otherwise("ragas").alias("tool"),
            ((F.col("conv_id") * 37) % 1000 + F.col("last")).cast("double").alias("ran_at"),
        )
    )
    return evaluation.latest_run(runs)


@query
def compare_suites(spark, sf):
    return rounded(evaluation.compare_suites(fx.metric_scores(spark, sf)), *evaluation.SUITE_METRICS)


# ------------------------------------------------------------------ telemetry
def _runs(spark, sf):
    return fx.run_events(fx.table(spark, sf, "events"))


@query
def session_timeline(spark, sf):
    return telemetry.session_events(_runs(spark, sf)).select("run_id", "seq", "event_id", "t", "type")


@query
def node_spans(spark, sf):
    return telemetry.node_spans(_runs(spark, sf))


@query
def node_latency(spark, sf):
    table = telemetry.node_latency(_runs(spark, sf), accuracy=1_000_000)
    return rounded(table, "mean_ms")


@query
def node_status(spark, sf):
    return telemetry.node_status(_runs(spark, sf))


@query
def skipped_nodes(spark, sf):
    return telemetry.skipped_specialists(_runs(spark, sf))


@query
def retrieval_by_node(spark, sf):
    return telemetry.attribute_retrieval(_runs(spark, sf))


@query
def run_status(spark, sf):
    return rounded(telemetry.run_status(_runs(spark, sf)), "elapsed_ms")


@query
def run_metrics(spark, sf):
    return rounded(telemetry.run_metrics(_runs(spark, sf)), "elapsed_total")


@query
def quality_score(spark, sf):
    scored = telemetry.quality_score(telemetry.run_metrics(_runs(spark, sf)))
    return scored.select("run_id", "quality", "band")


@query
def human_review_queue(spark, sf):
    queue = telemetry.human_review_queue(telemetry.run_status(_runs(spark, sf)))
    return queue.select("run_id", "status", "severity", "intent")


@query
def recent_feedback(spark, sf):
    return telemetry.recent_feedback(fx.feedback(spark, sf)).select("session_id", "message_id", "rating", "ts")


@query
def guard_outcomes(spark, sf):
    checked = guards.validate_input(_conversations(spark, sf), verdict_col="verdict")
    return telemetry.guard_outcomes(telemetry.guard_events(checked))


# ------------------------------------------------------------------ batch twins of streams
@query
def hourly_events(spark, sf):
    return jobs.event_counts(fx.table(spark, sf, "events"))


@query
def event_sessions(spark, sf):
    return telemetry.session_extents(fx.table(spark, sf, "events"), "user_id", time="ts")
