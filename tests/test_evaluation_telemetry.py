"""Score tables and run telemetry on small inline rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluation as ev
from riskframe.operators import telemetry as tel

SCORES = "tool string, sample_id int, metric string, score double"


def test_pass_flag_edges(spark):
    rows = [
        ("deepeval", 1, "faithfulness", 0.7), ("deepeval", 2, "faithfulness", 0.69),
        ("deepeval", 3, "hallucination", 0.4), ("deepeval", 4, "hallucination", 0.41),
        ("ragas", 5, "context_recall", None), ("deepeval", 6, "hallucination", None),
    ]
    got = {r.sample_id: (r.score, r.passed) for r in ev.pass_flag(spark.createDataFrame(rows, SCORES)).collect()}
    assert got == {1: (0.7, True), 2: (0.69, False), 3: (0.4, True), 4: (0.41, False), 5: (0.0, False), 6: (0.0, False)}


def test_aggregates_and_overall(spark):
    rows = [("deepeval", i, "faithfulness", s) for i, s in enumerate((0.5, 0.9))]
    rows += [("deepeval", i, "hallucination", s) for i, s in enumerate((0.1, 0.3))]
    table = ev.aggregate_scores(ev.pass_flag(spark.createDataFrame(rows, SCORES)))
    got = {r.metric: (r.mean_score, r.min_score, r.max_score, r.pass_rate, r.sample_count, r.threshold) for r in table.collect()}
    assert got == {"faithfulness": (0.7, 0.5, 0.9, 0.5, 2, 0.7), "hallucination": (0.2, 0.1, 0.3, 1.0, 2, 0.4)}
    row = ev.overall(table).first()
    assert (row.overall_pass_rate, row.overall_mean_score) == (0.75, 0.75)


def test_suite_pass_judges_means(spark):
    rows = [("ragas", i, "faithfulness", s) for i, s in enumerate((0.5, 0.9))] + [("ragas", 0, "context_recall", 0.2)]
    got = {r.metric: (r.passed, r.pass_rate, r.overall_pass_rate, r.overall_mean_score) for r in ev.suite_pass(spark.createDataFrame(rows, SCORES)).collect()}
    assert got == {"faithfulness": (True, 1.0, 0.5, 0.45), "context_recall": (False, 0.0, 0.5, 0.45)}


def test_compare_suites(spark):
    rows = [("deepeval", 1, "contextual_recall", 0.5), ("ragas", 1, "context_recall", 0.7), ("deepeval", 1, "hallucination", 0.3)]
    got = {r.metric: r for r in ev.compare_suites(spark.createDataFrame(rows, SCORES)).collect()}
    assert (got["contextual_recall"].deepeval_passed, got["contextual_recall"].ragas_passed) == (False, True)
    assert got["hallucination"].deepeval_passed is True and got["hallucination"].ragas is None


def test_samples_and_answers(spark):
    golden = spark.createDataFrame(
        [(3, "q3", "g3", ["c"], "shipment"), (1, "q1", "g1", [], "shipment"), (2, "q2", "g2", None, "inventory")],
        "pos int, question string, ground_truth string, contexts array<string>, category string",
    )
    assert [r.pos for r in ev.select_samples(golden, "shipment", 1).collect()] == [1]
    assert [r.pos for r in ev.select_samples(golden, n=2).collect()] == [1, 2]
    assert ev.select_samples(golden, n=500).count() == 3
    with pytest.raises(ValueError):
        ev.select_samples(golden, n=0)
    live = spark.createDataFrame([(3, "a3", []), (1, None, ["x"])], "pos int, answer string, contexts array<string>")
    got = {r.pos: (r.answer, r.contexts) for r in ev.resolve_answers(golden, live).collect()}
    assert got == {3: ("a3", ["c"]), 1: ("g1", ["x"]), 2: ("g2", None)}
    assert {r.pos: r.contexts for r in ev.default_contexts(ev.resolve_answers(golden)).collect()} == {3: ["c"], 1: ["g1"], 2: ["g2"]}
    assert ev.metrics_config(spark).count() == 9


def test_latest_run(spark):
    schema = "job_id string, status string, tool string, ran_at double"
    runs = spark.createDataFrame([("zz", "completed", "ragas", 1.0), ("aa", "completed", "deepeval", 5.0), ("bb", "running", "ragas", 9.0)], schema)
    assert ev.latest_run(runs).first().job_id == "aa"
    none = ev.latest_run(runs.filter("status = 'failed'")).first()
    assert none.status == "no_results" and none.job_id is None and none.note


# ------------------------------------------------------------------ telemetry
EVENTS = (
    "run_id string, t timestamp_ntz, event_id long, type string, node string, elapsed_ms double, docs long, "
    "max_score double, faithful boolean, pii_redacted array<string>, intent string, severity string, reason string"
)
START = dt.datetime(2024, 1, 1)


def make(spark, rows):
    """rows: (run, minute, type, overrides)"""
    names = [f.split()[0] for f in EVENTS.split(", ")]
    full = []
    for i, (run, minute, kind, over) in enumerate(rows):
        row = dict.fromkeys(names) | dict(run_id=run, t=START + dt.timedelta(minutes=minute), event_id=i, type=kind) | over
        full.append(tuple(row[n] for n in names))
    return spark.createDataFrame(full, EVENTS)


def test_spans_cross_time_spans(spark):
    n = dict(node="supplier_risk")
    df = make(
        spark,
        [
            ("r", 0, "node_start", n), ("r", 45, "node_end", n | dict(elapsed_ms=9.0)), ("r", 46, "node_start", n),
            ("r", 47, "node_start", n), ("r", 900, "node_error", n | dict(elapsed_ms=1.0)), ("r", 901, "node_end", n),
            ("r", 902, "node_start", n), ("s", 903, "node_end", n),
        ],
    )
    got = [(r.started_at.minute, r.status, r.elapsed_ms) for r in tel.node_spans(df).orderBy("started_at").collect()]
    assert got == [(0, "done", 9.0), (46, "running", None), (47, "error", 1.0), (2, "running", None)]


def fold(rows):
    """The open node at each retrieval, one event after another."""
    active, out = None, []
    for i, (_, _, kind, over) in enumerate(rows):
        if kind == "node_start":
            active = over["node"]
        elif kind in ("node_end", "node_error") and active == over["node"]:
            active = None
        elif kind == "retrieval":
            out.append((i, active))
    return out


def test_retrieval_attribution_against_a_fold(spark):
    r = random.Random(5)
    rows, minute = [], 0
    for _ in range(600):
        minute += r.choice([0, 0, 1, 3, 25])
        kind = r.choice(["node_start", "node_end", "node_error", "retrieval", "retrieval", "final"])
        rows.append(("hot", minute, kind, dict(node=r.choice(tel.NODES)) if kind.startswith("node") else {}))
    got = {x.event_id: x.node for x in tel.attribute_retrieval(make(spark, rows)).collect()}
    assert got == dict(fold(rows))


def test_timeline_numbers_a_hot_run(spark):
    df = spark.range(30_000).selectExpr(
        "'hot' AS run_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 7000) AS t", "id AS event_id", "'x' AS type"
    )
    got = tel.session_events(df.unionByName(df.limit(3).withColumn("run_id", F.lit(""))))
    ordered = [(r.seq, r.event_id) for r in got.orderBy("t", "event_id").collect()]
    assert [s for s, _ in ordered] == list(range(1, 30_001))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


def test_node_status_skips_and_idles(spark):
    d = dict(intent="shipment_analysis")
    df = make(
        spark,
        [
            ("a", 0, "orchestrator_decision", d), ("a", 1, "node_start", dict(node="shipment_analysis")),
            ("a", 2, "node_end", dict(node="shipment_analysis", elapsed_ms=5.0)), ("a", 3, "node_start", dict(node="supplier_risk")),
            ("b", 0, "orchestrator_decision", dict(intent="general")), ("b", 1, "node_error", dict(node="recommendation", elapsed_ms=2.0)),
        ],
    )
    got = {(r.run_id, r.node): (r.status, r.elapsed_ms) for r in tel.node_status(df).collect()}
    assert len(got) == 10
    assert got["a", "shipment_analysis"] == ("done", 5.0) and got["a", "supplier_risk"] == ("running", None)
    assert got["a", "inventory_intelligence"] == ("skipped", None) and got["a", "orchestrator"] == ("idle", None)
    assert got["b", "recommendation"] == ("error", 2.0) and got["b", "supplier_risk"] == ("idle", None)
    assert [tuple(r) for r in tel.skipped_specialists(df).collect()] == [("a", "inventory_intelligence")]


def test_run_status_and_metrics(spark):
    df = make(
        spark,
        [
            ("a", 0, "orchestrator_decision", dict(intent="general", severity="HIGH")),
            ("a", 1, "retrieval", dict(docs=2, max_score=0.3, elapsed_ms=10.0)), ("a", 2, "crag_retry", {}),
            ("a", 3, "retrieval", dict(docs=None, max_score=0.9, elapsed_ms=20.0)),
            ("a", 4, "faithfulness", dict(faithful=True, pii_redacted=["email"])), ("a", 5, "final", {}),
            ("b", 0, "guard_block", dict(reason="why", severity="LOW")), ("c", 0, "node_start", dict(node="x")),
            ("d", 0, "cached", {}), ("d", 1, "error", {}),
        ],
    )
    runs = {r.run_id: r for r in tel.run_status(df).collect()}
    assert {k: v.status for k, v in runs.items()} == {"a": "done", "b": "blocked", "c": "running", "d": "error"}
    assert (runs["a"].intent, runs["a"].severity, runs["a"].elapsed_ms) == ("general", "HIGH", 300_000.0)
    assert runs["b"].reason == "why" and runs["c"].finished_at is None
    assert [r.run_id for r in tel.human_review_queue(tel.run_status(df)).collect()] == ["a"]
    metrics = {r.run_id: r for r in tel.run_metrics(df).collect()}
    a = metrics["a"]
    assert (a.retrieval_docs, a.retrieval_score, a.retrieval_ms, a.retries) == (0, 0.9, 20.0, 1)
    assert (a.faithful, a.pii_redacted, a.cache_hit, a.elapsed_total) == (True, True, False, 300_000.0)
    assert metrics["d"].cache_hit is True and metrics["b"].retrieval_score is None


@pytest.mark.parametrize(
    "faithful, score, retries, docs, pii, want, band",
    [
        (True, 1.0, 0, 3, False, 100, "green"), (True, 0.35, 0, 3, True, 76, "amber"), (False, 0.5, 1, 3, False, 25, "red"),
        (None, None, 0, 3, False, None, None), (None, 0.05, 0, 0, None, 2, "red"), (True, None, 0, None, False, 50, "red"),
    ],
)
def test_quality(spark, faithful, score, retries, docs, pii, want, band):
    df = spark.createDataFrame(
        [(faithful, score, retries, docs, pii)],
        "faithful boolean, retrieval_score double, retries int, retrieval_docs int, pii_redacted boolean",
    )
    row = tel.quality_score(df).first()
    assert (row.quality, row.band) == (want, band)


def test_sessions_against_a_fold(spark):
    r = random.Random(9)
    rows, t = [], START
    for i in range(400):
        t += dt.timedelta(minutes=r.choice([0, 1, 5, 29, 30, 31, 200]))
        rows.append((i, r.choice(["u", "u", "v"]), t))
    df = spark.createDataFrame(rows, "event_id long, user string, t timestamp_ntz")
    got = {(x.user, x.session_start): (x.session_end, x.events) for x in tel.session_extents(df, "user").collect()}
    want = {}
    for user in ("u", "v"):
        times = [x for _, w, x in rows if w == user]
        start = last = times[0]
        n = 1
        for x in times[1:] + [None]:
            if x is None or x >= last + dt.timedelta(minutes=30):
                want[user, start] = (last + dt.timedelta(minutes=30), n)
                start, n = x, 0
            last, n = x, n + 1
    assert got == want


def test_events_without_a_time_come_first(spark):
    rows = [("r", None, 2, "node_start"), ("r", dt.datetime(2024, 1, 1), 1, "node_end"), ("r", None, 1, "final")]
    events = spark.createDataFrame(rows, "run_id string, t timestamp_ntz, event_id long, type string")
    got = tel.session_events(events).orderBy("seq").collect()
    assert [(r.seq, r.event_id, r.t is None) for r in got] == [(1, 1, True), (2, 2, True), (3, 1, False)]
