"""Run telemetry (TEL group) over an event table (run_id, t, event_id, type, node, ...).

Per-run state is a fold that keeps "the last value of x", so almost all of it
is conditional max_by aggregation, which combines before the shuffle and does
not mind a run that holds much of the table.

What needs neighbours in time (pairing starts with ends, the node open at a
retrieval) must order the events of a run. A run is cut into fixed spans of
time: windows run inside a span, and one summary row per span hands its last
(or first) value on to the others. No task sorts more of a run than one span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.operators.ranking import SPECIALISTS, routed

ORDER = ("t", "event_id")
# Nodes of a run.
NODES = ("orchestrator", *SPECIALISTS, "recommendation")
#: Seconds of a span, and the span of events that have no time (they come first).
SPAN, TIMELESS = 600, -(2**62)


# ------------------------------------------------------------------ ordered helpers
def _spans(df: DataFrame, span: int) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (span * 1_000_000))
    return df.withColumn("_span", F.coalesce(at, F.lit(TIMELESS)))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    forward: bool = False,
    include_self: bool = True,
    span: int = SPAN,
) -> DataFrame:
    """Adds each of ``values``: its last non-null value at or before the row, within the key group.

    ``forward`` looks ahead instead (first value at or after the row);
    ``include_self=False`` leaves out the row itself. All values share one
    shuffle of the rows and one of the span summaries.
    """
    keys = list(keys)
    staged = _spans(df.withColumns({f"_v_{n}": v for n, v in values.items()}), span)
    edge, scan = (F.min_by, F.first) if forward else (F.max_by, F.last)
    edges = [
        edge(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*ORDER))).alias(f"_e_{n}") for n in values
    ]
    over_spans = Window.partitionBy(*keys).orderBy("_span")
    inside = Window.partitionBy(*keys, "_span").orderBy(*ORDER)
    near = 0 if include_self else 1
    if forward:
        over_spans = over_spans.rowsBetween(1, Window.unboundedFollowing)
        inside = inside.rowsBetween(near, Window.unboundedFollowing)
    else:
        over_spans = over_spans.rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.rowsBetween(Window.unboundedPreceding, -near)
    handed = [scan(f"_e_{n}", ignorenulls=True).over(over_spans).alias(f"_h_{n}") for n in values]
    summary = staged.groupBy(*keys, "_span").agg(*edges).select(*keys, "_span", *handed)
    found = {n: F.coalesce(scan(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_h_{n}")) for n in values}
    joined = staged.join(summary, [*keys, "_span"])
    return joined.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def numbered(df: DataFrame, keys: Sequence[str], name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: position of each row within its key group, from 1, in time order."""
    keys = list(keys)
    staged = _spans(df, span)
    over_spans = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        staged.groupBy(*keys, "_span")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_span", F.coalesce(F.sum("_n").over(over_spans), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(*ORDER)
    return (
        staged.join(before, [*keys, "_span"])
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_span", "_before")
    )


def _last(value: Column | str, condition: Column) -> Column:
    """The value of the last event for which the condition holds."""
    return F.max_by(value, F.when(condition, F.struct(*ORDER)))


# ------------------------------------------------------------------ operators
def session_extents(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "t") -> DataFrame:
    """STR6 in batch: activity sessions of a key, split where nothing happens for ``gap``.

    (key, session_start, session_end, events), where the end is the last event
    plus the gap, as `session_window` has it. Events of one gap-long span
    always share a session, so spans are aggregated first (no sort, combined
    before the shuffle) and only span rows are put in order.
    """
    length = F.expr(f"interval {gap}")
    spans = (
        events.groupBy(key, F.window(time, gap).alias("w"))
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
        .select(key, "first", "last", "n")
    )
    w = Window.partitionBy(key).orderBy("first")
    before = F.lag("last").over(w)
    opens = F.when(before.isNull() | (F.col("first") >= before + length), 1).otherwise(0)
    numbered_spans = spans.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(w))
    return (
        numbered_spans.groupBy(key, "_session")
        .agg(
            F.min("first").alias("session_start"),
            (F.max("last") + length).alias("session_end"),
            F.sum("n").alias("events"),
        )
        .drop("_session")
    )


def session_events(events: DataFrame, session: str | None = None) -> DataFrame:
    """TEL1: the events of a session (or of each) numbered in emission order; others are discarded."""
    kept = events.filter(F.col("run_id").isNotNull() & (F.col("run_id") != ""))
    if session is not None:
        kept = kept.filter(F.col("run_id") == session)
    return numbered(kept, ["run_id"], "seq")


def node_spans(events: DataFrame) -> DataFrame:
    """TEL2: every node start with the end or error that directly follows it in its run and node.

    A start that is followed by another start, or by nothing, is still running.
    """
    steps = events.filter(F.col("type").isin("node_start", "node_end", "node_error"))
    step = F.struct("type", "t", "elapsed_ms")
    following = carry(steps, ["run_id", "node"], {"_next": step}, forward=True, include_self=False)
    closed = F.col("_next.type").isin("node_end", "node_error")
    return following.filter(F.col("type") == "node_start").select(
        "run_id",
        "node",
        F.col("t").alias("started_at"),
        F.when(closed, F.col("_next.t")).alias("finished_at"),
        F.when(closed, F.col("_next.elapsed_ms")).alias("elapsed_ms"),
        F.when(~closed | closed.isNull(), "running")
        .when(F.col("_next.type") == "node_end", "done")
        .otherwise("error")
        .alias("status"),
    )


def node_latency(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """TEL3: spans, errors and elapsed milliseconds per node."""
    closing = events.filter(F.col("type").isin("node_end", "node_error"))
    return closing.groupBy("node").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("type") == "node_error").alias("errors"),
        F.avg("elapsed_ms").alias("mean_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.percentile_approx("elapsed_ms", 0.95, accuracy).alias("p95_ms"),
    )


#: Size of stored latency sketches: a quantile's rank is off by about 0.3 % at most.
SKETCH_K, SKETCH_ERROR = 1000, 0.01


def latency_sketches(events: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """TEL3 to be stored: sums and a mergeable sketch of elapsed milliseconds per node and hour."""
    closing = events.filter(F.col("type").isin("node_end", "node_error"))
    return closing.groupBy("node", F.date_trunc("hour", "t").alias("hour")).agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("type") == "node_error").alias("errors"),
        F.count("elapsed_ms").alias("timed"),
        F.sum("elapsed_ms").alias("sum_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.kll_sketch_agg_double(F.col("elapsed_ms").cast("double"), F.lit(k)).alias("sketch"),
    )


def latency_of_sketches(sketches: DataFrame, quantile: float = 0.95) -> DataFrame:
    """TEL3 of any nodes and hours from their stored rows, without the events.

    The quantile's rank is off by less than ``SKETCH_ERROR``; the rest is exact.
    """
    merged = sketches.groupBy("node").agg(
        F.sum("spans").alias("spans"),
        F.sum("errors").alias("errors"),
        F.try_divide(F.sum("sum_ms"), F.sum("timed")).alias("mean_ms"),
        F.max("max_ms").alias("max_ms"),
        F.sum("timed").alias("timed"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    p = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)))
    return merged.withColumn("p95_ms", p).drop("timed", "sketch")


def node_status(events: DataFrame) -> DataFrame:
    """TEL4: final status of all five nodes of every run: idle, running, done, error or skipped.

    One aggregate per run holds the five nodes side by side and is then
    unfolded, so idle nodes need no join. A specialist is skipped when some
    routing decision left it out and it has no events of its own.
    """
    node, kind = F.col("node"), F.col("type")
    closing = kind.isin("node_end", "node_error")
    stepping = kind.isin("node_start", "node_end", "node_error")
    decision = (kind == "orchestrator_decision") & F.col("intent").isNotNull()
    folded = []
    for i, name in enumerate(NODES):
        mine = (node == name) & stepping
        folded += [
            _last(kind, mine).alias(f"kind_{i}"),
            _last("elapsed_ms", mine & closing).alias(f"ms_{i}"),
            F.coalesce(F.bool_or(decision & ~F.array_contains(routed(F.col("intent")), name)), F.lit(False)).alias(
                f"out_{i}"
            ),
        ]
    return _unfolded(events.groupBy("run_id").agg(*folded))


def _unfolded(per_run: DataFrame) -> DataFrame:
    """One row per run and node from the nodes' columns side by side."""
    rows = []
    for i, name in enumerate(NODES):
        last = F.col(f"kind_{i}")
        status = (
            F.when(last == "node_start", "running").when(last == "node_end", "done").when(last == "node_error", "error")
        )
        if name in SPECIALISTS:
            status = status.when(F.col(f"out_{i}"), "skipped")
        rows.append(
            F.struct(
                F.lit(name).alias("node"), status.otherwise("idle").alias("status"), F.col(f"ms_{i}").alias("elapsed_ms")
            )
        )
    return per_run.select("run_id", F.explode(F.array(*rows)).alias("n")).select("run_id", "n.*")


def skipped_specialists(events: DataFrame) -> DataFrame:
    """TEL5: specialists that were not routed to and never ran."""
    return node_status(events).filter(F.col("status") == "skipped").select("run_id", "node")


def attribute_retrieval(events: DataFrame) -> DataFrame:
    """TEL6: retrieval and retry events with the node that was open at that moment (null if none).

    A start opens its node; an end or error closes it only if that very node
    is the open one.
    """
    kind, place = F.col("type"), F.struct(*ORDER)
    closing = kind.isin("node_end", "node_error")
    marks = {"_start": F.when(kind == "node_start", F.struct(place.alias("at"), "node"))}
    marks |= {f"_end_{i}": F.when(closing & (F.col("node") == n), place) for i, n in enumerate(NODES)}
    seen = carry(
        events.filter(kind.isin("node_start", "node_end", "node_error", "retrieval", "crag_retry")), ["run_id"], marks
    )
    ended = F.lit(None)
    for i, n in enumerate(NODES):
        ended = F.when(F.col("_start.node") == n, F.col(f"_end_{i}")).otherwise(ended)
    still_open = ended.isNull() | (ended < F.col("_start.at"))
    return seen.filter(kind.isin("retrieval", "crag_retry")).select(
        "run_id",
        "t",
        "event_id",
        "type",
        F.when(still_open, F.col("_start.node")).alias("node"),
        "docs",
        "max_score",
        "elapsed_ms",
    )


# Terminal event types and the run status they mean.
TERMINAL = {"final": "done", "cached": "cached", "guard_block": "blocked", "error": "error"}


def _status(kind: Column) -> Column:
    status = F.lit(None).cast("string")
    for event, name in TERMINAL.items():
        status = F.when(kind == event, name).otherwise(status)
    return status


def run_status(events: DataFrame) -> DataFrame:
    """TEL7: status, intent, severity, block reason and times of every run."""
    kind = F.col("type")
    ends = kind.isin(*TERMINAL)
    return (
        events.groupBy("run_id")
        .agg(
            F.coalesce(_last(_status(kind), ends), F.lit("running")).alias("status"),
            _last("intent", F.col("intent").isNotNull()).alias("intent"),
            _last("severity", F.col("severity").isNotNull()).alias("severity"),
            _last("reason", kind == "guard_block").alias("reason"),
            F.min("t").alias("started_at"),
            F.max(F.when(ends, F.col("t"))).alias("finished_at"),
        )
        .withColumn("elapsed_ms", millis_between(F.col("started_at"), F.col("finished_at")))
    )


# ------------------------------------------------------------------ mergeable folds
def _placed(value: Column | str, condition: Column) -> Column:
    """The value of the last event for which the condition holds, with its place; the greatest of two such is that of both."""
    return F.max(F.when(condition, F.struct(*ORDER, (F.col(value) if isinstance(value, str) else value).alias("value"))))


def run_folds() -> list[Column]:
    """Aggregates over any part of a run's events that merge to those of the whole run (TEL4, TEL7).

    Each is a least or greatest time, a flag, or a last value with its place.
    """
    node, kind = F.col("node"), F.col("type")
    ends = kind.isin(*TERMINAL)
    folds = [
        F.min("t").alias("started_at"),
        F.max(F.when(ends, F.col("t"))).alias("finished_at"),
        _placed(_status(kind), ends).alias("status"),
        _placed("intent", F.col("intent").isNotNull()).alias("intent"),
        _placed("severity", F.col("severity").isNotNull()).alias("severity"),
        _placed("reason", kind == "guard_block").alias("reason"),
    ]
    decision = (kind == "orchestrator_decision") & F.col("intent").isNotNull()
    for i, name in enumerate(NODES):
        mine = (node == name) & kind.isin("node_start", "node_end", "node_error")
        left_out = decision & ~F.array_contains(routed(F.col("intent")), name)
        folds += [
            _placed(kind, mine).alias(f"kind_{i}"),
            _placed("elapsed_ms", mine & (kind != "node_start")).alias(f"ms_{i}"),
            F.coalesce(F.bool_or(left_out), F.lit(False)).alias(f"out_{i}"),
        ]
    return folds


def merge_folds(parts: DataFrame) -> DataFrame:
    """One row per run from the folds of its parts."""
    merged = []
    for name in (c for c in parts.columns if c != "run_id"):
        merge = F.min if name == "started_at" else F.bool_or if name.startswith("out_") else F.max
        merged.append(merge(name).alias(name))
    return parts.groupBy("run_id").agg(*merged)


def status_of_folds(folds: DataFrame) -> DataFrame:
    """TEL7 (`run_status`) of runs given as folds."""
    return folds.select(
        "run_id",
        F.coalesce("status.value", F.lit("running")).alias("status"),
        *[F.col(f"{n}.value").alias(n) for n in ("intent", "severity", "reason")],
        *[F.col(n).cast("timestamp_ntz").alias(n) for n in ("started_at", "finished_at")],
    ).withColumn("elapsed_ms", millis_between(F.col("started_at"), F.col("finished_at")))


def nodes_of_folds(folds: DataFrame) -> DataFrame:
    """TEL4 (`node_status`) of runs given as folds."""
    n = range(len(NODES))
    last = [F.col(f"{c}_{i}.value").alias(f"{c}_{i}") for i in n for c in ("kind", "ms")]
    return _unfolded(folds.select("run_id", *last, *[f"out_{i}" for i in n]))


def millis_between(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, with fractions."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1000.0


def run_metrics(events: DataFrame) -> DataFrame:
    """TEL8: last retrieval, retry count, faithfulness, PII, cache use and total time of every run."""
    kind = F.col("type")
    retrieval, faith, final = kind == "retrieval", kind == "faithfulness", kind == "final"
    return (
        events.groupBy("run_id")
        .agg(
            _last(F.coalesce("docs", F.lit(0)), retrieval).alias("retrieval_docs"),
            _last("max_score", retrieval).alias("retrieval_score"),
            _last("elapsed_ms", retrieval).alias("retrieval_ms"),
            F.count_if(kind == "crag_retry").alias("retries"),
            _last("faithful", faith).alias("faithful"),
            _last(F.coalesce(F.size("pii_redacted") > 0, F.lit(False)), faith).alias("pii_redacted"),
            _last(kind == "cached", kind.isin("cached", "final")).alias("cache_hit"),
            F.min("t").alias("_start"),
            F.max(F.when(final, F.col("t"))).alias("_final"),
        )
        .withColumn("elapsed_total", millis_between(F.col("_start"), F.col("_final")))
        .drop("_start", "_final")
    )


def quality_score(metrics: DataFrame) -> DataFrame:
    """TEL9: 0-100 score of a run and its band; null without faithfulness and retrieval score.

    Faithful 40, retrieval score up to 30 (rounded half up), no retry 20, no
    PII 10 (5 when redacted). Unknown parts add nothing.
    """
    faith = F.when(F.col("faithful"), 40).when(~F.col("faithful"), 0)
    found = F.floor(F.col("retrieval_score") * 30 + 0.5).cast("int")
    steady = F.when(F.col("retries") > 0, 0).when(F.col("retrieval_docs") > 0, 20)
    clean = F.when(F.col("pii_redacted"), 5).when(~F.col("pii_redacted"), 10)
    parts = [F.coalesce(p, F.lit(0)) for p in (faith, found, steady, clean)]
    known = faith.isNotNull() | found.isNotNull()
    total = F.when(known, parts[0] + parts[1] + parts[2] + parts[3])
    return metrics.withColumn("quality", total).withColumn(
        "band", F.when(F.col("quality") >= 80, "green").when(F.col("quality") >= 55, "amber").when(known, "red")
    )


def human_review_queue(runs: DataFrame) -> DataFrame:
    """TEL10: runs of severity HIGH. Input from `run_status`."""
    return runs.filter(F.upper("severity") == "HIGH")


def recent_feedback(feedback: DataFrame, n: int = 50) -> DataFrame:
    """TEL11: the newest ``n`` ratings."""
    return feedback.orderBy(F.desc("ts"), "session_id", "message_id").limit(n)


def guard_events(guarded: DataFrame) -> DataFrame:
    """The guard events of a table from `validate_input`: (stage, ok, reason).

    Every message has one event of the instant check; one that passed it and
    was then found off topic has a second, of the domain check. A classifier
    that was not available leaves no event of its own.
    """
    from riskframe.operators.guards import REASONS

    g = F.col("guard")
    passed = g["ok"] | g["reason"].isin(REASONS["off_topic"], REASONS["unavailable"])
    event = lambda stage, ok, reason: F.struct(F.lit(stage).alias("stage"), ok.alias("ok"), reason.alias("reason"))
    instant = event("instant", passed, F.when(passed, F.lit("")).otherwise(g["reason"]))
    domain = F.when(g["reason"] == REASONS["off_topic"], event("domain", F.lit(False), g["reason"]))
    return guarded.select(F.explode(F.array_compact(F.array(instant, domain))).alias("e")).select("e.*")


def guard_outcomes(events: DataFrame) -> DataFrame:
    """TEL12: number of guard events by stage, outcome and reason."""
    return events.groupBy("stage", "ok", "reason").agg(F.count(F.lit(1)).alias("events"))
