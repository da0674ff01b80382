"""Streams run to completion and compared with their batch twins."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from riskframe.operators import guards, incidents, telemetry
from riskframe.plans import fixtures as fx
from riskframe.sources import readers
from riskframe.streaming import jobs


def _done(query):
    query.awaitTermination(300)
    assert query.exception() is None
    return query


@pytest.fixture(scope="module")
def event_files(spark, sf, tmp_path_factory):
    """The event table as three files in time order, one per micro-batch."""
    import os

    folder = tmp_path_factory.mktemp("events")
    events = fx.table(spark, sf, "events").toPandas().sort_values("ts")
    third = len(events) // 3 + 1
    for i in range(3):
        path = folder / f"events{i}.parquet"
        spark_part = events.iloc[i * third : (i + 1) * third]
        spark_part.astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return str(folder)


def test_event_counts_equal_batch(spark, sf, event_files, tmp_path):
    source = jobs.event_source(spark, event_files)
    _done(jobs.stream_event_counts(source, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = jobs.read_update_log(spark, f"{tmp_path}/out", ["window_start", "event_type"]).toPandas()
    want = jobs.event_counts(fx.table(spark, sf, "events")).toPandas()
    assert compare(got, want) is None


def test_append_mode_emits_closed_windows_only(spark, sf, event_files, tmp_path):
    source = jobs.event_source(spark, event_files)
    _done(jobs.stream_event_counts(source, f"{tmp_path}/out", f"{tmp_path}/ckpt", mode="append"))
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id").toPandas()
    batch = jobs.event_counts(fx.table(spark, sf, "events")).toPandas()
    last = fx.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    closed = batch[batch["window_start"] + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1)]
    assert compare(got, closed) is None
    assert len(got) < len(batch)


def test_late_rows_are_dropped(spark, tmp_path):
    import os

    rows = lambda hours: [(i, dt.datetime(2024, 1, 1, h), 1, "view", 1.0, "{}") for i, h in enumerate(hours)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    folder = tmp_path / "in"
    folder.mkdir()
    for i, hours in enumerate([[10], [11], [2, 10]]):
        spark.createDataFrame(rows(hours), schema).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(
            folder / f"events{i}.parquet", index=False
        )
        os.utime(folder / f"events{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    source = jobs.event_source(spark, str(folder))
    _done(jobs.stream_event_counts(source, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = jobs.read_update_log(spark, f"{tmp_path}/out", ["window_start", "event_type"]).collect()
    # the watermark that drops late rows is the one of the batch before
    assert sorted((r.window_start.hour, r.events) for r in got) == [(10, 2), (11, 1)]


def test_dedup_keeps_one_row_per_id(spark, sf, event_files, tmp_path):
    source = jobs.event_source(spark, event_files)
    doubled = source.unionByName(source)
    _done(jobs.stream_dedup(doubled, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("event_id").distinct().count() == fx.table(spark, sf, "events").count()


def test_session_spans_equal_batch_for_closed_sessions(spark, sf, event_files, tmp_path):
    source = jobs.event_source(spark, event_files)
    _done(jobs.stream_session_spans(source, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    events = fx.table(spark, sf, "events")
    batch = telemetry.session_extents(events, "user_id", time="ts").toPandas()
    last = events.agg(F.max("ts")).first()[0]
    closed = batch[batch["session_end"] <= last - dt.timedelta(hours=1)]
    assert compare(got, closed) is None


def test_guard_stream_equals_batch(spark, sf, tmp_path):
    messages = spark.readStream.schema("conv_id long, turn long, role string, text string").option(
        "pathGlobFilter", "conversations.parquet"
    ).parquet(sf)
    _done(jobs.stream_guard(messages, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    pick = lambda df: df.select(
        "conv_id", "turn", "guard.ok", "guard.reason", "clean_text", F.array_join("pii_found", ",").alias("pii")
    ).toPandas()
    want = guards.scrub_pii(guards.validate_input(fx.table(spark, sf, "conversations")))
    assert compare(pick(spark.read.parquet(f"{tmp_path}/out")), pick(want)) is None


def _order_csv(path, rows):
    header = [f.name for f in readers.schemas.ORDER_FILE.fields]
    lines = [",".join(header)]
    for row in rows:
        lines.append(",".join(str(row.get(h, "")) for h in header))
    path.write_text("\n".join(lines) + "\n", encoding="latin-1")


def test_ingest_stream_equals_batch_and_skips_seen_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    base = {"Product Name": "Café", "Late_delivery_risk": 1, "Market": "LATAM", "Order Item Quantity": 2.0}
    _order_csv(folder / "a.csv", [{**base, "Order Id": i, "Order Item Id": 1} for i in range(5)])
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    _done(jobs.stream_ingest(jobs.order_source(spark, str(folder)), out, ckpt))
    _order_csv(folder / "b.csv", [{**base, "Order Id": i, "Order Item Id": 1, "Market": "Europe"} for i in (4, 9)])
    _done(jobs.stream_ingest(jobs.order_source(spark, str(folder)), out, ckpt))
    got = jobs.read_update_log(spark, out, ["id"]).select("id", "text").toPandas()
    batch = incidents.to_incidents(readers.read_orders(spark, f"{folder}/a.csv"), "dataco")
    second = incidents.to_incidents(readers.read_orders(spark, f"{folder}/b.csv"), "dataco")
    kept = batch.join(second, "id", "left_anti").unionByName(second)
    assert compare(got, kept.select("id", "text").toPandas()) is None
    assert len(got) == 6 and got["text"].str.contains("Café").all()
    # two runs, two batches: the second read the new file only
    assert spark.read.parquet(out).groupBy("batch_id").count().orderBy("batch_id").toPandas()["count"].to_list() == [5, 2]


def test_run_state_equals_batch(spark, sf, event_files, tmp_path):
    source = fx.run_events(jobs.event_source(spark, event_files))
    query = _done(jobs.stream_run_state(source, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    events = fx.run_events(fx.table(spark, sf, "events"))
    got = jobs.read_run_state(spark, f"{tmp_path}/out").toPandas()
    assert compare(got, telemetry.run_status(events).toPandas()) is None
    nodes = jobs.read_node_state(spark, f"{tmp_path}/out").toPandas()
    assert compare(nodes, telemetry.node_status(events).toPandas()) is None
    plan = query._jsq.explainInternal(True)
    assert "StateStoreSave" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_run_state_is_dropped_after_silence(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, day in enumerate((1, 2, 9, 10)):
        rows = [(100 * i + u, dt.datetime(2024, 1, day, 6), u, "view", 1.0, "{}") for u in range(5)]
        path = folder / f"events{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    query = _done(jobs.stream_run_state(fx.run_events(jobs.event_source(spark, str(folder))), f"{tmp_path}/out", f"{tmp_path}/ckpt"))
    states = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(s.numRowsRemoved for s in states) >= 10 and states[-1].numRowsTotal <= 10
    assert jobs.read_run_state(spark, f"{tmp_path}/out").count() == telemetry.run_status(fx.run_events(spark.read.parquet(str(folder)))).count()


def test_folds_of_parts_merge_to_the_whole(spark, sf):
    events = fx.run_events(fx.table(spark, sf, "events"))
    parts = events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(7))).groupBy("run_id", "part").agg(*telemetry.run_folds()).drop("part")
    folds = telemetry.merge_folds(parts)
    assert compare(telemetry.status_of_folds(folds).toPandas(), telemetry.run_status(events).toPandas()) is None
    assert compare(telemetry.nodes_of_folds(folds).toPandas(), telemetry.node_status(events).toPandas()) is None


def test_tables_in_folders_of_parts_are_read_whole(spark, sf, tmp_path):
    """Tables whose files are folders of parts, in no order of time, give what the plain files give."""
    from riskframe.plans import round_trips  # noqa: F401  registers its queries
    from riskframe.plans.queries import QUERIES

    for name, order in (("conversations", "conv_id"), ("events", "event_id")):
        whole = spark.read.parquet(f"{sf}/{name}.parquet")
        whole.repartition(3, order).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_cache_retain", "stream_guarded", "stream_hourly_events"):
        got, want = (QUERIES[name](spark, d).toPandas() for d in (str(tmp_path), sf))
        assert len(want) and compare(got, want) is None, name


def test_a_log_of_one_batch_is_read_as_it_is(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "id string, text string")
    rows(("a", "1"), ("b", "1")).write.parquet(f"{tmp_path}/log/batch_id=0")
    one = jobs.read_update_log(spark, f"{tmp_path}/log", ["id"])
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, one.collect())) == [("a", "1"), ("b", "1")]
    rows(("a", "2")).write.parquet(f"{tmp_path}/log/batch_id=1")
    assert sorted(map(tuple, jobs.read_update_log(spark, f"{tmp_path}/log", ["id"]).collect())) == [("a", "2"), ("b", "1")]


@pytest.mark.parametrize("most", [0, 200_000])
def test_only_rows_of_repeated_ids_are_shuffled(spark, monkeypatch, most):
    from riskframe.operators.incidents import SEQUENCE

    monkeypatch.setattr(jobs, "MAX_REPEATED", most)
    order = lambda i, item, market, place: (i, item, market, ("t", place))
    schema = f"order_id long, order_item_id int, market string, {SEQUENCE} struct<time: string, place: int>"
    ids = lambda rows: sorted((r.metadata["order_id"], r.metadata["market"]) for r in rows)
    alone = spark.createDataFrame([order(i, 1, f"m{i}", 0) for i in range(20)] + [order(None, None, "none", 0)], schema).repartition(3)
    docs = jobs._latest_documents(alone)
    assert "SortAggregate" not in docs._jdf.queryExecution().executedPlan().toString()  # no row moves
    assert ids(docs.collect()) == sorted([(str(i), f"m{i}") for i in range(20)] + [("0", "none")])
    more = spark.createDataFrame([order(3, 1, "new", 2), order(3, 1, "mid", 1), order(None, None, "last", 9), order(4, 2, "item", 0)], schema)
    got = jobs._latest_documents(alone.unionByName(more)).collect()
    want = [(str(i), "new" if i == 3 else f"m{i}") for i in range(20)] + [("0", "last"), ("4", "item")]
    assert ids(got) == sorted(want) and len({r.id for r in got}) == len(got)


def test_shuffle_files_are_let_go_when_order_files_are_written(spark, sf, monkeypatch):
    from riskframe.plans import round_trips

    seen, real = [], round_trips.release
    monkeypatch.setattr(round_trips, "release", lambda s: seen.append(real(s)))
    assert round_trips._order_files(spark, sf) and seen
