"""Files read in parallel, summaries that are stored and merged, the streamed cache, scans dealt over the cores."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from riskframe.operators import anomaly, ranking, telemetry
from riskframe.plans import fixtures as fx
from riskframe.sources import readers
from riskframe.streaming import jobs


# ------------------------------------------------------------------ JSON arrays
def odd_value(rng, depth=0):
    kinds = ["}", "]", "{[", '"', "\\", '\\"}', "}]}", "é世\n\t", "", "a,b:c", '{"x": [1, 2]}', "\\\\", "line\r\nend"]
    pick = rng.random()
    if depth < 3 and pick < 0.2:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if depth < 3 and pick < 0.4:
        return {rng.choice(["p", "q}", '"r"', "s["]): odd_value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return rng.choice([*kinds, rng.randrange(100), None, True, 1.5]) if pick < 0.9 else "".join(rng.choices(kinds, k=6))


@pytest.mark.parametrize("indent", [None, 1])
def test_records_of_an_array_are_its_objects(spark, tmp_path, indent):
    rng = random.Random(4)
    objects = [{"id": i, "v": odd_value(rng), "w": odd_value(rng)} for i in range(1500)]
    for n, part in enumerate((objects[:1000], objects[1000:], [])):
        path = tmp_path / "a.json" / f"{n}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(part, ensure_ascii=False, indent=indent), encoding="utf-8")
    for size in ("1m", "1500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            records = readers.array_records(spark, f"{tmp_path}/a.json")
            got = [json.loads(r.value) for r in records.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got, key=lambda o: o["id"]) == objects


def test_a_one_line_array_is_read_by_many_tasks_and_equals_the_lines(spark, tmp_path):
    objects = [{"id": i, "text": "word } ] \" " * 20, "n": i / 2} for i in range(4000)]
    (tmp_path / "array.json").write_text(json.dumps(objects))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, objects)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        raw = spark.read.option("lineSep", "}").text(f"{tmp_path}/array.json")
        rows = raw.groupBy(F.spark_partition_id()).count().where("count > 1").count()
        array, lines = (readers.read_any(spark, f"{tmp_path}/{n}.json") for n in ("array", "lines"))
        assert rows > 4 and array.schema == lines.schema
        assert sorted(map(tuple, array.collect())) == sorted(map(tuple, lines.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ------------------------------------------------------------------ encodings
def test_every_file_of_a_folder_is_read_in_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("näme,size\ncafé,1\nNA,2\n", encoding="utf-8")
    (folder / "b.csv").write_text("näme,size\nnaïve,3.5\n", encoding="latin-1")
    df = readers.read_any(spark, str(folder))
    assert df.columns == ["näme", "size"] and dict(df.dtypes)["size"] == "double"
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [("café", 1.0), (None, 2.0), ("naïve", 3.5)]
    (folder / "a.csv").unlink()
    assert readers.read_any(spark, str(folder)).collect()[0][0] == "naïve"


# ------------------------------------------------------------------ latency sketches
def test_stored_sketches_give_quantiles_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"n{i % 2}", 1_700_000_000 + int(t), "node_error" if i % 7 == 0 else "node_end", float(x)) for i, (t, x) in enumerate(zip(rng.integers(0, 10 * 86400, 30_000), rng.lognormal(3, 1, 30_000)))]
    rows += [("n3", 1_700_000_000, "node_end", None), ("n0", 1_700_000_000, "node_start", 9e9)]
    events = spark.createDataFrame(rows, "node string, s long, type string, elapsed_ms double").withColumn("t", F.timestamp_seconds("s"))
    telemetry.latency_sketches(events).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    early = F.col("hour") < F.timestamp_seconds(F.lit(1_700_000_000 + 3 * 86400))
    for part, end in ((stored, 99), (stored.where(early), 3)):
        got = {r.node: r for r in telemetry.latency_of_sketches(part).collect()}
        last = max(r.hour for r in part.select("hour").collect()).timestamp() + 3600
        for node in ("n0", "n1"):
            own = np.sort([x for n, t, kind, x in rows if n == node and t < last and kind != "node_start" and x is not None])
            assert got[node].spans == len(own) and abs(got[node].mean_ms - own.mean()) < 1e-6 and got[node].max_ms == own[-1]
            rank = np.searchsorted(own, got[node].p95_ms, side="right") / len(own)
            assert abs(rank - 0.95) < telemetry.SKETCH_ERROR
        assert end == 3 or (got["n3"].p95_ms is None and got["n3"].spans == 1)


# ------------------------------------------------------------------ stored cells
def test_report_from_stored_cells_equals_the_report(spark, sf, tmp_path):
    columns = ["market", "region", "category", "shipping_mode", "days_real", "days_scheduled", "late_delivery_risk", "order_status", "profit", "quantity", "order_date"]
    orders = anomaly.prepare_orders(fx.order_items(spark, sf, columns)).withColumn("order_date", F.concat(F.lit("2024-"), F.substring("order_date", 6, 5)))
    loose = anomaly.Thresholds(shipping_gap_zscore=0.5, cancellation_rate=0.05, profit_negative_rate=0.2, quantity_zscore=0.01)
    path, have = f"{tmp_path}/cells", set(orders.columns)
    early, late = orders.where("order_date < '2024-06-01'"), orders.where("order_date >= '2024-06-01'")
    anomaly.write_cells(anomaly.span_cells(early, "month"), path)
    files = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    want = anomaly.rounded(anomaly.run_all(early, loose)).drop("supporting_data").toPandas()
    assert compare(anomaly.rounded(anomaly.report_of_cells(spark.read.parquet(path), have, loose)).drop("supporting_data").toPandas(), want) is None
    for _ in range(2):  # storing a span again replaces it
        anomaly.write_cells(anomaly.span_cells(late, "month"), path)
    assert all(os.stat(f).st_mtime_ns == t for f, t in files.items())
    want = anomaly.rounded(anomaly.run_all(orders, loose)).drop("supporting_data").toPandas()
    assert len(want) > 3
    assert compare(anomaly.rounded(anomaly.report_of_cells(spark.read.parquet(path), have, loose)).drop("supporting_data").toPandas(), want) is None


# ------------------------------------------------------------------ the streamed cache
def test_streamed_cache_equals_the_batch_and_forgets(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "query string, payload string, store_ts double, hit_ts double"
    every = []
    for day in range(4):
        rows = []
        for i in range(60):
            at = 1_700_000_000.0 + day * 3 * 86400 + rng.randrange(7200)
            stored = rng.random() < 0.6
            rows.append((f"q{rng.randrange(25) + 10 * day}", f"p{day}-{i}" if stored else None, at if stored else None, None if stored else at))
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/d{day}")
        for f in os.listdir(f"{folder}/d{day}"):
            if f.startswith("part-"):
                os.rename(f"{folder}/d{day}/{f}", f"{folder}/{day}.parquet")
                os.utime(f"{folder}/{day}.parquet", (1_700_000_000 + 60 * day,) * 2)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(folder))
    timed = source.withColumn("t", F.timestamp_seconds(F.coalesce("store_ts", "hit_ts")))
    query = jobs.stream_cache(timed, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(300)
    rows = spark.createDataFrame(every, schema)
    for k in (7, 500):
        want = ranking.cache_retain(rows, k).where("position IS NOT NULL").toPandas()
        got = jobs.read_cache(spark, f"{tmp_path}/out", k).where("position IS NOT NULL").toPandas()
        assert compare(got, want) is None
    states = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(s.numRowsRemoved for s in states) > 0 and states[-1].numRowsTotal < len({r[0] for r in every}) + 25


# ------------------------------------------------------------------ scans
def test_a_file_of_one_row_group_is_worked_on_by_many_tasks(spark):
    for sf in ("sf0.01", "sf0.1"):
        docs = fx.texts(spark, f"/root/testdata/{sf}")
        assert docs.groupBy(F.spark_partition_id()).count().where("count > 0").count() == spark.sparkContext.defaultParallelism


def test_a_table_of_many_files_is_not_dealt_anew(spark, tmp_path):
    spark.range(100).repartition(12).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert fx.spread(df) is df


def test_postings_stay_with_their_document(spark, tmp_path):
    """The texts move once, as they are; scores are added up without another shuffle of matches."""
    from riskframe.operators import lexical

    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 9))) for i in range(60)] + [(60, None), (61, ""), (5, "w1 w1 w2"), (5, "w1 w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w10 w10 w3"), (3, "unknown")], "query_id long, text string")
    index = lexical.build_bm25(docs, compute=True)
    for dealt in (index.postings, lexical.bm25_search(queries, index, 5, pad=False)):
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(doc_id" in plan and "dl#" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
        assert not any("Exchange hashpartitioning(query_id" in x and "doc_id" in x.split("), ")[0] for x in plan.splitlines())
    lexical.write_index(index, f"{tmp_path}/index")
    files = spark.read.parquet(f"{tmp_path}/index/postings").select("doc_id", F.input_file_name().alias("file"))
    assert files.groupBy("doc_id").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    shown = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    got = shown(lexical.bm25_search(queries, lexical.read_index(spark, f"{tmp_path}/index"), 70))
    assert got == shown(lexical.bm25_search(queries, index, 70))
    assert [g for g in got if g[1] <= 5] == shown(lexical.bm25_search(queries, index, 5))
