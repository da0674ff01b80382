"""Readers, inventories, samples, upserts, manifest, feedback and ingestion end to end."""

import json

import pytest
from pyspark.sql import functions as F

from riskframe import schemas
from riskframe.operators.incidents import ORDER_SOURCE, SKU_SOURCE
from riskframe.plans import fixtures as fx
from riskframe.operators import segments
from riskframe.plans import ingest as ing
from riskframe.plans import store
from riskframe.sources import inventory, readers, tables
from riskframe.sources.sampling import sample_n


def order_csv(path, rows, header=None):
    names = [f.name for f in schemas.ORDER_FILE.fields]
    # published headers carry stray blanks and a capital S
    shown = {"Days for shipping (real)": "Days for shipping (real)   ", "shipping date (DateOrders)": "Shipping date (DateOrders)  "}
    lines = [",".join(shown.get(n, n) for n in names)]
    lines += [",".join(str(r.get(n, "")) for n in names) for r in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode("latin-1"))


def test_read_orders(spark, tmp_path):
    rows = [
        {"Order Id": 1, "Order Item Id": 10, "Product Name": "Café", "Days for shipping (real)": 5, "Late_delivery_risk": 1, "shipping date (DateOrders)": "1/2/2018"},
        {"Order Id": "bad", "Market": "NA"},
    ]
    order_csv(tmp_path / "o.csv", rows)
    df = readers.read_orders(spark, f"{tmp_path}/o.csv")
    first, second = df.orderBy(F.col("order_id").asc_nulls_last()).collect()
    assert (first["product"], first.days_real, first.ship_date) == ("Café", 5, "1/2/2018")
    assert second.order_id is None and second.market is None and second._corrupt_record is None
    with open(tmp_path / "o.csv", "a") as f:
        f.write("too,few\n")
    good, bad = readers.split_rejects(readers.read_orders(spark, f"{tmp_path}/o.csv"))
    assert good.count() == 2 and [r[0] for r in bad.collect()] == ["too,few"]


def test_read_skus(spark, tmp_path):
    header = list(schemas.SKU_COLUMNS)
    values = {h: "1" for h in header} | {"SKU": "SKU0", "Defect rates": "4.85", "Lead times": "30"}
    (tmp_path / "s.csv").write_text(",".join(header) + "\n" + ",".join(values[h] for h in header) + "\n")
    row = readers.read_skus(spark, f"{tmp_path}/s.csv").first()
    assert (row.sku, row.defect_rate, row.lead_time, row.supplier_lead_time) == ("SKU0", 4.85, 30, 1)


def test_read_any(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,v\nCafé,1\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("n,v\nCafé,1\n".encode("utf-8"))
    (tmp_path / "t.tsv").write_text("n\tv\nx,y\t2\n")
    (tmp_path / "a.json").write_text(json.dumps([{"n": "a"}, {"n": "b"}], indent=1))
    (tmp_path / "l.json").write_text('{"n": "a"}\n{"n": "b"}\n')
    (tmp_path / "odd.dat").write_text("n,v\nz,3\n")
    spark.range(3).write.parquet(f"{tmp_path}/p.parquet")
    read = lambda f: readers.read_any(spark, f"{tmp_path}/{f}")
    assert read("a.csv").first().n == read("u.csv").first().n == "Café"
    assert tuple(read("t.tsv").first()) == ("x,y", 2)
    assert sorted(r.n for r in read("a.json").collect()) == sorted(r.n for r in read("l.json").collect()) == ["a", "b"]
    assert read("odd.dat").first().n == "z" and read("p.parquet").count() == 3
    with pytest.raises(ValueError):
        read("x.xlsx")


def test_category_filter_reaches_the_scan(spark, sf):
    parts = fx.table(spark, sf, "part").withColumnRenamed("p_type", "category")
    plan = readers.category_filter(parts, "PROMO")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan


def test_sample(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    a = {r.id for r in sample_n(df, 300, ["id"]).collect()}
    b = {r.id for r in sample_n(df.repartition(7), 300, ["id"]).collect()}
    assert len(a) == 300 and a == b and a != {r.id for r in sample_n(df, 300, ["id"], seed=1).collect()}
    assert sample_n(df, 9000, ["id"]).count() == 5000
    same_key = spark.range(100).select(F.lit(1).alias("id"))
    assert sample_n(same_key, 40, ["id"]).count() == 40


def test_inventory_and_choice(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b+c.csv").write_text("x" * 100)
    (tmp_path / "sub" / "big.CSV").write_text("x" * 3_000_000)
    (tmp_path / "sub" / "n.json").write_text("{}")
    (tmp_path / "skip.txt").write_text("no")
    manifest = spark.createDataFrame([("sub/n.json", 3, 2, 1.0)], schemas.MANIFEST)
    listed = inventory.source_inventory(spark, str(tmp_path), manifest)
    rows = {r.path: r for r in listed.collect()}
    assert list(rows) == ["a b+c.csv", "sub/big.CSV", "sub/n.json"]
    assert (rows["sub/big.CSV"].folder, rows["sub/big.CSV"].size_mb, rows["sub/big.CSV"].ext) == ("sub", 2.86, ".csv")
    assert (rows["sub/n.json"].loaded, rows["sub/n.json"].loaded_docs, rows["sub/n.json"].loaded_rows) == (True, 2, 3)
    assert inventory.pick_source(listed).first().path == "sub/big.CSV"
    assert inventory.pick_source(listed, "skus").first().path == "a b+c.csv"
    assert inventory.preferred_source(listed, ["none.csv", "sub/n.json", "a b+c.csv"]).first().path == "sub/n.json"
    assert inventory.preferred_source(listed, ["none.csv"]).count() == 0
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "1", 0)], "id string, text string, seq int")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "4", 1)] + [("hot", str(i), i) for i in range(500)], "id string, text string, seq int")
    got = {r.id: r.text for r in tables.upsert_corpus(old, new, ["id"], ["seq"]).collect()}
    assert got == {"a": "1", "b": "3", "c": "4", "hot": "499"}


def test_metadata(spark):
    df = spark.createDataFrame([("x", None, [1, 2])], "a string, b int, c array<int>")
    assert df.select(tables.metadata_map(df, ["a", "b", "c"]).alias("m")).first().m == {"a": "x", "c": "[1,2]"}
    m = df.select(F.create_map(F.lit("k"), F.col("b").cast("string"), F.lit("l"), F.col("a")).alias("m"))
    assert m.select(tables.sanitise_metadata("m").alias("m")).first().m == {"l": "x"}


def test_manifest(spark, tmp_path):
    path = f"{tmp_path}/m"
    assert tables.read_manifest(spark, path).count() == 0
    tables.manifest_mark(spark, path, "a", 10, 9, at=1.0)
    tables.manifest_mark(spark, path, "b", 5, 5, at=2.0)
    tables.manifest_mark(spark, path, "a", 20, 19, at=3.0)
    tables.manifest_remove(spark, path, "b", at=4.0)
    assert [tuple(r) for r in tables.read_manifest(spark, path).collect()] == [("a", 20, 19, 3.0)]
    inventory_frame = spark.createDataFrame([("a",), ("b",)], "key string")
    manifest = tables.read_manifest(spark, path)
    assert [r.key for r in tables.pending_sources(inventory_frame, manifest).collect()] == ["b"]
    assert tables.pending_sources(inventory_frame, manifest, reset=True).count() == 2
    tables.manifest_clear(spark, path)
    assert tables.read_manifest(spark, path).count() == 0


def test_feedback(spark, tmp_path):
    rows = [("s", "m1", "up", None, 5.0), ("s", "m2", "meh", None, 6.0), ("s", "m3", "down", "n", None)]
    tables.append_feedback(spark.createDataFrame(rows, schemas.FEEDBACK), f"{tmp_path}/fb")
    kept = spark.read.parquet(f"{tmp_path}/fb").orderBy("message_id").collect()
    assert [r.message_id for r in kept] == ["m1", "m3"] and kept[1].ts > 1e9


def test_ingest_end_to_end(spark, tmp_path):
    root, path = f"{tmp_path}/store", tmp_path / "orders.csv"
    order_csv(path, [{"Order Id": i, "Order Item Id": 1, "Market": "LATAM"} for i in range(8)])
    with open(path, "a") as f:
        f.write("too,few\n")
    log = ing.ingest(spark, ORDER_SOURCE, str(path), root, key="orders").first()
    assert (log.state, log.docs_built) == ("done", 8)
    corpus = ing.read_corpus(spark, root)
    assert corpus.count() == 8 and len(corpus.first().vec) == 64 and corpus.first().metadata["market"] == "LATAM"
    assert spark.read.parquet(f"{root}/rejects").count() == 1
    assert ing.ingest(spark, ORDER_SOURCE, str(path), root, key="orders").first().state == "already_loaded"

    (tmp_path / "extra.csv").write_text("name,size\nbolt,3\nnut,4\n")
    ing.ingest(spark, "custom", f"{tmp_path}/extra.csv", root)
    assert ing.read_corpus(spark, root).count() == 10
    assert tables.read_manifest(spark, f"{root}/manifest").count() == 2
    assert segments.postings_index(store.read_index(spark, root)).docs.count() == 10

    again = ing.ingest(spark, ORDER_SOURCE, str(path), root, key="orders", reset=True, sample=5).first()
    assert (again.state, ing.read_corpus(spark, root).count()) == ("done", 5)
    assert [r.key for r in tables.read_manifest(spark, f"{root}/manifest").collect()] == ["orders"]
    with pytest.raises(Exception):
        ing.ingest(spark, SKU_SOURCE, f"{tmp_path}/missing.csv", root)
    runs = spark.read.parquet(f"{root}/runs")
    assert runs.filter("state = 'error'").count() == 1 and runs.count() == 5
    ing.clear_corpus(spark, root)
    assert ing.read_corpus(spark, root).count() == 0 and tables.read_manifest(spark, f"{root}/manifest").count() == 0


def test_an_unreadable_log_stops_the_run_and_loses_nothing(spark, tmp_path):
    root = f"{tmp_path}/store"
    (tmp_path / "a.csv").write_text("name\nx\ny\n")
    (tmp_path / "b.csv").write_text("name\nz\n")
    ing.ingest(spark, "custom", f"{tmp_path}/a.csv", root)
    logs = {f: f.read_bytes() for f in (tmp_path / "store" / "commits").glob("*.json")}
    for f in (tmp_path / "store" / "commits").glob(".*.crc"):
        f.unlink()
    for f in logs:
        f.write_bytes(b"not JSON")
    with pytest.raises(Exception):
        ing.ingest(spark, "custom", f"{tmp_path}/b.csv", root)
    for f, whole in logs.items():
        f.write_bytes(whole)
    assert ing.read_corpus(spark, root).count() == 2
    ing.ingest(spark, "custom", f"{tmp_path}/b.csv", root)
    assert ing.read_corpus(spark, root).count() == 3


def test_a_failed_index_leaves_the_former_corpus_in_force(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    (tmp_path / "a.csv").write_text("name\nx\ny\n")
    ing.ingest(spark, "custom", f"{tmp_path}/a.csv", root)
    (tmp_path / "b.csv").write_text("name\nz\n")

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(segments, "write_segment", fail)
    with pytest.raises(OSError):
        ing.ingest(spark, "custom", f"{tmp_path}/b.csv", root)
    assert ing.read_corpus(spark, root).count() == 2
    assert tables.read_manifest(spark, f"{root}/manifest").count() == 1


def test_rows_without_a_key_keep_their_ids_however_they_are_split(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", None), ("c", 2)], "n string, v int")
    keys = [sorted(r.row_key for r in ing.numbered_rows(df.repartition(n)).collect()) for n in (1, 5)]
    assert keys[0] == keys[1] and len(set(keys[0])) == 5


def test_the_last_row_of_an_id_wins(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = [{"Order Id": 1, "Order Item Id": 1, "Market": m} for m in ("Z", "M", "A")]
    order_csv(tmp_path / "o.csv", rows)
    ing.ingest(spark, ORDER_SOURCE, f"{tmp_path}/o.csv", root)
    assert [r.metadata["market"] for r in ing.read_corpus(spark, root).collect()] == ["A"]


def test_forty_fields_all_count(spark):
    from riskframe.operators.incidents import rows_to_incidents

    df = spark.createDataFrame([(0, *range(40)), (1, *range(39), 99)], "k int, " + ", ".join(f"f{i} int" for i in range(40)))
    rows = rows_to_incidents(df, "k").collect()
    assert all("f39: " in r.text and len(r.metadata) == 42 and len(r.id) == 32 for r in rows)
    capped = rows_to_incidents(df, "k", text_fields=30, metadata_fields=20).first()
    assert "f30" not in capped.text and len(capped.metadata) == 22


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    names = [f.name for f in schemas.ORDER_FILE.fields]
    for file, order in (("a", names), ("b", names[::-1])):
        (tmp_path / f"{file}.csv").write_text(",".join(order) + "\n" + ",".join("1" for _ in order) + "\n")
    with pytest.raises(Exception):
        readers.read_orders(spark, str(tmp_path)).collect()


def test_a_cluster_needs_a_shared_folder():
    from riskframe.session import is_local

    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")


@pytest.mark.parametrize("bad", [0, 2])
def test_a_file_is_read_again_for_rejected_lines_only_if_it_has_some(spark, tmp_path, monkeypatch, bad):
    root, path = f"{tmp_path}/store", tmp_path / "orders.csv"
    order_csv(path, [{"Order Id": i, "Order Item Id": 1, "Market": "LATAM"} for i in range(8)])
    with open(path, "a") as f:
        f.write("too,few\n" * bad)
    seen, real = spark.sparkContext.accumulator(0), ing._load

    def counted(*args):
        df = real(*args)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(ing, "_load", counted)
    monkeypatch.setattr(ing.readers, "read_order", lambda: F.struct(F.monotonically_increasing_id().alias("place")))
    log = ing.ingest(spark, ORDER_SOURCE, str(path), root, key="orders").first()
    assert (log.state, log.rows_loaded, log.docs_built) == ("done", 8 + bad, 8)
    assert spark.read.parquet(f"{root}/rejects").count() == bad and ing.read_corpus(spark, root).count() == 8
    assert seen.value == (8 + bad) * (2 if bad else 1)
