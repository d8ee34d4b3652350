import os

from pyspark.sql import functions as F

from trolley.operators.transform import product_lookup
from trolley.sources import files as FS
from trolley.streaming import ingest as ST

from test_ingest import LINES_A, LINES_B, catalogs, write


def test_available_now_ingest_and_rerun(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    lookup = product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    land, out, ckpt = tmpdir_path + "/landing", tmpdir_path + "/out", tmpdir_path + "/ckpt"
    write(land, "102_marzo.csv", LINES_A)
    q = ST.start_ingest(spark, land, lookup, out, ckpt)
    q.awaitTermination()
    assert FS.load_table(spark, out, "transactions_flat").count() == 10
    write(land, "103_marzo.csv", LINES_B)
    q = ST.start_ingest(spark, land, lookup, out, ckpt)
    q.awaitTermination()
    assert FS.load_table(spark, out, "transactions_flat").count() == 13
    assert FS.load_table(spark, out, "daily_summary").count() == 3
    q = ST.start_ingest(spark, land, lookup, out, ckpt)  # nothing new: no batch
    q.awaitTermination()
    assert q.lastProgress is None or q.lastProgress["numInputRows"] == 0
    assert FS.load_table(spark, out, "transactions_flat").count() == 13


def test_weekly_counts_monday_windows(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    lookup = product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    land = tmpdir_path + "/landing"
    write(land, "1.csv", ["2013-06-30|102|1|20", "2013-06-24|102|1|20", "2013-07-01|102|1|20"])
    items = ST.stream_items(ST.read_landing_stream(spark, land), ST.static_lookup(lookup))
    q = (ST.weekly_counts(items).writeStream.outputMode("complete").format("memory")
         .queryName("weekly_test").start())
    q.processAllAvailable()
    q.stop()
    got = {(str(r.semana), r.frecuencia) for r in spark.sql("select * from weekly_test").collect()}
    assert got == {("2013-06-24", 2), ("2013-07-01", 1)}


def test_in_stream_dedupe_with_watermark(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    lookup = ST.static_lookup(product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path)))
    land = tmpdir_path + "/landing"
    write(land, "1.csv", ["2013-07-01|102|7|7 7 8", "2013-07-01|102|7|8", "2013-07-02|102|7|8"])
    items = ST.dedupe_stream(ST.stream_items(ST.read_landing_stream(spark, land), lookup), "7 days")
    q = items.writeStream.format("memory").queryName("dedupe_test").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r.fecha), r.id_producto) for r in spark.sql("select * from dedupe_test").collect())
    assert got == [("2013-07-01", 7), ("2013-07-01", 8), ("2013-07-02", 8)]
