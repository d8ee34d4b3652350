import datetime as dt

from pyspark.sql import functions as F

from trolley.operators.transform import add_calendar, apply_filters, categorize, explode_baskets, product_lookup
from trolley.schemas import CATEGORIES, PRODUCT_CATEGORY, TRANSACTIONS_RAW

D = dt.date(2013, 7, 1)


def raw(spark, rows):
    return spark.createDataFrame(rows, TRANSACTIONS_RAW)


def test_reference_sample_explodes_to_eight_items(spark):
    df = raw(spark, [(D, 102, 530, "20 3 1"), (D, 102, 587, "6 29 43 21 34")])
    out = explode_baskets(df)
    assert out.count() == 8
    assert sorted(r.id_producto for r in out.collect()) == [1, 3, 6, 20, 21, 29, 34, 43]


def test_blank_null_and_repeated_baskets(spark):
    df = raw(spark, [(D, 102, 1, ""), (D, 102, 2, "   "), (D, 102, 3, None), (D, 102, 4, " 7 7  8 ")])
    out = explode_baskets(df)
    assert [r.id_producto for r in out.orderBy("id_producto").collect()] == [7, 7, 8]
    assert out.dropDuplicates(["fecha", "id_tienda", "id_cliente", "id_producto"]).count() == 2


def test_bad_token_dropped_in_lenient_mode(spark):
    df = raw(spark, [(D, 102, 9, "7 x 8")])
    assert [r.id_producto for r in explode_baskets(df).orderBy("id_producto").collect()] == [7, 8]


def test_category_branches(spark):
    cats = spark.createDataFrame([(1, "A"), (2, "B"), (5, "E")], CATEGORIES)
    pc = spark.createDataFrame([(100, 1), (101, 9), (5, 2)], PRODUCT_CATEGORY)
    items = spark.createDataFrame([(100,), (101,), (2,), (5,), (777,)], "id_producto long")
    got = {r.id_producto: r.nombre_categoria for r in categorize(items, product_lookup(cats, pc)).collect()}
    # known category; unknown category (no fall-through); id used as category; product
    # listed in the catalog wins over its id being a category id; none
    assert got == {100: "A", 101: "SIN CATEGORIA", 2: "B", 5: "B", 777: "SIN CATEGORIA"}


def test_calendar_edges(spark):
    df = spark.createDataFrame([(dt.date(2012, 12, 31),), (dt.date(2013, 6, 30),)], "fecha date")
    rows = {r.fecha: r for r in add_calendar(df).collect()}
    assert rows[dt.date(2012, 12, 31)].dia_semana == 0 and rows[dt.date(2012, 12, 31)].semana == 1
    assert rows[dt.date(2013, 6, 30)].dia_semana == 6
    from trolley.functions.calendar import week_start
    assert df.select(week_start(F.col("fecha")).alias("w")).collect()[1].w == dt.date(2013, 6, 24)


def test_filters_are_inclusive_and_optional(spark):
    df = spark.createDataFrame([(dt.date(2013, 1, d), 102 if d % 2 else 103) for d in range(1, 11)],
                               "fecha date, id_tienda int")
    assert apply_filters(df).count() == 10
    assert apply_filters(df, 102).count() == 5
    assert apply_filters(df, None, "2013-01-03", "2013-01-05").count() == 3
    assert apply_filters(df, 103, dt.date(2013, 1, 2), dt.date(2013, 1, 2)).count() == 1


def test_filter_reaches_parquet_scan(spark, tmpdir_path):
    df = spark.createDataFrame([(dt.date(2013, 1, d), 102, 1, 1) for d in range(1, 5)],
                               "fecha date, id_tienda int, id_cliente long, id_producto long")
    path = tmpdir_path + "/flat"
    df.write.partitionBy("id_tienda").parquet(path)
    plan = apply_filters(spark.read.parquet(path), 102, "2013-01-02", None)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "fecha" in plan


def test_clustered_write_keeps_rows_and_splits_dates(spark, tmpdir_path):
    from trolley.sources import files as FS
    from trolley.sources.testdata import retail
    flat = retail(spark, "/root/testdata/sf0.001").flat
    FS.store_flat(flat, tmpdir_path)
    back = spark.read.parquet(f"{tmpdir_path}/transactions_flat")
    assert back.count() == flat.count()
    assert back.select(*flat.columns).exceptAll(flat).count() == 0
    per_file = (back.withColumn("f", F.input_file_name()).groupBy("periodo", "id_tienda", "f")
                .agg(F.min("fecha").alias("lo"), F.max("fecha").alias("hi")).collect())
    by_store = {}
    for r in per_file:
        by_store.setdefault((r.periodo, r.id_tienda), []).append((r.lo, r.hi))
    for ranges in by_store.values():  # files of a month and store hold disjoint date ranges
        ranges.sort()
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_lookup_broadcasts_no_whole_catalog(spark):
    """Only products with a category's id meet the categories; nulls and repeated lines count as before."""
    categories = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (None, "N")], "cat_id int, cat_name string")
    products = spark.createDataFrame([(2, 1), (2, 3), (50, 9), (60, None), (None, 1)], "prod_id long, cat_id int")
    lookup = product_lookup(categories, products)
    got = sorted(((r.id_producto, r.nombre_categoria) for r in lookup.collect()), key=str)
    assert got == sorted([(1, "A"), (2, "A"), (2, "C"), (3, "C"), (50, "SIN CATEGORIA"), (60, "SIN CATEGORIA"), (None, "A"), (None, "N")], key=str)
    plan = lookup._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("LeftAnti"):]
