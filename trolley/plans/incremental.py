"""Derived tables kept up to date from the rows a run has added.

Distinct counts are maintained with two tables of distinct keys that only grow: ``visits``
(customer, day, store) by month and ``bought`` (customer, product, category) by a hash of the
customer. A batch looks up its own keys in the months it has dates of and in the buckets of its
customers; what is not there yet is appended and raises the counts of its customer and product.
Items per customer and store are additive. So a run reads and writes:

* flat table (stored keys), daily_summary and visits: the months of the batch;
* bought, customer_stores, customer_features: the buckets of its customers;
* product_freq: the table itself, one row per product and category;
* daily_customers, daily_categories: the months of the batch.

The last two make distinct counts mergeable over any stores and dates. Every customer gets a
number when first seen (``customer_numbers``, by bucket, without gaps inside a bucket); a day
and store holds its customers as bitmaps over these numbers, one per 32,768 of them. The union
of the bitmaps of some days and stores counts their customers exactly, without the items.

History outside these is not read. The tables equal those of ``operators.tables`` over all items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from trolley import schemas as S
from trolley.operators import tables as TB
from trolley.plans.joins import checked_broadcast
from trolley.session import cut_lineage
from trolley.sources import files as FS
from trolley.sources import versions
from trolley.sources.versions import Version

FLAT = "transactions_flat"
# Buckets of customers where the caller names no number (a large store wants thousands). Kept in
# the manifest: a store keeps the number it began with.
BUCKETS = 16
_ITEM = {f.name: f for f in S.TRANSACTIONS_FLAT.fields}
VISITS = T.StructType([_ITEM[c] for c in ("id_cliente", "fecha", "id_tienda")])
BOUGHT = T.StructType([_ITEM[c] for c in ("id_cliente", "id_producto", "nombre_categoria")])
STORES = T.StructType([_ITEM["id_cliente"], _ITEM["id_tienda"], T.StructField("n", T.LongType())])
NUMBERS = T.StructType([_ITEM["id_cliente"], T.StructField("numero", T.LongType())])
DAY = [_ITEM["fecha"], _ITEM["id_tienda"]]
DAILY_CUSTOMERS = T.StructType([*DAY, T.StructField("tramo", T.LongType()), T.StructField("bits", T.BinaryType())])
DAILY_CATEGORIES = T.StructType([*DAY, _ITEM["nombre_categoria"], T.StructField("n", T.LongType())])


def bucket_of(customer: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(buckets)).cast("int")


def unseen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of ``rows`` that ``stored`` does not have: one shuffle of both, combined
    before it."""
    both = rows.select(*keys, F.lit(False).alias("held")).unionByName(stored.select(*keys, F.lit(True).alias("held")))
    return both.groupBy(*keys).agg(F.max("held").alias("held")).filter("not held").drop("held")


def unseen_in_ranges(rows: DataFrame, stored: DataFrame, keys: list[str], ranged: int) -> DataFrame:
    """``unseen`` rows laid out by ranges of the first ``ranged`` keys and sorted by them, in one
    shuffle: equal rows are in the same range, so they meet where they will be written."""
    both = rows.select(*keys, F.lit(False).alias("held")).unionByName(stored.select(*keys, F.lit(True).alias("held")))
    by = keys[:ranged]
    return (both.repartitionByRange(*by).groupBy(*keys).agg(F.max("held").alias("held"))
            .filter("not held").drop("held").sortWithinPartitions(*by))


def new_products(new_bought: DataFrame, old_bought: DataFrame, products: DataFrame) -> DataFrame:
    """(customer, product) once for each of ``new_bought`` that ``old_bought`` does not have. A product
    of one category (``products``: a row for each product and category, of all runs) has one row for
    a customer, which is new itself; only products of several categories are looked up."""
    keys = ["id_cliente", "id_producto"]
    several = cut_lineage(products.groupBy("id_producto").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id_producto"))
    if several.isEmpty():
        return new_bought.select(*keys)
    several = checked_broadcast(several)
    again = unseen(new_bought.join(several, "id_producto", "left_semi"), old_bought.join(several, "id_producto", "left_semi"), keys)
    return new_bought.join(several, "id_producto", "left_anti").select(*keys).unionByName(again)


def new_categories(new_bought: DataFrame, old_bought: DataFrame) -> DataFrame:
    """One row of a customer for each of its categories in ``new_bought`` that ``old_bought`` does not
    have. A customer's categories are gathered before the one shuffle, which is by customer."""
    both = new_bought.select("id_cliente", "nombre_categoria", F.lit(False).alias("held")).unionByName(
        old_bought.select("id_cliente", "nombre_categoria", F.lit(True).alias("held")))
    of = lambda held: F.collect_set(F.when(F.col("held") == held, F.col("nombre_categoria")))
    return (both.groupBy("id_cliente").agg(of(False).alias("now"), of(True).alias("then"))
            .select("id_cliente", F.explode(F.array_except("now", "then"))).select("id_cliente"))


def of_customers(stored: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of ``stored`` of these customers. Where they are too many to broadcast it is ``stored``
    itself: to leave rows out would shuffle as much as to look keys up in all of them."""
    own = checked_broadcast(customers)
    return stored if own is customers else cut_lineage(stored.join(own, "id_cliente", "left_semi"))


def raised(old: DataFrame, keys: list[str], counts: dict[str, DataFrame]) -> DataFrame:
    """``old`` (keys and counts) with each count raised by the number of rows of its frame that
    have the keys; keys that are new start at zero. One shuffle on the keys."""
    names = list(counts)
    whole = old.select(*keys, *names)
    for name, rows in counts.items():
        n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        whole = whole.unionByName(n.select(*keys, *((F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in names)))
    return whole.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names))


def number_customers(v: Version, customers: DataFrame, touched: list[int], buckets: int) -> None:
    """Numbers for the customers of ``customers(id_cliente, cubo)`` that have none: bucket + 1,
    bucket + 1 + buckets, ... in the order of their ids after those that the bucket has."""
    stored = v.load("customer_numbers", NUMBERS, touched).withColumn("cubo", bucket_of("id_cliente", buckets))
    new = customers.join(stored.select("id_cliente"), "id_cliente", "left_anti")
    taken = F.broadcast(stored.groupBy("cubo").agg(F.count(F.lit(1)).alias("taken")))      # one row per bucket
    at = F.coalesce("taken", F.lit(0)) + F.row_number().over(Window.partitionBy("cubo").orderBy("id_cliente")) - 1
    v.append("customer_numbers", new.join(taken, "cubo", "left").select("id_cliente", (at * buckets + F.col("cubo") + 1).cast("long").alias("numero"), "cubo"),
             by=["cubo"], merge=lambda parts: v.load("customer_numbers", NUMBERS, parts).withColumn("cubo", bucket_of("id_cliente", buckets)))


def day_bitmaps(visits: DataFrame) -> DataFrame:
    """Customers of a day and store of ``visits(fecha, id_tienda, numero)`` as bitmaps. The numbers
    are shuffled and not bitmaps: with many customers, every visit of a task has one of 4 KB."""
    at = visits.select("fecha", "id_tienda", F.bitmap_bucket_number("numero").alias("tramo"), F.bitmap_bit_position("numero").alias("bit"))
    keys = ["fecha", "id_tienda", "tramo"]
    return at.repartition(*keys).groupBy(*keys).agg(F.bitmap_construct_agg("bit").alias("bits"))


def refresh(v: Version, buckets: int = BUCKETS) -> None:
    """Bring the derived tables up to the rows that ``v`` has appended to the flat table."""
    months = sorted(v.written.get(FLAT, {}))
    if not months and "customer_features" in v.tables:
        return
    buckets = v.settings.setdefault("customer_buckets", buckets)
    added = v.added(FLAT, S.TRANSACTIONS_FLAT)

    customers = cut_lineage(added.select("id_cliente").distinct().withColumn("cubo", bucket_of("id_cliente", buckets)))
    touched = sorted(r[0] for r in customers.select("cubo").distinct().collect())     # at most the number of buckets
    own = customers.select("id_cliente")

    old_visits = of_customers(v.load("visits", VISITS, months), own)
    v.append("visits", unseen(added, old_visits, VISITS.fieldNames()).withColumn("periodo", FS.month_key()), by=["periodo"],
             merge=lambda parts: v.load("visits", VISITS, parts).withColumn("periodo", FS.month_key()))
    new_visits = v.added("visits", VISITS)     # written: read instead of made distinct once more
    daily = raised(v.load("daily_summary", S.DAILY_SUMMARY, months), ["fecha", "id_tienda"], {"n_transacciones": new_visits, "n_items": added})
    v.replace("daily_summary", TB.daily_of_counts(daily).select(*S.DAILY_SUMMARY.fieldNames(), FS.month_key().alias("periodo")), by=["periodo"], parts=months)
    days = unseen(new_visits, old_visits, ["id_cliente", "fecha"])
    number_customers(v, customers, touched, buckets)
    numbered = day_bitmaps(new_visits.join(v.load("customer_numbers", NUMBERS, touched), "id_cliente"))   # stored visits have their bits
    bits = (v.load("daily_customers", DAILY_CUSTOMERS, months).unionByName(numbered)
            .groupBy("fecha", "id_tienda", "tramo").agg(F.bitmap_or_agg("bits").alias("bits")))
    v.replace("daily_customers", bits.withColumn("periodo", FS.month_key()), by=["periodo"], parts=months)
    kinds = raised(v.load("daily_categories", DAILY_CATEGORIES, months), ["fecha", "id_tienda", "nombre_categoria"], {"n": added})
    v.replace("daily_categories", kinds.withColumn("periodo", FS.month_key()), by=["periodo"], parts=months)

    old_bought = of_customers(v.load("bought", BOUGHT, touched), own)
    with_bucket = lambda df: df.withColumn("cubo", bucket_of("id_cliente", buckets))
    v.append("bought", unseen_in_ranges(with_bucket(added), with_bucket(old_bought), ["cubo", *BOUGHT.fieldNames()], 3), by=["cubo"],
             merge=lambda parts: with_bucket(v.load("bought", BOUGHT, parts)).repartitionByRange("cubo", "id_cliente").sortWithinPartitions("cubo", "id_cliente"))
    new_bought = v.added("bought", BOUGHT)     # written: read instead of joined once more
    products = cut_lineage(raised(v.load("product_freq", S.PRODUCT_FREQ), ["id_producto", "nombre_categoria"],
                                  {"frecuencia_absoluta": added, "n_clientes": new_bought}))

    old = v.load("customer_features", S.CUSTOMER_FEATURES, touched)
    counts = raised(old, ["id_cliente"], {
        "frecuencia": days, "n_productos_distintos": new_products(new_bought, old_bought, products),
        "n_categorias_distintas": new_categories(new_bought, old_bought)})
    stores = raised(v.load("customer_stores", STORES, touched), ["id_cliente", "id_tienda"], {"n": added})
    v.replace("customer_stores", with_bucket(stores), by=["cubo"], parts=touched)
    main = TB.items_and_main(v.load("customer_stores", STORES, touched).withColumnRenamed("n", "cnt"))
    v.replace("customer_features", with_bucket(counts.join(main, "id_cliente").select(*S.CUSTOMER_FEATURES.fieldNames())),
              by=["cubo"], parts=touched)

    total = v.load("customer_features", S.CUSTOMER_FEATURES).select(F.count(F.lit(1))).scalar()     # from file footers
    v.replace("product_freq", TB.with_share(products, total))


MEASURES = {"daily_summary": S.DAILY_SUMMARY, "daily_customers": DAILY_CUSTOMERS, "daily_categories": DAILY_CATEGORIES}


def load_measures(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables by day and store that filtered reports are answered from, of one version."""
    of = versions.manifest(spark, base)["tables"]
    return {name: versions.read(spark, base, versions.folders(of, name), schema) for name, schema in MEASURES.items()}
