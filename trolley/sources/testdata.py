"""Adapter from the driver's TPC-H-like tables to the retail tables.

The retail engine works on basket transactions (day, store, customer, product) and a
two-level product catalog. The driver ships order/lineitem/part tables instead, so:

* one lineitem = one purchased item; its order gives day and customer;
* the store is derived from the order key (four stores);
* the catalog comes from ``part``: category = brand number.  Parts whose key is a
  multiple of ten are left out of the product->category catalog and brand 25 gets no
  category name, so every branch of the category lookup is exercised.  No row of
  ``lineitem`` or ``orders`` is dropped by this mapping.

The same mapping is spelled as SQL in ``trolley.oracle.ADAPTER_CTE``.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.operators.transform import add_calendar, categorize, product_lookup

# Fixed values of the fixture mapping: the four store ids, chosen by order key mod 4.
STORE_IDS = [102, 103, 107, 110]
# A category id above this has no name in the category catalog.
MAX_NAMED_CATEGORY = 24


# The driver's tables are read-only, so their DataFrames (schema read from the Parquet
# footer, file listing) are built once per session and path and reused by every query.
_READS: dict[tuple, DataFrame] = {}
_READS_LOCK = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark, path)
    with _READS_LOCK:
        df = _READS.get(key)
    if df is None:
        df = spark.read.parquet(path)
        with _READS_LOCK:
            df = _READS.setdefault(key, df)
    return df


def store_of(orderkey) -> F.Column:
    k = orderkey % 4
    expr = F.when(k == 0, F.lit(STORE_IDS[0]))
    for i in range(1, 4):
        expr = expr.when(k == i, F.lit(STORE_IDS[i]))
    return expr.cast("int")


@dataclass
class RetailTables:
    spark: SparkSession
    sf_dir: str

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def items(self) -> DataFrame:
        """Undeduplicated item rows (fecha, id_tienda, id_cliente, id_producto)."""
        return self.order_items.drop("o_orderkey")

    @cached_property
    def order_items(self) -> DataFrame:
        """``items`` with the key of their order."""
        li = self.t("lineitem").select("l_orderkey", "l_partkey")
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select("o_orderkey", F.to_date("o_orderdate").alias("fecha"),
                        store_of(F.col("o_orderkey")).alias("id_tienda"),
                        F.col("o_custkey").alias("id_cliente"),
                        F.col("l_partkey").alias("id_producto")))

    @cached_property
    def product_category(self) -> DataFrame:
        p = self.t("part").select("p_partkey", "p_brand")
        return (p.filter(F.col("p_partkey") % 10 != 0)
                .select(F.col("p_partkey").alias("prod_id"),
                        F.substring("p_brand", 7, 10).cast("int").alias("cat_id")))

    @cached_property
    def categories(self) -> DataFrame:
        p = self.t("part").select(F.substring("p_brand", 7, 10).alias("b"))
        return (p.filter(F.col("b").cast("int") <= MAX_NAMED_CATEGORY)
                .select(F.col("b").cast("int").alias("cat_id"),
                        F.concat(F.lit("CAT_"), F.col("b")).alias("cat_name"))
                .distinct())

    @cached_property
    def lookup(self) -> DataFrame:
        return product_lookup(self.categories, self.product_category)

    @cached_property
    def flat(self) -> DataFrame:
        """transactions_flat: one row per distinct (day, store, customer, product)."""
        return add_calendar(categorize(self.items.distinct(), self.lookup))

    @cached_property
    def raw(self) -> DataFrame:
        """transactions_raw: one basket line per (day, store, customer), products as text. The items
        of an order become one text before it meets the order, so items are not joined one by one."""
        text = F.concat_ws(" ", F.collect_list(F.col("l_partkey").cast("string"))).alias("t")
        keys = ["fecha", "id_tienda", "id_cliente"]
        bought = self.t("lineitem").groupBy("l_orderkey").agg(text)
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return (bought.join(o, bought.l_orderkey == o.o_orderkey)
                .select(F.to_date("o_orderdate").alias("fecha"), store_of(F.col("o_orderkey")).alias("id_tienda"),
                        F.col("o_custkey").alias("id_cliente"), "t").groupBy(*keys)
                .agg(F.concat_ws(" ", F.collect_list(F.nullif("t", F.lit("")))).alias("basket_raw")))


_RETAIL: dict[tuple, RetailTables] = {}


def retail(spark: SparkSession, sf_dir: str) -> RetailTables:
    """The retail view of one test-data directory, built once per session (its frames
    are immutable plans; every query of the session starts from the same ones)."""
    key = (spark, sf_dir.rstrip("/"))
    with _READS_LOCK:
        rt = _RETAIL.get(key)
        if rt is None:
            rt = _RETAIL[key] = RetailTables(spark, sf_dir)
    return rt
