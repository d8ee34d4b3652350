"""Derived tables over transactions_flat.

Each is one ``groupBy().agg()`` — Spark plans partial (map-side) aggregation, and
distinct counts are planned with the value inside the first shuffle key, so a
customer or day that holds a large share of the rows is still spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.functions.calendar import iso_week, month_of, weekday0
from trolley.functions.numeric import round_even
from trolley.session import cut_lineage


# Fixed value: 10^10 exceeds twice the magnitude of any 32-bit store id.
_STORE_SPAN = 10 ** 10


def main_of_counts(per_store: DataFrame) -> DataFrame:
    """Main store from (id_cliente, id_tienda, cnt).

    The order (items desc, store asc) is one exact decimal key, items * 10^10 - store:
    a long count times 10^10 stays below 10^29, and store ids of any int value differ by
    less than 10^10. A numeric key keeps ``max_by`` in a hash aggregate (a struct key
    would force a sort-based one)."""
    return items_and_main(per_store).select("id_cliente", "id_tienda")


def items_and_main(per_store: DataFrame) -> DataFrame:
    """``main_of_counts`` with the items of all stores (``volumen_total``)."""
    dec = "decimal(38,0)"
    key = (F.col("cnt").cast(dec) * F.lit(_STORE_SPAN).cast(dec)) - F.col("id_tienda").cast(dec)
    return per_store.groupBy("id_cliente").agg(F.max_by("id_tienda", key).alias("id_tienda"), F.sum("cnt").alias("volumen_total"))


def main_store(flat: DataFrame) -> DataFrame:
    """Store with most items per customer; ties go to the smallest store id."""
    return main_of_counts(flat.groupBy("id_cliente", "id_tienda").agg(F.count(F.lit(1)).alias("cnt")))


def customer_features(flat: DataFrame) -> DataFrame:
    """Per customer: distinct days, distinct products, items, distinct categories, main store.

    The items are counted once per (customer, day, store) and once per (customer, product,
    category), combined before each shuffle. All figures come from these counts, so the
    items are never multiplied by the number of distinct counts (no Expand over them)."""
    visits = flat.groupBy("id_cliente", "fecha", "id_tienda").agg(F.count(F.lit(1)).alias("n"))
    bought = flat.groupBy("id_cliente", "id_producto", "nombre_categoria").agg(F.lit(1).alias("one"))
    days = visits.groupBy("id_cliente").agg(F.countDistinct("fecha").alias("frecuencia"), F.sum("n").alias("volumen_total"))
    kinds = bought.groupBy("id_cliente").agg(F.countDistinct("id_producto").alias("n_productos_distintos"),
                                             F.countDistinct("nombre_categoria").alias("n_categorias_distintas"))
    store = main_of_counts(visits.groupBy("id_cliente", "id_tienda").agg(F.sum("n").alias("cnt")))
    return (days.join(kinds, "id_cliente").join(store, "id_cliente")
            .select("id_cliente", "frecuencia", "n_productos_distintos", "volumen_total",
                    "n_categorias_distintas", "id_tienda"))


def daily_summary(flat: DataFrame, ordered: bool = True) -> DataFrame:
    """Per (day, store): transactions (= distinct customers), items, customers + calendar."""
    df = daily_of_counts(flat.groupBy("fecha", "id_tienda")
                         .agg(F.countDistinct("id_cliente").alias("n_transacciones"), F.count(F.lit(1)).alias("n_items")))
    return df.orderBy("fecha", "id_tienda") if ordered else df


def daily_of_counts(counts: DataFrame) -> DataFrame:
    """Daily table from (fecha, id_tienda, n_transacciones, n_items)."""
    return (counts.withColumn("n_clientes", F.col("n_transacciones"))
            .withColumn("dia_semana", weekday0(F.col("fecha")))
            .withColumn("semana", iso_week(F.col("fecha")))
            .withColumn("mes", month_of(F.col("fecha"))))


def with_share(counts: DataFrame, total) -> DataFrame:
    """Product counts with the % of ``total`` customers (2 dp)."""
    return counts.select("id_producto", "nombre_categoria", "frecuencia_absoluta", "n_clientes",
                         round_even(F.col("n_clientes").cast("double") / total * 100.0, 2).alias("pct_clientes"))


def product_freq(flat: DataFrame, ordered: bool = False, total_customers=None) -> DataFrame:
    """Per product: items, distinct customers, % of the customers of ``flat`` (2 dp).

    One scan: grouping sets (product, category) and () give the per-product counts and
    the overall distinct customers together; the grouped result (one row per product,
    plus one) is checkpointed and the denominator read from its total row.
    ``total_customers`` (a number or a scalar Column, e.g. the row count of a stored
    customer table of the same flat) keeps the plan lazy instead."""
    if total_customers is not None:
        total = total_customers if isinstance(total_customers, F.Column) else F.lit(total_customers)
        grouped = flat.groupBy("id_producto", "nombre_categoria").agg(
            F.count(F.lit(1)).alias("frecuencia_absoluta"), F.countDistinct("id_cliente").alias("n_clientes"))
    else:
        g = cut_lineage(
            flat.groupingSets([["id_producto", "nombre_categoria"], []], "id_producto", "nombre_categoria")
            .agg(F.count(F.lit(1)).alias("frecuencia_absoluta"), F.countDistinct("id_cliente").alias("n_clientes"),
                 F.grouping_id().alias("gid")))
        row = g.filter(F.col("gid") == 3).select("n_clientes").first()
        total = F.lit(int(row[0]) if row else 0)
        grouped = g.filter(F.col("gid") == 0).drop("gid")
    df = with_share(grouped, total)
    return df.orderBy(F.desc("frecuencia_absoluta"), "id_producto") if ordered else df


def top_products(flat: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` products by items; ties by ascending product id (O1/O2)."""
    return product_freq(flat).orderBy(F.desc("frecuencia_absoluta"), "id_producto").limit(n)


def top_stored_products(product_freq: DataFrame, n: int = 10) -> DataFrame:
    """``top_products`` of the whole table from the stored product table, without the items."""
    return product_freq.orderBy(F.desc("frecuencia_absoluta"), "id_producto").limit(n)


def rows_per_store(flat: DataFrame) -> DataFrame:
    return flat.groupBy("id_tienda").agg(F.count(F.lit(1)).alias("rows"))


def derived_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The three tables rebuilt from one (persisted by the caller) flat."""
    return {
        "customer_features": customer_features(flat),
        "daily_summary": daily_summary(flat, ordered=False),
        "product_freq": product_freq(flat),
    }
