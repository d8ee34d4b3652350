"""Row-level transforms: basket explode (P3, F1, F2), calendar (F3–F5), category
lookup (J1), filters (P1, P2) and key dedupe (U3)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from trolley.functions.calendar import iso_week, month_of, weekday0
from trolley.functions.labels import NO_CATEGORY
from trolley.plans.joins import checked_broadcast
from trolley.schemas import FLAT_KEYS


def add_calendar(df: DataFrame, date_col: str = "fecha") -> DataFrame:
    d = F.col(date_col)
    return (df.withColumn("dia_semana", weekday0(d))
              .withColumn("semana", iso_week(d))
              .withColumn("mes", month_of(d)))


def explode_baskets(raw: DataFrame, strict: bool = False) -> DataFrame:
    """One row per product token of each non-blank basket.

    ``strict=True`` casts with ANSI semantics (a bad token fails the job, as the
    reference does); the default ``try_cast`` drops bad tokens, which
    ``sources.csv.validate`` counts.
    """
    basket = F.trim(F.coalesce(F.col("basket_raw"), F.lit("")))
    tok = F.explode(F.split(basket, r"\s+")).alias("tok")
    cast = (F.col("tok").cast("long") if strict else F.expr("try_cast(tok AS BIGINT)"))
    keys = [c for c in raw.columns if c != "basket_raw"]
    return (raw.filter(basket != "")
               .select(*keys, tok)
               .select(*keys, cast.alias("id_producto"))
               .filter(F.col("id_producto").isNotNull()))


def product_lookup(categories: DataFrame, product_category: DataFrame) -> DataFrame:
    """Product id -> category name, the three-way rule folded into one small table.

    * product in the product->category catalog: that category's name, or
      ``SIN CATEGORIA`` when the category has no name (no fall-through);
    * else a category id equal to the product id: that category's name;
    * else (not in this table): ``SIN CATEGORIA`` at lookup time.

    The categories are the smaller side: of the products only those with a category's id meet them,
    so no broadcast (Spark picks one by file size) holds the whole product->category catalog.
    """
    pc = product_category.select(F.col("prod_id").cast("long").alias("prod_id"),
                                 F.col("cat_id").cast("int").alias("cat_id"))
    cat = categories.select(F.col("cat_id").cast("int").alias("cat_id"), "cat_name")
    via_pc = (pc.join(cat, "cat_id", "left")
                .select(F.col("prod_id").alias("id_producto"),
                        F.coalesce("cat_name", F.lit(NO_CATEGORY)).alias("nombre_categoria")))
    ids = cat.select(F.col("cat_id").cast("long").alias("id"))
    listed = pc.select("prod_id").join(ids, F.col("prod_id") == F.col("id"), "left_semi")
    direct = (cat.join(listed, F.col("cat_id").cast("long") == F.col("prod_id"), "left_anti")
                 .select(F.col("cat_id").cast("long").alias("id_producto"),
                         F.col("cat_name").alias("nombre_categoria")))
    return via_pc.unionByName(direct)


def categorize(flat: DataFrame, lookup: DataFrame) -> DataFrame:
    """Attach ``nombre_categoria``. The lookup is broadcast only after a size check."""
    return categorize_by(flat, checked_broadcast(lookup))


def categorize_by(flat: DataFrame, lookup: DataFrame) -> DataFrame:
    """``categorize`` by a lookup whose size was checked."""
    return (flat.join(lookup, "id_producto", "left")
                .withColumn("nombre_categoria",
                            F.coalesce("nombre_categoria", F.lit(NO_CATEGORY))))


def dedupe_items(flat: DataFrame) -> DataFrame:
    """Distinct on the item key; the other flat columns are functions of the key."""
    return flat.dropDuplicates(FLAT_KEYS)


def merge_flat(existing: DataFrame | None, new: DataFrame, policy: str = "always") -> DataFrame:
    """U2 + U3: append new item rows to an existing flat table.

    ``policy='always'`` dedupes every load, so file-by-file ingest equals one full load.
    ``policy='reference'`` reproduces the reference: a first load keeps repeated keys,
    every later merge dedupes the whole table (X4)."""
    if policy not in ("always", "reference"):
        raise ValueError("policy must be 'always' or 'reference'")
    if existing is None:
        return dedupe_items(new) if policy == "always" else new
    return dedupe_items(existing.unionByName(new))


def _as_date(v):
    if v is None or isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))


def apply_filters(df: DataFrame, tienda: int | None = None, fecha_ini=None,
                  fecha_fin=None) -> DataFrame:
    """AND of the given conditions only: store equality, inclusive date bounds.

    Plain column predicates, so they reach the Parquet scan as pushed filters
    (and prune ``id_tienda`` partitions of a partitioned table)."""
    if tienda is not None:
        df = df.filter(F.col("id_tienda") == F.lit(int(tienda)))
    if fecha_ini is not None:
        df = df.filter(F.col("fecha") >= F.lit(_as_date(fecha_ini)))
    if fecha_fin is not None:
        df = df.filter(F.col("fecha") <= F.lit(_as_date(fecha_fin)))
    return df


def filter_customers_by_store(customers: DataFrame, tienda: int | None = None) -> DataFrame:
    """Customers whose main store is ``tienda``; dates do not apply."""
    return customers if tienda is None else customers.filter(F.col("id_tienda") == int(tienda))
