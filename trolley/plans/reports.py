"""Composite reports (C1–C3): several outputs of one table.

With a store or date filter the outputs come from the filtered items, persisted once;
``release(bundle)`` lets go of them. Without one, ``stored_summary`` and ``stored_bundle``
answer from the stored derived tables and never read or persist the item table (but for the
weekly categories). ``measured_report`` answers filtered reports, weekly categories included,
from the tables by day and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.operators import metrics as M
from trolley.operators import tables as TB
from trolley.operators.transform import apply_filters, filter_customers_by_store


def _filtered(flat: DataFrame, tienda, fecha_ini, fecha_fin) -> tuple[DataFrame, DataFrame | None]:
    """(items, the persisted base or None): only a filtered table is persisted."""
    if tienda is None and fecha_ini is None and fecha_fin is None:
        return flat, None
    ff = apply_filters(flat, tienda, fecha_ini, fecha_fin).persist()
    return ff, ff


def executive_summary(flat: DataFrame, tienda=None, fecha_ini=None, fecha_fin=None, n: int = 10) -> dict:
    """KPIs, top products, top customers, daily table and category counts."""
    ff, base = _filtered(flat, tienda, fecha_ini, fecha_fin)
    return {
        "_base": base,
        "summary": M.summary_kpis(ff),
        "top_products": TB.top_products(ff, n),
        "top_customers": M.top_customers(ff, n),
        "daily": daily_text(ff),
        "categories": M.category_counts(ff),
    }


def stored_summary(tables: dict, n: int = 10) -> dict:
    """C1 of the whole table from the stored tables (``files.load_tables``)."""
    products, customers, daily = tables["product_freq"], tables["customer_features"], tables["daily_summary"]
    return {
        "summary": M.stored_summary_kpis(daily, customers, products),
        "top_products": TB.top_stored_products(products, n),
        "top_customers": M.top_stored_customers(customers, n),
        "daily": stored_daily(daily),
        "categories": M.stored_category_counts(products),
    }


def analytics_bundle(flat: DataFrame, customers: DataFrame, tienda=None, fecha_ini=None,
                     fecha_fin=None, top_n: int = 5) -> dict:
    """Daily table, weekly category evolution and customer features (main-store filter only)."""
    ff, base = _filtered(flat, tienda, fecha_ini, fecha_fin)
    return {
        "_base": base,
        "daily": daily_text(ff),
        "category_evolution": M.category_evolution(ff, top_n),
        "customer_features": filter_customers_by_store(customers, tienda),
    }


def stored_bundle(tables: dict, tienda=None, fecha_ini=None, fecha_fin=None, top_n: int = 5) -> dict:
    """C2 from the stored tables: filters go to the stored daily table and the month and
    store directories of the item table."""
    return {
        "daily": stored_daily(tables["daily_summary"], tienda, fecha_ini, fecha_fin),
        "category_evolution": M.category_evolution(apply_filters(tables["transactions_flat"], tienda, fecha_ini, fecha_fin), top_n),
        "customer_features": filter_customers_by_store(tables["customer_features"], tienda),
    }


def measured_report(measures: dict, tienda=None, fecha_ini=None, fecha_fin=None, top_n: int = 5) -> dict:
    """KPIs, daily table, category counts and weekly categories of any store and dates from the
    tables by day and store (``incremental.load_measures``); the items are not read."""
    daily, customers, categories = (apply_filters(measures[name], tienda, fecha_ini, fecha_fin)
                                    for name in ("daily_summary", "daily_customers", "daily_categories"))
    return {
        "summary": M.measured_kpis(daily, customers, categories),
        "daily": stored_daily(daily),
        "categories": M.measured_category_counts(categories),
        "category_evolution": M.measured_category_evolution(categories, top_n),
    }


def stored_daily(daily: DataFrame, tienda=None, fecha_ini=None, fecha_fin=None) -> DataFrame:
    """C3 from the stored daily table: filter, dates as ISO text, in order."""
    return (apply_filters(daily, tienda, fecha_ini, fecha_fin).orderBy("fecha", "id_tienda")
            .withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd")))


def daily_text(flat: DataFrame) -> DataFrame:
    """Daily table with dates as ISO text."""
    return TB.daily_summary(flat).withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


def release(bundle: dict) -> None:
    base = bundle.get("_base")
    if base is not None:
        base.unpersist()
