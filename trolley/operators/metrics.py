"""Metrics and report tables.

All work is grouped aggregation over the flat/daily/customer tables. Windows without
``partitionBy`` are only used on frames already reduced to one row per date, store or
category; one-row totals enter other expressions as scalar subqueries, not joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trolley.functions.calendar import date_text, week_start
from trolley.functions.labels import FEATURES, OTHER_BUCKET, day_name, month_name
from trolley.functions.numeric import round_even
from trolley.operators.tables import daily_summary
from trolley.plans.joins import checked_broadcast
from trolley.session import cut_lineage


def _whole():
    """Window over the whole (already aggregated, small) frame."""
    return Window.partitionBy()


# ------------------------------------------------------------------ KPIs

def summary_kpis(flat: DataFrame) -> DataFrame:
    """Totals and first-half vs second-half deltas of a (filtered) flat table.

    The split date is the item-weighted upper median: the first date whose running
    item count exceeds floor(n/2). Deltas are null when there is at most one item.

    One pass over ``flat``: grouping sets (day, store) and () give the per-day-and-store
    items and transactions and the overall distinct customers and categories together.
    That small result (one row per day and store, plus one) is checkpointed to the
    shared folder; the running sum and the half sums read only it."""
    g = cut_lineage(
        flat.groupingSets([["fecha", "id_tienda"], []], "fecha", "id_tienda")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id_cliente").alias("c"),
             F.countDistinct("nombre_categoria").alias("k"), F.grouping_id().alias("gid")))
    per_date = (g.filter(F.col("gid") == 0).groupBy("fecha")
                .agg(F.sum("n").alias("n"), F.sum("c").alias("t")))
    total = g.filter(F.col("gid") == 3).select("c", "k").first()
    return _kpis(per_date, F.lit(int(total["c"]) if total else 0), F.lit(int(total["k"]) if total else 0))


def stored_summary_kpis(daily: DataFrame, customers: DataFrame, product_freq: DataFrame) -> DataFrame:
    """``summary_kpis`` of the whole table from the stored derived tables, without the items."""
    per_date = daily.groupBy("fecha").agg(F.sum("n_items").alias("n"), F.sum("n_transacciones").alias("t"))
    return _kpis(cut_lineage(per_date), customers.agg(F.count(F.lit(1))).scalar(),
                 product_freq.agg(F.countDistinct("nombre_categoria")).scalar())


def measured_kpis(daily: DataFrame, daily_customers: DataFrame, daily_categories: DataFrame) -> DataFrame:
    """``summary_kpis`` of any stores and dates from the tables by day and store (filtered by the
    caller), without the items. Customers are counted in the union of their bitmaps: one
    ``or`` per 32,768 customers, merged before its shuffle."""
    per_date = daily.groupBy("fecha").agg(F.sum("n_items").alias("n"), F.sum("n_transacciones").alias("t"))
    customers = (daily_customers.groupBy("tramo").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c"))
                 .agg(F.coalesce(F.sum("c"), F.lit(0))).scalar())
    return _kpis(cut_lineage(per_date), customers, daily_categories.agg(F.countDistinct("nombre_categoria")).scalar())


def _kpis(per_date: DataFrame, customers, categories) -> DataFrame:
    """KPIs from one row per date (items n, transactions t) and the two distinct counts."""
    running = F.sum("n").over(Window.orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0))
    n_total = per_date.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mid = (per_date.select("fecha", running.alias("cum"))
           .filter(F.col("cum") > F.lit(n_total // 2))
           .agg(F.min("fecha")).first()[0])
    mid = F.lit(mid).cast("date")
    agg = per_date.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_items"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total_transacciones"),
        F.coalesce(F.sum(F.when(F.col("fecha") <= mid, F.col("n"))), F.lit(0)).alias("h1_items"),
        F.coalesce(F.sum(F.when(F.col("fecha") > mid, F.col("n"))), F.lit(0)).alias("h2_items"),
        F.coalesce(F.sum(F.when(F.col("fecha") <= mid, F.col("t"))), F.lit(0)).alias("h1_trans"),
        F.coalesce(F.sum(F.when(F.col("fecha") > mid, F.col("t"))), F.lit(0)).alias("h2_trans"),
    )

    def delta(h1, h2):
        x = (F.col(h2) - F.col(h1)).cast("double") / F.greatest(F.col(h1), F.lit(1)).cast("double") * 100.0
        return F.when(F.col("total_items") > 1, round_even(x, 1))

    return agg.select(
        "total_items", "total_transacciones",
        customers.cast("long").alias("clientes_unicos"), categories.cast("long").alias("categorias_activas"),
        delta("h1_items", "h2_items").alias("delta_items_pct"),
        delta("h1_trans", "h2_trans").alias("delta_trans_pct"),
    )


# ------------------------------------------------------------------ categories

def category_counts(flat: DataFrame, ordered: bool = True) -> DataFrame:
    df = flat.groupBy("nombre_categoria").agg(F.count(F.lit(1)).alias("frecuencia"))
    return df.orderBy(F.desc("frecuencia"), "nombre_categoria") if ordered else df


def measured_category_counts(daily_categories: DataFrame) -> DataFrame:
    """``category_counts`` from the items per day, store and category."""
    return (daily_categories.groupBy("nombre_categoria").agg(F.sum("n").alias("frecuencia"))
            .orderBy(F.desc("frecuencia"), "nombre_categoria"))


def top_categories(flat: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` categories by items; ties by ascending name."""
    return category_counts(flat, ordered=False).orderBy(F.desc("frecuencia"), "nombre_categoria").limit(top_n)


def category_evolution(flat: DataFrame, top_n: int = 5) -> DataFrame:
    """Weekly (Monday) item counts of the top-N categories; weeks as ISO text, no zero-fill.

    One scan: items per (week, category) first; the category totals and the top-N come
    from that small result, which is then semi-joined to the top-N list (at most
    ``top_n`` rows — a parameter — so broadcasting it is bounded)."""
    return _top_weeks(flat.groupBy(week_start(F.col("fecha")).alias("semana_d"), "nombre_categoria")
                      .agg(F.count(F.lit(1)).alias("frecuencia")), top_n)


def measured_category_evolution(daily_categories: DataFrame, top_n: int = 5) -> DataFrame:
    """``category_evolution`` from the items per day, store and category."""
    return _top_weeks(daily_categories.groupBy(week_start(F.col("fecha")).alias("semana_d"), "nombre_categoria")
                      .agg(F.sum("n").alias("frecuencia")), top_n)


def _top_weeks(weekly: DataFrame, top_n: int) -> DataFrame:
    weekly = cut_lineage(weekly)
    top = (weekly.groupBy("nombre_categoria").agg(F.sum("frecuencia").alias("total"))
           .orderBy(F.desc("total"), "nombre_categoria").limit(top_n).select("nombre_categoria"))
    return (weekly.join(F.broadcast(top), "nombre_categoria", "left_semi")
            .select(date_text(F.col("semana_d")).alias("semana"), "nombre_categoria", "frecuencia"))


def category_share_top10(flat: DataFrame, top: int = 10) -> DataFrame:
    """Top categories plus one 'Otras' row holding the rest (only when the rest is > 0).

    One scan; the rank is a window over the aggregated categories (one row each)."""
    counts = category_counts(flat, ordered=False)
    rank = F.row_number().over(Window.orderBy(F.desc("frecuencia"), "nombre_categoria"))
    ranked = counts.withColumn("rk", rank)
    label = F.when(F.col("rk") <= top, F.col("nombre_categoria")).otherwise(F.lit(OTHER_BUCKET))
    return (ranked.groupBy(label.alias("nombre_categoria"), (F.col("rk") <= top).alias("head"))
            .agg(F.sum("frecuencia").cast("long").alias("frecuencia"))
            .filter(F.col("head") | (F.col("frecuencia") > 0))
            .select("nombre_categoria", "frecuencia"))


# ------------------------------------------------------------------ customers / time

def top_customers(flat: DataFrame, n: int = 10) -> DataFrame:
    return (flat.groupBy("id_cliente").agg(F.count(F.lit(1)).alias("total_items"))
            .orderBy(F.desc("total_items"), "id_cliente").limit(n))


def top_stored_customers(customers: DataFrame, n: int = 10) -> DataFrame:
    """``top_customers`` of the whole table from the stored customer table."""
    return (customers.select("id_cliente", F.col("volumen_total").alias("total_items"))
            .orderBy(F.desc("total_items"), "id_cliente").limit(n))


def stored_category_counts(product_freq: DataFrame) -> DataFrame:
    """``category_counts`` of the whole table from the stored product table."""
    return (product_freq.groupBy("nombre_categoria").agg(F.sum("frecuencia_absoluta").alias("frecuencia"))
            .orderBy(F.desc("frecuencia"), "nombre_categoria"))


def customer_list(customers: DataFrame) -> DataFrame:
    """Sorted distinct customer ids."""
    return customers.select("id_cliente").distinct().orderBy("id_cliente")


def bar_order(df: DataFrame, value: str) -> DataFrame:
    """A top-n frame (n rows) smallest value first, as horizontal bars are drawn."""
    return df.orderBy(F.asc(value))


def top_customers_chart(flat: DataFrame, n: int = 10) -> DataFrame:
    """O2 + F11 + O7: top customers with their 'Cliente X' label, smallest first."""
    from trolley.functions.labels import customer_label
    top = top_customers(flat, n)
    return bar_order(top.select("id_cliente", customer_label(F.col("id_cliente")).alias("label"), "total_items"),
                     "total_items")


def time_series(daily: DataFrame, granularity: str = "D", by_store: bool = False) -> DataFrame:
    """Transactions per day ('D') or Monday-week ('W'), optionally per store."""
    if granularity not in ("D", "W"):
        raise ValueError("granularity must be 'D' or 'W'")
    periodo = F.col("fecha") if granularity == "D" else week_start(F.col("fecha"))
    keys = [periodo.alias("periodo")] + ([F.col("id_tienda")] if by_store else [])
    return daily.groupBy(*keys).agg(F.sum("n_transacciones").alias("n_transacciones"))


def peak_days_long(daily: DataFrame, with_year: bool = False) -> DataFrame:
    """Σ transactions per (weekday, ISO week[, ISO year])."""
    keys = ["dia_semana", "semana"]
    if with_year:
        daily = daily.withColumn("anio_iso", F.year(F.date_add(F.col("fecha"), 3 - F.col("dia_semana"))))
        keys = ["anio_iso"] + keys
    return daily.groupBy(*keys).agg(F.sum("n_transacciones").alias("n_transacciones"))


def peak_days_pivot(daily: DataFrame) -> DataFrame:
    """Weekday x ISO-week matrix of Σ transactions, gaps as 0 (weeks of all years add up).

    Spark finds the pivot values itself; ISO week numbers are a fixed 1..53 domain."""
    return (daily.groupBy("dia_semana").pivot("semana")
            .agg(F.sum("n_transacciones")).na.fill(0))


# ------------------------------------------------------------------ distributions

def describe_features(customers: DataFrame, features=FEATURES) -> DataFrame:
    """count, mean, sample std, min, quartiles (exact, linear), max; 2 dp; one row per feature.

    Exact percentiles keep one counter per distinct value, which for these integer
    count features is small."""
    aggs = []
    for f in features:
        c = F.col(f)
        aggs += [F.count(c).alias(f"{f}__count"), F.avg(c).alias(f"{f}__mean"),
                 F.stddev_samp(c).alias(f"{f}__std"), F.min(c).alias(f"{f}__min"),
                 F.percentile(c, 0.25).alias(f"{f}__q1"), F.percentile(c, 0.5).alias(f"{f}__median"),
                 F.percentile(c, 0.75).alias(f"{f}__q3"), F.max(c).alias(f"{f}__max")]
    wide = customers.agg(*aggs)
    stats = ["mean", "std", "min", "q1", "median", "q3", "max"]
    rows = F.array(*[
        F.struct(F.lit(f).alias("variable"), F.col(f"{f}__count").cast("long").alias("count"),
                 *[round_even(F.col(f"{f}__{s}").cast("double"), 2).alias(s) for s in stats])
        for f in features])
    return wide.select(F.inline(rows))


def box_stats(customers: DataFrame, variable: str) -> DataFrame:
    """Per main store, after dropping rows above the global 99th percentile:
    quartiles, 1.5·IQR fences, whisker ends and outlier count."""
    v = F.col(variable)
    p99 = customers.select(F.percentile(v, 0.99)).scalar()
    kept = customers.filter(v <= p99).select("id_tienda", v.cast("double").alias("v"))
    q = (kept.groupBy("id_tienda")
         .agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.25).alias("q1"),
              F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.75).alias("q3"))
         .withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    inner = (kept.join(checked_broadcast(q.select("id_tienda", "lo_fence", "hi_fence")), "id_tienda")
             .groupBy("id_tienda")
             .agg(F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("whisker_lo"),
                  F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("whisker_hi"),
                  F.count(F.when((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence")),
                                 F.lit(1))).alias("n_outliers")))
    cols = ["q1", "median", "q3", "lo_fence", "hi_fence", "whisker_lo", "whisker_hi"]
    return (q.join(inner, "id_tienda")
            .select("id_tienda", F.col("n").cast("long").alias("n"),
                    *[round_even(F.col(c), 4).alias(c) for c in cols], "n_outliers"))


def correlation_matrix(customers: DataFrame, features=FEATURES, digits: int = 6) -> DataFrame:
    """Pearson correlation of every feature pair, long form (var_x, var_y, corr)."""
    pairs = [(a, b) for a in features for b in features]
    wide = customers.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                              round_even(F.col(f"{a}__{b}"), digits).alias("corr")) for a, b in pairs])
    return wide.select(F.inline(rows))


# ------------------------------------------------------------------ report figures

def dataset_profile(flat: DataFrame) -> DataFrame:
    """R1. Everything but the customers comes from one small pre-aggregate (products by
    store), the customers from one distinct count: no Expand over the items."""
    cells = (flat.groupBy("id_producto", "nombre_categoria", "id_tienda")
             .agg(F.count(F.lit(1)).alias("n"), F.min("fecha").alias("lo"), F.max("fecha").alias("hi")))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        flat.agg(F.countDistinct("id_cliente")).scalar().alias("n_clientes"),
        F.countDistinct("id_producto").alias("n_productos"),
        F.countDistinct("nombre_categoria").alias("n_categorias"),
        F.countDistinct("id_tienda").alias("n_tiendas"),
        F.min("lo").alias("fecha_min"), F.max("hi").alias("fecha_max"))


def store_profile(flat: DataFrame) -> DataFrame:
    """Items, share of all items (%, 2 dp) and distinct customers per store."""
    per = flat.groupBy("id_tienda").agg(F.count(F.lit(1)).alias("n_items"),
                                        F.countDistinct("id_cliente").alias("n_clientes"))
    share = F.col("n_items").cast("double") / F.sum("n_items").over(_whole()).cast("double") * 100.0
    return per.select("id_tienda", "n_items", round_even(share, 2).alias("pct_items"), "n_clientes")


def category_share(flat: DataFrame) -> DataFrame:
    per = category_counts(flat, ordered=False)
    share = F.col("frecuencia").cast("double") / F.sum("frecuencia").over(_whole()).cast("double") * 100.0
    return per.select("nombre_categoria", "frecuencia", round_even(share, 2).alias("pct_items"))


def daily_peak(daily: DataFrame) -> DataFrame:
    """Mean and max of daily transactions (all stores) and the peak day (earliest on ties)."""
    per = daily.groupBy("fecha").agg(F.sum("n_transacciones").alias("t"))
    return per.agg(round_even(F.avg("t"), 2).alias("mean_trans_dia"),
                   F.max("t").cast("long").alias("max_trans_dia"),
                   F.max_by("fecha", F.struct(F.col("t"), -F.unix_date("fecha"))).alias("fecha_pico"))


def basket_size_stats(flat: DataFrame) -> DataFrame:
    """Mean and median items per basket (day, store, customer)."""
    sizes = flat.groupBy("fecha", "id_tienda", "id_cliente").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_baskets"),
                     round_even(F.avg("n"), 2).alias("mean_basket"),
                     round_even(F.percentile("n", 0.5), 2).alias("median_basket"))


def items_by_weekday(flat: DataFrame) -> DataFrame:
    """R6 + F12: items per weekday with the day's short name, most items first."""
    return (flat.groupBy("dia_semana").agg(F.count(F.lit(1)).alias("n_items"))
            .withColumn("dia", day_name(F.col("dia_semana")))
            .orderBy(F.desc("n_items")))


def transactions_by_month(daily: DataFrame) -> DataFrame:
    """R7 + F12: transactions per month with the month's short name."""
    return (daily.groupBy("mes").agg(F.sum("n_transacciones").alias("n_transacciones"))
            .withColumn("mes_nombre", month_name(F.col("mes"))).orderBy("mes"))
