"""Registered queries: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None).

Every query reads the driver tables of ``sf_dir`` whole (through the adapter of
``sources.testdata``), so its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley import schemas as S
from trolley.oracle import q, r
from trolley.operators import tables as TB
from trolley.operators.transform import add_calendar, apply_filters, categorize, explode_baskets, \
    filter_customers_by_store
from trolley.functions.numeric import round_even
from trolley.sources.testdata import retail

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}

# Fixed query parameters used by the filtered queries (store, inclusive date range).
STORE = 103
DATE_FROM = "1996-01-01"
DATE_TO = "1998-12-31"
SQL_FILTER = f"id_tienda = {STORE} AND fecha BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _flat(spark, sf):
    return retail(spark, sf).flat


def _filtered(spark, sf):
    return apply_filters(_flat(spark, sf), STORE, DATE_FROM, DATE_TO)


def round_even_col(c: str, d: int):
    """Column ``c`` rounded half-to-even to ``d`` places, keeping its name."""
    return round_even(F.col(c), d).alias(c)


# ---------------------------------------------------------------- phase 0/1: core tables

@register("top_products_filtered", q(f"""
SELECT id_producto, nombre_categoria, frecuencia_absoluta, n_clientes, pct_clientes FROM (
  SELECT id_producto, nombre_categoria, count(*) AS frecuencia_absoluta,
         count(DISTINCT id_cliente) AS n_clientes,
         {r("CAST(count(DISTINCT id_cliente) AS DOUBLE) / (SELECT count(DISTINCT id_cliente) FROM ff) * 100.0", 2)} AS pct_clientes
  FROM ff GROUP BY id_producto, nombre_categoria)
ORDER BY frecuencia_absoluta DESC, id_producto LIMIT 10""",
    f"ff AS (SELECT * FROM flat WHERE {SQL_FILTER})"))
def top_products_filtered(spark, sf):
    """P1 + A5 + O1: top 10 products of one store and date range."""
    return TB.top_products(_filtered(spark, sf), 10)


@register("transactions_flat", q("SELECT * FROM flat"))
def transactions_flat(spark, sf):
    """Adapter + U3 dedupe + J1 category lookup + F3–F5 calendar."""
    return _flat(spark, sf)


@register("explode_baskets", q("""
SELECT b.fecha, b.id_tienda, b.id_cliente, CAST(t.tok AS BIGINT) AS id_producto
FROM raw b, unnest(string_split(b.basket_raw, ' ')) AS t(tok)""",
    """raw AS (SELECT fecha, id_tienda, id_cliente, string_agg(CAST(id_producto AS VARCHAR), ' ') AS basket_raw
              FROM items GROUP BY fecha, id_tienda, id_cliente)"""))
def explode_baskets_q(spark, sf):
    """Raw basket lines (one per day, store, customer) back to item rows."""
    return explode_baskets(retail(spark, sf).raw)


@register("flat_from_raw", q("SELECT * FROM flat"))
def flat_from_raw(spark, sf):
    """S2 path: raw lines -> explode -> dedupe -> categorise -> calendar == transactions_flat."""
    t = retail(spark, sf)
    items = explode_baskets(t.raw).dropDuplicates(["fecha", "id_tienda", "id_cliente", "id_producto"])
    return add_calendar(categorize(items, t.lookup))


@register("product_lookup", q("""
SELECT p.id_producto,
       CASE WHEN pc.prod_id IS NOT NULL THEN coalesce(c1.cat_name, 'SIN CATEGORIA')
            ELSE coalesce(c2.cat_name, 'SIN CATEGORIA') END AS nombre_categoria
FROM (SELECT prod_id AS id_producto FROM product_category
      UNION SELECT CAST(cat_id AS BIGINT) FROM categories) p
LEFT JOIN product_category pc ON p.id_producto = pc.prod_id
LEFT JOIN categories c1 ON pc.cat_id = c1.cat_id
LEFT JOIN categories c2 ON p.id_producto = c2.cat_id"""))
def product_lookup_q(spark, sf):
    """J1 catalog folding: every catalogued product id and its category name."""
    return retail(spark, sf).lookup


@register("product_freq", q(f"""
SELECT id_producto, nombre_categoria, count(*) AS frecuencia_absoluta,
       count(DISTINCT id_cliente) AS n_clientes,
       {r("CAST(count(DISTINCT id_cliente) AS DOUBLE) / (SELECT count(DISTINCT id_cliente) FROM flat) * 100.0", 2)} AS pct_clientes
FROM flat GROUP BY id_producto, nombre_categoria"""))
def product_freq(spark, sf):
    """A4: product frequency table."""
    return TB.product_freq(_flat(spark, sf))


@register("product_freq_filtered", q(f"""
SELECT id_producto, nombre_categoria, count(*) AS frecuencia_absoluta,
       count(DISTINCT id_cliente) AS n_clientes,
       {r("CAST(count(DISTINCT id_cliente) AS DOUBLE) / (SELECT count(DISTINCT id_cliente) FROM ff) * 100.0", 2)} AS pct_clientes
FROM ff GROUP BY id_producto, nombre_categoria""", f"ff AS (SELECT * FROM flat WHERE {SQL_FILTER})"))
def product_freq_filtered(spark, sf):
    """A5: product frequency over a filtered subset (denominator = subset customers)."""
    return TB.product_freq(_filtered(spark, sf))


_CUSTOMER_FEATURES_CTE = """
cf AS (SELECT id_cliente, count(DISTINCT fecha) AS frecuencia,
              count(DISTINCT id_producto) AS n_productos_distintos, count(*) AS volumen_total,
              count(DISTINCT nombre_categoria) AS n_categorias_distintas
       FROM flat GROUP BY id_cliente),
ms AS (SELECT id_cliente, id_tienda FROM (
         SELECT id_cliente, id_tienda,
                row_number() OVER (PARTITION BY id_cliente ORDER BY count(*) DESC, id_tienda) AS rn
         FROM flat GROUP BY id_cliente, id_tienda) s WHERE rn = 1),
customers AS (SELECT cf.*, ms.id_tienda FROM cf JOIN ms USING (id_cliente))"""


@register("customer_features", q("SELECT * FROM customers", _CUSTOMER_FEATURES_CTE))
def customer_features(spark, sf):
    """A1 + A2 + J3: one row per customer."""
    return TB.customer_features(_flat(spark, sf))


@register("customer_features_by_store",
          q(f"SELECT * FROM customers WHERE id_tienda = {STORE}", _CUSTOMER_FEATURES_CTE))
def customer_features_by_store(spark, sf):
    """Customers by main store (dates are not applied)."""
    return filter_customers_by_store(TB.customer_features(_flat(spark, sf)), STORE)


@register("main_store", q("SELECT id_cliente, id_tienda FROM customers", _CUSTOMER_FEATURES_CTE))
def main_store(spark, sf):
    """Main store per customer, ties to the smallest store id."""
    return TB.main_store(_flat(spark, sf))


_DAILY_CTE = """
daily AS (SELECT fecha, id_tienda, count(DISTINCT id_cliente) AS n_transacciones, count(*) AS n_items,
                 count(DISTINCT id_cliente) AS n_clientes,
                 CAST(isodow(fecha) - 1 AS INTEGER) AS dia_semana, CAST(week(fecha) AS INTEGER) AS semana,
                 CAST(month(fecha) AS INTEGER) AS mes
          FROM flat GROUP BY fecha, id_tienda)"""


@register("daily_summary", q("SELECT * FROM daily", _DAILY_CTE))
def daily_summary(spark, sf):
    """A3 + J2: per day and store."""
    return TB.daily_summary(_flat(spark, sf))


@register("daily_filtered", q(f"""
SELECT strftime(fecha, '%Y-%m-%d') AS fecha, id_tienda, n_transacciones, n_items, n_clientes,
       dia_semana, semana, mes FROM daily WHERE {SQL_FILTER}""", _DAILY_CTE))
def daily_filtered(spark, sf):
    """Daily table under a filter, dates as ISO text."""
    d = apply_filters(TB.daily_summary(_flat(spark, sf), ordered=False), STORE, DATE_FROM, DATE_TO)
    return d.withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


@register("rows_per_store", q("SELECT id_tienda, count(*) AS \"rows\" FROM flat GROUP BY id_tienda"))
def rows_per_store(spark, sf):
    """Rows per store."""
    return TB.rows_per_store(_flat(spark, sf))


# ---------------------------------------------------------------- phase 2: metrics

from trolley.operators import metrics as M  # noqa: E402

_FF = f"ff AS (SELECT * FROM flat WHERE {SQL_FILTER})"
_DAILY_ALL = """
daily AS (SELECT fecha, id_tienda, count(DISTINCT id_cliente) AS n_transacciones, count(*) AS n_items,
                 CAST(isodow(fecha) - 1 AS INTEGER) AS dia_semana, CAST(week(fecha) AS INTEGER) AS semana,
                 CAST(month(fecha) AS INTEGER) AS mes
          FROM flat GROUP BY fecha, id_tienda)"""


def _kpi_sql(src: str) -> str:
    return f"""
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_items,
       CAST(coalesce(sum(t), 0) AS BIGINT) AS total_transacciones,
       (SELECT count(DISTINCT id_cliente) FROM {src}) AS clientes_unicos,
       (SELECT count(DISTINCT nombre_categoria) FROM {src}) AS categorias_activas,
       CASE WHEN coalesce(sum(n), 0) > 1 THEN {r("CAST(coalesce(sum(n) FILTER (WHERE fecha > (SELECT m FROM mid)), 0) - coalesce(sum(n) FILTER (WHERE fecha <= (SELECT m FROM mid)), 0) AS DOUBLE) / CAST(greatest(coalesce(sum(n) FILTER (WHERE fecha <= (SELECT m FROM mid)), 0), 1) AS DOUBLE) * 100.0", 1)} END AS delta_items_pct,
       CASE WHEN coalesce(sum(n), 0) > 1 THEN {r("CAST(coalesce(sum(t) FILTER (WHERE fecha > (SELECT m FROM mid)), 0) - coalesce(sum(t) FILTER (WHERE fecha <= (SELECT m FROM mid)), 0) AS DOUBLE) / CAST(greatest(coalesce(sum(t) FILTER (WHERE fecha <= (SELECT m FROM mid)), 0), 1) AS DOUBLE) * 100.0", 1)} END AS delta_trans_pct
FROM pdt"""


def _kpi_ctes(src: str) -> list[str]:
    return [
        f"""dd AS (SELECT fecha, id_tienda, count(DISTINCT id_cliente) AS t, count(*) AS n FROM {src} GROUP BY fecha, id_tienda)""",
        "pdt AS (SELECT fecha, sum(n) AS n, sum(t) AS t FROM dd GROUP BY fecha)",
        # literal definition of the split date: element n//2 (0-based) of the sorted item dates
        f"""mid AS (SELECT fecha AS m FROM (SELECT fecha, row_number() OVER (ORDER BY fecha) - 1 AS i FROM {src}) s
                WHERE i = (SELECT count(*) FROM {src}) // 2)""",
    ]


@register("summary_kpis", q(_kpi_sql("flat"), *_kpi_ctes("flat")))
def summary_kpis(spark, sf):
    """A6 + A7 on the whole table."""
    return M.summary_kpis(_flat(spark, sf))


@register("summary_kpis_filtered", q(_kpi_sql("ff"), _FF, *_kpi_ctes("ff")))
def summary_kpis_filtered(spark, sf):
    """A6 + A7 under a store/date filter."""
    return M.summary_kpis(_filtered(spark, sf))


@register("category_counts_filtered", q(
    "SELECT nombre_categoria, count(*) AS frecuencia FROM ff GROUP BY nombre_categoria", _FF))
def category_counts_filtered(spark, sf):
    """A8 under a filter."""
    return M.category_counts(_filtered(spark, sf))


@register("category_evolution", q("""
SELECT strftime(CAST(date_trunc('week', fecha) AS DATE), '%Y-%m-%d') AS semana, nombre_categoria,
       count(*) AS frecuencia
FROM flat WHERE nombre_categoria IN (SELECT nombre_categoria FROM top)
GROUP BY 1, 2""", """top AS (SELECT nombre_categoria FROM flat GROUP BY nombre_categoria
                             ORDER BY count(*) DESC, nombre_categoria LIMIT 5)"""))
def category_evolution(spark, sf):
    """A9 + P5 + J5: weekly counts of the top 5 categories."""
    return M.category_evolution(_flat(spark, sf), 5)


@register("category_evolution_filtered", q("""
SELECT strftime(CAST(date_trunc('week', fecha) AS DATE), '%Y-%m-%d') AS semana, nombre_categoria,
       count(*) AS frecuencia
FROM ff WHERE nombre_categoria IN (SELECT nombre_categoria FROM top)
GROUP BY 1, 2""", _FF, """top AS (SELECT nombre_categoria FROM ff GROUP BY nombre_categoria
                             ORDER BY count(*) DESC, nombre_categoria LIMIT 3)"""))
def category_evolution_filtered(spark, sf):
    """A9 under a filter, top 3."""
    return M.category_evolution(_filtered(spark, sf), 3)


@register("category_share_top10", q("""
SELECT nombre_categoria, frecuencia FROM rk WHERE rn <= 10
UNION ALL
SELECT 'Otras' AS nombre_categoria, CAST(sum(frecuencia) AS BIGINT) AS frecuencia FROM rk WHERE rn > 10
HAVING sum(frecuencia) > 0""", """cc AS (SELECT nombre_categoria, count(*) AS frecuencia FROM flat GROUP BY 1)""",
    """rk AS (SELECT *, row_number() OVER (ORDER BY frecuencia DESC, nombre_categoria) AS rn FROM cc)"""))
def category_share_top10(spark, sf):
    """A13 + W3 + U7: top 10 categories and the rest as 'Otras'."""
    return M.category_share_top10(_flat(spark, sf))


@register("top_customers_filtered", q(
    "SELECT id_cliente, count(*) AS total_items FROM ff GROUP BY id_cliente ORDER BY 2 DESC, 1 LIMIT 10", _FF))
def top_customers_filtered(spark, sf):
    """A10 + O2 under a filter."""
    return M.top_customers(_filtered(spark, sf), 10)


@register("top_customers", q(
    "SELECT id_cliente, count(*) AS total_items FROM flat GROUP BY id_cliente ORDER BY 2 DESC, 1 LIMIT 25"))
def top_customers(spark, sf):
    """A10 on the whole table, n = 25."""
    return M.top_customers(_flat(spark, sf), 25)


def _daily(spark, sf):
    return TB.daily_summary(_flat(spark, sf), ordered=False)


@register("time_series_daily", q(
    "SELECT fecha AS periodo, CAST(sum(n_transacciones) AS BIGINT) AS n_transacciones FROM daily GROUP BY fecha",
    _DAILY_ALL))
def time_series_daily(spark, sf):
    """A11, daily, all stores."""
    return M.time_series(_daily(spark, sf), "D", False)


@register("time_series_weekly_by_store", q("""
SELECT CAST(date_trunc('week', fecha) AS DATE) AS periodo, id_tienda,
       CAST(sum(n_transacciones) AS BIGINT) AS n_transacciones
FROM daily GROUP BY 1, 2""", _DAILY_ALL))
def time_series_weekly_by_store(spark, sf):
    """A11, Monday weeks, per store."""
    return M.time_series(_daily(spark, sf), "W", True)


@register("peak_days_long", q("""
SELECT dia_semana, semana, CAST(sum(n_transacciones) AS BIGINT) AS n_transacciones
FROM daily GROUP BY 1, 2""", _DAILY_ALL))
def peak_days_long(spark, sf):
    """A12 in long form."""
    return M.peak_days_long(_daily(spark, sf))


@register("peak_days_pivot", q(
    "SELECT dia_semana, " + ", ".join(
        f'CAST(coalesce(sum(n_transacciones) FILTER (WHERE semana = {k}), 0) AS BIGINT) AS "{k}"'
        for k in range(1, 54)) + " FROM daily GROUP BY dia_semana", _DAILY_ALL))
def peak_days_pivot(spark, sf):
    """A12 weekday x ISO-week matrix with zero fill (all 53 weeks occur in the test data)."""
    return M.peak_days_pivot(_daily(spark, sf))


_FEATS = ["frecuencia", "n_productos_distintos", "volumen_total", "n_categorias_distintas"]


@register("describe_features", q(" UNION ALL ".join(f"""
SELECT '{f}' AS variable, count({f}) AS count, {r(f"avg({f})", 2)} AS mean, {r(f"stddev_samp({f})", 2)} AS std,
       {r(f"CAST(min({f}) AS DOUBLE)", 2)} AS min, {r(f"quantile_cont({f}, 0.25)", 2)} AS q1,
       {r(f"quantile_cont({f}, 0.5)", 2)} AS median, {r(f"quantile_cont({f}, 0.75)", 2)} AS q3,
       {r(f"CAST(max({f}) AS DOUBLE)", 2)} AS max FROM customers""" for f in _FEATS), _CUSTOMER_FEATURES_CTE))
def describe_features(spark, sf):
    """A14 for the four customer features."""
    return M.describe_features(TB.customer_features(_flat(spark, sf)))


@register("box_stats_volumen", q(f"""
SELECT f.id_tienda, CAST(f.n AS BIGINT) AS n, {r("f.q1", 4)} AS q1, {r("f.median", 4)} AS median, {r("f.q3", 4)} AS q3,
       {r("f.lo_fence", 4)} AS lo_fence, {r("f.hi_fence", 4)} AS hi_fence,
       {r("min(k.v) FILTER (WHERE k.v >= f.lo_fence)", 4)} AS whisker_lo,
       {r("max(k.v) FILTER (WHERE k.v <= f.hi_fence)", 4)} AS whisker_hi,
       count(*) FILTER (WHERE k.v < f.lo_fence OR k.v > f.hi_fence) AS n_outliers
FROM f JOIN k ON f.id_tienda = k.id_tienda
GROUP BY f.id_tienda, f.n, f.q1, f.median, f.q3, f.lo_fence, f.hi_fence""", _CUSTOMER_FEATURES_CTE,
    "p AS (SELECT quantile_cont(volumen_total, 0.99) AS p99 FROM customers)",
    "k AS (SELECT id_tienda, CAST(volumen_total AS DOUBLE) AS v FROM customers, p WHERE volumen_total <= p99)",
    """qq AS (SELECT id_tienda, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                    quantile_cont(v, 0.75) AS q3 FROM k GROUP BY id_tienda)""",
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM qq)"))
def box_stats_volumen(spark, sf):
    """A15 + P7 for volumen_total (the customer table is read three times: checkpointed once)."""
    from trolley.session import cut_lineage
    return M.box_stats(cut_lineage(TB.customer_features(_flat(spark, sf))), "volumen_total")


@register("correlation_matrix", q(" UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, {r(f'corr({a}, {b})', 6)} AS corr FROM customers"
    for a in _FEATS for b in _FEATS), _CUSTOMER_FEATURES_CTE))
def correlation_matrix(spark, sf):
    """Pearson matrix of the customer features (long form, 6 dp)."""
    return M.correlation_matrix(TB.customer_features(_flat(spark, sf)))


@register("dataset_profile", q("""
SELECT count(*) AS n_items, count(DISTINCT id_cliente) AS n_clientes, count(DISTINCT id_producto) AS n_productos,
       count(DISTINCT nombre_categoria) AS n_categorias, count(DISTINCT id_tienda) AS n_tiendas,
       min(fecha) AS fecha_min, max(fecha) AS fecha_max FROM flat"""))
def dataset_profile(spark, sf):
    """R1."""
    return M.dataset_profile(_flat(spark, sf))


@register("store_profile", q(f"""
SELECT id_tienda, n_items, {r("CAST(n_items AS DOUBLE) / CAST(sum(n_items) OVER () AS DOUBLE) * 100.0", 2)} AS pct_items,
       n_clientes
FROM (SELECT id_tienda, count(*) AS n_items, count(DISTINCT id_cliente) AS n_clientes FROM flat GROUP BY 1) s"""))
def store_profile(spark, sf):
    """R2 + W6."""
    return M.store_profile(_flat(spark, sf))


@register("category_share", q(f"""
SELECT nombre_categoria, frecuencia,
       {r("CAST(frecuencia AS DOUBLE) / CAST(sum(frecuencia) OVER () AS DOUBLE) * 100.0", 2)} AS pct_items
FROM (SELECT nombre_categoria, count(*) AS frecuencia FROM flat GROUP BY 1) s"""))
def category_share(spark, sf):
    """R3."""
    return M.category_share(_flat(spark, sf))


@register("daily_peak", q(f"""
SELECT {r("avg(t)", 2)} AS mean_trans_dia, CAST(max(t) AS BIGINT) AS max_trans_dia,
       (SELECT fecha FROM pd2 ORDER BY t DESC, fecha LIMIT 1) AS fecha_pico FROM pd2""", _DAILY_ALL,
    "pd2 AS (SELECT fecha, sum(n_transacciones) AS t FROM daily GROUP BY fecha)"))
def daily_peak(spark, sf):
    """R4."""
    return M.daily_peak(_daily(spark, sf))


@register("basket_size_stats", q(f"""
SELECT count(*) AS n_baskets, {r("avg(n)", 2)} AS mean_basket, {r("quantile_cont(n, 0.5)", 2)} AS median_basket
FROM (SELECT fecha, id_tienda, id_cliente, count(*) AS n FROM flat GROUP BY 1, 2, 3) b"""))
def basket_size_stats(spark, sf):
    """R5."""
    return M.basket_size_stats(_flat(spark, sf))


@register("items_by_weekday", q(
    "SELECT dia_semana, count(*) AS n_items, list_extract(['Lun', 'Mar', 'Mié', 'Jue', 'Vie', 'Sáb', 'Dom'], dia_semana + 1) AS dia "
    "FROM flat GROUP BY 1"))
def items_by_weekday(spark, sf):
    """R6."""
    return M.items_by_weekday(_flat(spark, sf))


@register("transactions_by_month", q(
    "SELECT mes, CAST(sum(n_transacciones) AS BIGINT) AS n_transacciones, "
    "list_extract(['Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sep', 'Oct', 'Nov', 'Dic'], mes) AS mes_nombre "
    "FROM daily GROUP BY mes", _DAILY_ALL))
def transactions_by_month(spark, sf):
    """R7."""
    return M.transactions_by_month(_daily(spark, sf))


# ---------------------------------------------------------------- phase 3: baskets and rules

from trolley.operators import rules as RU  # noqa: E402
from trolley.plans.joins import is_bounded  # noqa: E402


def _txt(c: str):
    """Array column as 'a|b|c' text (stable value hash across engines)."""
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), "|").alias(c)


def _rules_txt(df: DataFrame) -> DataFrame:
    return df.select(_txt("antecedents"), _txt("consequents"), "support", "confidence", "lift")


def _part_items(spark, sf, attr: str) -> DataFrame:
    """Basket keys + a part attribute per item (the test data's coarser item universe).

    Parts beyond the bounds of a broadcast are merged: by the size of their files alone Spark would
    broadcast millions of them."""
    part = retail(spark, sf).t("part").select("p_partkey", attr)
    part = F.broadcast(part) if is_bounded(part) else part.hint("merge")
    return (_flat(spark, sf).select("fecha", "id_tienda", "id_cliente", "id_producto")
            .join(part, F.col("id_producto") == F.col("p_partkey"))
            .select("fecha", "id_tienda", "id_cliente", F.col(attr).alias("item")))


def _type_rules(spark, sf, frac=1.0, conf=0.1):
    return RU.compute_association_rules(_part_items(spark, sf, "p_type"), "item",
                                        sample_frac=frac, min_support=0.01, min_confidence=conf)


_SAMPLE_SQL = "substr(md5(concat_ws('|', fecha, id_tienda, id_cliente)), 1, 8) < '{t}'"


def _type_baskets_ctes(frac: float) -> list[str]:
    where = "TRUE" if frac >= 1.0 else _SAMPLE_SQL.format(t=RU.hash_sample_threshold(frac))
    return [
        "ti AS (SELECT f.fecha, f.id_tienda, f.id_cliente, p.p_type AS item FROM flat f JOIN part p ON f.id_producto = p.p_partkey)",
        "bk AS (SELECT fecha, id_tienda, id_cliente, list_sort(list(DISTINCT item)) AS items FROM ti GROUP BY 1, 2, 3)",
        f"bks AS (SELECT * FROM bk WHERE {where})",
        "nb AS (SELECT count(*) AS n FROM bks)",
        "u AS (SELECT list_sort(list(DISTINCT x)) AS all_items FROM (SELECT unnest(items) AS x FROM bks) s)",
        # every subset of the item universe, by bit mask
        """cand AS (SELECT list_filter(all_items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items
                  FROM (SELECT all_items, unnest(range(1, CAST(pow(2, len(all_items)) AS BIGINT))) AS m FROM u) s)""",
        """fi AS (SELECT c.items, count(*) AS freq FROM cand c JOIN bks b ON list_has_all(b.items, c.items)
                GROUP BY c.items HAVING count(*) >= ceil(0.01 * (SELECT n FROM nb)))""",
    ]


def _rules_sql_tail(conf: float) -> tuple[str, list[str]]:
    ctes = [
        # antecedent = any proper non-empty frequent subset of a frequent itemset
        """sp AS (SELECT x.freq, a.items AS antecedents, a.freq AS afreq,
                       list_filter(x.items, lambda e: NOT list_contains(a.items, e)) AS consequents
                FROM fi x JOIN fi a ON len(a.items) < len(x.items) AND list_has_all(x.items, a.items))""",
        """rl AS (SELECT sp.antecedents, sp.consequents, sp.freq, c.freq AS cfreq,
                       CAST(sp.freq AS DOUBLE) / CAST(sp.afreq AS DOUBLE) AS confidence
                FROM sp JOIN fi c ON c.items = sp.consequents)""",
    ]
    select = f"""
SELECT array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents,
       {r("CAST(freq AS DOUBLE) / CAST(n AS DOUBLE)", 10)} AS support, {r("confidence", 10)} AS confidence,
       {r("confidence / (CAST(cfreq AS DOUBLE) / CAST(n AS DOUBLE))", 10)} AS lift
FROM rl, nb WHERE confidence >= {conf}"""
    return select, ctes


def _rules_sql(conf: float, base_ctes: list[str], outer: str | None = None) -> str:
    select, ctes = _rules_sql_tail(conf)
    if outer is None:
        return q(select, *base_ctes, *ctes)
    return q(outer, *base_ctes, *ctes, f"rules AS ({select.strip()})")


@register("baskets_types", q(
    "SELECT fecha, id_tienda, id_cliente, array_to_string(items, '|') AS items FROM bk",
    *_type_baskets_ctes(1.0)[:2]))
def baskets_types(spark, sf):
    """Sorted distinct item set per basket (items = part type)."""
    return RU.baskets(_part_items(spark, sf, "p_type"), "item").select(
        "fecha", "id_tienda", "id_cliente", _txt("items"))


@register("raw_baskets_sampled", q(
    f"""SELECT fecha, id_tienda, id_cliente,
       array_to_string(list_sort(list_distinct(list_transform(string_split(basket_raw, ' '), lambda t: CAST(t AS BIGINT)))), '|') AS items
FROM raw WHERE {_SAMPLE_SQL.format(t=RU.hash_sample_threshold(0.3))}""",
    """raw AS (SELECT fecha, id_tienda, id_cliente, string_agg(CAST(id_producto AS VARCHAR), ' ') AS basket_raw
              FROM items GROUP BY fecha, id_tienda, id_cliente)"""))
def raw_baskets_sampled(spark, sf):
    """A18 + M1: 30 % deterministic sample of raw basket lines as distinct integer sets."""
    return RU.hash_sample(RU.raw_baskets(retail(spark, sf).raw), 0.3).select(
        "fecha", "id_tienda", "id_cliente", _txt("items"))


@register("raw_baskets_exact_sample", q(f"""
SELECT fecha, id_tienda, id_cliente,
       array_to_string(list_sort(list_distinct(list_transform(string_split(basket_raw, ' '), lambda t: CAST(t AS BIGINT)))), '|') AS items
FROM (SELECT *, row_number() OVER (ORDER BY substr(md5(concat_ws('|', fecha, id_tienda, id_cliente)), 1, 15), fecha, id_tienda, id_cliente) AS rn,
             count(*) OVER () AS n FROM raw) s
WHERE rn <= round_even(0.3 * n, 0)""",
    """raw AS (SELECT fecha, id_tienda, id_cliente, string_agg(CAST(id_producto AS VARCHAR), ' ') AS basket_raw
              FROM items GROUP BY fecha, id_tienda, id_cliente)"""))
def raw_baskets_exact_sample(spark, sf):
    """M1: a sample of exactly 30 % of the baskets."""
    return RU.exact_sample(RU.raw_baskets(retail(spark, sf).raw), 0.3).select(
        "fecha", "id_tienda", "id_cliente", _txt("items"))


@register("frequent_itemsets_types", q(
    """SELECT array_to_string(items, '|') AS items, freq,
              CAST(freq AS DOUBLE) / CAST((SELECT n FROM nb) AS DOUBLE) AS support FROM fi""",
    *_type_baskets_ctes(1.0)))
def frequent_itemsets_types(spark, sf):
    """M2: all frequent itemsets (support 0.01) over part-type baskets."""
    # counted, searched and read again for the result: made once
    bk = cut_lineage(RU.baskets(_part_items(spark, sf, "p_type"), "item"))
    return RU.frequent_itemsets(bk, 0.01).select(_txt("items"), "freq", "support")


@register("association_rules_types", _rules_sql(0.1, _type_baskets_ctes(1.0)))
def association_rules_types(spark, sf):
    """M3: all rules incl. multi-item consequents (support 0.01, confidence 0.1)."""
    return _rules_txt(_type_rules(spark, sf))


@register("association_rules_types_sampled", _rules_sql(0.3, _type_baskets_ctes(0.3)))
def association_rules_types_sampled(spark, sf):
    """M1 + M2 + M3 on a 30 % sample of the baskets (support 0.01, confidence 0.3)."""
    return _rules_txt(_type_rules(spark, sf, frac=0.3, conf=0.3))


def _levelwise_ctes(item_sql: str, frac: float, flat_filter: str = "TRUE") -> list[str]:
    """Itemsets of size <= 4 by level-wise self-joins (exact when no 5-itemset is
    frequent, which holds for the item universes used with it)."""
    where = "TRUE" if frac >= 1.0 else _SAMPLE_SQL.format(t=RU.hash_sample_threshold(frac))
    join = "JOIN part p ON f.id_producto = p.p_partkey" if "p." in item_sql else ""
    return [
        f"bi0 AS (SELECT DISTINCT fecha, id_tienda, id_cliente, {item_sql} AS item FROM flat f {join} WHERE {flat_filter})",
        f"bi AS (SELECT * FROM bi0 WHERE {where})",
        "nb AS (SELECT count(*) AS n FROM (SELECT DISTINCT fecha, id_tienda, id_cliente FROM bi) s)",
        "mc AS (SELECT ceil(0.01 * n) AS m FROM nb)",
        "f1 AS (SELECT item AS i1, count(*) AS freq FROM bi GROUP BY item HAVING count(*) >= (SELECT m FROM mc))",
        "p1 AS (SELECT * FROM bi WHERE item IN (SELECT i1 FROM f1))",
        """f2 AS (SELECT a.item AS i1, b.item AS i2, count(*) AS freq FROM p1 a JOIN p1 b
                ON a.fecha = b.fecha AND a.id_tienda = b.id_tienda AND a.id_cliente = b.id_cliente AND a.item < b.item
                GROUP BY 1, 2 HAVING count(*) >= (SELECT m FROM mc))""",
        """f3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS freq FROM p1 a
                JOIN p1 b ON a.fecha = b.fecha AND a.id_tienda = b.id_tienda AND a.id_cliente = b.id_cliente AND a.item < b.item
                JOIN p1 c ON a.fecha = c.fecha AND a.id_tienda = c.id_tienda AND a.id_cliente = c.id_cliente AND b.item < c.item
                GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT m FROM mc))""",
        """f4 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, d.item AS i4, count(*) AS freq FROM p1 a
                JOIN p1 b ON a.fecha = b.fecha AND a.id_tienda = b.id_tienda AND a.id_cliente = b.id_cliente AND a.item < b.item
                JOIN p1 c ON a.fecha = c.fecha AND a.id_tienda = c.id_tienda AND a.id_cliente = c.id_cliente AND b.item < c.item
                JOIN p1 d ON a.fecha = d.fecha AND a.id_tienda = d.id_tienda AND a.id_cliente = d.id_cliente AND c.item < d.item
                GROUP BY 1, 2, 3, 4 HAVING count(*) >= (SELECT m FROM mc))""",
        """fi AS (SELECT [i1] AS items, freq FROM f1 UNION ALL SELECT [i1, i2], freq FROM f2
                UNION ALL SELECT [i1, i2, i3], freq FROM f3 UNION ALL SELECT [i1, i2, i3, i4], freq FROM f4)""",
    ]


@register("association_rules_brands", _rules_sql(0.1, _levelwise_ctes("p.p_brand", 1.0)))
def association_rules_brands(spark, sf):
    """M3 over part-brand baskets (25 items; frequent pairs only at this support)."""
    return _rules_txt(RU.compute_association_rules(_part_items(spark, sf, "p_brand"), "item",
                                                   sample_frac=1.0, min_support=0.01, min_confidence=0.1))


# Fixture of the product rules: products in thirty lines (id modulo 30), so that at the fixed
# support of 0.01 pairs of lines form rules at any size of the test tables.
_LINES = 30
_PRODUCT_CTES = _levelwise_ctes(f"(f.id_producto % {_LINES})", 1.0)
# Rules of the stored tables: single products, sets that at least two baskets hold.
_PAIR_CTES = [c.replace("ceil(0.01 * n)", "2") for c in _levelwise_ctes("f.id_producto", 1.0)]


def _product_line_rules(spark, sf) -> DataFrame:
    items = _flat(spark, sf).select(*S.BASKET_KEYS, (F.col("id_producto") % _LINES).alias("id_producto"))
    return RU.compute_association_rules(items, "id_producto", min_support=0.01, min_confidence=0.05)


@register("association_rules_products", _rules_sql(0.05, _PRODUCT_CTES))
def association_rules_products(spark, sf):
    """M3 over all product baskets, products in thirty lines."""
    return _rules_txt(_product_line_rules(spark, sf))


@register("rules_display", _rules_sql(0.05, _PRODUCT_CTES, """
SELECT array_to_string(list_transform(antecedents, lambda x: concat('P', x)), ', ') AS si_compra,
       array_to_string(list_transform(consequents, lambda x: concat('P', x)), ', ') AS recomendar,
       printf('%.3f', lift) AS lift, printf('%.3f', confidence) AS confianza, printf('%.3f', support) AS soporte FROM rules""")
    .replace("SELECT array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents,", "SELECT antecedents, consequents,"))
def rules_display(spark, sf):
    """rules of products as display texts."""
    return RU.rules_display(_product_line_rules(spark, sf))


_TYPE_RULES = _type_baskets_ctes(1.0)
_RULES_SEL = "SELECT array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents, support, confidence, lift"


def _on_type_rules(outer: str) -> str:
    """Oracle over the type rules (confidence 0.1) kept with list-typed sides."""
    _, ctes = _rules_sql_tail(0.1)
    rules_cte = f"""rules AS (SELECT antecedents, consequents,
        {r("CAST(freq AS DOUBLE) / CAST(n AS DOUBLE)", 10)} AS support, {r("confidence", 10)} AS confidence,
        {r("confidence / (CAST(cfreq AS DOUBLE) / CAST(n AS DOUBLE))", 10)} AS lift
        FROM rl, nb WHERE confidence >= 0.1)"""
    return q(outer, *_TYPE_RULES, *ctes, rules_cte)


_RULE_ORDER_SQL = "ORDER BY lift DESC, confidence DESC, support DESC, antecedents, consequents"


@register("recommend_for_product", _on_type_rules(
    f"{_RULES_SEL} FROM rules WHERE list_contains(antecedents, 'PROMO') {_RULE_ORDER_SQL} LIMIT 10"))
def recommend_for_product(spark, sf):
    """M4 + P6 + O3: best 10 rules whose antecedent holds 'PROMO'."""
    return _rules_txt(RU.recommend_for_product(_type_rules(spark, sf), "PROMO", 10))


@register("recommend_for_products", _on_type_rules(f"""
SELECT product, array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents,
       support, confidence, lift, rank FROM (
  SELECT p.product, r.*, row_number() OVER (PARTITION BY p.product {_RULE_ORDER_SQL}) AS rank
  FROM rules r, (SELECT DISTINCT unnest(antecedents) AS product FROM rules) p
  WHERE list_contains(r.antecedents, p.product)) s WHERE rank <= 3"""))
def recommend_for_products(spark, sf):
    """M4 batch form: best 3 rules per antecedent item."""
    df = RU.recommend_for_products(_type_rules(spark, sf), 3)
    return df.select("product", _txt("antecedents"), _txt("consequents"), "support", "confidence", "lift",
                     F.col("rank").cast("long").alias("rank"))


@register("rule_products", _on_type_rules(
    "SELECT DISTINCT unnest(antecedents) AS id_producto FROM rules"))
def rule_products(spark, sf):
    """Items that occur in some antecedent."""
    return RU.rule_products(_type_rules(spark, sf))


@register("best_rule", _on_type_rules(
    f"SELECT lift, confidence, support FROM rules WHERE list_contains(antecedents, 'SMALL') {_RULE_ORDER_SQL} LIMIT 1"))
def best_rule(spark, sf):
    """The best rule of one item."""
    return RU.best_rule(_type_rules(spark, sf), "SMALL")


@register("rules_profile", _on_type_rules(
    f"SELECT count(*) AS n_rules, {r('avg(lift)', 4)} AS mean_lift, {r('avg(confidence)', 4)} AS mean_confidence FROM rules"))
def rules_profile(spark, sf):
    """Rule count, mean lift and mean confidence."""
    return RU.rules_profile(_type_rules(spark, sf))


@register("top_rules", _on_type_rules(f"{_RULES_SEL} FROM rules {_RULE_ORDER_SQL} LIMIT 10"))
def top_rules(spark, sf):
    """Global best 10 rules by lift."""
    return _rules_txt(RU.top_rules(_type_rules(spark, sf), 10))


# ---------------------------------------------------------------- phase 4: segmentation

from trolley.functions.labels import FEATURE_LABELS, LEVEL_LABELS  # noqa: E402
from trolley.operators import segments as SG  # noqa: E402

SEG_K = 4


def _z(spark, sf):
    from trolley.session import cut_lineage
    cust = cut_lineage(SG.select_features(TB.customer_features(_flat(spark, sf)), _FEATS))
    return SG.standardize(cust, _FEATS)


def _lloyd(spark, sf):
    return SG.lloyd_kmeans(_z(spark, sf), _FEATS, SEG_K)


def _z_ctes() -> list[str]:
    fs = _FEATS
    return [_CUSTOMER_FEATURES_CTE.strip(),
            "mom AS (SELECT " + ", ".join(f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std" for f in fs)
            + " FROM customers)",
            "zc AS MATERIALIZED (SELECT c.id_cliente, " + ", ".join(f"c.{f}" for f in fs) + ", " + ", ".join(
                f"CASE WHEN {f}_std > 0 THEN {r(f'(CAST(c.{f} AS DOUBLE) - {f}_mean) / {f}_std', 6)} ELSE 0.0 END AS z_{f}"
                for f in fs) + " FROM customers c, mom)"]


def _lloyd_ctes(k: int = SEG_K) -> list[str]:
    """Lloyd steps as a recursion over the list of centres, until none moves."""
    fs = _FEATS
    start = "[" + ", ".join("[" + ", ".join(r(f"quantile_cont(z_{f}, {(i + 0.5) / k})", 6) for f in fs) + "]" for i in range(k)) + "]"
    dists = "[" + ", ".join(" + ".join(f"((z_{f} - c[{i + 1}][{j + 1}]) * (z_{f} - c[{i + 1}][{j + 1}]))" for j, f in enumerate(fs)) for i in range(k)) + "]"
    means = "[" + ", ".join("[" + ", ".join(
        f"coalesce({r(f'avg(z_{f}) FILTER (cluster = {i})', 6)}, any_value(c[{i + 1}][{j + 1}]))" for j, f in enumerate(fs)) + "]" for i in range(k)) + "]"
    return [*_z_ctes(), f"""steps AS (
  SELECT 0 AS t, {start} AS c, true AS moved FROM zc
  UNION ALL
  SELECT t + 1, n, n <> c FROM (
    SELECT t, any_value(c) AS c, {means} AS n FROM (
      SELECT t, c, {', '.join(f'z_{f}' for f in fs)}, list_position(d, list_min(d)) - 1 AS cluster
      FROM (SELECT t, c, {', '.join(f'z_{f}' for f in fs)}, {dists} AS d FROM steps, zc WHERE moved AND t < 300) a) b
    GROUP BY t) s)""",
            f"""seg AS (SELECT zc.*, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster, list_min(d) AS dist2
  FROM (SELECT zc.*, {dists} AS d FROM zc, (SELECT c FROM steps ORDER BY t DESC LIMIT 1) f) zc)"""]


def _seg_q(select: str, *extra: str) -> str:
    return q(select, *_lloyd_ctes(), *extra)


@register("standardized_features", q(
    "SELECT id_cliente, " + ", ".join(_FEATS) + ", " + ", ".join(f"z_{f}" for f in _FEATS) + " FROM zc",
    *_z_ctes()))
def standardized_features(spark, sf):
    """P8 + M5: population z-scores (6 dp)."""
    return _z(spark, sf)


@register("kmeans_lloyd", _seg_q(f"SELECT id_cliente, cluster, {r('dist2', 6)} AS dist2, true AS converged FROM seg"))
def kmeans_lloyd(spark, sf):
    """Deterministic k-means (k=4, quantile init, Lloyd steps until no centre moves) —
    label per customer."""
    seg, _ = _lloyd(spark, sf)
    return seg.select("id_cliente", "cluster", round_even_col("dist2", 6), "converged")


@register("kmeans_lloyd_inertia", _seg_q(f"SELECT count(*) AS n, {r('sum(dist2)', 4)} AS inertia FROM seg"))
def kmeans_lloyd_inertia(spark, sf):
    """Inertia (Σ squared distance to the own centre) of the deterministic k-means."""
    seg, _ = _lloyd(spark, sf)
    return seg.agg(F.count(F.lit(1)).alias("n"), round_even(F.sum("dist2"), 4).alias("inertia"))


@register("cluster_stats", _seg_q("SELECT cluster, count(*) AS n_clientes, " + ", ".join(
    f"{r(f'avg(CAST({f} AS DOUBLE))', 2)} AS {f}_mean, {r(f'quantile_cont(CAST({f} AS DOUBLE), 0.5)', 2)} AS {f}_median"
    for f in _FEATS) + " FROM seg GROUP BY cluster"))
def cluster_stats(spark, sf):
    """Size, mean and median per segment."""
    seg, _ = _lloyd(spark, sf)
    return SG.cluster_stats(seg, _FEATS)


@register("feature_ranges", q(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max FROM customers"
    for f in _FEATS), _CUSTOMER_FEATURES_CTE))
def feature_ranges(spark, sf):
    """Global min / max per feature."""
    return SG.feature_ranges(SG.select_features(TB.customer_features(_flat(spark, sf)), _FEATS), _FEATS)


def _level_sql(mean: str, f: str) -> str:
    lo, hi = f"(SELECT CAST(min({f}) AS DOUBLE) FROM seg)", f"(SELECT CAST(max({f}) AS DOUBLE) FROM seg)"
    labels = "[" + ", ".join(f"'{x}'" for x in LEVEL_LABELS) + "]"
    return (f"CASE WHEN {hi} = {lo} THEN 'moderado' ELSE "
            f"list_extract({labels}, CAST(least(floor(({mean} - {lo}) / ({hi} - {lo}) * 5), 4) AS INTEGER) + 1) END")


@register("segment_interpretation", _seg_q(
    "SELECT cluster, concat_ws(' | ', " + ", ".join(
        f"concat('{FEATURE_LABELS[f]}: ', {_level_sql(f'{f}_mean', f)})" for f in _FEATS)
    + ") AS interpretacion FROM st",
    "st AS (SELECT cluster, " + ", ".join(f"{r(f'avg(CAST({f} AS DOUBLE))', 2)} AS {f}_mean" for f in _FEATS)
    + " FROM seg GROUP BY cluster)"))
def segment_interpretation(spark, sf):
    """M10 + F14 + F15: readable description per segment."""
    seg, _ = _lloyd(spark, sf)
    return SG.interpret_segments(seg, _FEATS)


@register("segment_profile", _seg_q(
    "SELECT cluster, n_clientes, " + r("CAST(n_clientes AS DOUBLE) / CAST(sum(n_clientes) OVER () AS DOUBLE) * 100.0", 2)
    + " AS pct_clientes, " + ", ".join(f"{f}_mean" for f in _FEATS) + " FROM st",
    "st AS (SELECT cluster, count(*) AS n_clientes, " + ", ".join(
        f"{r(f'avg(CAST({f} AS DOUBLE))', 2)} AS {f}_mean" for f in _FEATS) + " FROM seg GROUP BY cluster)"))
def segment_profile(spark, sf):
    """Segment size, share and feature means."""
    seg, _ = _lloyd(spark, sf)
    return SG.segment_profile(seg, _FEATS)


_SEEDS = (1, 2)


def _fits_ctes(ks=tuple(range(2, 9))) -> list[str]:
    """Lloyd steps of all fits (k, seed) as one recursion: seed 0 starts at quantiles, the others
    at the rows with the smallest digests."""
    fs = _FEATS
    point = "[" + ", ".join(f"z_{f}" for f in fs) + "]"
    quantiles = " UNION ALL ".join(
        f"SELECT {k} AS k, 0 AS seed, [" + ", ".join("[" + ", ".join(r(f"quantile_cont(z_{f}, {(i + 0.5) / k})", 6) for f in fs) + "]" for i in range(k))
        + "] AS c FROM zc" for k in ks)
    rows = " UNION ALL ".join(
        f"SELECT k, {s} AS seed, list(p ORDER BY h, id_cliente) AS c FROM (SELECT id_cliente, {point} AS p, md5(concat_ws('|', {s}, id_cliente)) AS h, "
        f"row_number() OVER (ORDER BY md5(concat_ws('|', {s}, id_cliente)), id_cliente) AS rn FROM zc) x, unnest([{', '.join(map(str, ks))}]) AS u(k) WHERE rn <= k GROUP BY k" for s in _SEEDS)
    dist = "list_transform(c, lambda x: " + " + ".join(f"((z_{f} - x[{j + 1}]) * (z_{f} - x[{j + 1}]))" for j, f in enumerate(fs)) + ")"
    means = "[" + ", ".join("[" + ", ".join(
        f"coalesce({r(f'avg(z_{f}) FILTER (cluster = {i})', 6)}, any_value(c[{i + 1}][{j + 1}]))" for j, f in enumerate(fs)) + "]" for i in range(max(ks))) + "]"
    zs = ", ".join(f"z_{f}" for f in fs)
    return [*_z_ctes(), f"starts AS (SELECT * FROM ({quantiles}) q UNION ALL SELECT * FROM ({rows}) w)", f"""steps AS (
  SELECT 0 AS t, k, seed, c, true AS moved FROM starts
  UNION ALL
  SELECT t + 1, k, seed, n, n <> c FROM (
    SELECT t, k, seed, any_value(c) AS c, list_slice({means}, 1, k) AS n FROM (
      SELECT t, k, seed, c, {zs}, list_position(d, list_min(d)) - 1 AS cluster
      FROM (SELECT t, k, seed, c, {zs}, {dist} AS d FROM steps, zc WHERE moved AND t < 300) a) b
    GROUP BY t, k, seed) s)""",
            "final AS (SELECT k, seed, arg_max(c, t) AS c FROM steps GROUP BY k, seed)",
            f"costs AS (SELECT k, seed, any_value(c) AS c, sum(list_min({dist})) AS inertia FROM final, zc GROUP BY k, seed)",
            "best AS (SELECT k, list_sort(arg_min(c, inertia)) AS c, min(inertia) AS inertia FROM costs GROUP BY k)"]


def _fits(spark, sf) -> dict:
    return SG.elbow_fits(_z(spark, sf), _FEATS, seeds=_SEEDS)


@register("elbow_one_scan", q(f"SELECT CAST(k AS INTEGER) AS k, {r('inertia', 2)} AS inercia FROM best", *_fits_ctes()))
def elbow_one_scan(spark, sf):
    """M7: inertia for k = 2..8, the least of three starts each; 21 fits in the scans of one."""
    return SG.elbow_table(spark, _fits(spark, sf))


_BEST3 = ["b3 AS (SELECT c FROM best WHERE k = 3)",
          "lab AS (SELECT zc.*, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster FROM (SELECT zc.*, list_transform(c, lambda x: "
          + " + ".join(f"((z_{f} - x[{j + 1}]) * (z_{f} - x[{j + 1}]))" for j, f in enumerate(_FEATS)) + ") AS d FROM zc, b3) zc)"]


def _best3(spark, sf):
    z = _z(spark, sf)
    fits = SG.elbow_fits(z, _FEATS, k_max=3, seeds=_SEEDS)
    return z, SG.best_fit(fits, 3)


@register("kmeans_best_labels", q("SELECT id_cliente, cluster FROM lab", *_fits_ctes((3,)), *_BEST3))
def kmeans_best_labels(spark, sf):
    """M6 + J9: label per customer of the best of three k=3 fits from stated starts."""
    z, centers = _best3(spark, sf)
    return SG.assign(z, _FEATS, centers).select("id_cliente", "cluster")


@register("kmeans_best_centers", q("SELECT CAST(i - 1 AS INTEGER) AS cluster, " + ", ".join(
    r(f"c[i][{j + 1}] * (SELECT {f}_std FROM mom) + (SELECT {f}_mean FROM mom)", 4) + f" AS {f}" for j, f in enumerate(_FEATS))
    + " FROM b3, unnest(range(1, 4)) AS u(i)", *_fits_ctes((3,)), *_BEST3))
def kmeans_best_centers(spark, sf):
    """M9: centres of that fit in feature units."""
    z, centers = _best3(spark, sf)
    return SG.centers_original_units(z, centers, _FEATS).select("cluster", *[round_even_col(f, 4) for f in _FEATS])


def _pca_ctes(squarings: int = 40) -> list[str]:
    """The two leading eigenvectors of the covariances by repeated squaring: M <- M M / trace
    tends to the projector on the leading one; the second is that of the matrix without it."""
    fs, d = _FEATS, len(_FEATS)
    at = lambda m, i, j: f"{m}[{i * d + j + 1}]"
    cells = [(i, j) for i in range(d) for j in range(d)]
    square = "[" + ", ".join(" + ".join(f"{at('m', i, k)} * {at('m', k, j)}" for k in range(d)) for i, j in cells) + "]"
    trace = lambda m: " + ".join(at(m, i, i) for i in range(d))

    def leading(name: str, source: str) -> list[str]:
        # the column of the projector with the largest diagonal, of length one
        diagonal = "[" + ", ".join(at("m", i, i) for i in range(d)) + "]"
        norm = f"sqrt({' + '.join(f'v[{i + 1}] * v[{i + 1}]' for i in range(d))})"
        return [f"""{name}_p AS (SELECT 0 AS t, m FROM {source}
  UNION ALL SELECT t + 1, list_transform(s, lambda x: x / ({trace('s')})) FROM (SELECT t, {square} AS s FROM {name}_p WHERE t < {squarings}) q)""",
                f"{name}_c AS (SELECT list_slice(m, ({d} * (list_position({diagonal}, list_max({diagonal})) - 1)) + 1, {d} * list_position({diagonal}, list_max({diagonal}))) AS v FROM {name}_p WHERE t = {squarings})",
                f"{name}_n AS (SELECT list_transform(v, lambda x: x / {norm}) AS v FROM {name}_c)",
                # its largest loading is positive
                f"""{name} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM {name}_n)"""]
    cov = "cov AS (SELECT [" + ", ".join(f"covar_samp(z_{fs[i]}, z_{fs[j]})" for i, j in cells) + "] AS m FROM zc)"
    value = " + ".join(f"{at('m', i, j)} * v[{i + 1}] * v[{j + 1}]" for i, j in cells)
    rest = "rest AS (SELECT [" + ", ".join(f"{at('m', i, j)} - lam * v[{i + 1}] * v[{j + 1}]" for i, j in cells) + f"] AS m FROM (SELECT m, v, {value} AS lam FROM cov, e1) q)"
    return [cov, *leading("e1", "cov"), rest, *leading("e2", "rest")]


@register("pca_best_coordinates", q("SELECT id_cliente, cluster, " + ", ".join(
    r(" + ".join(f"z_{f} * {e}.v[{j + 1}]" for j, f in enumerate(_FEATS)), 3) + f" AS {name}" for e, name in (("e1", "pca_x"), ("e2", "pca_y")))
    + " FROM lab, e1, e2", *_fits_ctes((3,)), *_BEST3, *_pca_ctes()))
def pca_best_coordinates(spark, sf):
    """M8 + F22 + J9: 2-D coordinates (3 dp) of the customers with their label."""
    z, centers = _best3(spark, sf)
    coords, _ = SG.pca_2d(SG.assign(z, _FEATS, centers), _FEATS)
    return coords.select("id_cliente", "cluster", round_even_col("pca_x", 3), round_even_col("pca_y", 3))


@register("kmeans_segments")
def kmeans_segments(spark, sf):
    """M6: Spark ML KMeans, k=3 (API default), best of 10 seeds; label per customer (rows-only)."""
    labelled, _, _ = SG.kmeans(_z(spark, sf), _FEATS, 3, n_init=10)
    return labelled.select("id_cliente", "cluster")


@register("kmeans_centers")
def kmeans_centers(spark, sf):
    """M9: centres of the k=3 model in feature units (rows-only)."""
    z = _z(spark, sf)
    _, centers, _ = SG.kmeans(z, _FEATS, 3, n_init=10)
    return SG.centers_original_units(z, centers, _FEATS)


@register("kmeans_elbow")
def kmeans_elbow(spark, sf):
    """M7: inertia for k = 2..8, best of 5 seeds, 100 iterations (rows-only)."""
    return SG.elbow_curve(_z(spark, sf), _FEATS)


@register("pca_coordinates")
def pca_coordinates(spark, sf):
    """M8: 2-D PCA coordinates of the standardized customers with their k=3 label (rows-only)."""
    labelled, _, _ = SG.kmeans(_z(spark, sf), _FEATS, 3, n_init=10)
    coords, _ = SG.pca_2d(labelled, _FEATS)
    return coords.select("id_cliente", "cluster", "pca_x", "pca_y")


# ---------------------------------------------------------------- phase 5: recommender

from trolley.operators import recommend as RC  # noqa: E402

_CC = "cc AS (SELECT id_cliente, nombre_categoria, count(*) AS n FROM flat GROUP BY 1, 2)"
_TGT = "tgt AS (SELECT id_cliente AS t FROM flat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_SIM_CTES = [
    _CC, _TGT,
    "nr AS (SELECT id_cliente, sqrt(sum(n * n)) AS norm FROM cc GROUP BY 1)",
    "tv AS (SELECT nombre_categoria, n AS tn FROM cc WHERE id_cliente = (SELECT t FROM tgt))",
    "dt AS (SELECT c.id_cliente, sum(c.n * v.tn) AS dot FROM cc c JOIN tv v USING (nombre_categoria) GROUP BY 1)",
    """sims AS (SELECT nr.id_cliente,
                CASE WHEN nr.norm * (SELECT norm FROM nr WHERE id_cliente = (SELECT t FROM tgt)) > 0
                     THEN CAST(coalesce(dt.dot, 0) AS DOUBLE) / (nr.norm * (SELECT norm FROM nr WHERE id_cliente = (SELECT t FROM tgt)))
                     ELSE 0.0 END AS sim
         FROM nr LEFT JOIN dt USING (id_cliente) WHERE nr.id_cliente <> (SELECT t FROM tgt))""",
    "nb AS (SELECT * FROM sims ORDER BY sim DESC, id_cliente LIMIT 10)",
]


def _target(counts: DataFrame):
    """The customer with most items (ties: smaller id): one id, resolved once from the
    stored customer x category counts (no extra pass over the item table)."""
    row = RC.top_customers_by_items(counts, 1).first()
    return None if row is None else int(row.id_cliente)


@register("customer_category_counts", q("SELECT * FROM cc", _CC))
def customer_category_counts(spark, sf):
    """A19 (long form): items per customer and category."""
    return RC.customer_category_counts(_flat(spark, sf))


_CATEGORIES = ["SIN CATEGORIA", *(f"CAT_{i}" for i in range(1, 25))]  # of the test catalog


@register("customer_category_matrix", q("SELECT id_cliente, " + ", ".join(
    f"CAST(sum(CASE WHEN nombre_categoria = '{c}' THEN n ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in _CATEGORIES) + " FROM cc GROUP BY id_cliente", _CC))
def customer_category_matrix(spark, sf):
    """A19 (wide form): zero-filled customer x category pivot."""
    return RC.customer_category_matrix(_flat(spark, sf), _CATEGORIES)


@register("neighbours_exact", q(f"SELECT id_cliente, {r('sim', 10)} AS sim FROM nb", *_SIM_CTES))
def neighbours_exact(spark, sf):
    """M12 + J8 + P11 + W4: 10 nearest customers (exact cosine) of the top customer."""
    counts = RC.stored_counts(_flat(spark, sf))
    vec = counts.select("id_cliente", F.col("nombre_categoria").alias("dim"), F.col("n").cast("double").alias("val"))
    nb = RC.nearest_neighbours(RC.cosine_to_target(vec, _target(counts)), 10)
    return nb.select("id_cliente", round_even_col("sim", 10))


@register("recommend_customer_exact", q(f"""
SELECT nombre_categoria AS categoria, {r('score', 4)} AS score FROM (
  SELECT c.nombre_categoria, sum(nb.sim) AS score FROM nb JOIN cc c USING (id_cliente)
  WHERE c.n > 0 AND c.nombre_categoria NOT IN (SELECT nombre_categoria FROM tv)
  GROUP BY 1) s
ORDER BY score DESC, categoria LIMIT 5""", *_SIM_CTES))
def recommend_customer_exact(spark, sf):
    """M13 (exact cosine) + J6 + A25 + W5 for the top customer."""
    flat = _flat(spark, sf)
    counts = RC.stored_counts(flat)
    return RC.recommend_for_customer(flat, _target(counts), 5, 10, method="exact", counts=counts)


@register("recommend_customer_exact_small", q(f"""
SELECT nombre_categoria AS categoria, {r('score', 4)} AS score FROM (
  SELECT c.nombre_categoria, sum(nb.sim) AS score FROM nb JOIN cc c USING (id_cliente)
  WHERE c.n > 0 AND c.nombre_categoria NOT IN (SELECT nombre_categoria FROM tv)
  GROUP BY 1) s
ORDER BY score DESC, categoria LIMIT 5""", *[c.replace("ORDER BY count(*) DESC, 1 LIMIT 1", "ORDER BY count(*), 1 LIMIT 1") for c in _SIM_CTES]))
def recommend_customer_exact_small(spark, sf):
    """M13 (exact cosine) for the customer with fewest items, who lacks many categories."""
    flat = _flat(spark, sf)
    counts = RC.stored_counts(flat)
    target = counts.groupBy("id_cliente").agg(F.sum("n").alias("n")).orderBy("n", "id_cliente").first()["id_cliente"]
    return RC.recommend_for_customer(flat, int(target), 5, 10, method="exact", counts=counts)


@register("recommend_customer_svd")
def recommend_customer_svd(spark, sf):
    """M11 + M13 as the reference: rank-min(50, C-1, N-1) SVD, cosine, 10 neighbours (rows-only)."""
    flat = _flat(spark, sf)
    counts = RC.stored_counts(flat)
    return RC.recommend_for_customer(flat, _target(counts), 5, 10, method="svd", counts=counts)


_BATCH_SQL = q(f"""
SELECT target AS id_cliente, nombre_categoria AS categoria, score, rank FROM (
  SELECT target, nombre_categoria, score,
         row_number() OVER (PARTITION BY target ORDER BY score DESC, nombre_categoria) AS rank
  FROM (SELECT s.target, c.nombre_categoria, {r('sum(s.sim)', 4)} AS score
        FROM nbs s JOIN cc c ON c.id_cliente = s.id_cliente
        WHERE c.n > 0 AND NOT EXISTS (SELECT 1 FROM cc o WHERE o.id_cliente = s.target AND o.nombre_categoria = c.nombre_categoria)
        GROUP BY 1, 2) a) b
WHERE rank <= 5""", _CC,
    "tg AS (SELECT id_cliente AS target FROM flat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)",
    "nr AS (SELECT id_cliente, sqrt(sum(n * n)) AS norm FROM cc GROUP BY 1)",
    """dts AS (SELECT tg.target, c.id_cliente, sum(c.n * t.n) AS dot
              FROM tg JOIN cc t ON t.id_cliente = tg.target JOIN cc c ON c.nombre_categoria = t.nombre_categoria
              WHERE c.id_cliente <> tg.target GROUP BY 1, 2)""",
    """nbs AS (SELECT * FROM (
              SELECT c.target, c.id_cliente,
                     CAST(coalesce(d.dot, 0) AS DOUBLE) / (n1.norm * n2.norm) AS sim,
                     row_number() OVER (PARTITION BY c.target
                                        ORDER BY CAST(coalesce(d.dot, 0) AS DOUBLE) / (n1.norm * n2.norm) DESC,
                                                 c.id_cliente) AS rk
              FROM (SELECT tg.target, nr.id_cliente FROM tg, nr WHERE nr.id_cliente <> tg.target) c
              LEFT JOIN dts d ON d.target = c.target AND d.id_cliente = c.id_cliente
              JOIN nr n1 ON n1.id_cliente = c.id_cliente JOIN nr n2 ON n2.id_cliente = c.target) x
            WHERE rk <= 10)""")


@register("recommend_customers_batch", _BATCH_SQL)
def recommend_customers_batch(spark, sf):
    """Exact recommendations for the 5 customers with most items at once."""
    flat = _flat(spark, sf)
    counts = RC.stored_counts(flat)
    targets = RC.top_customers_by_items(counts, 5).select("id_cliente")
    return RC.recommend_for_customers(flat, targets, 5, 10, counts=counts).withColumn("rank", F.col("rank").cast("long"))


@register("recommend_customers_batch_small", _BATCH_SQL.replace(
    "SELECT id_cliente AS target FROM flat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5",
    "SELECT id_cliente AS target FROM flat GROUP BY 1 ORDER BY count(*), 1 LIMIT 5"))
def recommend_customers_batch_small(spark, sf):
    """The 5 customers with fewest items, in two blocks."""
    flat = _flat(spark, sf)
    counts = RC.stored_counts(flat)
    targets = counts.groupBy("id_cliente").agg(F.sum("n").alias("n")).orderBy("n", "id_cliente").limit(5)
    return (RC.recommend_for_customers(flat, targets, 5, 10, counts=counts, block_rows=3)
            .withColumn("rank", F.col("rank").cast("long")))


_TOP_TARGETS = "SELECT id_cliente AS target FROM flat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5"
_ALL_SQL = _BATCH_SQL.replace(_TOP_TARGETS, "SELECT id_cliente AS target FROM flat GROUP BY 1")


@register("neighbours_all", _ALL_SQL[:_ALL_SQL.index("SELECT target AS id_cliente")]
          + f"SELECT target, id_cliente, {r('sim', 10)} AS sim, rk AS rank FROM nbs")
def neighbours_all(spark, sf):
    """M12 for every customer: pruned exact cosine join."""
    return (RC.all_neighbours(RC.stored_counts(_flat(spark, sf)), 10)
            .select("target", "id_cliente", round_even_col("sim", 10), "rank"))


@register("recommend_customers_all", _ALL_SQL)
def recommend_customers_all(spark, sf):
    """M14 for every customer."""
    return RC.recommend_for_all(RC.stored_counts(_flat(spark, sf)), 5, 10).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- phase 6: files, ETL, streaming

import uuid  # noqa: E402

from trolley.plans import etl as ETL  # noqa: E402
from trolley.plans import incremental  # noqa: E402
from trolley.session import cut_lineage, scratch_path  # noqa: E402
from trolley.sources import files as FS  # noqa: E402
from trolley.sources.versions import Version  # noqa: E402
from trolley.sources import registry_table as RG  # noqa: E402
from trolley.streaming import ingest as ST  # noqa: E402


def _write_catalogs(spark, sf, base: str) -> tuple[str, str]:
    t = retail(spark, sf)
    cat_path, pc_path = base + "/categories", base + "/product_category"
    (t.categories.select(F.col("cat_id").cast("string"), "cat_name")
     .write.mode("overwrite").option("sep", "|").csv(cat_path))
    (t.product_category.select(F.col("prod_id").cast("string"), F.col("cat_id").cast("string"))
     .write.mode("overwrite").option("sep", "|").option("header", "true").csv(pc_path))
    return cat_path, pc_path


# Fixture of the ingest queries: baskets of every 50th customer also come as bad lines (a
# field missing, a date that does not parse, a product token that is no integer).
_BAD = "id_cliente % 50 = 0"


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat_ws("|", F.date_format("fecha", "yyyy-MM-dd"), "id_tienda", "id_cliente", "basket_raw").alias("value"))


def _bad_lines(raw: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.date_format("fecha", "yyyy-MM-dd"), "id_tienda", "id_cliente")
    kinds = F.array(key, F.concat(F.lit("notadate|"), F.concat_ws("|", "id_tienda", "id_cliente", "basket_raw")),
                    F.concat(key, F.lit("|"), "basket_raw", F.lit(" x9z")))
    return raw.filter(_BAD).select(F.explode(kinds).alias("value"))


def _drop_files(lines: DataFrame, landing: str, files: int | None = None) -> None:
    """Add transaction files to a landing directory (empty ones where a part has no line)."""
    lines = lines.repartition(files) if files else lines
    lines.write.mode("append").option("compression", "none").format("text").save(landing + "/incoming")
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(landing).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(landing + "/incoming")):  # a handful of fixture files
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), path(f"{landing}/{name.removesuffix('.txt')}.csv"))
    fs.delete(path(landing + "/incoming"), True)


def _landing(spark, sf) -> tuple[str, list[str]]:
    """Raw lines of the test tables and the bad lines as landing files."""
    base = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    raw = retail(spark, sf).raw
    _drop_files(_lines(raw).unionByName(_bad_lines(raw)), base + "/all")
    return base, [base + "/all"]


@register("csv_ingest_flat", q("SELECT * FROM flat"))
def csv_ingest_flat(spark, sf):
    """S1 + S2 + S3 + S4 + U1: raw lines written as pipe files and catalogs as CSV files,
    read back with declared schemas -> explode -> dedupe -> categorise == transactions_flat."""
    base, dirs = _landing(spark, sf)
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    lookup = ETL.product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    items = ETL.explode_baskets(FS.read_transactions(spark, dirs[0]).drop("file_name")).dropDuplicates(
        ["fecha", "id_tienda", "id_cliente", "id_producto"])
    return add_calendar(categorize(items, lookup))


@register("csv_validate", q(f"""
SELECT count(*) + 3 * count(*) FILTER ({_BAD}) AS n_lines, count(*) FILTER ({_BAD}) AS n_wrong_columns, count(*) FILTER ({_BAD}) AS n_bad_keys,
       count(*) FILTER ({_BAD}) AS n_bad_products, count(*) AS n_valid
FROM (SELECT DISTINCT fecha, id_tienda, id_cliente FROM items) b"""))
def csv_validate(spark, sf):
    """S13 over every line of every file, summed over files."""
    _, dirs = _landing(spark, sf)
    v = FS.validate(FS.read_raw_lines(spark, dirs[0]))
    return v.agg(*[F.sum(c).cast("long").alias(c) for c in
                   ["n_lines", "n_wrong_columns", "n_bad_keys", "n_bad_products", "n_valid"]])


_ETL_RUNS: dict[tuple, str] = {}


def _run_two_step_etl(spark, sf) -> str:
    """Files arrive in one landing directory in three steps: dates before 1998; dates from
    July 1997, so that half a year comes twice, and the bad lines; the year 1995 once more,
    which brings no new row, and an empty file. The ETL runs after each step, picks up only
    the new files, and once more with nothing to do. Run once per session and directory."""
    key = (spark, sf.rstrip("/"))
    if key in _ETL_RUNS:
        return _ETL_RUNS[key]
    base = scratch_path(spark, f"etl-{uuid.uuid4().hex}")
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    landing, out = base + "/landing", base + "/processed"
    raw = cut_lineage(retail(spark, sf).raw)       # read by every step
    steps = [(_lines(raw.filter("fecha < '1998-01-01'")), None),
             (_lines(raw.filter("fecha >= '1997-07-01'")).unionByName(_bad_lines(raw)), None),
             (_lines(raw.filter("year(fecha) = 1995")).repartition(1).unionByName(_lines(raw.limit(0))), {"min_baskets": 2, "min_confidence": 0.05})]
    for lines, params in steps:
        _drop_files(lines, landing)
        if not ETL.run_etl(spark, landing, cat_path, pc_path, out, rules_params=params):
            raise RuntimeError("new files were not picked up")
    if ETL.run_etl(spark, landing, cat_path, pc_path, out):
        raise RuntimeError("a run without new files must return nothing")
    _ETL_RUNS[key] = out
    return out


@register("etl_incremental_flat", q("SELECT * FROM flat"))
def etl_incremental_flat(spark, sf):
    """C4 + S9 + S10 + U2 + U3 + T2: incremental ETL runs over overlapping files == one full load."""
    out = _run_two_step_etl(spark, sf)
    return FS.load_table(spark, out, "transactions_flat")


@register("etl_incremental_customers", q("SELECT * FROM customers", _CUSTOMER_FEATURES_CTE))
def etl_incremental_customers(spark, sf):
    """C5 after the ETL runs: the stored customer_features table."""
    out = _run_two_step_etl(spark, sf)
    return FS.load_table(spark, out, "customer_features")


@register("etl_incremental_products", q(f"""
SELECT id_producto, nombre_categoria, count(*) AS frecuencia_absoluta, count(DISTINCT id_cliente) AS n_clientes,
       {r("CAST(count(DISTINCT id_cliente) AS DOUBLE) / (SELECT count(DISTINCT id_cliente) FROM flat) * 100.0", 2)} AS pct_clientes
FROM flat GROUP BY 1, 2"""))
def etl_incremental_products(spark, sf):
    """C5 after the ETL runs: the stored product_freq table."""
    return FS.load_table(spark, _run_two_step_etl(spark, sf), "product_freq")


@register("etl_incremental_daily", q("SELECT fecha, id_tienda, n_transacciones, n_items, n_clientes, dia_semana, semana, mes FROM daily",
                                     _DAILY_CTE))
def etl_incremental_daily(spark, sf):
    """C5 + T3 after the ETL runs: the daily table, refreshed only for the touched months."""
    out = _run_two_step_etl(spark, sf)
    return FS.load_table(spark, out, "daily_summary")


_FILE_ROWS = f"""(SELECT count(*) FROM items WHERE fecha < DATE '1998-01-01') + (SELECT count(*) FROM items WHERE fecha >= DATE '1997-07-01')
       + (SELECT count(*) FROM items WHERE year(fecha) = 1995) + (SELECT count(*) FROM items WHERE {_BAD})"""


@register("etl_registry_rows", q(f"""
SELECT {_FILE_ROWS} AS "rows", 3 * count(*) FILTER ({_BAD}) AS rejected, CAST(0 AS BIGINT) AS unregistered
FROM (SELECT DISTINCT fecha, id_tienda, id_cliente FROM items) b"""))
def etl_registry_rows(spark, sf):
    """S10 + S18: items and rejected lines the registry holds for all files together, and
    files of the landing directory that are not registered."""
    out = _run_two_step_etl(spark, sf)
    registry = RG.load_registry(spark, out)
    left = RG.discover_new_files(spark, out.removesuffix("/processed") + "/landing", registry)
    return registry.agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected")).withColumn(
        "unregistered", left.select(F.count(F.lit(1))).scalar())


@register("etl_rejects", q(f"""
SELECT unnest(['columns', 'key', 'product']) AS reason, count(*) FILTER ({_BAD}) AS n
FROM (SELECT DISTINCT fecha, id_tienda, id_cliente FROM items) b"""))
def etl_rejects(spark, sf):
    """S2 + F2: lines that were not wholly usable, by reason, as the ETL recorded them."""
    out = _run_two_step_etl(spark, sf)
    return FS.load_optional(spark, out, "rejects", S.REJECTS).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("etl_status", q(f"""
SELECT CAST(4 AS BIGINT) AS min_files, true AS sorted_names, true AS recent, {_FILE_ROWS} AS "rows" """))
def etl_status(spark, sf):
    """S12 + F20: the status figures (at least one file per step; names sorted; the last
    update is now), with the rows of all files."""
    registry = RG.load_registry(spark, _run_two_step_etl(spark, sf))
    names = F.col("processed_files")
    return RG.etl_status(registry).select(
        F.least(F.col("n_files"), F.lit(4)).cast("long").alias("min_files"), (names == F.array_sort(names)).alias("sorted_names"),
        (F.col("last_updated") > F.current_timestamp() - F.expr("interval 1 day")).alias("recent"),
        registry.select(F.sum("rows")).scalar().alias("rows"))


@register("etl_rerun_after_crash", q("SELECT fecha, id_tienda, n_transacciones, n_items, n_clientes, dia_semana, semana, mes FROM daily", _DAILY_CTE))
def etl_rerun_after_crash(spark, sf):
    """C4 + T3: a run dies after its appends and before it publishes them; readers see no table
    of it, and its rerun brings all of them."""
    base, dirs = _landing(spark, sf)
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    out = base + "/processed"
    lookup = ETL.product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    died = Version(spark, out)
    ETL.append_batch(died, ETL.new_items(FS.read_transactions(spark, dirs[0]), lookup))
    incremental.refresh(died)      # and no more
    if FS.has_table(spark, out, "transactions_flat"):
        raise RuntimeError("a run that was not published is seen")
    ETL.run_etl(spark, dirs[0], cat_path, pc_path, out, refresh_rules=False)
    return FS.load_table(spark, out, "daily_summary")


@register("etl_force", q("""
SELECT f.id_tienda, count(*) AS "rows", CAST((SELECT count(*) FROM items WHERE fecha >= DATE '1997-07-01') AS BIGINT) AS registered
FROM flat f WHERE fecha >= DATE '1997-07-01' GROUP BY 1"""))
def etl_force(spark, sf):
    """A forced run over a landing directory with fewer files rebuilds every table and
    the registry from these alone."""
    base = scratch_path(spark, f"force-{uuid.uuid4().hex}")
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    raw, out = retail(spark, sf).raw, base + "/processed"
    _drop_files(_lines(raw.filter("fecha < '1997-07-01'")), base + "/first")
    ETL.run_etl(spark, base + "/first", cat_path, pc_path, out, refresh_rules=False)
    _drop_files(_lines(raw.filter("fecha >= '1997-07-01'")), base + "/second")
    ETL.run_etl(spark, base + "/second", cat_path, pc_path, out, force=True, refresh_rules=False)
    registered = RG.load_registry(spark, out).select(F.sum("rows")).scalar()
    return TB.rows_per_store(FS.load_table(spark, out, "transactions_flat")).withColumn("registered", registered)


@register("catalog_last_wins", q("""
SELECT cat_id, concat('NEW_', cat_name) AS cat_name FROM categories"""))
def catalog_last_wins(spark, sf):
    """S3 + W7: a catalog of two files that repeat every id; the later file name wins, also
    where the earlier file is larger."""
    base = scratch_path(spark, f"catalog-{uuid.uuid4().hex}")
    cats = retail(spark, sf).categories
    old = cats.select(F.concat_ws("|", "cat_id", F.concat(F.lit("OLD_"), "cat_name", F.repeat(F.lit("_"), 500))).alias("value"))
    new = cats.select(F.concat_ws("|", "cat_id", F.concat(F.lit("NEW_"), "cat_name")).alias("value"))
    (old.withColumn("file", F.lit("a")).unionByName(new.withColumn("file", F.lit("b"))).repartition(1).write.partitionBy("file").text(base))
    return FS.read_categories(spark, base).select("cat_id", "cat_name")


@register("file_store_prefix", q("""
SELECT DISTINCT id_tienda AS store_prefix, true AS accepted FROM items"""))
def file_store_prefix(spark, sf):
    """F17 + S13: store prefix of the names of files that are split by store."""
    base = scratch_path(spark, f"stores-{uuid.uuid4().hex}")
    raw = retail(spark, sf).raw
    _drop_files(_lines(raw), base + "/all")
    lines = FS.read_raw_lines(spark, base + "/all").withColumn("file_name", F.concat("id_tienda", F.lit("_Tran.csv")))
    return FS.validate(lines).select("store_prefix", "accepted")


@register("stream_ingest_flat", q("SELECT * FROM flat"))
def stream_ingest_flat(spark, sf):
    """The landing directory as a file stream (availableNow) in two micro-batches whose
    files overlap by half a year, foreachBatch append with key dedupe, derived tables
    refreshed; the stored flat equals the full load."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    raw = retail(spark, sf).raw
    _drop_files(_lines(raw.filter("fecha < '1998-01-01'")), base + "/landing", 1)
    _drop_files(_lines(raw.filter("fecha >= '1997-07-01'")), base + "/landing", 1)
    lookup = ETL.product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    out = base + "/processed"
    query = ST.start_ingest(spark, base + "/landing", lookup, out, base + "/stream-checkpoint", max_files_per_trigger=1)
    query.awaitTermination()
    return FS.load_table(spark, out, "transactions_flat")


@register("stream_late_data", q("SELECT fecha, id_tienda, n_transacciones, n_items, n_clientes, dia_semana, semana, mes FROM daily", _DAILY_CTE))
def stream_late_data(spark, sf):
    """T4: the newer dates arrive first, the older ones in a later micro-batch; the daily
    table holds both."""
    base = scratch_path(spark, f"late-{uuid.uuid4().hex}")
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    lookup = ETL.product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    raw, out = retail(spark, sf).raw, base + "/processed"
    for part in ("fecha >= '1996-01-01'", "fecha < '1996-01-01'"):
        _drop_files(_lines(raw.filter(part)), base + "/landing", 1)
        ST.start_ingest(spark, base + "/landing", lookup, out, base + "/stream-checkpoint").awaitTermination()
    return FS.load_table(spark, out, "daily_summary")


@register("peak_days_by_iso_year", q("""
SELECT CAST(isoyear(fecha) AS INTEGER) AS anio_iso, dia_semana, semana,
       CAST(sum(n_transacciones) AS BIGINT) AS n_transacciones
FROM daily GROUP BY 1, 2, 3""", _DAILY_ALL))
def peak_days_by_iso_year(spark, sf):
    """A12 with the ISO year as a key (X11: weeks of different years kept apart)."""
    return M.peak_days_long(_daily(spark, sf), with_year=True)


@register("top_products_labels", q("""
SELECT id_producto, concat('Prod ', id_producto, ' (', nombre_categoria, ')') AS label, count(*) AS frecuencia_absoluta
FROM flat GROUP BY id_producto, nombre_categoria ORDER BY frecuencia_absoluta DESC, id_producto LIMIT 10"""))
def top_products_labels(spark, sf):
    """O1 + F11: top 10 products with their display label."""
    from trolley.functions.labels import product_label
    top = TB.top_products(_flat(spark, sf), 10)
    return top.select("id_producto", product_label(F.col("id_producto"), F.col("nombre_categoria")).alias("label"),
                      "frecuencia_absoluta")


@register("store_labels", q("SELECT concat('Tienda ', id_tienda) AS label, count(*) AS \"rows\" FROM flat GROUP BY id_tienda"))
def store_labels(spark, sf):
    """F11 + A24: items per store under the store's display label."""
    from trolley.functions.labels import store_label
    return TB.rows_per_store(_flat(spark, sf)).select(store_label(F.col("id_tienda")).alias("label"), "rows")


@register("etl_table_counts", q("""
SELECT 'transactions_flat' AS "table", count(*) AS "rows" FROM flat
UNION ALL SELECT 'customer_features', count(DISTINCT id_cliente) FROM flat
UNION ALL SELECT 'daily_summary', count(*) FROM (SELECT DISTINCT fecha, id_tienda FROM flat) d
UNION ALL SELECT 'product_freq', count(*) FROM (SELECT DISTINCT id_producto, nombre_categoria FROM flat) p
UNION ALL SELECT 'association_rules', (SELECT count(*) FROM rules)
UNION ALL SELECT 'registry_rows', """ + _FILE_ROWS, *_PAIR_CTES,
    *_rules_sql_tail(0.05)[1], f"rules AS ({_rules_sql_tail(0.05)[0].strip()})"))
def etl_table_counts(spark, sf):
    """S5 + S6 + S10 + S17 after the ETL runs: rows per stored table, and the items the
    registry recorded for all files together. The rules follow the stored table (X6)."""
    out = _run_two_step_etl(spark, sf)
    counts = FS.table_counts(FS.load_tables(spark, out))
    reg = RG.load_registry(spark, out).agg(F.lit("registry_rows").alias("table"),
                                           F.sum("rows").cast("long").alias("rows"))
    return counts.unionByName(reg)


@register("csv_preview_stats", q("""
SELECT count(*) + 3 * count(*) FILTER (""" + _BAD + """) AS n_lines, 4 AS n_columns
FROM (SELECT DISTINCT fecha, id_tienda, id_cliente FROM items) b"""))
def csv_preview_stats(spark, sf):
    """Line and column count of the landing files (all lines of every file)."""
    _, dirs = _landing(spark, sf)
    _, stats = FS.preview_file(spark, dirs[0])
    return stats.select(F.col("n_lines").cast("long").alias("n_lines"), F.col("n_columns").cast("int").alias("n_columns"))


def _complete(stream: DataFrame, base: str) -> DataFrame:
    """Run a complete-mode aggregation over what is there; its last result as a table."""
    def write(result: DataFrame, epoch_id: int) -> None:
        result.write.mode("overwrite").parquet(base + "/result")
    query = (stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", base + "/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(base + "/result")


@register("stream_weekly_counts", q("""
SELECT CAST(date_trunc('week', i.fecha) AS DATE) AS semana,
       coalesce(l.nombre_categoria, 'SIN CATEGORIA') AS nombre_categoria, count(*) AS frecuencia
FROM (SELECT * FROM items UNION ALL SELECT * FROM items WHERE """ + _BAD + """) i LEFT JOIN (
  SELECT p.id_producto,
         CASE WHEN pc.prod_id IS NOT NULL THEN coalesce(c1.cat_name, 'SIN CATEGORIA')
              ELSE coalesce(c2.cat_name, 'SIN CATEGORIA') END AS nombre_categoria
  FROM (SELECT prod_id AS id_producto FROM product_category UNION SELECT CAST(cat_id AS BIGINT) FROM categories) p
  LEFT JOIN product_category pc ON p.id_producto = pc.prod_id
  LEFT JOIN categories c1 ON pc.cat_id = c1.cat_id
  LEFT JOIN categories c2 ON p.id_producto = c2.cat_id) l ON i.id_producto = l.id_producto
GROUP BY 1, 2"""))
def stream_weekly_counts(spark, sf):
    """T5: Monday-aligned 7-day event-time windows over the landing file stream (every item
    line, before key dedupe, the usable tokens of bad lines included), complete mode."""
    base, dirs = _landing(spark, sf)
    cat_path, pc_path = _write_catalogs(spark, sf, base)
    lookup = ST.static_lookup(ETL.product_lookup(FS.read_categories(spark, cat_path),
                                                 FS.read_product_category(spark, pc_path)))
    items = ST.stream_items(ST.read_landing_stream(spark, dirs[0]), lookup)
    return _complete(ST.weekly_counts(items), base + "/weekly")


@register("customer_list", q("SELECT DISTINCT id_cliente FROM customers", _CUSTOMER_FEATURES_CTE))
def customer_list(spark, sf):
    """Sorted distinct customer ids of the customer table."""
    return M.customer_list(TB.customer_features(_flat(spark, sf)))


@register("top_customers_chart", q("""
SELECT id_cliente, concat('Cliente ', id_cliente) AS label, count(*) AS total_items
FROM flat GROUP BY id_cliente ORDER BY total_items DESC, id_cliente LIMIT 10"""))
def top_customers_chart(spark, sf):
    """O2 + F11 + O7: top 10 customers labelled, smallest first for bars."""
    return M.top_customers_chart(_flat(spark, sf), 10)


# ---------------------------------------------------------------- the events table as a second source

def _event_items(spark, sf) -> DataFrame:
    """(fecha, user_id, event_type) of every event: baskets are a user's day."""
    ev = retail(spark, sf).t("events").select("ts", "user_id", "event_type")
    return ev.select(F.to_date("ts").alias("fecha"), "user_id", "event_type")


def _bitmask_rules_sql(basket_cte: str, conf: float) -> str:
    """All frequent itemsets by bit-mask enumeration over the item universe of ``bk``,
    then every antecedent/consequent split (same tail as the other rule oracles)."""
    base = [
        basket_cte,
        "bks AS (SELECT * FROM bk)",
        "nb AS (SELECT count(*) AS n FROM bks)",
        "u AS (SELECT list_sort(list(DISTINCT x)) AS all_items FROM (SELECT unnest(items) AS x FROM bks) s)",
        """cand AS (SELECT list_filter(all_items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items
                  FROM (SELECT all_items, unnest(range(1, CAST(pow(2, len(all_items)) AS BIGINT))) AS m FROM u) s)""",
        """fi AS (SELECT c.items, count(*) AS freq FROM cand c JOIN bks b ON list_has_all(b.items, c.items)
                GROUP BY c.items HAVING count(*) >= ceil(0.01 * (SELECT n FROM nb)))""",
    ]
    return _rules_sql(conf, base)


@register("association_rules_events", _bitmask_rules_sql(
    """bk AS (SELECT CAST(ts AS DATE) AS fecha, user_id, list_sort(list(DISTINCT event_type)) AS items
              FROM events GROUP BY 1, 2)""", 0.1))
def association_rules_events(spark, sf):
    """M2 + M3 on the events table: baskets = a user's day, items = event types."""
    return _rules_txt(_events_rules(spark, sf))


def _events_rules(spark, sf):
    return RU.compute_association_rules(_event_items(spark, sf), "event_type", sample_frac=1.0,
                                        min_support=0.01, min_confidence=0.1, keys=["fecha", "user_id"])


@register("stream_events_weekly", q("""
SELECT CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS semana, event_type, count(*) AS n_events,
       round_even(sum(value) * 100.0, 0) / 100.0 AS total_value
FROM events GROUP BY 1, 2"""))
def stream_events_weekly(spark, sf):
    """T1 + T5 on a given table: ``events.parquet`` read as a Parquet file stream,
    Monday-aligned 7-day windows per event type (complete mode)."""
    from trolley.streaming.ingest import event_time
    schema = retail(spark, sf).t("events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", "1").parquet(sf))
    agg = (stream.withColumn("t", event_time(F.to_date("ts")))
           .groupBy(F.window("t", "7 days", "7 days", "4 days").alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("v"))
           .select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("semana"),
                   "event_type", "n_events", round_even(F.col("v"), 2).alias("total_value")))
    return _complete(agg, scratch_path(spark, f"events-stream-{uuid.uuid4().hex}"))


# ---------------------------------------------------------------- reports and stored tables

from trolley.plans import reports as RP  # noqa: E402

_TOP_PRODUCTS_SQL = f"""
SELECT id_producto, nombre_categoria, count(*) AS frecuencia_absoluta, count(DISTINCT id_cliente) AS n_clientes,
       {r("CAST(count(DISTINCT id_cliente) AS DOUBLE) / (SELECT count(DISTINCT id_cliente) FROM {t}) * 100.0", 2)} AS pct_clientes,
       row_number() OVER (ORDER BY count(*) DESC, id_producto) AS pos
FROM {{t}} GROUP BY 1, 2 ORDER BY frecuencia_absoluta DESC, id_producto LIMIT 10"""
_REPORT_SQL = {
    "top_customers": """SELECT id_cliente, count(*) AS total_items, row_number() OVER (ORDER BY count(*) DESC, id_cliente) AS pos
FROM {t} GROUP BY 1 ORDER BY total_items DESC, id_cliente LIMIT 10""",
    "daily": """SELECT strftime(fecha, '%Y-%m-%d') AS fecha, id_tienda, count(DISTINCT id_cliente) AS n_transacciones, count(*) AS n_items,
       count(DISTINCT id_cliente) AS n_clientes, dia_semana, semana, mes, row_number() OVER (ORDER BY d.fecha, id_tienda) AS pos
FROM {t} d GROUP BY d.fecha, id_tienda, dia_semana, semana, mes""",
    "categories": """SELECT nombre_categoria, count(*) AS frecuencia, row_number() OVER (ORDER BY count(*) DESC, nombre_categoria) AS pos
FROM {t} GROUP BY 1""",
    "top_products": _TOP_PRODUCTS_SQL,
    "category_evolution": """SELECT strftime(CAST(date_trunc('week', fecha) AS DATE), '%Y-%m-%d') AS semana, nombre_categoria, count(*) AS frecuencia
FROM {t} WHERE nombre_categoria IN (SELECT nombre_categoria FROM {t} GROUP BY nombre_categoria ORDER BY count(*) DESC, nombre_categoria LIMIT 5)
GROUP BY 1, 2""",
    "customer_features": "SELECT * FROM customers WHERE id_tienda = " + str(STORE),
}


def _placed(df: DataFrame) -> DataFrame:
    """``df`` with its row number in output order (O5-O7), so that the order is checked, too.
    For the small frames of a report only."""
    from pyspark.sql import Window
    return (df.withColumn("i", F.monotonically_increasing_id())
            .withColumn("pos", F.row_number().over(Window.orderBy("i")).cast("long")).drop("i"))


def _report(prefix: str, name: str, build: Callable, filtered: bool) -> None:
    t = "ff" if filtered else "flat"
    if name == "summary":
        sql = q(_kpi_sql(t), *([_FF] if filtered else []), *_kpi_ctes(t))
    else:
        sql = q(_REPORT_SQL[name].replace("{t}", t), *([_FF] if filtered else []), *([_CUSTOMER_FEATURES_CTE] if name == "customer_features" else []))

    def run(spark, sf):
        bundle = build(spark, sf)
        df = cut_lineage(bundle[name])      # small; the persisted items are then let go
        RP.release(bundle)
        return _placed(df) if "pos" in sql else df
    run.__doc__ = f"{prefix}: {name}, {'filtered by store and dates' if filtered else 'whole table'}."
    register(f"{prefix}_{name}", sql)(run)


def _executive(spark, sf):
    return RP.executive_summary(_flat(spark, sf), STORE, DATE_FROM, DATE_TO)


def _stored(spark, sf):
    return RP.stored_summary(FS.load_tables(spark, _run_two_step_etl(spark, sf)))


def _bundle(spark, sf):
    return RP.analytics_bundle(_flat(spark, sf), TB.customer_features(_flat(spark, sf)), STORE, DATE_FROM, DATE_TO)


def _stored_bundle(spark, sf):
    return RP.stored_bundle(FS.load_tables(spark, _run_two_step_etl(spark, sf)), STORE, DATE_FROM, DATE_TO)


def _measured(spark, sf):
    return RP.measured_report(incremental.load_measures(spark, _run_two_step_etl(spark, sf)), STORE, DATE_FROM, DATE_TO)


for _name in ("summary", "daily", "categories", "category_evolution"):
    _report("measured_report", _name, _measured, True)
for _name in ("summary", "top_products", "top_customers", "daily", "categories"):
    _report("executive_summary", _name, _executive, True)
    _report("stored_summary", _name, _stored, False)
for _name in ("daily", "category_evolution", "customer_features"):
    _report("analytics_bundle", _name, _bundle, True)
    _report("stored_bundle", _name, _stored_bundle, True)


@register("segmentation_invariants", q("""
SELECT count(*) AS n_labels, count(DISTINCT id_cliente) AS n_customers, CAST(3 AS BIGINT) AS n_clusters,
       count(*) AS in_stats, true AS inertia_falls, count(*) AS n_points FROM customers""", _CUSTOMER_FEATURES_CTE))
def segmentation_invariants(spark, sf):
    """M6 + M7 + M8 + M15: figures of the segmentation bundle that hold for any start."""
    out = SG.segmentation_result(TB.customer_features(_flat(spark, sf)), k=3, n_init=3)
    curve = [row["inercia"] for row in out["elbow"].orderBy("k").collect()]  # seven numbers
    return out["labels"].agg(
        F.count(F.lit(1)).alias("n_labels"), F.countDistinct("id_cliente").alias("n_customers"),
        F.countDistinct("cluster").alias("n_clusters"), out["stats"].agg(F.sum("n_clientes")).scalar().alias("in_stats"),
        F.lit(all(a >= b for a, b in zip(curve, curve[1:], strict=False))).alias("inertia_falls"),
        out["pca"].agg(F.count("pca_x")).scalar().alias("n_points"))
