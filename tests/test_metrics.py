import datetime as dt

from trolley.operators import metrics as M
from trolley.operators import tables as TB

SCHEMA = ("fecha date, id_tienda int, id_cliente long, id_producto long, dia_semana int, semana int, "
          "mes int, nombre_categoria string")


def flat(spark, rows):
    full = [(d, t, c, p, d.weekday(), d.isocalendar()[1], d.month, cat) for d, t, c, p, cat in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_half_split_upper_median_even(spark):
    d1, d2, d3, d4 = (dt.date(2013, 1, i) for i in (1, 2, 3, 4))
    # 4 items on 4 dates: element 4//2 = 2 -> d3; h1 = 3 items, h2 = 1 item
    f = flat(spark, [(d1, 102, 1, 1, "A"), (d2, 102, 1, 2, "A"), (d3, 102, 2, 1, "B"), (d4, 102, 2, 3, "B")])
    r = M.summary_kpis(f).first()
    assert r.total_items == 4 and r.clientes_unicos == 2 and r.categorias_activas == 2
    assert r.delta_items_pct == round((1 - 3) / 3 * 100, 1)


def test_half_split_single_row_has_no_delta(spark):
    f = flat(spark, [(dt.date(2013, 1, 1), 102, 1, 1, "A")])
    r = M.summary_kpis(f).first()
    assert r.total_items == 1 and r.delta_items_pct is None and r.delta_trans_pct is None


def test_half_split_all_one_date(spark):
    d = dt.date(2013, 1, 1)
    f = flat(spark, [(d, 102, 1, p, "A") for p in range(5)])
    r = M.summary_kpis(f).first()
    assert r.delta_items_pct == -100.0  # everything falls in the first half


def test_top10_plus_rest(spark):
    d = dt.date(2013, 1, 1)
    rows = [(d, 102, i, j, f"C{i:02d}") for i in range(12) for j in range(i + 1)]
    out = {r.nombre_categoria: r.frecuencia for r in M.category_share_top10(flat(spark, rows)).collect()}
    assert len(out) == 11 and out["Otras"] == 1 + 2


def test_main_store_tie_smallest_id(spark):
    d = dt.date(2013, 1, 1)
    f = flat(spark, [(d, 107, 1, 1, "A"), (d, 103, 1, 2, "A")])
    assert TB.main_store(f).first().id_tienda == 103


def test_product_pct_uses_subset_customers(spark):
    d = dt.date(2013, 1, 1)
    f = flat(spark, [(d, 102, 1, 1, "A"), (d, 102, 2, 1, "A"), (d, 102, 3, 2, "A")])
    got = {r.id_producto: r.pct_clientes for r in TB.product_freq(f).collect()}
    assert got == {1: 66.67, 2: 33.33}


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = [1, 2, 2, 3, 7, 9, 10]
    cust = spark.createDataFrame([(i, v, v, v, v) for i, v in enumerate(vals)],
                                 "id_cliente long, frecuencia long, n_productos_distintos long, "
                                 "volumen_total long, n_categorias_distintas long")
    r = M.describe_features(cust).filter("variable = 'frecuencia'").first()
    d = pd.Series(vals).describe()
    assert r["count"] == 7 and r.mean == round(d["mean"], 2) and r.std == round(d["std"], 2)
    assert (r.q1, r.median, r.q3) == (round(d["25%"], 2), round(d["50%"], 2), round(d["75%"], 2))


def test_main_store_ties_and_extreme_ids(spark):
    from trolley.operators import tables as TB
    rows = [(1, 103), (1, 102), (1, 103), (1, 102),          # tie -> smaller store
            (2, 2147483647), (2, -2147483648),               # tie at the int extremes
            (3, 110), (3, 107), (3, 110)]                    # plain majority
    flat = spark.createDataFrame(rows, "id_cliente long, id_tienda int")
    got = {r.id_cliente: r.id_tienda for r in TB.main_store(flat).collect()}
    assert got == {1: 102, 2: -2147483648, 3: 110}
    plan = TB.main_store(flat)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
