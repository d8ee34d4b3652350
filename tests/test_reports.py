import datetime as dt

from trolley.operators import tables as TB
from trolley.plans import reports as RP

SCHEMA = ("fecha date, id_tienda int, id_cliente long, id_producto long, dia_semana int, semana int, "
          "mes int, nombre_categoria string")


def flat(spark):
    rows = []
    for d in range(1, 15):
        day = dt.date(2013, 1, d)
        for c in range(1, 6):
            rows.append((day, 102 if c % 2 else 103, c, (c * d) % 7, day.weekday(), day.isocalendar()[1],
                         1, f"C{(c * d) % 3}"))
    return spark.createDataFrame(rows, SCHEMA)


def test_executive_summary_bundle(spark):
    f = flat(spark)
    b = RP.executive_summary(f, 102, "2013-01-03", "2013-01-10", n=3)
    try:
        s = b["summary"].first()
        assert s.total_items == 8 * 3 and s.clientes_unicos == 3
        assert b["top_products"].count() == 3 and b["top_customers"].count() == 3
        assert b["daily"].count() == 8 and isinstance(b["daily"].first().fecha, str)
        assert sum(r.frecuencia for r in b["categories"].collect()) == 24
    finally:
        RP.release(b)


def test_analytics_bundle_customer_filter_ignores_dates(spark):
    f = flat(spark)
    cust = TB.customer_features(f)
    b = RP.analytics_bundle(f, cust, 103, "2013-01-01", "2013-01-02", top_n=2)
    try:
        assert b["customer_features"].count() == 2  # customers 2 and 4, whatever the dates
        assert b["category_evolution"].select("nombre_categoria").distinct().count() <= 2
    finally:
        RP.release(b)
