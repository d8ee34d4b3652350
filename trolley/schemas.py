"""Declared schemas of every table the library reads or writes (never inferred)."""

from pyspark.sql import types as T

# A transaction line is fecha|id_tienda|id_cliente|basket ("p1 p2 p3"), without a header.
TRANSACTIONS_RAW = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("id_tienda", T.IntegerType()),
    T.StructField("id_cliente", T.LongType()),
    T.StructField("basket_raw", T.StringType()),
])

TRANSACTIONS_FLAT = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("id_tienda", T.IntegerType()),
    T.StructField("id_cliente", T.LongType()),
    T.StructField("id_producto", T.LongType()),
    T.StructField("dia_semana", T.IntegerType()),
    T.StructField("semana", T.IntegerType()),
    T.StructField("mes", T.IntegerType()),
    T.StructField("nombre_categoria", T.StringType()),
])

CATEGORIES = T.StructType([
    T.StructField("cat_id", T.IntegerType()),
    T.StructField("cat_name", T.StringType()),
])

PRODUCT_CATEGORY = T.StructType([
    T.StructField("prod_id", T.LongType()),
    T.StructField("cat_id", T.IntegerType()),
])

CUSTOMER_FEATURES = T.StructType([
    T.StructField("id_cliente", T.LongType()),
    T.StructField("frecuencia", T.LongType()),
    T.StructField("n_productos_distintos", T.LongType()),
    T.StructField("volumen_total", T.LongType()),
    T.StructField("n_categorias_distintas", T.LongType()),
    T.StructField("id_tienda", T.IntegerType()),
])

DAILY_SUMMARY = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("id_tienda", T.IntegerType()),
    T.StructField("n_transacciones", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("n_clientes", T.LongType()),
    T.StructField("dia_semana", T.IntegerType()),
    T.StructField("semana", T.IntegerType()),
    T.StructField("mes", T.IntegerType()),
])

PRODUCT_FREQ = T.StructType([
    T.StructField("id_producto", T.LongType()),
    T.StructField("nombre_categoria", T.StringType()),
    T.StructField("frecuencia_absoluta", T.LongType()),
    T.StructField("n_clientes", T.LongType()),
    T.StructField("pct_clientes", T.DoubleType()),
])

ASSOCIATION_RULES = T.StructType([
    T.StructField("antecedents", T.ArrayType(T.LongType())),
    T.StructField("consequents", T.ArrayType(T.LongType())),
    T.StructField("support", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("lift", T.DoubleType()),
])

ETL_REGISTRY = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("rows", T.LongType()),
    T.StructField("rejected", T.LongType()),
])

REJECTS = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("reason", T.StringType()),
])

FLAT_KEYS = ["fecha", "id_tienda", "id_cliente", "id_producto"]
BASKET_KEYS = ["fecha", "id_tienda", "id_cliente"]
