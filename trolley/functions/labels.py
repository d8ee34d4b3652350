"""Display labels and text columns."""

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's output text.
FEATURES = ["frecuencia", "n_productos_distintos", "volumen_total", "n_categorias_distintas"]
FEATURE_LABELS = {
    "frecuencia": "Frecuencia de Compra",
    "n_productos_distintos": "Diversidad de Productos",
    "volumen_total": "Volumen Total",
    "n_categorias_distintas": "Diversidad de Categorías",
}
LEVEL_LABELS = ["muy bajo", "bajo", "moderado", "alto", "muy alto"]
DAY_NAMES = ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"]
MONTH_NAMES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
NO_CATEGORY = "SIN CATEGORIA"
OTHER_BUCKET = "Otras"


def level_label(value: Column, lo: Column, hi: Column) -> Column:
    """Equal-width fifth of [lo, hi] holding ``value``; an empty range is the middle level."""
    idx = F.least(F.floor((value - lo) / (hi - lo) * 5), F.lit(4)).cast("int")
    levels = F.array(*[F.lit(x) for x in LEVEL_LABELS])
    return F.when(hi == lo, F.lit(LEVEL_LABELS[2])).otherwise(F.element_at(levels, idx + 1))


def product_label(pid: Column, cat: Column) -> Column:
    return F.format_string("Prod %s (%s)", pid, cat)


def customer_label(cid: Column) -> Column:
    return F.concat(F.lit("Cliente "), cid.cast("string"))


def store_label(store) -> Column:
    """'Tienda 102'."""
    return F.concat(F.lit("Tienda "), store.cast("string"))


def rule_text(items: Column) -> Column:
    """[3, 21] -> 'P3, P21'."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("P"), x.cast("string"))), ", ")


def day_name(dow0: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), dow0 + 1)


def month_name(m: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), m)
