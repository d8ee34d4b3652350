"""File sources and sinks (S1–S8, S13, S14, S17): pipe-delimited transaction files,
catalog files and the processed Parquet tables. Schemas are always declared."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trolley import schemas as S
from trolley.operators.transform import add_calendar
from trolley.sources import versions

CORRUPT = "_corrupt"
TABLE_SCHEMAS = {
    "transactions_flat": S.TRANSACTIONS_FLAT,
    "customer_features": S.CUSTOMER_FEATURES,
    "daily_summary": S.DAILY_SUMMARY,
    "product_freq": S.PRODUCT_FREQ,
}


def lines_to_columns(text: DataFrame) -> DataFrame:
    """Split ``value`` lines on '|' into the four raw columns; ``line`` is the text, also in
    ``_corrupt`` if the field count is another. Blank lines are skipped (as CSV readers do)."""
    parts = F.split(F.col("value"), r"\|", -1)
    ok = F.size(parts) == 4
    return (text.filter(F.trim("value") != "")
            .select(*[F.when(ok | (F.size(parts) > i), parts[i]).alias(name)
                      for i, name in enumerate(["fecha", "id_tienda", "id_cliente", "basket_raw"])],
                    F.when(~ok, F.col("value")).alias(CORRUPT), F.col("value").alias("line"), "file_name"))


def read_raw_lines(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """Transaction files as raw string columns plus ``file_name`` and the corrupt-line text.

    The lines are read with the text source and split here, so the field count is
    checked on every line whatever columns a later action needs. ``paths`` is a
    directory (every ``*.csv`` in it) or a list of files. A missing path raises
    ``FileNotFoundError`` (S1)."""
    reader = spark.read
    if isinstance(paths, str):
        reader = reader.option("pathGlobFilter", glob)
        paths = [paths]
    paths = list(paths)
    if not paths:
        raise FileNotFoundError("no transaction files given")
    try:
        text = reader.text(paths)
    except AnalysisException as e:  # path does not exist
        raise FileNotFoundError(str(e)) from e
    return lines_to_columns(text.select("value", F.col("_metadata.file_name").alias("file_name")))


def tokens_of(basket: str = "basket_raw") -> F.Column:
    """Product tokens of a basket text; a blank basket has one empty token."""
    return F.split(F.trim(F.coalesce(F.col(basket), F.lit(""))), r"\s+")


def plain_basket(basket: str = "basket_raw") -> F.Column:
    """Is the basket made of spaces and of at most 18 digits a token? Then every token is an integer,
    which one search of the text shows; other baskets are looked at token by token."""
    return F.coalesce(~F.col(basket).rlike("[^0-9 ]|[0-9]{19}"), F.lit(False))


def line_reason() -> F.Column:
    """Why a line is not (wholly) usable: ``columns`` (another field count), ``key`` (date or
    ids do not parse), ``product`` (a token is no integer; the others are used), else null."""
    bad_key = (F.expr("try_to_date(trim(fecha), 'yyyy-MM-dd')").isNull()
               | F.expr("try_cast(trim(id_tienda) AS INT)").isNull()
               | F.expr("try_cast(trim(id_cliente) AS BIGINT)").isNull())
    bad_token = F.when(plain_basket(), F.lit(False)).otherwise(F.exists(tokens_of(), lambda t: (t != "") & t.try_cast("long").isNull()))
    return (F.when(F.col(CORRUPT).isNotNull(), F.lit("columns")).when(bad_key, F.lit("key"))
            .when(bad_token, F.lit("product")))


def rejects(lines: DataFrame) -> DataFrame:
    """(file_name, line, reason) of every line that is not wholly usable."""
    return lines.select("file_name", "line", line_reason().alias("reason")).filter("reason is not null")


def file_stats(lines: DataFrame) -> DataFrame:
    """Per file: ``rows`` (items its usable lines and tokens give, repeats counted) and
    ``rejected`` (lines that are not wholly usable)."""
    count = F.when(F.trim("basket_raw") == "", F.lit(0)).otherwise(F.size(tokens_of()))
    good = (F.when(plain_basket(), count)
            .otherwise(F.size(F.filter(tokens_of(), lambda t: t.try_cast("long").isNotNull()))).cast("long"))
    usable = F.col("reason").isNull() | (F.col("reason") == "product")
    return (lines.withColumn("reason", line_reason()).groupBy("file_name")
            .agg(F.coalesce(F.sum(F.when(usable, good)), F.lit(0)).alias("rows"), F.count("reason").alias("rejected")))


def typed_transactions(lines: DataFrame) -> DataFrame:
    """transactions_raw: parsed columns of the lines whose fields, date and ids parse; the
    other lines are in ``rejects``."""
    typed = lines.select(
        F.expr("try_to_date(trim(fecha), 'yyyy-MM-dd')").alias("fecha"),
        F.expr("try_cast(trim(id_tienda) AS INT)").alias("id_tienda"),
        F.expr("try_cast(trim(id_cliente) AS BIGINT)").alias("id_cliente"),
        F.col("basket_raw"), F.col("file_name"), F.col(CORRUPT))
    return (typed.filter(F.col(CORRUPT).isNull() & F.col("fecha").isNotNull()
                         & F.col("id_tienda").isNotNull() & F.col("id_cliente").isNotNull())
            .drop(CORRUPT))


def read_transactions(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """(fecha, id_tienda, id_cliente, basket_raw, file_name)."""
    return typed_transactions(read_raw_lines(spark, paths, glob))


def validate(lines: DataFrame) -> DataFrame:
    """S13 over every line (not only the first five): per file, lines, lines with a wrong
    column count, bad date/ids, bad product tokens, and valid lines."""
    reason = F.col("reason")
    return (lines.withColumn("reason", line_reason()).groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.count(F.when(reason == "columns", 1)).alias("n_wrong_columns"),
                 F.count(F.when(reason == "key", 1)).alias("n_bad_keys"),
                 F.count(F.when(reason == "product", 1)).alias("n_bad_products"),
                 F.count(F.when(reason.isNull(), 1)).alias("n_valid"))
            .withColumn("valid_name", F.col("file_name").endswith(".csv"))
            .withColumn("store_prefix", F.nullif(F.regexp_extract("file_name", r"^(\d+)_", 1), F.lit(""))
                        .try_cast("int"))
            # an upload is accepted when named *.csv and every line has exactly four fields
            .withColumn("accepted", F.col("valid_name") & (F.col("n_wrong_columns") == 0)))


def preview_file(spark: SparkSession, path: str, n: int = 10):
    """(first ``n`` lines, line count, column count of the first line)."""
    text = spark.read.text(path)
    head = text.limit(n)
    stats = text.agg(F.count(F.lit(1)).alias("n_lines"),
                     F.max(F.size(F.split("value", r"\|"))).alias("n_columns"))
    return head, stats


def _line_order() -> list[F.Column]:
    """Order of a catalog's lines: path of the file, block of the file, line of the block.
    (Row ids alone follow the splits, of which Spark packs the large ones first.)"""
    return [F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("i")).alias("_line")]


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``cat_id|cat_name`` with or without a header line; names trimmed; for a
    repeated id the last line wins (W7), files in path order."""
    raw = spark.read.schema("cat_id string, cat_name string").option("sep", "|").csv(path)
    typed = (raw.select(F.expr("try_cast(trim(cat_id) AS INT)").alias("cat_id"),
                        F.trim("cat_name").alias("cat_name"), *_line_order())
             .filter(F.col("cat_id").isNotNull()))
    return typed.groupBy("cat_id").agg(F.max_by("cat_name", "_line").alias("cat_name"))


def read_product_category(spark: SparkSession, path: str) -> DataFrame:
    """Header line, two integer columns taken by position; last line wins per product,
    files in path order."""
    raw = (spark.read.option("sep", "|").option("header", "true").csv(path))
    first, second = raw.columns[:2]
    typed = raw.select(F.col(first).try_cast("long").alias("prod_id"),
                       F.col(second).try_cast("int").alias("cat_id"), *_line_order()).filter(F.col("prod_id").isNotNull())
    return typed.groupBy("prod_id").agg(F.max_by("cat_id", "_line").alias("cat_id"))


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A processed table of the newest published version, with its declared schema
    (storage-only partition columns, such as the year-month, are dropped)."""
    return _load(spark, base, versions.manifest(spark, base), name)


def _load(spark: SparkSession, base: str, manifest: dict, name: str) -> DataFrame:
    if name not in manifest["tables"]:
        raise FileNotFoundError(f"no table {name} under {base}")
    return versions.read(spark, base, versions.folders(manifest["tables"], name), TABLE_SCHEMAS[name])


def has_table(spark: SparkSession, base: str, name: str) -> bool:
    return name in versions.manifest(spark, base)["tables"]


def load_optional(spark: SparkSession, base: str, name: str, schema) -> DataFrame:
    """The table, or an empty frame with ``schema`` when there is none."""
    return versions.read(spark, base, versions.folders(versions.manifest(spark, base)["tables"], name), schema)


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """S5 + S6: the four processed tables and the optional rules table, all of one version."""
    of = versions.manifest(spark, base)
    out = {name: _load(spark, base, of, name) for name in TABLE_SCHEMAS}
    out["association_rules"] = versions.read(spark, base, versions.folders(of["tables"], "association_rules"), S.ASSOCIATION_RULES)
    return out


# Layout of the stored flat table: month and store directories, dates clustered inside them.
FLAT_PARTITIONS = ["periodo", "id_tienda"]
FLAT_CLUSTER = ["periodo", "id_tienda", "fecha"]


def month_key(fecha: str = "fecha") -> F.Column:
    return F.date_format(fecha, "yyyy-MM")


def in_ranges(df: DataFrame) -> DataFrame:
    """Rows with their month, laid out by ranges of month, store and date."""
    return df.withColumn("_month", F.trunc("fecha", "MM")).repartitionByRange("_month", "id_tienda", "fecha")


def append_flat(v: versions.Version, df: DataFrame, distinct: bool = False, ranged: bool = False) -> None:
    """Add items to the flat table, stored by month and store.

    Rows are range-partitioned on month, store and date (Spark samples the key range, so a
    store that holds a third of all rows is split by date over many tasks) and sorted within
    each task: a task writes few, date-contiguous files inside one store's folder, whose
    min/max statistics let date filters skip files and row groups. What follows from the date is
    not shuffled but worked out again behind it. ``distinct`` leaves one row of equal items, which
    are in one range; ``ranged`` rows come from ``in_ranges`` and are where they belong."""
    def keyed(x: DataFrame, distinct: bool = False, ranged: bool = False) -> DataFrame:
        x = x if ranged else in_ranges(x.select(*S.FLAT_KEYS, "nombre_categoria"))
        x = x.select("_month", *S.FLAT_KEYS, "nombre_categoria")
        x = x.distinct() if distinct else x
        return add_calendar(x).select(*S.TRANSACTIONS_FLAT.fieldNames(), month_key().alias("periodo")).sortWithinPartitions(*FLAT_CLUSTER)
    v.append("transactions_flat", keyed(df, distinct, ranged), by=FLAT_PARTITIONS,
             merge=lambda parts: keyed(v.load("transactions_flat", S.TRANSACTIONS_FLAT, parts)))


def store_flat(df: DataFrame, base: str) -> None:
    """The flat table alone, as a new version of the tables under ``base``."""
    v = versions.Version(df.sparkSession, base, fresh=True)
    append_flat(v, df)
    v.commit()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as one small frame."""
    parts = [df.select(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
