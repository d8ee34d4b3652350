"""ETL registry of processed files (S9–S12, J4) kept as a Parquet table next to the
processed tables: one row per (file_name, processed_at, rows, rejected), also for files
that brought no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.schemas import ETL_REGISTRY
from trolley.sources.files import load_optional
from trolley.sources.versions import Version

REGISTRY = "_registry"


def load_registry(spark: SparkSession, base: str) -> DataFrame:
    """The registry, empty when none was written yet."""
    return load_optional(spark, base, REGISTRY, ETL_REGISTRY)


def list_files(spark: SparkSession, landing_dir: str, glob: str = "*.csv") -> DataFrame:
    """(path, file_name) of the landing files; only file metadata is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(landing_dir)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name")))


def discover_new_files(spark: SparkSession, landing_dir: str, registry: DataFrame) -> DataFrame:
    """S9 + J4: landing files whose base name is not registered."""
    return list_files(spark, landing_dir).join(registry.select("file_name"), "file_name", "left_anti")


def store_prefix(file_name) -> F.Column:
    """the store id a file name starts with ('102_Tran.csv' -> 102), else null."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.nullif(F.regexp_extract(c, r"^(\d+)_", 1), F.lit("")).try_cast("int")


def registry_rows(files: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for every file read, with the items it holds (repeats and rows that are
    stored already included) and the lines rejected; 0 for files without lines."""
    return (files.select("file_name").distinct().join(stats, "file_name", "left")
            .select("file_name", F.current_timestamp().alias("processed_at"),
                    F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                    F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected")))


def register_files(v: Version, rows: DataFrame) -> None:
    """Append to the registry, published together with the tables of the run."""
    v.append(REGISTRY, rows.select(*ETL_REGISTRY.fieldNames()), merge=lambda parts: v.load(REGISTRY, ETL_REGISTRY))


def etl_status(registry: DataFrame) -> DataFrame:
    """Processed files (sorted), last update, number of files."""
    return registry.agg(F.array_sort(F.collect_set("file_name")).alias("processed_files"),
                        F.max("processed_at").alias("last_updated"),
                        F.countDistinct("file_name").alias("n_files"))


# Layout of a registry kept as one JSON document:
# {"processed_files": {name: {"processed_at": iso-time, "rows": n}}, "last_updated": iso-time}


def _read_small_text(spark: SparkSession, path: str) -> str:
    """Whole text of one small file through the Hadoop FileSystem API (any URI scheme).
    Spark's file sources skip names starting with '_', which registry documents use."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(hpath)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def import_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows from a JSON registry document (migration into the registry table).
    The document holds one entry per processed file, so it is read as file metadata."""
    import json
    doc = json.loads(_read_small_text(spark, path))
    rows = [(name, str(e.get("processed_at")), int(e.get("rows", 0)), int(e.get("rejected", 0)))
            for name, e in (doc.get("processed_files") or {}).items()]
    df = spark.createDataFrame(rows, "file_name string, processed_at string, rows bigint, rejected bigint")
    return df.withColumn("processed_at", F.to_timestamp("processed_at"))


def registry_document(registry: DataFrame) -> DataFrame:
    """The registry as one JSON document (one row, column ``doc``). The registry holds one
    row per processed file — file metadata, not data rows."""
    ts = F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    latest = registry.groupBy("file_name").agg(F.max_by(F.struct(ts.alias("processed_at"), "rows", "rejected"),
                                                        "processed_at").alias("entry"))
    return latest.agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("file_name", "entry")))
                           .alias("processed_files"),
                           F.max("entry.processed_at").alias("last_updated"))).alias("doc"))
