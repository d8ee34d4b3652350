"""The incremental ETL job.

run_etl(landing, catalog, out):
  1. registry -> files not yet processed (all files with ``force``); none -> {}
  2. catalogs -> one product->category lookup (broadcast after a size check)
  3. lines -> usable rows and rejects; nothing is dropped without a trace: rejects keep file,
     line and reason, the registry counts them, and ``on_bad="fail"`` stops before any write
  4. lines are laid out by month, store and date, then exploded, categorised and deduped where they
     will be written (``append_lines``)
  5. rows whose key is already stored are removed by an anti-join of the months that the batch
     and the table share; the rest is appended to the flat table, which is stored
     by month and store
  6. derived tables (C5) are raised by the appended rows (``plans.incremental``)
  7. rules over the whole stored table (``refresh_rules=False`` leaves the stored ones)
  8. every file read is registered
  9. one manifest publishes all tables of the run (``sources.versions``): readers see the whole
     run or nothing, and a run that dies is simply run again

``force`` builds a version from no table and publishes it the same way.
Dedupe policy 'always' makes file-by-file ingest equal to one full load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley import schemas as S
from trolley.operators import rules as RU
from trolley.operators.transform import add_calendar, categorize, categorize_by, explode_baskets, product_lookup
from trolley.plans.joins import checked_broadcast
from trolley.plans import incremental
from trolley.session import cut_lineage
from trolley.sources import files as FS
from trolley.sources import registry_table as RG
from trolley.sources.versions import Version

FLAT = incremental.FLAT


def new_items(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Raw lines -> categorised, calendar-tagged items, deduped on the key."""
    items = explode_baskets(raw.select("fecha", "id_tienda", "id_cliente", "basket_raw")).distinct()
    return add_calendar(categorize(items, lookup))


def batch_months(batch: DataFrame) -> list[str]:
    """Year-months of the batch (one short text per month)."""
    return sorted(r[0] for r in batch.select(FS.month_key()).distinct().collect())


def unseen_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``stored``."""
    return batch.join(stored.select(*S.FLAT_KEYS), S.FLAT_KEYS, "left_anti")


def append_batch(v: Version, batch: DataFrame) -> None:
    """Append the rows of ``batch`` whose key is not stored yet."""
    batch = cut_lineage(batch)
    months = batch_months(batch)
    again = [m for m in months if m in v.tables.get(FLAT, {})]     # a key in any other month is new
    stored = v.load(FLAT, S.TRANSACTIONS_FLAT, months)
    seen_month = F.coalesce(FS.month_key().isin(again), F.lit(False))
    FS.append_flat(v, batch.filter(~seen_month).unionByName(unseen_rows(batch.filter(seen_month), stored)) if again else batch)


def append_lines(v: Version, raw: DataFrame, lookup: DataFrame) -> None:
    """``append_batch`` of the items of typed lines. Items of one date and store are made distinct in
    the range that writes them, so what is shuffled are the lines, which are exploded behind it. If
    the lookup is too large to broadcast, the items themselves are shuffled to their products and then
    to their ranges. Items of months that are stored already meet the stored keys first."""
    lines = raw.select("fecha", "id_tienda", "id_cliente", "basket_raw")
    months = batch_months(lines) if v.tables.get(FLAT) else []
    again = [m for m in months if m in v.tables[FLAT]] if months else []
    side = checked_broadcast(lookup)
    small = side is not lookup
    # a catalog is hashed in each task: joined items are read twice (ranges are sampled) without a sort
    side = side if small else lookup.hint("shuffle_hash")
    if not again or len(again) < len(months):
        new = lines.filter(~F.coalesce(FS.month_key().isin(again), F.lit(False))) if again else lines
        FS.append_flat(v, categorize_by(explode_baskets(FS.in_ranges(new) if small else new), side), distinct=True, ranged=small)
    if again:       # what is left of these months is mostly little, and written for the sampling of its ranges
        late = explode_baskets(lines.filter(F.coalesce(FS.month_key().isin(again), F.lit(False))))
        late = cut_lineage(unseen_rows(late, v.load(FLAT, S.TRANSACTIONS_FLAT, again)))
        if not late.isEmpty():
            FS.append_flat(v, categorize_by(late, side), distinct=True)


def item_counts(v: Version) -> tuple[DataFrame, int]:
    """(x, freq) of every product and the number of baskets of the stored items, from the derived
    tables: a basket holds a product once and is one transaction of its day and store."""
    products = v.load("product_freq", S.PRODUCT_FREQ).groupBy(F.col("id_producto").alias("x")).agg(F.sum("frecuencia_absoluta").alias("freq"))
    return products, v.load("daily_summary", S.DAILY_SUMMARY).agg(F.coalesce(F.sum("n_transacciones"), F.lit(0))).first()[0]


def ingest(v: Version, lines: DataFrame, files: DataFrame, lookup: DataFrame, on_bad: str = "record",
           customer_buckets: int = incremental.BUCKETS) -> None:
    """Steps 3 to 6 and 8 for the raw ``lines`` of ``files(file_name)``."""
    if on_bad not in ("record", "fail"):
        raise ValueError("on_bad must be 'record' or 'fail'")
    stats = cut_lineage(FS.file_stats(lines))
    if on_bad == "fail" and (bad := stats.filter("rejected > 0").orderBy("file_name").first()):
        raise ValueError(f"{bad['file_name']}: {bad['rejected']} lines are not usable")
    append_lines(v, FS.typed_transactions(lines), lookup)
    incremental.refresh(v, customer_buckets)
    v.append("rejects", FS.rejects(lines).select(*S.REJECTS.fieldNames()), merge=lambda parts: v.load("rejects", S.REJECTS))
    RG.register_files(v, RG.registry_rows(files, stats))


def run_etl(spark: SparkSession, landing_dir: str, categories_path: str, product_category_path: str,
            out: str, force: bool = False, refresh_rules: bool = True, rules_params: dict | None = None,
            on_bad: str = "record", customer_buckets: int = incremental.BUCKETS) -> dict:
    """Run one incremental ETL step; returns the published tables (S18), ``{}`` if nothing is new.
    ``rules_params`` may name the ``item_col`` of the rules (the product by default);
    ``customer_buckets`` counts for the first run of a store."""
    registry = RG.load_registry(spark, out)
    files = RG.list_files(spark, landing_dir) if force else RG.discover_new_files(spark, landing_dir, registry)
    paths = [r.path for r in files.select("path").orderBy("path").collect()]  # file names only
    if not paths:
        return {}
    lookup = cut_lineage(product_lookup(FS.read_categories(spark, categories_path),
                                        FS.read_product_category(spark, product_category_path)))    # measured, then joined
    v = Version(spark, out, fresh=force)
    ingest(v, FS.read_raw_lines(spark, paths), files, lookup, on_bad, customer_buckets)
    if refresh_rules or "association_rules" not in v.tables:
        params = {"item_col": "id_producto", **(rules_params or {})}
        counted = item_counts(v) if params["item_col"] == "id_producto" and "keys" not in params else None
        v.replace("association_rules", RU.compute_association_rules(v.load(FLAT, S.TRANSACTIONS_FLAT), counted=counted, **params))
    v.commit()
    return FS.load_tables(spark, out)
