"""Structured Streaming ingest.

The landing directory is a file stream source: only files not yet seen by the query's
checkpoint are read (T1 — the streaming counterpart of the file registry). Each
micro-batch goes through ``foreachBatch``: the ETL's ingest step, with key dedupe against
the stored months of the batch (T2), append, derived tables (T3), rejects and registry. With no watermark any
date is accepted (T4, as the reference). ``weekly_counts`` is an event-time window
aggregation aligned to Mondays (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley import schemas as S
from trolley.operators.transform import add_calendar, categorize, explode_baskets
from trolley.plans.etl import ingest
from trolley.sources import files as FS
from trolley.sources.versions import Version
from trolley.session import cut_lineage


def static_lookup(lookup: DataFrame) -> DataFrame:
    """The product->category lookup materialized once (reliable checkpoint): catalogs are
    read a single time for the whole stream, and the line-order ids of the last-wins
    rule stay out of the streaming plan."""
    return cut_lineage(lookup)


def read_landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw transaction lines of a landing directory as a stream (with ``file_name``)."""
    reader = spark.readStream.option("pathGlobFilter", "*.csv")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    text = reader.text(landing_dir).select("value", F.col("_metadata.file_name").alias("file_name"))
    return FS.lines_to_columns(text)


def make_batch_writer(out: str, lookup: DataFrame, on_bad: str = "record", stream: str | None = None):
    """foreachBatch body. Every micro-batch is one published version, which also holds the
    number of the batch under the name ``stream``: a batch that is run again after its version
    was published does nothing, so its rows and files count once. Files without lines give no
    row of the stream and are not registered here."""
    def write(lines: DataFrame, epoch_id: int) -> None:
        v = Version(lines.sparkSession, out)
        if stream is not None and v.streams.get(stream, -1) >= epoch_id:
            return
        lines = lines.persist()     # one read of the batch's files for its several uses
        try:
            ingest(v, lines, lines.select("file_name"), lookup, on_bad)
            if stream is not None:
                v.streams[stream] = epoch_id
            v.commit()
        finally:
            lines.unpersist()
    return write


def start_ingest(spark: SparkSession, landing_dir: str, lookup: DataFrame, out: str,
                 checkpoint: str, available_now: bool = True, processing_time: str | None = None,
                 max_files_per_trigger: int | None = None, on_bad: str = "record"):
    """Start the ingest query; ``available_now`` processes what is there and stops. The stream
    goes by the path of its checkpoint."""
    w = (read_landing_stream(spark, landing_dir, max_files_per_trigger).writeStream
         .foreachBatch(make_batch_writer(out, static_lookup(lookup), on_bad, checkpoint))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def stream_items(lines: DataFrame, lookup: DataFrame) -> DataFrame:
    """Stateless item rows of a line stream (explode, categorise, calendar), for
    event-time aggregations that must be the only stateful operator of the query."""
    raw = FS.typed_transactions(lines)
    return add_calendar(categorize(explode_baskets(raw), lookup))


def event_time(fecha) -> F.Column:
    """The item date as an instant at 00:00 UTC, independent of the session time zone."""
    return F.timestamp_seconds(F.unix_date(fecha).cast("long") * 86400)


def dedupe_stream(items: DataFrame, watermark: str | None = None) -> DataFrame:
    """In-stream key dedupe (T2 option). With a watermark on the item date the dedupe
    state is bounded by event time; without one every key is remembered."""
    if watermark:
        return (items.withColumn("fecha_ts", event_time(F.col("fecha")))
                .withWatermark("fecha_ts", watermark)
                .dropDuplicatesWithinWatermark(S.FLAT_KEYS))
    return items.dropDuplicates(S.FLAT_KEYS)


def weekly_counts(items: DataFrame, watermark: str | None = None) -> DataFrame:
    """T5: items per Monday-aligned week and category. Windows are laid on UTC epoch time
    (epoch day 0 is a Thursday, so they start 4 days later) and mapped back to dates
    without the session time zone."""
    ts = items.withColumn("fecha_ts", event_time(F.col("fecha")))
    if watermark:
        ts = ts.withWatermark("fecha_ts", watermark)
    return (ts.groupBy(F.window("fecha_ts", "7 days", "7 days", "4 days").alias("w"), "nombre_categoria")
            .agg(F.count(F.lit(1)).alias("frecuencia"))
            .select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
                    .alias("semana"), "nombre_categoria", "frecuencia"))
