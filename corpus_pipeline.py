"""Training corpus from raw documents: language identification, near-duplicate removal,
benchmark decontamination, redaction of personal data and mixing to target weights.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that is written as Parquet and reread as the next stage's ``docs``. All but the last
return the columns of ``docs``. Empty tables pass through; other columns are kept. There is no
SQL for the rows (hashing, training and sampling); tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.llm import common, decontaminate, langid, mixing, ngram_join, pii
from trolley.plans.joins import checked_broadcast


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay: null texts, texts without a letter and
    predictions below the calibrated score go. A null ``lang`` gets the prediction."""
    found = docs.withColumn("_id", langid.language(F.col("text"), spark, langid.fit(docs)))
    return (found.filter(~F.col("_id.rejected")).withColumn("lang", F.coalesce("lang", "_id.lang"))
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, the one with the smallest id (of rows
    that repeat it the smallest one). Rows whose ids clash are told apart by their texts, so
    texts that are not linked all stay. Null ids, null and blank texts stay as they are."""
    rows = ngram_join.near_texts(docs, keys=True)
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    groups = common.stage(rows.filter("group_key is not null").groupBy("group_key").agg(F.count("*").alias("n"), first).filter("n > 1"), "groups")
    gone = common.stage(rows.join(groups.select("group_key"), "group_key", "left_semi").groupBy("doc_id", "text_key").agg(F.lit(1).alias("x")), "grouped")
    key = F.unhex(F.sha2("text", 256))
    same = lambda side: (docs["doc_id"] == side["doc_id"]) & (key == side["text_key"])
    # checked by rows and bytes: beyond the bounds both joins shuffle the texts
    gone, keep = checked_broadcast(gone), checked_broadcast(common.stage(groups.select("first.*"), "first"))
    once = docs.join(gone, same(gone), "left_anti")
    least = (docs.join(keep, same(keep), "left_semi")
             .groupBy(F.col("doc_id").alias("_id"), key.alias("_key")).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    return once.unionByName(least)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null, empty and wordless texts hold
    none and stay; repeated rows are judged alike; other columns are kept."""
    found = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"), into="_hits")
    return found.filter(F.size("_hits") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in <>; ``n_chars`` follows the text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per draw of a document, with draw, shard and shard_order; sources come near
    their target words. A null source is one source, a null text has no words, repeated rows
    are documents of their own; columns named like the three new ones are replaced."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("ngram_join", near_duplicates), ("decontamination", decontamination),
          ("pii", personal_data), ("mixing", mixture)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return docs
