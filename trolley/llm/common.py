"""Helpers shared by the operators: table reads, intermediate tables in the shared folder,
connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and reread it: the lineage
    ends there, and a lost executor only costs a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TEXT_BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_BATCH`` rows where they are larger: ten
    thousand rows of whole texts at once are too much for a Python worker. The setting holds
    for the session, as plans read it only when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def others(df: DataFrame, names: set[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``names`` (case-insensitively)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: one row (node, component) per
    node that occurs in an edge, component = smallest node reachable.

    Alternating large-star and small-star steps. Each is a ``min`` aggregate, combined before
    its shuffle, and a join on the node with its written result: with both sides straight
    from a shuffle, AQE can split a hub that holds a third of the edges. Every step ends in
    a table in the shared folder.
    Raises if the edges have not settled after ``max_rounds``; the number of rounds grows
    with the logarithm of the longest path, so this is no limit in practice."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e  # small star: a > b already
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "low")
        out = both.join(low, "a")
        if large:   # neighbours above the node go to its smallest neighbour
            out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:       # the node and its smaller neighbours go to the smallest
            out = (out.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
                   .select("e.a", F.col("e.m").alias("b")))
        return out.filter(F.col("a") > F.col("b")).distinct()

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"),
                           F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .filter("a > b").distinct(), "edges")
    before = summary(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        e = stage(star(star(e, True), False), "edges")
        now = summary(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(e.select("b", "b").distinct()))


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    for start in range(len(linked)):
        if label[start] == start:
            seen, front = np.zeros(len(linked), bool), np.zeros(len(linked), bool)
            front[start] = True
            while front.any():
                seen |= front
                front = linked[front].any(0) & ~seen
            label[seen] = start
    return label


def link_facts(nodes: DataFrame, found: DataFrame, component: str) -> DataFrame:
    """Facts of the linked nodes from the counts and spanning forests of all tasks.

    ``nodes(node, rep, n)``: smallest id and number of rows of each node; ``found(node, links,
    root)``: rows of other nodes linked directly, and a node linked by a path. Result per node:
    node, rep, n_links (other rows linked directly, copies included), ``component`` (smallest
    id reachable) and root (smallest node reachable, null for a node without links)."""
    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    reps = nodes.select("node", "rep").join(whole, "node")
    low = stage(reps.groupBy("component").agg(F.min("rep").alias("low")), "low")  # written, so that AQE can split the join
    reps = reps.join(low, "component").select("node", "low", F.col("component").alias("root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # written, so that AQE can split the caller's join of a class that holds many rows
    return stage(nodes.select("node", "rep", "n").join(links, "node", "left").join(reps, "node", "left")
            .select("node", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias(component), "root"), "facts")
