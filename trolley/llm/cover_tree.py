"""Embedding near-duplicates: exact threshold pairs by a dual traversal of cover trees.

On unit vectors, cosine >= t means a distance of at most sqrt(2 - 2t). The top of the tree is
distributed: per group (label and dimension), nested pivots from a bounded sample cut the
vectors into cells with a covering radius, and a vector is sent to a cell only if its distance
to the cell's pivot is within radius and threshold. Cells are dealt in chunks, so every task
holds two chunks at most. There, each chunk is a cover tree (nested centres, halving radii)
and node pairs are pruned, or taken whole, by their covering radii; leaves that remain are
compared exactly. A task returns counts and a spanning forest, never pairs. Equal vectors are
one node with a multiplicity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import link_facts, roots, stage, table

MARGIN = 1e-9   # pairs this close to a bound are compared exactly


@dataclass
class Node:
    center: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, leaf: int = 64, fan: int = 32) -> Node:
    """Tree over the rows of ``x``. The children of a node have the node's centre and then,
    one by one, the point farthest from all centres, until half of the node's radius covers
    (or ``fan`` is reached); points go to the nearest centre."""
    def grow(center: int, points: np.ndarray, dist: np.ndarray) -> Node:
        node = Node(center, float(dist.max()), points)
        if len(points) <= leaf or node.radius < 1e-6:
            return node
        near, owner, centers, far = dist.copy(), np.zeros(len(points), int), [center], [dist]
        while near.max() > node.radius / 2 and len(centers) < fan:
            centers.append(int(points[near.argmax()]))
            d = np.linalg.norm(x[points] - x[centers[-1]], axis=1)
            owner[d < near] = len(centers) - 1
            near = np.minimum(near, d)
            far.append(d)
        for k, c in enumerate(centers):
            mine = owner == k
            if mine.any():
                node.children.append(grow(c, points[mine], far[k][mine]))
        return node
    return grow(0, np.arange(len(x)), np.linalg.norm(x - x[0], axis=1))


def nodes_of(tree: Node) -> list[Node]:
    out = [tree]
    for n in out:
        out.extend(n.children)
    return out


def threshold_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> np.ndarray:
    """Boolean matrix of the pairs of unit rows of ``x`` and ``y`` (or ``x`` and itself,
    without the diagonal) with a cosine of at least ``cosine``, by dual traversal."""
    a_nodes = nodes_of(a_tree := cover_tree(x))
    other = x if y is None else y
    b_nodes = a_nodes if y is None else nodes_of(cover_tree(y))
    a_at, b_at = ({id(n): k for k, n in enumerate(ns)} for ns in (a_nodes, b_nodes))
    dist = np.sqrt(np.maximum(0, 2 - 2 * x[[n.center for n in a_nodes]] @ other[[n.center for n in b_nodes]].T))
    limit = (2 - 2 * cosine) ** 0.5
    out = np.zeros((len(x), len(other)), dtype=bool)
    todo = [(a_tree, b_nodes[0])]
    while todo:
        a, b = todo.pop()
        d = dist[a_at[id(a)], b_at[id(b)]]
        if d > limit + a.radius + b.radius + MARGIN * 1e3:
            continue
        if d + a.radius + b.radius < limit - MARGIN * 1e3:
            out[np.ix_(a.points, b.points)] = True
        elif a.children and (a.radius >= b.radius or not b.children):
            todo += [(c, b) for c in a.children]
        elif b.children:
            todo += [(a, c) for c in b.children]
        else:
            out[np.ix_(a.points, b.points)] = x[a.points] @ other[b.points].T >= cosine
    if y is None:
        np.fill_diagonal(out, False)
    return out


def unit_rows(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps the norm finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Counts of linked vectors and a spanning forest of one pair of chunks."""
        rows = rows.sort_values("node", kind="stable")
        same = bool(rows["same"].iloc[0])
        left = rows if same else rows[rows["left"]]
        right = left if same else rows[~rows["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype({"links": "int64"})
        x, y = unit_rows(left["embedding"]), unit_rows(right["embedding"])
        hit = threshold_links(x, None if same else y, cosine)
        links = hit @ right["n"].to_numpy(np.int64)
        both, whole = left, hit
        if not same:
            links = np.concatenate([links, hit.T @ left["n"].to_numpy(np.int64)])
            both = pd.concat([left, right])
            whole = np.block([[np.zeros((len(x), len(x)), bool), hit], [hit.T, np.zeros((len(y), len(y)), bool)]])
        ids = both["node"].to_numpy()
        some = whole.any(1)
        return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": ids[roots(whole)][some]})
    return compare


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` in nested order: each next one is the farthest from those before."""
    chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 chunk_rows: int = 1024, max_groups: int = 256, max_pivots: int = 32) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable by links) and kept (vec_id = component_id).

    Rows link if their labels are equal and not null, their dimensions are equal and their
    cosine in double precision is at least ``cosine``. Null, empty and zero vectors and those
    with null or non-finite components link with nothing; so do rows with a null label. Null
    ids are ignored in minima (a component of null ids only has a null component_id and is
    kept). Repeated rows count as other rows. Other columns are ignored.

    Pivots come from a sample of at most 16 x ``max_pivots`` vectors of each of the
    ``max_groups`` largest groups; other groups have one cell. Neither changes the result."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = (F.col("label").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(e, lambda v: v != 0))
    code = lambda *cols: F.lpad(F.hex(F.xxhash64(*cols)), 16, "0")
    rows = (vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
            .withColumn("node", F.when(fine, F.unhex(F.concat(code("label", e), code(F.lit(1), F.size(e), e, "label"))))))
    nodes = stage(rows.filter("node is not null").groupBy("node")
                  .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"),
                       F.first(F.concat_ws("/", F.col("label").cast("string"), F.size(e).cast("string"))).alias("grp")), "nodes")

    large = {r["grp"]: r["count"] for r in nodes.groupBy("grp").count().filter(F.col("count") > chunk_rows)
             .orderBy(F.desc("count"), "grp").limit(max_groups).collect()}
    pivots: dict[str, np.ndarray] = {}
    if large:
        wanted = spark.createDataFrame([(g, min(max_pivots, -(-n // (2 * chunk_rows))), n) for g, n in large.items()], "grp string, k int, size long")
        sample = (nodes.join(F.broadcast(wanted), "grp")
                  .filter(F.pmod(F.xxhash64("node"), F.col("size")) < 16 * F.col("k")).select("grp", "k", "node", "embedding")
                  .orderBy("node").limit(32 * max_pivots * len(large)).toPandas())
        for g, part in sample.groupby("grp"):
            pivots[g] = farthest_first(unit_rows(part["embedding"]), int(part["k"].iloc[0]))
    shared = spark.sparkContext.broadcast(pivots)   # at most max_groups x max_pivots vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far: list = [[0.0]] * len(b)
            for g, at in b.groupby("grp").indices.items():
                if g in shared.value:
                    x, p = unit_rows(b["embedding"].iloc[at]), shared.value[g]
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                    for i, r in zip(at, d, strict=True):
                        far[i] = r.tolist()
            yield b.assign(far=far, cell=[int(np.argmin(f)) for f in far])
    placed = stage(nodes.select("node", "n", "grp", "embedding").mapInPandas(
        assign, "node binary, n long, grp string, embedding array<double>, far array<double>, cell int"), "placed")

    chunks = F.ceil(F.col("size") / chunk_rows).cast("int")
    cells = stage(placed.groupBy("grp", "cell").agg(F.count("*").alias("size"), F.max(F.get("far", F.col("cell"))).alias("radius"))
                  .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cell", chunks.alias("chunks"), "radius"))).alias("cells")), "cells")
    limit = (2 - 2 * cosine) ** 0.5
    own = F.get(F.filter("cells", lambda c: c["cell"] == F.col("cell")), F.lit(0))["chunks"]
    me, them = F.struct("cell", "chunk"), F.struct(F.col("to.cell").alias("cell"), F.col("to_chunk").alias("chunk"))
    units = (placed.join(cells, "grp")
             .withColumn("chunk", F.pmod(F.xxhash64("node"), own).cast("int"))
             .withColumn("to", F.explode(F.filter("cells", lambda c: F.get("far", c["cell"]) <= c["radius"] + limit + 1e-6)))
             .withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.col("to.chunks") - 1)))
             .select("node", "n", "embedding", "grp", F.least(me, them).alias("a"), F.greatest(me, them).alias("b"),
                     (me <= them).alias("left"), (me == them).alias("same")))
    # dealt by unit: a shuffle on the group alone would do for Spark, and put a hot label in one task
    found = stage(units.repartition("grp", "a", "b").groupBy("grp", "a", "b").applyInPandas(_compare(cosine), "node binary, links long, root binary"), "links")

    facts = link_facts(nodes, found, "component_id").drop("rep").filter("n_links > 0")
    return (rows.select("vec_id", "node").join(facts, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(reach.low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(reach.low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""
