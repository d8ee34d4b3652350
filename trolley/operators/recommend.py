"""Neighbour-based category recommendation.

Customer vectors are kept in long form (id_cliente, dim, value): dim is a category
(exact cosine) or an SVD component (reduced cosine). A target's vector has at most
one row per dimension, so it is broadcast after a size check and every other
customer's dot product with it is an equi-join on the dimension followed by a
partial aggregation — no pairs of customers are generated beyond (target, other)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.numeric import round_even
from trolley.operators.neighbours import all_neighbours
from trolley.plans.joins import checked_broadcast
from trolley.session import cut_lineage


def customer_category_counts(flat: DataFrame) -> DataFrame:
    """A19 long form: items per (customer, category)."""
    return flat.groupBy("id_cliente", "nombre_categoria").agg(F.count(F.lit(1)).alias("n"))


def stored_counts(flat: DataFrame) -> DataFrame:
    """Customer x category counts, materialized once in the shared checkpoint folder.

    One row per (customer, category) is far smaller than the item table; every later
    step (targets, norms, dot products, scores) reads this table instead of the items."""
    return cut_lineage(customer_category_counts(flat))


def top_customers_by_items(counts: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` customers with most items (ties: smaller id), read from the counts:
    a customer's items are the sum of its per-category counts."""
    return (counts.groupBy("id_cliente").agg(F.sum("n").alias("total_items"))
            .orderBy(F.desc("total_items"), "id_cliente").limit(n))


def customer_category_matrix(flat: DataFrame, categories: list[str]) -> DataFrame:
    """A19 wide form (one 0-filled column per given category); for display/export only. The
    categories come from the catalog, so no pass over the items looks for them."""
    return (customer_category_counts(flat).groupBy("id_cliente")
            .pivot("nombre_categoria", categories).agg(F.first("n")).na.fill(0))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def cosine_to_target(vectors: DataFrame, target, dim: str = "dim", val: str = "val") -> DataFrame:
    """(id_cliente, sim) of every customer other than ``target`` (P11), zero-overlap
    customers included with similarity 0; a zero-norm vector has similarity 0."""
    t = _lit(target)
    norms = vectors.groupBy("id_cliente").agg(F.sqrt(F.sum(F.col(val) * F.col(val))).alias("norm"))
    tvec = checked_broadcast(vectors.filter(F.col("id_cliente") == t)
                             .select(F.col(dim).alias("_d"), F.col(val).alias("_tv")))
    tnorm = norms.filter(F.col("id_cliente") == t).select("norm").scalar()
    dots = (vectors.join(tvec, F.col(dim) == F.col("_d"))
            .groupBy("id_cliente").agg(F.sum(F.col(val) * F.col("_tv")).alias("dot")))
    denom = F.col("norm") * tnorm
    # an unknown target has no norm: no candidates at all (empty result, as the reference)
    return (norms.filter((F.col("id_cliente") != t) & tnorm.isNotNull()).join(dots, "id_cliente", "left")
            .select("id_cliente",
                    F.when(denom > 0, F.coalesce(F.col("dot"), F.lit(0.0)).cast("double") / denom)
                    .otherwise(F.lit(0.0)).alias("sim")))


def nearest_neighbours(sims: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """The ``n_neighbors`` most similar customers (ties: smaller id)."""
    return sims.orderBy(F.desc("sim"), "id_cliente").limit(n_neighbors)


def score_categories(counts: DataFrame, neighbours: DataFrame, target, top_n: int = 5) -> DataFrame:
    """J6 + A25 + W5: Σ similarity of the neighbours over categories the target lacks."""
    t = _lit(target)
    own = counts.filter((F.col("id_cliente") == t) & (F.col("n") > 0)).select("nombre_categoria")
    nb = checked_broadcast(neighbours.select(F.col("id_cliente").alias("_nb"), "sim"))
    bought = counts.filter(F.col("n") > 0).join(nb, F.col("id_cliente") == F.col("_nb"))
    return (bought.join(checked_broadcast(own), "nombre_categoria", "left_anti")
            .groupBy("nombre_categoria").agg(F.sum("sim").alias("score"))
            .select(F.col("nombre_categoria").alias("categoria"), round_even(F.col("score"), 4).alias("score"))
            .orderBy(F.desc("score"), "categoria").limit(top_n))


def svd_components(counts: DataFrame, n_components: int = 50, cap_rank: bool = True):
    """Right singular vectors of the (uncentred) customer x category count matrix.

    Customer rows are built on the JVM: the counts are put in order of the known category
    list (one row per customer, C values), made vectors and handed to
    ``RowMatrix`` as a DataFrame, so no row goes through Python. The C x C Gram matrix
    is tree-aggregated by ``RowMatrix`` (no pairs are emitted) and decomposed on the
    driver — C is the number of categories. Returns (categories in index order, V as
    C x r ndarray) or None when r < 1."""
    cats = _categories(counts)
    rows = customer_vectors(counts, cats)
    v = _right_vectors(rows, rows.count(), len(cats), n_components, cap_rank)
    return None if v is None else (cats, v)


def _categories(counts: DataFrame) -> list[str]:
    return [r[0] for r in counts.select("nombre_categoria").distinct().orderBy("nombre_categoria").collect()]


def _right_vectors(rows: DataFrame, n_rows: int, n_cats: int, n_components: int, cap_rank: bool):
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    # the reference keeps at most C-1 and N-1 components; cap_rank=False allows full rank
    r = min(n_components, n_cats - 1, n_rows - 1) if cap_rank else min(n_components, n_cats, n_rows)
    if r < 1:
        return None
    vecs = rows.select(array_to_vector("v").alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vecs, "v")).computeSVD(r, computeU=False).V.toArray()


def customer_vectors(counts: DataFrame, cats: list[str]) -> DataFrame:
    """(id_cliente, v): the counts of a customer by ``cats``, 0 where it has none. The counts of a
    customer are shuffled once and become one row."""
    wide = (counts.select("id_cliente", "nombre_categoria", F.col("n").cast("double").alias("n")).repartition("id_cliente")
            .groupBy("id_cliente").pivot("nombre_categoria", cats).agg(F.first("n")).na.fill(0.0, cats).toDF("id_cliente", *(f"c{i}" for i in range(len(cats)))))
    return wide.select("id_cliente", F.array(*(f"c{i}" for i in range(len(cats)))).alias("v"))


def svd_similarities(counts: DataFrame, target, n_components: int = 50, cap_rank: bool = True) -> DataFrame | None:
    """``cosine_to_target`` of the reduced vectors. A customer's coordinates are worked out in its
    row and neither shuffled nor spread over rows; only the target's leave it."""
    cats = _categories(counts)
    rows = cut_lineage(customer_vectors(counts, cats))
    v = _right_vectors(rows, rows.count(), len(cats), n_components, cap_rank)
    if v is None:
        return None
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    at = F.transform(F.lit(v.T.tolist()), lambda axis: dot(F.col("v"), axis))
    t = _lit(target)
    own = rows.filter(F.col("id_cliente") == t).select(at.alias("at")).first()
    if own is None:
        return counts.sparkSession.createDataFrame([], "id_cliente long, sim double")
    theirs = F.lit(list(own["at"]))
    placed = rows.filter(F.col("id_cliente") != t).select("id_cliente", at.alias("at"))
    denom = F.sqrt(dot(F.col("at"), F.col("at"))) * F.sqrt(dot(theirs, theirs))
    return placed.select("id_cliente", denom.alias("d"), dot(F.col("at"), theirs).alias("dot")).select(
        "id_cliente", F.when(F.col("d") > 0, F.col("dot") / F.col("d")).otherwise(F.lit(0.0)).alias("sim"))


def svd_vectors(counts: DataFrame, n_components: int = 50, cap_rank: bool = True) -> DataFrame | None:
    """Customer coordinates U·Σ = A·V in long form (id_cliente, dim, val)."""
    res = svd_components(counts, n_components, cap_rank)
    if res is None:
        return None
    cats, v = res
    spark = counts.sparkSession
    vlong = spark.createDataFrame(
        [(c, j, float(v[i, j])) for i, c in enumerate(cats) for j in range(v.shape[1])],
        "nombre_categoria string, dim int, w double")
    return (counts.join(checked_broadcast(vlong), "nombre_categoria")
            .groupBy("id_cliente", "dim").agg(F.sum(F.col("n") * F.col("w")).alias("val")))


def recommend_for_customer(flat: DataFrame, customer_id, top_n: int = 5, n_neighbors: int = 10,
                           n_components: int = 50, method: str = "svd",
                           counts: DataFrame | None = None) -> DataFrame:
    """Categories for one customer from its nearest neighbours.

    ``method='svd'`` reduces the count matrix to rank min(n_components, C-1, N-1) as the
    reference does; ``method='exact'`` uses cosine on the counts. An unknown customer
    gives an empty result. ``counts`` (from ``stored_counts(flat)``) is reused when given."""
    if method not in ("svd", "exact"):
        raise ValueError("method must be 'svd' or 'exact'")
    if not 1 <= int(top_n) <= 20:  # P9
        raise ValueError("top_n must be within 1..20")
    if counts is None:
        counts = stored_counts(flat)
    if method == "exact":
        sims = cosine_to_target(counts.select("id_cliente", F.col("nombre_categoria").alias("dim"),
                                              F.col("n").cast("double").alias("val")), customer_id)
    else:
        sims = svd_similarities(counts, customer_id, n_components)
        if sims is None:
            return flat.sparkSession.createDataFrame([], "categoria string, score double")
    return score_categories(counts, nearest_neighbours(sims, n_neighbors), customer_id, top_n)


def _block_neighbours(vectors: DataFrame, block: DataFrame, n_neighbors: int) -> DataFrame:
    """(target, id_cliente, sim) of the nearest customers of a block of targets.

    The block travels as one array value to every customer row, where all its dot products
    are computed; a customer and a target are never matched through a shuffle on a category,
    and ``row_number() <= k`` keeps k rows per target and task before the one shuffle.
    Customers without a common category take part with similarity 0."""
    held = block.agg(F.collect_list(F.struct(F.col("id_cliente").alias("target"), "of", F.col("norm").alias("tnorm")))).scalar()
    dot = F.aggregate("cats", F.lit(0).cast("long"),
                      lambda acc, e: acc + e["n"] * F.coalesce(F.try_element_at(F.col("t.of"), e["nombre_categoria"]), F.lit(0)))
    sims = (vectors.select("id_cliente", "norm", "cats", F.explode(held).alias("t")).filter(F.col("id_cliente") != F.col("t.target"))
            .select(F.col("t.target").alias("target"), "id_cliente",
                    (dot.cast("double") / (F.col("norm") * F.col("t.tnorm"))).alias("sim")))
    w = Window.partitionBy("target").orderBy(F.desc("sim"), "id_cliente")
    return sims.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n_neighbors).drop("rk")


def recommend_for_customers(flat: DataFrame, targets: DataFrame, top_n: int = 5, n_neighbors: int = 10,
                            counts: DataFrame | None = None, block_rows: int = 500) -> DataFrame:
    """Exact recommendation for a stated set of target customers (column ``id_cliente``),
    in blocks of about ``block_rows`` targets against all customers.

    A customer is one row: its category counts and norm. ``counts`` (from
    ``stored_counts(flat)``) is reused when given. Unknown targets give no rows."""
    if counts is None:
        counts = stored_counts(flat)
    entry = F.struct("nombre_categoria", "n")  # at most one per category
    vectors = cut_lineage(counts.groupBy("id_cliente").agg(F.collect_list(entry).alias("cats"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")))
    wanted = cut_lineage(vectors.join(targets.select("id_cliente").distinct(), "id_cliente", "left_semi")
                         .select("id_cliente", F.map_from_entries("cats").alias("of"), "norm"))
    blocks = max(1, -(-wanted.count() // block_rows))
    parts = [_block_neighbours(vectors, wanted.filter(F.pmod(F.xxhash64("id_cliente"), F.lit(blocks)) == k), n_neighbors)
             for k in range(blocks)]
    nbrs = reduce(DataFrame.unionByName, parts)
    own = wanted.select(F.col("id_cliente").alias("target"), F.explode(F.map_keys("of")).alias("nombre_categoria"))
    return score_targets(counts, nbrs, own, top_n)


def score_targets(counts: DataFrame, nbrs: DataFrame, own: DataFrame, top_n: int = 5) -> DataFrame:
    """W5 of many targets: best categories by the summed similarity of the neighbours
    (target, id_cliente, sim) that bought them, without those in ``own`` (target, nombre_categoria).

    A neighbour meets its target as one row with all its categories; only those that the target
    lacks become rows, where the target's rows are together already."""
    entry = F.struct("nombre_categoria")    # a struct keeps a category without a name
    bought = (counts.filter(F.col("n") > 0).groupBy("id_cliente").agg(F.collect_list(entry).alias("cats"))
              .select("id_cliente", F.col("cats.nombre_categoria").alias("cats")))
    has = own.groupBy("target").agg(F.collect_set("nombre_categoria").alias("own"))
    lacks = F.filter("cats", lambda c: ~F.coalesce(F.array_contains("own", c), F.lit(False)))
    scored = (nbrs.join(bought, "id_cliente").select("target", "sim", "cats").join(has, "target", "left")
              .select("target", "sim", F.explode(lacks).alias("nombre_categoria"))
              .groupBy("target", "nombre_categoria").agg(F.sum("sim").alias("score"))
              .withColumn("score", round_even(F.col("score"), 4)))
    w2 = Window.partitionBy("target").orderBy(F.desc("score"), "nombre_categoria")
    return (scored.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= top_n)
            .select(F.col("target").alias("id_cliente"), F.col("nombre_categoria").alias("categoria"),
                    "score", "rank"))


def recommend_for_all(counts: DataFrame, top_n: int = 5, n_neighbors: int = 10) -> DataFrame:
    """M14 for every customer: exact neighbours by the pruned join, then the scores."""
    nbrs = cut_lineage(all_neighbours(counts, n_neighbors).drop("rank"))
    own = counts.filter(F.col("n") > 0).select(F.col("id_cliente").alias("target"), "nombre_categoria")
    return score_targets(counts, nbrs, own, top_n)


def cosine_matrix_check(counts_pd, target_idx: int) -> np.ndarray:
    """Brute-force cosine row for tests (small fixtures only)."""
    m = np.asarray(counts_pd, dtype=float)
    nrm = np.linalg.norm(m, axis=1)
    return (m @ m[target_idx]) / np.where(nrm * nrm[target_idx] > 0, nrm * nrm[target_idx], 1.0)
