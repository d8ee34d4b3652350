"""Customer segmentation.

* ``standardize``: population z-score from one aggregate (scalar subqueries that
  Spark merges into one scan); zero variance gives 0.
* ``kmeans``: Spark ML KMeans (k-means|| init) fitted for ``n_init`` seeds, keeping the
  lowest training cost — the distributed counterpart of best-of-n-inits.
* ``lloyd_kmeans``: deterministic Lloyd iterations from quantile centroids, written as
  DataFrame aggregations (the SQL-checkable sibling). Only the k x d centroid values
  travel to the driver between iterations.
* ``pca_2d``: Spark ML PCA on the standardized vectors, component signs fixed.
Cluster ids are relabelled by ascending centroid of the first feature so that
results do not depend on the initialisation order."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from trolley.functions.labels import FEATURE_LABELS, FEATURES, level_label
from trolley.functions.numeric import round_even
from trolley.session import cut_lineage

Z_DIGITS = 6
# Independent model fits submitted concurrently (as CrossValidator's ``parallelism``).
FIT_PARALLELISM = 8


def validate_params(features, k: int, n_rows: int | None = None) -> None:
    """Known features, 2 <= k <= 8, enough rows for k."""
    unknown = [f for f in features if f not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    if not features:
        raise ValueError("at least one feature is required")
    if not 2 <= k <= 8:
        raise ValueError("k must be within 2..8")
    if n_rows is not None and n_rows < k:
        raise ValueError(f"{n_rows} rows are fewer than k={k}")


def select_features(customers: DataFrame, features=FEATURES) -> DataFrame:
    """Id + features, rows with a null feature dropped."""
    return customers.select("id_cliente", *features).na.drop()


def feature_moments(df: DataFrame, features=FEATURES) -> DataFrame:
    """One row: mean and population std of every feature."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    return df.agg(*aggs)


def standardize(df: DataFrame, features=FEATURES, digits: int | None = Z_DIGITS) -> DataFrame:
    """M5: z_f = (x - mean) / std_pop, 0 when std is 0; kept columns plus ``z_<f>``."""
    out = df
    for f in features:
        mean = df.select(F.avg(f)).scalar()
        std = df.select(F.stddev_pop(f)).scalar()
        z = F.when(std > 0, (F.col(f).cast("double") - mean) / std).otherwise(F.lit(0.0))
        out = out.withColumn(f"z_{f}", round_even(z, digits) if digits is not None else z)
    return out


def _assign_expr(zcols, centers):
    """Index of the nearest centre (first one on ties) and the squared distance."""
    dists = []
    for c in centers:
        d = None
        for zc, v in zip(zcols, c):
            term = (F.col(zc) - F.lit(float(v))) * (F.col(zc) - F.lit(float(v)))
            d = term if d is None else d + term
        dists.append(d)
    arr = F.array(*dists)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int"), F.array_min(arr)


def quantile_centers(z: DataFrame, features, k: int, digits: int = Z_DIGITS) -> list[list[float]]:
    """Centre i = the ((i + 0.5) / k) quantile of every standardized feature."""
    aggs = [round_even(F.percentile(f"z_{f}", (i + 0.5) / k), digits).alias(f"c{i}_{f}")
            for i in range(k) for f in features]
    row = z.agg(*aggs).first()
    return [[row[f"c{i}_{f}"] for f in features] for i in range(k)]


def lloyd_kmeans(z: DataFrame, features, k: int, iterations: int = 300,
                 digits: int = Z_DIGITS) -> tuple[DataFrame, list[list[float]]]:
    """Deterministic k-means: quantile init, update steps until no centre moves (at
    ``digits`` decimals), then assignment.

    Returns (rows with ``cluster``, ``dist2`` and ``converged``, final centres);
    ``converged`` is false if ``iterations`` steps were not enough. An empty cluster keeps
    its previous centre."""
    zcols = [f"z_{f}" for f in features]
    z = cut_lineage(z.select("id_cliente", *features, *zcols))
    centers = quantile_centers(z, features, k, digits)
    points = z.select(*zcols).persist()     # read once per step
    converged = False
    for _ in range(iterations):
        label, _d = _assign_expr(zcols, centers)
        means = (points.select(label.alias("cluster"), *zcols).groupBy("cluster")
                 .agg(*[round_even(F.avg(c), digits).alias(c) for c in zcols]).collect())  # <= k rows
        moved = list(centers)
        for row in means:
            moved[row["cluster"]] = [row[c] for c in zcols]
        converged, centers = moved == centers, moved
        if converged:
            break
    points.unpersist()
    label, dist2 = _assign_expr(zcols, centers)
    return z.withColumn("cluster", label).withColumn("dist2", dist2).withColumn("converged", F.lit(converged)), centers


_SUMS = "fit int, cluster int, n long, s array<double>, dist2 double"


def _batch_sums(fits):
    """For batches of points: per fit (a list of centres) and cluster the points whose nearest
    centre (the first on ties) it is: their number, sums of coordinates and of squared distances."""
    import numpy as np
    import pandas as pd

    def of(batches):
        for batch in batches:
            points, out = batch.to_numpy(dtype=float), []
            for i, centers in enumerate(fits):
                d = np.stack([sum((points[:, j] - c) ** 2 for j, c in enumerate(center)) for center in centers])
                label = d.argmin(axis=0)
                for k in range(len(centers)):
                    mine = label == k
                    if n := int(mine.sum()):
                        out.append((i, k, n, points[mine].sum(axis=0).tolist(), float(d[k][mine].sum())))
            yield pd.DataFrame(out, columns=["fit", "cluster", "n", "s", "dist2"])
    return of


def lloyd_many(z: DataFrame, features, starts: dict, iterations: int = 300, digits: int = Z_DIGITS) -> dict:
    """Lloyd steps of many fits at once: ``starts`` maps a name to its first centres; the result
    maps it to (centres, converged, inertia).

    One scan per step serves all fits that still move: a row is assigned under every one of
    them, and the means of all (fit, cluster) pairs come from one aggregate, combined before
    its shuffle. So the scans are those of the slowest fit, plus one for the inertias. Only the
    centres of the fits pass through the driver."""
    zcols = [f"z_{f}" for f in features]
    points = cut_lineage(z.select(*zcols)).persist()
    names = list(starts)
    now, moving = {n: [list(map(float, c)) for c in starts[n]] for n in names}, list(names)
    for _ in range(iterations):
        if not moving:
            break
        means = (points.mapInPandas(_batch_sums([now[n] for n in moving]), _SUMS).groupBy("fit", "cluster")
                 .agg(*[round_even(F.sum(F.col("s")[j]) / F.sum("n"), digits).alias(c) for j, c in enumerate(zcols)]).collect())   # <= sum of k rows
        after = {n: list(now[n]) for n in moving}
        for row in means:
            after[moving[row["fit"]]][row["cluster"]] = [row[c] for c in zcols]
        moving = [n for n in moving if after[n] != now[n]]
        now |= after
    sums = {r["fit"]: r["s"] for r in points.mapInPandas(_batch_sums([now[n] for n in names]), _SUMS)
            .groupBy("fit").agg(F.sum("dist2").alias("s")).collect()} if names else {}     # one row per fit
    points.unpersist()
    return {n: (now[n], n not in moving, float(sums.get(i, 0.0))) for i, n in enumerate(names)}


def forgy_centers(z: DataFrame, features, k: int, seed: int) -> list[list[float]]:
    """``k`` rows as first centres: those with the smallest digests of seed and customer."""
    zcols = [f"z_{f}" for f in features]
    order = F.md5(F.concat_ws("|", F.lit(seed), "id_cliente"))
    return [[row[c] for c in zcols] for row in z.select("id_cliente", *zcols).orderBy(order, "id_cliente").limit(k).collect()]


def elbow_fits(z: DataFrame, features, k_max: int = 8, seeds=(1, 2)) -> dict:
    """Fits of k = 2 .. ``k_max`` from the quantile start (seed 0) and from seeded rows, all in
    the scans of the slowest one: (k, seed) -> (centres, converged, inertia)."""
    z = cut_lineage(z.select("id_cliente", *[f"z_{f}" for f in features]))
    ks = range(2, min(k_max, z.count()) + 1)
    starts = {(k, 0): quantile_centers(z, features, k) for k in ks} | {(k, s): forgy_centers(z, features, k, s) for k in ks for s in seeds}
    return lloyd_many(z, features, starts)


def elbow_table(spark, fits: dict) -> DataFrame:
    """M7: the least inertia (2 dp) of each k."""
    best = {k: min(f[2] for (x, _), f in fits.items() if x == k) for k, _ in fits}
    return spark.createDataFrame(sorted(best.items()), "k int, inercia double").withColumn("inercia", round_even(F.col("inercia"), 2))


def best_fit(fits: dict, k: int) -> list[list[float]]:
    """M6: the centres of the fit of ``k`` with the least inertia (the first seed on ties),
    ordered by their coordinates."""
    centers = min(((f[2], seed, f[0]) for (x, seed), f in fits.items() if x == k), key=lambda t: t[:2])[2]
    return sorted(centers)


def assign(z: DataFrame, features, centers) -> DataFrame:
    """``z`` with the label of the nearest centre (the first on ties)."""
    return z.withColumn("cluster", _assign_expr([f"z_{f}" for f in features], centers)[0])


def _relabel(centers):
    """Old cluster id -> new id ordered by the first coordinate (then the others)."""
    order = sorted(range(len(centers)), key=lambda i: tuple(centers[i]))
    return {old: new for new, old in enumerate(order)}


def assemble(z: DataFrame, features, keep=("id_cliente",)) -> DataFrame:
    """Standardized columns as one vector column, checkpointed to the shared folder so
    that repeated fits read a small stored table instead of re-running the lineage."""
    zcols = [f"z_{f}" for f in features]
    cols = [c for c in keep if c in z.columns]
    vec = VectorAssembler(inputCols=zcols, outputCol="features").transform(z).select(*cols, *zcols, "features")
    return cut_lineage(vec)


def _fit_all(vec: DataFrame, configs, max_iter: int, tol: float = 1e-4):
    """Fit one KMeans per (k, seed); independent fits run as concurrent Spark jobs."""
    vec = vec.persist()  # one copy for all fits

    def fit(cfg):
        k, seed = cfg
        return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features",
                      predictionCol="raw_cluster").fit(vec)
    try:
        with ThreadPoolExecutor(max_workers=min(FIT_PARALLELISM, len(configs))) as pool:
            return list(pool.map(fit, configs))
    finally:
        vec.unpersist()


def kmeans(z: DataFrame, features, k: int, n_init: int = 10, seed: int = 42,
           max_iter: int = 300, tol: float = 1e-4):
    """M6: best of ``n_init`` Spark ML KMeans fits on the standardized vectors.

    Returns (rows with ``cluster``, centres in z units, training cost)."""
    vec = assemble(z, features, keep=("id_cliente", *features))
    models = _fit_all(vec, [(k, seed + i) for i in range(n_init)], max_iter, tol)
    model = min(models, key=lambda m: m.summary.trainingCost)
    cost = model.summary.trainingCost
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    mapping = _relabel(centers)
    relabel = F.element_at(F.array(*[F.lit(mapping[i]) for i in range(len(centers))]),
                           F.col("raw_cluster") + 1)
    out = (model.transform(vec).withColumn("cluster", relabel.cast("int"))
           .drop("raw_cluster", "features"))
    ordered = [centers[old] for old, _ in sorted(mapping.items(), key=lambda kv: kv[1])]
    return out, ordered, float(cost)


def elbow_curve(z: DataFrame, features, k_max: int = 8, n_init: int = 5, seed: int = 42,
                max_iter: int = 100) -> DataFrame:
    """M7: inertia (2 dp) for k = 2 .. min(k_max, rows)."""
    spark = z.sparkSession
    vec = assemble(z, features, keep=())
    n = vec.count()
    ks = list(range(2, min(k_max, n) + 1))
    models = _fit_all(vec, [(k, seed + i) for k in ks for i in range(n_init)], max_iter)
    rows = []
    for j, k in enumerate(ks):
        costs = [m.summary.trainingCost for m in models[j * n_init:(j + 1) * n_init]]
        rows.append((k, float(min(costs))))
    df = spark.createDataFrame(rows, "k int, inercia double")
    return df.withColumn("inercia", round_even(F.col("inercia"), 2))


def pca_2d(z: DataFrame, features) -> tuple[DataFrame, list[float]]:
    """M8: 2-D coordinates of the standardized rows and the explained-variance ratios
    (4 dp). Each component's sign is fixed so its largest-magnitude loading is positive."""
    if len(features) < 2:
        raise ValueError("PCA needs at least two features")
    zcols = [f"z_{f}" for f in features]
    vec = VectorAssembler(inputCols=zcols, outputCol="features").transform(z)
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(vec)
    pc = model.pc.toArray()
    signs = []
    for j in range(2):
        col = pc[:, j]
        idx = max(range(len(col)), key=lambda i: abs(col[i]))
        signs.append(1.0 if col[idx] >= 0 else -1.0)
    arr = vector_to_array(F.col("pca"))
    coords = (model.transform(vec)
              .withColumn("pca_x", arr[0] * signs[0]).withColumn("pca_y", arr[1] * signs[1])
              .drop("features", "pca"))
    ratios = [round(float(v), 4) for v in model.explainedVariance.toArray()]
    return coords, ratios


def centers_original_units(df: DataFrame, centers, features) -> DataFrame:
    """M9: centres back in feature units (c * std + mean), one row per cluster."""
    spark = df.sparkSession
    cdf = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centers)],
                                ["cluster"] + [f"z_{f}" for f in features])
    m = feature_moments(df, features).first()
    return cdf.select("cluster", *[(F.col(f"z_{f}") * float(m[f"{f}__std"] or 0.0)
                                    + float(m[f"{f}__mean"])).alias(f) for f in features])


def cluster_stats(labelled: DataFrame, features) -> DataFrame:
    """Per cluster size, mean and median (2 dp) of each feature."""
    aggs = [F.count(F.lit(1)).alias("n_clientes")]
    for f in features:
        aggs += [round_even(F.avg(f), 2).alias(f"{f}_mean"),
                 round_even(F.percentile(f, 0.5), 2).alias(f"{f}_median")]
    return labelled.groupBy("cluster").agg(*aggs)


def feature_ranges(df: DataFrame, features) -> DataFrame:
    """Global min and max of each feature, long form."""
    wide = df.agg(*[x for f in features for x in (F.min(f).alias(f"{f}__min"), F.max(f).alias(f"{f}__max"))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__min").cast("double").alias("min"),
                              F.col(f"{f}__max").cast("double").alias("max")) for f in features])
    return wide.select(F.inline(rows))


def interpret_segments(labelled: DataFrame, features) -> DataFrame:
    """M10: 'Label: level | …' per cluster from rounded means against global ranges."""
    stats = cluster_stats(labelled, features)
    parts = []
    for f in features:
        lo = labelled.select(F.min(f).cast("double")).scalar()
        hi = labelled.select(F.max(f).cast("double")).scalar()
        parts.append(F.concat(F.lit(FEATURE_LABELS.get(f, f) + ": "),
                              level_label(F.col(f"{f}_mean"), lo, hi)))
    return stats.select("cluster", F.concat_ws(" | ", *parts).alias("interpretacion"))


def segment_profile(labelled: DataFrame, features) -> DataFrame:
    """Segment size, share of customers (%, 2 dp) and feature means."""
    stats = cluster_stats(labelled, features)
    share = F.col("n_clientes").cast("double") / F.sum("n_clientes").over(Window.partitionBy()).cast("double") * 100
    return stats.select("cluster", "n_clientes", round_even(share, 2).alias("pct_clientes"),
                        *[f"{f}_mean" for f in features])


def segmentation_result(customers: DataFrame, features=FEATURES, k: int = 3,
                        tienda: int | None = None, n_init: int = 10) -> dict:
    """The bundle of labels, PCA coordinates, centres, stats, elbow and texts."""
    if tienda is not None:
        customers = customers.filter(F.col("id_tienda") == int(tienda))
    df = cut_lineage(select_features(customers, features))  # one row per customer, read many times
    validate_params(features, k, df.count())
    z = standardize(df, features)
    labelled, centers, cost = kmeans(z, features, k, n_init=n_init)
    out = {"labels": labelled.select("id_cliente", "cluster"),
           "centers": centers_original_units(df, centers, features),
           "stats": cluster_stats(labelled, features),
           "interpretation": interpret_segments(labelled, features),
           "inertia": cost,
           "elbow": elbow_curve(z, features)}
    if len(features) >= 2:
        coords, ratios = pca_2d(labelled, features)
        out["pca"] = coords.select("id_cliente", "cluster", "pca_x", "pca_y")
        out["pca_var"] = ratios
    return out
