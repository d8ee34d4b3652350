import pytest
from pyspark.sql import functions as F

from trolley.functions.labels import level_label
from trolley.operators import segments as SG

FEATS = ["frecuencia", "n_productos_distintos", "volumen_total", "n_categorias_distintas"]


def customers(spark, n=60):
    rows = [(i, 1 + i % 7, 2 + (i * 3) % 11, 5 + (i * 7) % 23, 3) for i in range(n)]
    return spark.createDataFrame(rows, "id_cliente long, frecuencia long, n_productos_distintos long, "
                                       "volumen_total long, n_categorias_distintas long")


def test_zscore_population_and_zero_variance(spark):
    z = SG.standardize(customers(spark), FEATS).toPandas()
    assert (z["z_n_categorias_distintas"] == 0).all()
    v = z["frecuencia"]
    expected = ((v - v.mean()) / v.std(ddof=0)).round(6)
    assert (abs(z["z_frecuencia"] - expected) < 1e-6).all()


def test_level_label_bounds(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (5.0, 5.0, 5.0), (3.9, 0.0, 10.0)],
                               "v double, lo double, hi double")
    got = [r.l for r in df.select(level_label(F.col("v"), F.col("lo"), F.col("hi")).alias("l")).collect()]
    assert got == ["muy bajo", "muy alto", "moderado", "bajo"]


def test_params_validated():
    with pytest.raises(ValueError):
        SG.validate_params(["frecuencia"], 9)
    with pytest.raises(ValueError):
        SG.validate_params(["nope"], 3)
    with pytest.raises(ValueError):
        SG.validate_params(FEATS, 4, n_rows=3)


def test_lloyd_invariants(spark):
    z = SG.standardize(customers(spark), FEATS)
    seg, centers = SG.lloyd_kmeans(z, FEATS, 3, iterations=5)
    pdf = seg.toPandas()
    assert len(pdf) == 60 and set(pdf.cluster) <= {0, 1, 2}
    import numpy as np
    zs = pdf[[f"z_{f}" for f in FEATS]].to_numpy()
    c = np.array(centers)
    d2 = ((zs[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (d2.argmin(axis=1) == pdf.cluster.to_numpy()).all()
    assert abs(d2.min(axis=1).sum() - pdf.dist2.sum()) < 1e-6


def test_kmeans_ml_invariants_and_elbow(spark):
    z = SG.standardize(customers(spark), FEATS)
    seg, centers, cost = SG.kmeans(z, FEATS, 3, n_init=3)
    pdf = seg.toPandas()
    assert len(pdf) == 60 and sorted(pdf.cluster.unique()) == [0, 1, 2]
    first = [c[0] for c in centers]
    assert first == sorted(first)  # relabelled by the first coordinate
    elbow = SG.elbow_curve(z, FEATS, k_max=5, n_init=2).orderBy("k").toPandas()
    assert list(elbow.k) == [2, 3, 4, 5]
    assert all(b <= a * 1.01 + 1e-9 for a, b in zip(elbow.inercia, elbow.inercia[1:]))


def test_pca_ratios_and_result_bundle(spark):
    out = SG.segmentation_result(customers(spark), FEATS, k=3, n_init=2)
    assert out["labels"].count() == 60 and out["stats"].count() == 3
    r = out["pca_var"]
    assert all(0 <= x <= 1 for x in r) and sum(r) <= 1.0001
    assert out["stats"].agg(F.sum("n_clientes")).first()[0] == 60
    assert out["interpretation"].filter(F.col("interpretacion").contains("Frecuencia de Compra: ")).count() == 3


def test_many_fits_at_once_equal_single_fits(spark):
    z = SG.standardize(customers(spark), FEATS)
    starts = {(k, s): SG.forgy_centers(z, FEATS, k, s) for k in (2, 3, 5) for s in (1, 2)} | {("q", 3): SG.quantile_centers(z, FEATS, 3)}
    fits = SG.lloyd_many(z, FEATS, starts)
    seg, centers = SG.lloyd_kmeans(z, FEATS, 3)
    assert fits["q", 3][0] == centers and fits["q", 3][1]
    assert abs(fits["q", 3][2] - seg.agg(F.sum("dist2")).first()[0]) < 1e-9
    import numpy as np
    points = z.select(*[f"z_{f}" for f in FEATS]).toPandas().to_numpy()
    for (k, _), (c, converged, inertia) in fits.items():
        d2 = ((points[:, None, :] - np.array(c)[None, :, :]) ** 2).sum(axis=2)
        assert converged and abs(d2.min(axis=1).sum() - inertia) < 1e-6
        for j in range(len(c)):     # a converged centre is the mean of its rows
            own = points[d2.argmin(axis=1) == j]
            assert not len(own) or np.abs(own.mean(axis=0) - c[j]).max() < 1e-5
    assert SG.lloyd_many(z, FEATS, {}) == {}
    table = SG.elbow_table(spark, SG.elbow_fits(z, FEATS, k_max=4)).collect()
    assert [r.k for r in table] == [2, 3, 4] and all(a.inercia >= b.inercia for a, b in zip(table, table[1:]))


def test_sums_of_a_batch_of_points(spark):
    import pandas as pd
    points = [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0), (4.0, 4.0)]
    fits = [[[0.0, 0.0], [1.0, 0.0]], [[4.0, 4.0]]]
    (out,) = SG._batch_sums(fits)([pd.DataFrame(points)])
    got = {(r.fit, r.cluster): (r.n, r.s, r.dist2) for r in out.itertuples()}     # ties: the first centre
    assert got == {(0, 0): (2, [0.5, 0.0], 0.25), (0, 1): (2, [5.0, 4.0], 25.0), (1, 0): (4, [5.5, 4.0], 32.0 + 25.0 + 12.25 + 16.0)}
