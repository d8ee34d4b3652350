import datetime as dt
import re

import numpy as np
import pytest

from trolley.operators import neighbours, recommend as RC

SCHEMA = "fecha date, id_tienda int, id_cliente long, id_producto long, nombre_categoria string"
CATS = ["A", "B", "C", "D", "E"]


def flat(spark):
    d = dt.date(2013, 1, 1)
    rng = np.random.default_rng(7)
    rows = []
    for c in range(1, 31):
        for _ in range(int(rng.integers(1, 12))):
            rows.append((d, 102, c, 1, CATS[int(rng.integers(0, 5 if c % 3 else 3))]))
    return spark.createDataFrame(rows, SCHEMA)


def brute(spark, f, target, top_n=5, k=10):
    pdf = f.toPandas().groupby(["id_cliente", "nombre_categoria"]).size().unstack(fill_value=0)
    ids = list(pdf.index)
    sims = RC.cosine_matrix_check(pdf.values, ids.index(target))
    order = sorted((i for i in range(len(ids)) if ids[i] != target), key=lambda i: (-sims[i], ids[i]))[:k]
    own = set(pdf.columns[pdf.loc[target].values > 0])
    scores = {}
    for i in order:
        for cat in set(pdf.columns[pdf.iloc[i].values > 0]) - own:
            scores[cat] = scores.get(cat, 0.0) + sims[i]
    return sorted(((c, round(s, 4)) for c, s in scores.items()), key=lambda x: (-x[1], x[0]))[:top_n]


def test_exact_matches_brute_force(spark):
    f = flat(spark)
    for target in (3, 4, 9):
        got = [(r.categoria, r.score) for r in RC.recommend_for_customer(f, target, method="exact").collect()]
        assert got == brute(spark, f, target)


def test_unknown_customer_is_empty(spark):
    assert RC.recommend_for_customer(flat(spark), 999, method="exact").count() == 0


def test_batch_equals_single(spark):
    f = flat(spark)
    targets = spark.createDataFrame([(3,), (9,)], "id_cliente long")
    batch = RC.recommend_for_customers(f, targets).collect()
    for t in (3, 9):
        single = [(r.categoria, r.score) for r in RC.recommend_for_customer(f, t, method="exact").collect()]
        got = [(r.categoria, r.score) for r in sorted((r for r in batch if r.id_cliente == t), key=lambda r: r["rank"])]
        assert got == single


def test_batch_equals_single_with_few_overlapping_customers(spark):
    d = dt.date(2013, 1, 1)
    rows = [(d, 102, c, 1, "A") for c in range(1, 16)] + [(d, 102, c, 1, "B") for c in range(1, 4)]
    rows += [(d, 102, 100, 1, "Z"), (d, 102, 101, 1, "Z"), (d, 102, 101, 1, "B")]
    f = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([(100,), (2,)], "id_cliente long")
    batch = RC.recommend_for_customers(f, targets).collect()
    for t in (100, 2):
        single = [(r.categoria, r.score) for r in RC.recommend_for_customer(f, t, method="exact").collect()]
        got = [(r.categoria, r.score) for r in sorted((r for r in batch if r.id_cliente == t), key=lambda r: r["rank"])]
        assert got == single
    # customer 100 shares a category only with 101; nine zero-similarity neighbours fill up
    assert {c for c, _ in [(r.categoria, r.score) for r in batch if r.id_cliente == 100]} == {"A", "B"}


def test_svd_variant_excludes_owned_categories(spark):
    f = flat(spark)
    got = RC.recommend_for_customer(f, 3, method="svd").collect()
    own = {r.nombre_categoria for r in f.filter("id_cliente = 3").select("nombre_categoria").distinct().collect()}
    assert not {r.categoria for r in got} & own


def test_full_rank_svd_cosine_equals_exact(spark):
    f = flat(spark)
    counts = RC.customer_category_counts(f)
    exact = counts.select("id_cliente", counts.nombre_categoria.alias("dim"), counts.n.cast("double").alias("val"))
    reduced = RC.svd_vectors(counts, 50, cap_rank=False)
    a = {r.id_cliente: r.sim for r in RC.cosine_to_target(exact, 3).collect()}
    b = {r.id_cliente: r.sim for r in RC.cosine_to_target(reduced, 3).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "chunk": 4, "width": 0.3}])
def test_all_neighbours_against_brute_force(spark, options):
    """Clusters, many equal customers, proportional and disjoint counts, ties; whatever the cells."""
    rng = np.random.default_rng(8)
    rows = [(c, f"k{c % 4 * 5 + d}", int(n)) for c in range(60) for d, n in enumerate(rng.integers(0, 4, 5)) if n]
    rows += [(100 + c, "k1", 2) for c in range(25)] + [(200 + c, "k30", c + 1) for c in range(3)] + [(300, "k2", 0), (None, "k1", 5)]
    counts = spark.createDataFrame(rows, "id_cliente long, nombre_categoria string, n long")
    got = {}
    for r in neighbours.all_neighbours(counts, 7, **options).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append((r["id_cliente"], r["sim"]))
    of = {}
    for c, k, n in rows:
        if c is not None and n:
            of.setdefault(c, {})[k] = n
    norm = {c: np.sqrt(sum(n * n for n in v.values())) for c, v in of.items()}
    for t in of:
        sims = [(-sum(n * of[c].get(k, 0) for k, n in of[t].items()) / (norm[t] * norm[c]), c) for c in of if c != t]
        assert got[t] == [(c, -s) for s, c in sorted(sims)[:7]], t
    assert set(got) == set(of)
    assert 0 <= neighbours.pruned_share(counts, 7, **options) < 1
    assert neighbours.all_neighbours(counts.limit(0), 7).count() == 0
    assert neighbours.all_neighbours(counts.filter("id_cliente = 200"), 7).count() == 0


def test_clustered_customers_are_pruned(spark):
    """Twelve groups of customers without a common category: most pairs are never looked at."""
    rng = np.random.default_rng(9)
    rows = [(c, f"k{c % 12}_{d}", int(n)) for c in range(480) for d, n in enumerate(rng.integers(1, 30, 3))]
    counts = spark.createDataFrame(rows, "id_cliente long, nombre_categoria string, n long")
    assert neighbours.pruned_share(counts, 5) > 0.7


def test_many_distinct_customers_meet_as_matrices(spark):
    """A chunk of targets meets its members in one product, categories in slices, over several blocks."""
    rng = np.random.default_rng(10)
    n = rng.integers(0, 6, (1200, 9)) * (rng.random((1200, 9)) < 0.7)
    n[:, 0] += 1
    left = tuple(np.concatenate(x) for x in zip(*((np.full(k.size, r), k, n[r][k]) for r, k in ((r, np.flatnonzero(n[r])) for r in range(1200))), strict=True))
    whole, neighbours.COLUMNS = neighbours.COLUMNS, 4
    try:
        assert (neighbours.dots(left, 1200, left, 1200) == n @ n.T).all()
    finally:
        neighbours.COLUMNS = whole
    rows = [(int(c), f"k{d}", int(n[c, d])) for c in range(1200) for d in np.flatnonzero(n[c])]
    counts = spark.createDataFrame(rows, "id_cliente long, nombre_categoria string, n long")
    got = {}
    for r in neighbours.all_neighbours(counts, 5, chunk=40).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["id_cliente"])
    norm = np.sqrt((n * n).sum(1))
    far = -((n @ n.T) / (norm[:, None] * norm))
    np.fill_diagonal(far, np.inf)
    assert all(got[c] == np.lexsort((np.arange(1200), far[c]))[:5].tolist() for c in range(1200))


def test_svd_similarities_in_the_row_equal_the_long_form(spark):
    counts = RC.stored_counts(flat(spark))
    want = {r.id_cliente: r.sim for r in RC.cosine_to_target(RC.svd_vectors(counts, 2), 3).collect()}
    sims = RC.svd_similarities(counts, 3, 2)
    got = {r.id_cliente: r.sim for r in sims.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert "Exchange" not in sims._jdf.queryExecution().executedPlan().toString()
    assert RC.svd_similarities(counts, 10 ** 9, 2).count() == 0


def test_members_are_packed_small_and_looked_at_in_single_precision(spark):
    """Blocks travel in the smallest types; far more pairs are looked at than worked out exactly."""
    rng = np.random.default_rng(11)
    n = rng.poisson(1.6, (900, 25))
    n[:, 0] += 1
    row, cat = np.nonzero(n)
    norm = np.sqrt((n * n).sum(1).astype(float))

    def block(low, high):
        part = (row >= low) & (row < high)
        sizes = np.bincount(row[part] - low, minlength=high - low)
        packed = {"chunk": neighbours._bytes(np.arange(low, high) // 100), "norm": neighbours._bytes(norm[low:high]), "size": neighbours._bytes(sizes),
                  "cat": neighbours._bytes(cat[part]), "n": neighbours._bytes(n[row[part], cat[part]]), "n_ids": neighbours._bytes(np.ones(high - low, dtype=int)),
                  "ids": np.arange(low, high).tobytes()}
        assert len(packed["cat"]) + len(packed["n"]) == 2 * (part.sum() + 1)
        return neighbours.Block(packed)
    chunks = {"cell": np.zeros(9, dtype=int), "lo": np.zeros(9), "hi": np.full(9, np.pi / 2), "size": np.full(9, 100), "block": np.repeat([0, 1], [4, 5])}
    mine, other = block(0, 400), block(400, 900)
    best = neighbours.Nearest(mine, block(0, 1), chunks, 5)
    exact, among = [], best._among
    best._among = lambda *a: exact.append(len(a[1]) * len(a[4])) or among(*a)
    for members in (mine, other):
        for low, high, _ in mine.groups(chunks["cell"]):
            best.meet(low, high, members, best.open(low, high, chunks, np.array(list(members.runs))))
    far = -((n[:400] @ n.T) / (norm[:400, None] * norm))
    assert (best.id == np.array([np.lexsort((np.arange(900), f))[:6] for f in far])).all()
    assert best.looked == 400 * 900 and sum(exact) < 400 * 600
    assert (np.frombuffer(neighbours._bytes(np.array([3, 300]))[1:], np.uint16) == [3, 300]).all()


def test_blocks_are_not_put_together_by_their_size(spark):
    chunks = {"block": np.repeat(np.arange(6), 2)}
    blocks = spark.createDataFrame([], f"{neighbours.PACKED}, {neighbours.FOUND}")
    met = neighbours._met(blocks, chunks, [], 3)
    assert re.search(r"RepartitionByExpression \[target#\d+\], 24\b", met._jdf.queryExecution().analyzed().toString())


def test_neighbours_meet_their_target_as_one_row(spark):
    """Categories of neighbours are not exploded before the target's own ones are gone; null and repeated
    categories, targets without categories and neighbours without counts are kept as they were."""
    counts = spark.createDataFrame([(1, "A", 2), (2, "A", 1), (2, "B", 1), (2, None, 3), (2, "B", 4), (3, "C", 1), (3, "Z", 0), (None, "D", 1)],
                                   "id_cliente long, nombre_categoria string, n long")
    nbrs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (9, 2, 0.125), (1, 77, 1.0)], "target long, id_cliente long, sim double")
    own = spark.createDataFrame([(1, "A"), (1, None)], "target long, nombre_categoria string")
    scored = RC.score_targets(counts, nbrs, own, 5)
    got = sorted(((r.id_cliente, r["rank"], r.categoria, r.score) for r in scored.collect()))
    assert got == [(1, 1, "B", 1.0), (1, 2, None, 0.5), (1, 3, "C", 0.25), (9, 1, "B", 0.25), (9, 2, None, 0.125), (9, 3, "A", 0.125)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 0 and plan.index("Generate explode") < plan.index("Join LeftOuter")
