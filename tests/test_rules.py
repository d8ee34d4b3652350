import itertools
import random
import re
import datetime as dt

from trolley.operators import rules as RU

TOY = [[1, 2, 3], [1, 2, 3], [1, 2], [2, 3], [1, 3, 4], [1, 2, 3, 4]]


def brute_force(baskets, min_support, min_conf):
    n = len(baskets)
    items = sorted({i for b in baskets for i in b})
    freq = {}
    for size in range(1, len(items) + 1):
        for combo in itertools.combinations(items, size):
            c = sum(1 for b in baskets if set(combo) <= set(b))
            if c / n >= min_support:
                freq[combo] = c
    rules = {}
    for x, fx in freq.items():
        if len(x) < 2:
            continue
        for k in range(1, len(x)):
            for a in itertools.combinations(x, k):
                cons = tuple(i for i in x if i not in a)
                conf = fx / freq[a]
                if conf >= min_conf:
                    rules[(a, cons)] = (fx / n, conf, conf / (freq[cons] / n))
    return freq, rules


def toy_baskets(spark):
    return spark.createDataFrame([(i, b) for i, b in enumerate(TOY)], "bid long, items array<long>")


def test_itemsets_and_all_rules_match_brute_force(spark):
    bk = toy_baskets(spark)
    fi = RU.frequent_itemsets(bk, 0.3)
    got_fi = {tuple(r["items"]): r.freq for r in fi.collect()}
    exp_fi, exp_rules = brute_force(TOY, 0.3, 0.0)
    assert got_fi == exp_fi and len(got_fi) == 11
    rules = RU.association_rules(fi, len(TOY), 0.0).collect()
    got = {(tuple(r.antecedents), tuple(r.consequents)): (r.support, r.confidence, r.lift) for r in rules}
    assert set(got) == set(exp_rules) and len(got) == 22
    assert sum(1 for a, c in got if len(c) > 1) == 6
    for key, (s, c, li) in exp_rules.items():
        assert abs(got[key][0] - s) < 1e-9 and abs(got[key][1] - c) < 1e-9 and abs(got[key][2] - li) < 1e-9


def test_rule_invariants(spark):
    bk = toy_baskets(spark)
    fi = RU.frequent_itemsets(bk, 0.3)
    rules = RU.association_rules(fi, len(TOY), 0.5).collect()
    for r in rules:
        assert r.confidence >= 0.5
        assert sorted(r.antecedents) == list(r.antecedents) and not set(r.antecedents) & set(r.consequents)
    by_key = {(tuple(r.antecedents), tuple(r.consequents)): r for r in RU.association_rules(fi, len(TOY), 0.0).collect()}
    for (a, c), r in by_key.items():  # lift symmetric under swapping the sides
        assert abs(r.lift - by_key[(c, a)].lift) < 1e-9


def test_no_itemsets_gives_empty_rules_with_schema(spark):
    bk = toy_baskets(spark)
    fi = RU.frequent_itemsets(bk, 0.99)
    rules = RU.association_rules(fi, len(TOY), 0.3)
    assert rules.count() == 0 and rules.columns == ["antecedents", "consequents", "support", "confidence", "lift"]


def test_a_64_item_itemset(spark):
    x = list(range(1, 65))
    sets = [(x, 6)] + [([i for i in x if i != k], 8) for k in x] + [([k], 10) for k in x]
    fi = spark.createDataFrame(sets, "items array<long>, freq long")
    rules = RU.association_rules(fi, 20, 0.7).collect()
    assert sorted((len(r.antecedents), r.consequents[0], r.confidence, r.lift) for r in rules) == [(63, k, 0.75, 1.5) for k in x]


def test_consequents_grow_past_one_level(spark):
    rows = [(i, b) for i, b in enumerate([[1, 2, 3, 4, 5]] * 8 + [[1], [2, 3]])]
    fi = RU.frequent_itemsets(spark.createDataFrame(rows, "bid long, items array<long>"), 0.5)
    _, want = brute_force([b for _, b in rows], 0.5, 0.85)
    got = {(tuple(r.antecedents), tuple(r.consequents)) for r in RU.association_rules(fi, len(rows), 0.85).collect()}
    assert got == set(want) and max(len(c) for _, c in got) == 4


def test_recommend_for_product_and_profile(spark):
    fi = RU.frequent_itemsets(toy_baskets(spark), 0.3)
    rules = RU.association_rules(fi, len(TOY), 0.0)
    top = RU.recommend_for_product(rules, 4, 3).collect()
    assert len(top) == 3 and all(4 in r.antecedents for r in top)
    assert [r.lift for r in top] == sorted([r.lift for r in top], reverse=True)
    assert RU.rules_profile(rules).first().n_rules == 22
    assert [r.id_producto for r in RU.rule_products(rules).collect()] == [1, 2, 3, 4]


def test_hash_sample_is_deterministic_and_close_to_fraction(spark):
    d = dt.date(2013, 1, 1)
    df = spark.createDataFrame([(d, 102, i) for i in range(20000)], "fecha date, id_tienda int, id_cliente long")
    a = RU.hash_sample(df, 0.3)
    n1, n2 = a.count(), RU.hash_sample(df.repartition(7), 0.3).count()
    assert n1 == n2 and abs(n1 / 20000 - 0.3) < 0.02
    assert RU.hash_sample_threshold(0.3) == "4ccccccd"


def test_exact_sample_has_the_exact_size_and_is_stable(spark):
    import datetime as dt
    import hashlib
    from trolley.operators import rules as RU
    rows = [(dt.date(2021, 1, 1 + k % 28), 102 + k % 3, k, k % 7) for k in range(997)]
    df = spark.createDataFrame(rows, "fecha date, id_tienda int, id_cliente long, x int")
    digest = lambda r: hashlib.md5(f"{r[0].isoformat()}|{r[1]}|{r[2]}".encode()).hexdigest()[:15]
    for frac in (0.0, 0.001, 0.3, 0.5, 0.999, 1.0):
        want = sorted(sorted(rows, key=digest)[:round(frac * 997)])
        for parts in (1, 9):
            assert sorted(tuple(r) for r in RU.exact_sample(df.repartition(parts), frac).collect()) == want
    same = spark.createDataFrame([rows[0]] * 10 + rows[1:6], df.schema)     # equal digests
    assert RU.exact_sample(same, 0.5).count() == 8 and RU.exact_sample(df.limit(0), 0.5).count() == 0


def test_support_as_a_number_of_baskets(spark):
    """Sets that two baskets hold form rules, whatever the number of baskets."""
    rows = [(dt.date(2020, 1, 1), 1, c, p) for c in range(500) for p in ((1, 2) if c in (7, 9) else (3, 4) if c == 8 else (c + 10,))]
    items = spark.createDataFrame(rows, "fecha date, id_tienda int, id_cliente long, id_producto long")
    found = RU.compute_association_rules(items, min_baskets=2, min_confidence=0.05).collect()
    assert sorted((r["antecedents"], r["consequents"], r["support"]) for r in found) == [([1], [2], 0.004), ([2], [1], 0.004)]


def test_sets_of_two_baskets_equal_fp_growth(spark):
    rng = random.Random(5)
    bk = spark.createDataFrame([(sorted(rng.sample(range(40), rng.randint(1, 7))),) for _ in range(120)], "items array<long>")
    few = {(tuple(r["items"]), r["freq"], r["support"]) for r in RU.itemsets_of_few(bk, 2, 120).collect()}
    assert few == {(tuple(r["items"]), r["freq"], r["support"]) for r in RU.frequent_itemsets(bk, 1.5 / 120, 120).collect()}
    assert any(len(items) > 2 for items, _, _ in few)


def test_items_of_few_pairs_are_not_paired_again(spark, monkeypatch):
    """{1, 2, 3} comes twice; 8 and 9 have one frequent pair only, so no larger set holds them."""
    seen = []
    fit = RU.frequent_itemsets
    monkeypatch.setattr(RU, "frequent_itemsets", lambda bk, *a: seen.extend(r["items"] for r in bk.collect()) or fit(bk, *a))
    made = [[1, 2, 3, 8, 9], [1, 2, 3], [8, 9, 4], [4, 5]]
    got = RU.itemsets_of_few(spark.createDataFrame([(b,) for b in made], "items array<long>"), 2, len(made)).collect()
    assert sorted((r["items"], r["freq"]) for r in got) == [([1], 2), ([1, 2], 2), ([1, 2, 3], 2), ([1, 3], 2), ([2], 2), ([2, 3], 2), ([3], 2), ([4], 2), ([8], 2), ([8, 9], 2), ([9], 2)]
    assert sorted(seen) == [[1, 2, 3], [1, 2, 3]]


def test_fp_growth_gets_frequent_items_only(spark, monkeypatch):
    got, real = [], RU.FPGrowth.fit
    monkeypatch.setattr(RU.FPGrowth, "fit", lambda self, df: got.append(sorted(tuple(sorted(r["items"])) for r in df.collect())) or real(self, df))
    bk = spark.createDataFrame([([1, 2, 9],), ([1, 2, 8],), ([1, 7],), ([6],)], "items array<long>")
    assert sorted((tuple(r["items"]), r["freq"], r["support"]) for r in RU.frequent_itemsets(bk, 0.5).collect()) == [
        ((1,), 3, 0.75), ((1, 2), 2, 0.5), ((2,), 2, 0.5)]
    assert got == [[(), (1,), (1, 2), (1, 2)]]
    assert [(tuple(r["items"]), r["freq"]) for r in RU.frequent_itemsets(bk, 0.75).collect()] == [((1,), 3)]
    assert RU.frequent_itemsets(bk, 1.0).count() == 0 and len(got) == 1     # nothing to grow: not run
    monkeypatch.setattr(RU, "MOST_FREQUENT", 1)
    assert RU.frequent_itemsets(bk, 0.5).count() == 3 and (6,) in got[-1]


def test_a_null_basket_does_not_count_as_filled(spark):
    bk = spark.createDataFrame([([1],), ([1, 2],), ([2],), (None,)], "items array<long>")
    found = {tuple(r["items"]): (r["freq"], r["support"]) for r in RU.frequent_itemsets(bk, 0.6).collect()}
    assert found == {(1,): (2, 0.5), (2,): (2, 0.5)}


def test_itemsets_of_types_read_stored_baskets(spark, monkeypatch):
    """The baskets are made once; parts beyond the bounds of a broadcast are not broadcast by their file size."""
    from trolley import registry

    seen = []
    monkeypatch.setattr(registry.RU, "frequent_itemsets", lambda bk, *a, f=RU.frequent_itemsets: seen.append(bk) or f(bk, *a))
    assert registry.frequent_itemsets_types(spark, "/root/testdata/sf0.001").count() > 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan
    monkeypatch.setattr(registry, "is_bounded", lambda df: False)
    plan = registry._part_items(spark, "/root/testdata/sf0.001", "p_type")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[id_producto#\d+L?\], \[p_partkey#\d+L?\]", plan)
