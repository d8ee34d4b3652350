"""Published versions and derived tables that are raised by what a run adds."""

import os
import random

import pytest

from trolley import schemas as S
from trolley.operators import tables as TB
from trolley.operators.transform import product_lookup
from trolley.plans import etl as ETL
from trolley.plans import incremental
from trolley.sources import files as FS
from trolley.sources import registry_table as RG
from trolley.sources import versions
from trolley.sources.versions import Version
from trolley.streaming import ingest as ST

from test_ingest import LINES_A, LINES_B, catalogs, write

FLAT = incremental.FLAT


def lines_of(seed, n, months=("01", "02", "03"), customers=12):
    rng = random.Random(seed)
    return [f"2021-{rng.choice(months)}-{rng.randint(1, 9):02d}|{rng.choice([102, 103])}|{rng.randrange(customers)}|"
            + " ".join(str(rng.choice([1, 3, 6, 20, 29, 44, 50])) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def check_against_rebuild(spark, out):
    flat = FS.load_table(spark, out, FLAT)
    assert rows(FS.load_table(spark, out, "customer_features")) == rows(TB.customer_features(flat))
    assert rows(FS.load_table(spark, out, "product_freq")) == rows(TB.product_freq(flat))
    assert rows(FS.load_table(spark, out, "daily_summary")) == rows(TB.daily_summary(flat))


@pytest.fixture()
def shop(spark, tmpdir_path):
    cat, pc = catalogs(tmpdir_path + "/cat")
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"

    def run(**options):
        return ETL.run_etl(spark, land, cat, pc, out, refresh_rules=False, rules_params={"min_support": 0.3}, **options)
    return land, out, run


def test_raised_tables_equal_a_rebuild_after_overlapping_batches(spark, shop):
    land, out, run = shop
    first, second, third = lines_of(1, 60, ("01", "02")), lines_of(2, 60, ("02", "03")), lines_of(3, 40)
    for name, lines in (("a", first), ("b", second + first[:20]), ("c", third + second[30:] + ["2021-04-01|110|99|1 1 2"]), ("d", first)):
        write(land, name + ".csv", lines)
        assert run()
        check_against_rebuild(spark, out)
    flat = FS.load_table(spark, out, FLAT)
    now = versions.manifest(spark, out)
    assert now["version"] == 4 and now["settings"] == {"customer_buckets": incremental.BUCKETS}
    v = Version(spark, out)
    assert rows(v.load("visits", incremental.VISITS)) == rows(flat.select("id_cliente", "fecha", "id_tienda").distinct())
    assert rows(v.load("bought", incremental.BOUGHT)) == rows(flat.select("id_cliente", "id_producto", "nombre_categoria").distinct())
    assert rows(v.load("customer_stores", incremental.STORES)) == rows(flat.groupBy("id_cliente", "id_tienda").count())


def test_a_batch_reads_its_own_months_and_buckets_only(spark, shop, monkeypatch):
    land, out, run = shop
    write(land, "a.csv", lines_of(1, 80, customers=40))
    run()
    before = versions.manifest(spark, out)["tables"]
    seen = []
    load = Version.load
    monkeypatch.setattr(Version, "load", lambda v, name, schema, parts=None: seen.append((name, parts)) or load(v, name, schema, parts))
    write(land, "b.csv", ["2021-02-03|102|7|1 3 50", "2021-02-04|102|7|77"])
    run()
    mine = spark.range(1).selectExpr(f"pmod(xxhash64(7L), {incremental.BUCKETS}) as b").first()["b"]
    parts = {"daily_customers": ["2021-02"], "daily_categories": ["2021-02"], "customer_numbers": [mine], "transactions_flat": ["2021-02"], "visits": ["2021-02"], "bought": [mine], "customer_stores": [mine]}
    for name, wanted in parts.items():
        assert [p for n, p in seen if n == name] and all(p == wanted for n, p in seen if n == name), name
    # the whole customer table is only counted, the whole product table is one row per product
    assert sorted(n for n, p in seen if p is None) == ["customer_features", "product_freq"]
    after = versions.manifest(spark, out)["tables"]
    kept = {(t, p) for t in before for p in before[t] if after[t].get(p, [])[:len(before[t][p])] == before[t][p]}
    assert {("customer_features", p) for p in before["customer_features"] if p != str(mine)} <= kept
    assert {("daily_summary", "2021-01"), ("daily_summary", "2021-03"), ("transactions_flat", "2021-01"), ("visits", "2021-03")} <= kept
    check_against_rebuild(spark, out)


def test_a_crash_between_any_two_writes_leaves_the_old_version(spark, shop, monkeypatch):
    land, out, run = shop
    write(land, "a.csv", LINES_A)
    run()
    old = {t: rows(df.drop("antecedents", "consequents")) for t, df in FS.load_tables(spark, out).items()}
    registered = rows(RG.load_registry(spark, out))
    write(land, "b.csv", LINES_B)
    real, at = Version._write, 0
    for force in (False, True):
        at = 0
        while True:
            left = [at]

            def failing(self, *args):
                if not left[0]:
                    raise RuntimeError("executor lost")
                left[0] -= 1
                return real(self, *args)
            monkeypatch.setattr(Version, "_write", failing)
            # the last round passes every write and dies before the manifest is renamed
            monkeypatch.setattr(Version, "commit", lambda self, keep=5: (_ for _ in ()).throw(RuntimeError("driver lost")))
            with pytest.raises(RuntimeError) as e:
                run(force=force)
            assert {t: rows(df.drop("antecedents", "consequents")) for t, df in FS.load_tables(spark, out).items()} == old
            assert rows(RG.load_registry(spark, out)) == registered and versions.manifest(spark, out)["version"] == 1
            if "driver" in str(e.value):
                break
            at += 5 if force else 2
        assert at >= 8
    monkeypatch.undo()
    run()
    check_against_rebuild(spark, out)
    assert FS.load_table(spark, out, FLAT).count() == 13
    named = {f.split("/")[1] for fs in versions.manifest(spark, out)["tables"][FLAT].values() for f in fs}
    assert set(os.listdir(f"{out}/{FLAT}")) == named      # folders of the runs that died are gone


def test_of_two_runs_from_one_version_one_is_published(spark, tmpdir_path):
    df = spark.range(3).selectExpr("id as x")
    one, two = Version(spark, tmpdir_path), Version(spark, tmpdir_path)
    one.replace("t", df)
    two.replace("t", df.limit(1))
    assert one.commit() == 1
    with pytest.raises(versions.ConcurrentRun):
        two.commit()
    assert Version(spark, tmpdir_path).load("t", df.schema).count() == 3


def test_old_versions_expire_and_parts_merge(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(versions, "MERGE_AT", 2)
    schema = spark.range(1).schema
    for k in range(7):
        v = Version(spark, tmpdir_path)
        v.append("t", spark.range(k, k + 1).selectExpr("id", f"{k % 2} as p"), by=["p"], merge=lambda parts: v.load("t", schema, parts).selectExpr("id", f"{parts[0]} as p"))
        v.commit(keep=2)
    assert rows(Version(spark, tmpdir_path).load("t", schema)) == [(k,) for k in range(7)]
    assert rows(Version(spark, tmpdir_path).load("t", schema, [1])) == [(1,), (3,), (5,)]
    last = versions.manifest(spark, tmpdir_path)
    assert all(len(f) <= 2 for f in last["tables"]["t"].values())
    assert versions.published(spark, tmpdir_path) == ["v000000000006.json", "v000000000007.json"]
    named = {f.split("/")[1] for n in versions.published(spark, tmpdir_path) for fs in versions.manifest(spark, tmpdir_path, n)["tables"]["t"].values() for f in fs}
    assert set(os.listdir(tmpdir_path + "/t")) == named


def test_a_micro_batch_that_runs_again_counts_once(spark, tmpdir_path):
    cat, pc = catalogs(tmpdir_path + "/cat")
    lookup = ST.static_lookup(product_lookup(FS.read_categories(spark, cat), FS.read_product_category(spark, pc)))
    write(tmpdir_path + "/in", "a.csv", LINES_A)
    lines, out = FS.read_raw_lines(spark, tmpdir_path + "/in"), tmpdir_path + "/out"
    writer = ST.make_batch_writer(out, lookup, stream="s")
    writer(lines, 0)
    writer(lines, 0)
    assert RG.load_registry(spark, out).count() == 1 and versions.manifest(spark, out)["version"] == 1
    writer(lines, 1)    # another batch with the same lines: registered, no new item
    assert RG.load_registry(spark, out).count() == 2 and FS.load_table(spark, out, FLAT).count() == 10
    check_against_rebuild(spark, out)


def test_empty_landing_file_first(spark, shop):
    land, out, run = shop
    write(land, "a.csv", [""])
    assert run()
    tables = FS.load_tables(spark, out)
    assert all(df.count() == 0 for df in tables.values()) and tables[FLAT].columns == S.TRANSACTIONS_FLAT.fieldNames()
    write(land, "b.csv", LINES_A)
    run()
    check_against_rebuild(spark, out)


def test_measures_equal_the_item_scan(spark, shop):
    from trolley.operators import metrics as M
    from trolley.operators.transform import apply_filters
    from trolley.plans import reports as RP
    land, out, run = shop
    for name, lines in (("a", lines_of(1, 60, ("01", "02"), 70)), ("b", lines_of(2, 60, ("02", "03"), 90))):
        write(land, name + ".csv", lines)
        run()
    measures = incremental.load_measures(spark, out)
    for of in ((None, None, None), (103, "2021-02-01", "2021-03-03"), (None, "2021-01-05", "2021-01-05"), (999, None, None)):
        report = RP.measured_report(measures, *of, top_n=2)
        items = apply_filters(FS.load_table(spark, out, FLAT), *of)
        assert rows(report["summary"]) == rows(M.summary_kpis(items))
        assert rows(report["categories"]) == rows(M.category_counts(items)) and rows(report["category_evolution"]) == rows(M.category_evolution(items, 2))
        assert rows(report["daily"]) == rows(RP.daily_text(items))
    for df in measures.values():
        assert not any(FLAT in f for f in df.inputFiles())
    numbers = [r["numero"] for r in Version(spark, out).load("customer_numbers", incremental.NUMBERS).collect()]
    assert len(set(numbers)) == len(numbers) == FS.load_table(spark, out, "customer_features").count()


def test_day_bitmaps_are_made_behind_the_shuffle(spark):
    """What is shuffled are numbers: no aggregate (of 4 KB bitmaps) lies below the exchange."""
    visits = spark.range(3000).selectExpr("date_add(DATE '2020-01-01', CAST(id % 7 AS INT)) AS fecha", "CAST(id % 2 AS INT) AS id_tienda", "id * 50 + 1 AS numero")
    found = incremental.day_bitmaps(visits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan[plan.rindex("Exchange"):]
    assert found.selectExpr("sum(bitmap_count(bits))").first()[0] == 3000


def test_a_table_without_folders_costs_no_join(spark, tmpdir_path):
    from trolley.plans.joins import static_max_rows
    nothing = versions.read(spark, tmpdir_path, [], incremental.VISITS)
    assert static_max_rows(nothing) == 0 and nothing.schema.simpleString() == incremental.VISITS.simpleString()


def test_only_months_that_are_stored_are_looked_up(spark, shop, monkeypatch):
    land, out, run = shop
    first, second = lines_of(5, 40, ("01", "02")), lines_of(6, 40, ("03", "04"))
    write(land, "a.csv", first)
    run()
    met = []
    look = ETL.unseen_rows
    monkeypatch.setattr(ETL, "unseen_rows", lambda batch, stored: met.append(sorted({r.fecha.month for r in batch.collect()})) or look(batch, stored))
    write(land, "b.csv", second + first[:20])
    run()
    assert met and met[0] and set(met[0]) <= {1, 2}
    check_against_rebuild(spark, out)


def test_unseen_keys_take_one_shuffle_and_nulls_are_equal(spark):
    schema = "a long, b string"
    new = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, None), (None, "y"), (None, "z")], schema)
    stored = spark.createDataFrame([(2, None), (None, "y"), (9, "q")], schema)
    got = incremental.unseen(new, stored, ["a", "b"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "x"), (3, None), (None, "z")]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_many_customers_are_not_joined_before_the_lookup(spark, monkeypatch):
    stored, own = spark.range(9).toDF("id_cliente"), spark.range(3, 30).toDF("id_cliente")
    assert rows(incremental.of_customers(stored, own)) == [(c,) for c in range(3, 9)]
    monkeypatch.setattr(incremental, "checked_broadcast", lambda df: df)
    assert incremental.of_customers(stored, own) is stored


def test_a_product_whose_category_changes_counts_once(spark, tmpdir_path):
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"
    for n, (category, line) in enumerate([("1", "2021-01-01|102|7|20 21"), ("2", "2021-01-02|102|7|20 22"), ("2", "2021-01-03|102|8|20"), ("2", "2021-01-03|102|7|20")]):
        cat, pc = f"{tmpdir_path}/cat{n}", f"{tmpdir_path}/pc{n}"
        write(cat, "c.csv", ["1|ONE", "2|TWO"])
        write(pc, "p.csv", ["prod|cat", f"20|{category}", "21|1", "22|1"])
        write(land, f"{n}.csv", [line])
        assert ETL.run_etl(spark, land, cat, pc, out, refresh_rules=False)
        check_against_rebuild(spark, out)
    customers = {r["id_cliente"]: r for r in FS.load_table(spark, out, "customer_features").collect()}
    assert (customers[7]["n_productos_distintos"], customers[7]["n_categorias_distintas"]) == (3, 2)


def test_products_of_one_category_are_counted_without_a_shuffle(spark):
    def bought(rows):
        return spark.createDataFrame(rows, incremental.BOUGHT)

    def counted(new, old):
        pairs = bought(new + old).groupBy("id_producto", "nombre_categoria").count()
        return incremental.new_products(bought(new), bought(old), pairs)
    one = counted([(1, 10, "a"), (1, 11, "b"), (2, 10, "a")], [(3, 10, "a")])
    assert rows(one) == [(1, 10), (1, 11), (2, 10)]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    several = counted([(1, 10, "a"), (1, 10, "b"), (2, 10, "b"), (3, 10, "b"), (3, 11, "a")], [(2, 10, "a")])
    assert rows(several) == [(1, 10), (3, 10), (3, 11)]


def test_bought_is_ranged_and_made_distinct_in_one_shuffle(spark):
    keys = ["cubo", "id_cliente", "id_producto", "nombre_categoria"]
    schema = "cubo int, id_cliente long, id_producto long, nombre_categoria string"
    new = spark.createDataFrame([(0, 1, 5, "a"), (0, 1, 5, "a"), (0, 1, 6, None), (1, 2, 5, "a"), (None, None, 5, "a")], schema)
    old = spark.createDataFrame([(1, 2, 5, "a"), (0, 1, 6, None), (0, 9, 9, "z")], schema)
    left = incremental.unseen_in_ranges(new, old, keys, 3)
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, left.collect()), key=str) == [(0, 1, 5, "a"), (None, None, 5, "a")]


def test_visits_are_made_distinct_once(spark, shop, monkeypatch):
    land, out, run = shop
    seen, real = [], incremental.unseen

    def recorded(new, stored, keys):
        if "fecha" in keys:
            seen.append({f.split("/out/")[1].split("/")[0] for f in new.inputFiles()})
        return real(new, stored, keys)
    monkeypatch.setattr(incremental, "unseen", recorded)
    for name, seed in (("a", 1), ("b", 2)):
        write(land, name + ".csv", lines_of(seed, 40))
        run()
    assert seen == [{FLAT}, {"visits"}] * 2
    check_against_rebuild(spark, out)


def test_a_run_counts_days_and_rules_without_the_stored_items(spark, shop, monkeypatch):
    """Daily counts are raised; rules by a share take known counts and make baskets of frequent items."""
    from trolley.operators import rules as RU
    land, out, _ = shop
    cat, pc = catalogs(land.replace("landing", "cat"))

    def no_scan(*a, **k):
        raise AssertionError("counted from the items")
    seen, make = [], RU.baskets
    monkeypatch.setattr(TB, "daily_summary", no_scan)
    monkeypatch.setattr(RU, "baskets", lambda items, *a: seen.append(items) or make(items, *a))
    for name, lines in (("a", ["2021-01-01|102|1|3 6", "2021-01-02|102|2|3 20"]), ("b", ["2021-01-02|102|2|3 20 29", "2021-02-01|102|3|3 29", "2021-02-02|103|3|44"])):
        write(land, name + ".csv", lines)
        assert ETL.run_etl(spark, land, cat, pc, out, rules_params={"min_support": 0.6})
    assert seen == []       # one frequent product: nothing to combine
    write(land, "c.csv", ["2021-03-01|102|3|3 29"])
    assert ETL.run_etl(spark, land, cat, pc, out, rules_params={"min_support": 0.5})
    monkeypatch.undo()
    assert len(seen) == 1 and {r["id_producto"] for r in seen[0].collect()} == {3, 29}
    check_against_rebuild(spark, out)
    flat = FS.load_table(spark, out, FLAT)
    assert rows(FS.load_tables(spark, out)["association_rules"]) == rows(RU.compute_association_rules(flat, min_support=0.5)) != []


def test_lines_of_new_months_are_ranged_before_they_are_exploded(spark, shop, monkeypatch):
    land, out, run = shop
    seen, real = [], FS.append_flat
    monkeypatch.setattr(FS, "append_flat", lambda v, df, **how: seen.append((how.get("ranged", False), df.count())) or real(v, df, **how))
    write(land, "a.csv", ["2021-01-01|102|1|3 6 3", "2021-01-01|102|1|6 20"])
    run()
    write(land, "b.csv", ["2021-01-01|102|1|3 6", "2021-02-01|102|1|3 3"])
    run()
    write(land, "c.csv", ["2021-01-01|102|1|3 44 44"])
    run()
    assert seen == [(True, 5), (True, 2), (False, 2)]      # nothing left of January in b: not written
    assert FS.load_table(spark, out, FLAT).count() == 5
    check_against_rebuild(spark, out)


def test_plain_baskets_are_counted_as_token_by_token(spark, tmpdir_path):
    baskets = ["1 2 3", "", "  ", " 7  8 ", "9223372036854775807", "9223372036854775808", "1\t2", "+3 -4", "x 1", "000000000000000000001", "12345678901234567890 5"]
    write(tmpdir_path + "/in", "a.csv", [f"2021-01-01|102|1|{b}" for b in baskets])
    lines = FS.read_raw_lines(spark, tmpdir_path + "/in")
    assert {r["basket_raw"] for r in lines.filter(FS.plain_basket()).collect()} == {"1 2 3", "", "  ", " 7  8 "}
    assert rows(FS.file_stats(lines)) == [("a.csv", 3 + 2 + 1 + 2 + 2 + 1 + 1 + 1, 3)]
    assert {r["line"].split("|")[3] for r in FS.rejects(lines).collect()} == {"9223372036854775808", "x 1", "12345678901234567890 5"}
