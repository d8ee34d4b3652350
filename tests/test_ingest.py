import os

import pytest

from trolley import schemas as S
from trolley.plans import etl as ETL
from trolley.sources import files as FS
from trolley.sources import registry_table as RG
from trolley.sources.versions import Version

LINES_A = ["2021-03-04|102|811|20 3 1", "2021-03-04|102|902|6 29 44 25 36", "2021-03-04|102|1|",
           "2021-03-04|102|2|   ", "2021-03-04|102|7|7 7 8"]
LINES_B = ["2021-03-05|103|811|20 3", "2021-03-04|102|7|7 8", "2020-12-31|103|9|1"]
BAD = ["2021-03-04|102", "2021-03-04|102|5|1 2|x|y", "notadate|102|5|1 2", "2021-03-04|102|9|7 x 8"]


def write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def catalogs(base):
    write(base, "Categories.csv", ["cat_id|cat_name", "1| Frutas ", "3|Lacteos", "3|Lacteos2", "20|Bebidas"])
    write(base, "ProductCategory.csv", ["p|c", "20|1", "6|3", "29|99"])
    return os.path.join(base, "Categories.csv"), os.path.join(base, "ProductCategory.csv")


def test_validate_counts_every_line(spark, tmpdir_path):
    write(tmpdir_path, "102_marzo.csv", LINES_A + BAD)
    v = FS.validate(FS.read_raw_lines(spark, tmpdir_path)).first()
    assert (v.n_lines, v.n_wrong_columns, v.n_bad_keys, v.n_bad_products, v.n_valid) == (9, 2, 1, 1, 5)
    assert v.valid_name and v.store_prefix == 102 and not v.accepted
    assert FS.read_transactions(spark, tmpdir_path).count() == 6  # bad product line kept, token dropped later


def test_missing_dir_raises(spark, tmpdir_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        FS.read_transactions(spark, tmpdir_path + "/none")


def test_catalogs_header_optional_last_wins(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path)
    cats = {r.cat_id: r.cat_name for r in FS.read_categories(spark, cat_path).collect()}
    assert cats == {1: "Frutas", 3: "Lacteos2", 20: "Bebidas"}
    pcs = {r.prod_id: r.cat_id for r in FS.read_product_category(spark, pc_path).collect()}
    assert pcs == {20: 1, 6: 3, 29: 99}


def test_preview(spark, tmpdir_path):
    write(tmpdir_path, "102_marzo.csv", LINES_A)
    head, stats = FS.preview_file(spark, os.path.join(tmpdir_path, "102_marzo.csv"))
    s = stats.first()
    assert head.count() == 5 and s.n_lines == 5 and s.n_columns == 4


def test_incremental_equals_full_and_rerun_is_noop(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    land, out_inc, out_full = tmpdir_path + "/landing", tmpdir_path + "/inc", tmpdir_path + "/full"
    write(land, "102_marzo.csv", LINES_A)
    params = {"sample_frac": 1.0, "min_support": 0.3, "min_confidence": 0.1}
    first = ETL.run_etl(spark, land, cat_path, pc_path, out_inc, rules_params=params)
    assert first["transactions_flat"].count() == 10  # 3 + 5 + (7, 8) after key dedupe
    write(land, "103_marzo.csv", LINES_B)
    ETL.run_etl(spark, land, cat_path, pc_path, out_inc, rules_params=params)
    assert ETL.run_etl(spark, land, cat_path, pc_path, out_inc) == {}
    ETL.run_etl(spark, land, cat_path, pc_path, out_full, rules_params=params)
    cols = ["fecha", "id_tienda", "id_cliente", "id_producto", "nombre_categoria"]
    inc = sorted(tuple(r) for r in FS.load_table(spark, out_inc, "transactions_flat").select(*cols).collect())
    full = sorted(tuple(r) for r in FS.load_table(spark, out_full, "transactions_flat").select(*cols).collect())
    assert inc == full and len(inc) == 13
    d_inc = sorted(tuple(r) for r in FS.load_table(spark, out_inc, "daily_summary").collect())
    d_full = sorted(tuple(r) for r in FS.load_table(spark, out_full, "daily_summary").collect())
    assert d_inc == d_full and len(d_inc) == 3  # 2021-03-04/102 was refreshed, two days added
    from trolley.operators import tables as TB
    stored_pf = sorted(tuple(r) for r in FS.load_table(spark, out_inc, "product_freq").collect())
    direct_pf = sorted(tuple(r) for r in TB.product_freq(FS.load_table(spark, out_inc, "transactions_flat")).collect())
    assert stored_pf == direct_pf
    cats = {r.id_producto: r.nombre_categoria for r in FS.load_table(spark, out_full, "transactions_flat").collect()}
    assert cats[20] == "Frutas" and cats[6] == "Lacteos2" and cats[29] == "SIN CATEGORIA" and cats[3] == "Lacteos2"
    assert cats[44] == "SIN CATEGORIA" and cats[1] == "Frutas"
    reg = RG.load_registry(spark, out_inc)
    # the items a file holds, repeats and rows that were stored already included
    assert {r.file_name: (r.rows, r.rejected) for r in reg.collect()} == {"102_marzo.csv": (11, 0), "103_marzo.csv": (5, 0)}
    st = RG.etl_status(reg).first()
    assert st.n_files == 2 and st.processed_files == ["102_marzo.csv", "103_marzo.csv"]
    tables = FS.load_tables(spark, out_inc)
    counts = {r.table: r.rows for r in FS.table_counts(tables).collect()}
    assert counts["transactions_flat"] == 13 and counts["customer_features"] == 4  # 811, 902, 7, 9 (1 and 2 only had empty baskets)
    assert FS.load_optional(spark, out_full, "nothing", tables["association_rules"].schema).count() == 0


def test_merge_policies(spark):
    import datetime as dt
    from trolley.operators.transform import merge_flat
    d = dt.date(2013, 7, 1)
    schema = "fecha date, id_tienda int, id_cliente long, id_producto long"
    first = spark.createDataFrame([(d, 102, 7, 7), (d, 102, 7, 7), (d, 102, 7, 8)], schema)
    second = spark.createDataFrame([(d, 102, 7, 8), (d, 103, 1, 1)], schema)
    assert merge_flat(None, first, "reference").count() == 3  # first load keeps the repeat
    assert merge_flat(None, first, "always").count() == 2
    assert merge_flat(merge_flat(None, first, "reference"), second, "reference").count() == 3
    assert merge_flat(merge_flat(None, first), second).count() == 3


def test_registry_json_roundtrip(spark, tmpdir_path):
    import json
    doc = {"processed_files": {"a.csv": {"processed_at": "2020-02-03T04:05:06.000007+00:00", "rows": 12},
                               "b.csv": {"processed_at": "2020-02-03T04:05:07.000008+00:00", "rows": 34}},
           "last_updated": "2020-02-03T04:05:07.000008+00:00"}
    path = os.path.join(tmpdir_path, "_registry.json")
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    reg = RG.import_registry_json(spark, path)
    assert {r.file_name: r.rows for r in reg.collect()} == {"a.csv": 12, "b.csv": 34}
    back = json.loads(RG.registry_document(reg).first().doc)
    assert {k: v["rows"] for k, v in back["processed_files"].items()} == {"a.csv": 12, "b.csv": 34}
    assert back["last_updated"].startswith("2020-02-03T04:05:07.000008")


def test_every_file_is_registered_and_rejects_are_kept(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"
    write(land, "a.csv", LINES_A + BAD)
    ETL.run_etl(spark, land, cat_path, pc_path, out, refresh_rules=False)
    write(land, "b.csv", LINES_A)       # no new row
    write(land, "c.csv", [""])          # no line
    write(land, "d.csv", BAD[:3])       # no usable line
    assert ETL.run_etl(spark, land, cat_path, pc_path, out, refresh_rules=False)
    assert ETL.run_etl(spark, land, cat_path, pc_path, out) == {}
    reg = {r.file_name: (r.rows, r.rejected) for r in RG.load_registry(spark, out).collect()}
    assert reg == {"a.csv": (13, 4), "b.csv": (11, 0), "c.csv": (0, 0), "d.csv": (0, 3)}
    rejects = FS.load_optional(spark, out, "rejects", S.REJECTS).collect()
    assert sorted((r.file_name, r.line, r.reason) for r in rejects) == sorted(
        [("a.csv", x, y) for x, y in zip(BAD, ["columns", "columns", "key", "product"])] + [("d.csv", x, y) for x, y in zip(BAD, ["columns", "columns", "key"])])
    assert FS.load_table(spark, out, "transactions_flat").count() == 12  # the bad line's usable products too


def test_bad_lines_can_fail_the_run(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"
    write(land, "a.csv", LINES_A + BAD[:1])
    with pytest.raises(ValueError, match="a.csv"):
        ETL.run_etl(spark, land, cat_path, pc_path, out, on_bad="fail")
    assert not FS.has_table(spark, out, "transactions_flat") and RG.load_registry(spark, out).count() == 0


def test_rerun_after_a_crash_and_force(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"
    write(land, "a.csv", LINES_A)
    write(land, "b.csv", LINES_B)
    lookup = ETL.product_lookup(FS.read_categories(spark, cat_path), FS.read_product_category(spark, pc_path))
    died = Version(spark, out)
    ETL.append_batch(died, ETL.new_items(FS.read_transactions(spark, land), lookup))  # and then the job dies
    assert not FS.has_table(spark, out, "transactions_flat")
    ETL.run_etl(spark, land, cat_path, pc_path, out, refresh_rules=False)
    assert FS.load_table(spark, out, "daily_summary").count() == 3 and FS.load_table(spark, out, "transactions_flat").count() == 13
    other = tmpdir_path + "/other"
    write(other, "c.csv", ["2022-01-01|110|3|5 6"])
    ETL.run_etl(spark, other, cat_path, pc_path, out, force=True, refresh_rules=False)
    assert RG.etl_status(RG.load_registry(spark, out)).first().processed_files == ["c.csv"]
    assert FS.load_table(spark, out, "transactions_flat").count() == 2 and FS.load_table(spark, out, "daily_summary").count() == 1


def test_anti_join_reads_only_the_months_of_the_batch(spark, tmpdir_path):
    cat_path, pc_path = catalogs(tmpdir_path + "/cat")
    land, out = tmpdir_path + "/landing", tmpdir_path + "/out"
    write(land, "a.csv", LINES_A + LINES_B)
    ETL.run_etl(spark, land, cat_path, pc_path, out, refresh_rules=False)
    month = Version(spark, out).load("transactions_flat", S.TRANSACTIONS_FLAT, ["2020-12"])
    assert month.count() == 1 and all("periodo=2020-12" in f for f in month.inputFiles())
    batch = FS.load_table(spark, out, "transactions_flat")
    assert ETL.unseen_rows(batch, batch.filter("id_cliente <> 9")).count() == 1
