"""Removal of repeated passages against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import substring_dedup as SD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    least = {}
    words = [WORDS.findall(t or "") for _, t in rows]
    key = lambda i: (i is None, i or 0)
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            least[g] = min(least.get(g, (True, 1)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < key(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=120, words=15):
    """Texts of few words, so that windows meet often; with planted passages and copies."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in rng.sample(range(1000), n):
        w = rng.choices([f"w{k}" for k in range(words)], k=rng.randrange(60))
        if rng.random() < 0.4:
            a = rng.randrange(20)
            w[3:3] = passage[a:a + rng.randrange(2, 30)]
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(w)))
    rows += [(2000 + k, rows[0][1]) for k in range(20)]
    return rows


def run(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return SD.remove_repeats(docs, **options)


@pytest.mark.parametrize("seed,width,options", [(1, 13, {}), (2, 4, {"part_bytes": 8192, "block_bytes": 500}), (3, 8, {"part_bytes": 700, "block_bytes": 100}), (4, 2, {})])
def test_against_plain_loops(spark, seed, width, options):
    rows = corpus(seed)
    got = run(spark, rows, width=width, **options)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    want = plain(rows, width)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == want
    assert sum(r[2] for r in want) > 100


def test_nulls_ties_long_and_empty(spark):
    long = " ".join(f"x{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 30), (5, "a " * 12), (6, "a " * 13), (6, "a " * 13), (6, "a\xa0b " * 20), (7, long), (8, "y " + long), (None, long),
            (None, "only null " * 13), (None, "only null " * 13), (-5, "q r s " * 9), (9, "q r s " * 9), (10, "é 字 😀 " * 9), (11, "z 字 😀 é " * 4 + "é 字 😀 " * 7)]
    got = run(spark, rows, part_bytes=8192)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == plain(rows, 13)
    assert run(spark, rows).limit(0).count() == 0 and SD.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_and_extra_columns(spark):
    docs = spark.createDataFrame(corpus(6), "id long, body string").withColumns({
        "kept": F.lit("x"), "part": F.lit(1), "hashes": F.lit(2), "least": F.lit(3), "tags": F.array(F.lit("t"), F.lit(None))})
    got = SD.remove_repeats(docs, doc_id="id", text="body")
    assert got.columns == ["id", "body", "part", "hashes", "least", "tags", "n_words", "n_removed", "kept"]
    rows = got.collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str) == plain(corpus(6), 13)
    assert all(r["tags"] == ["t", None] for r in rows)


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 3000, 5000).astype(np.uint32)
    value, n = np.unique(sketch, return_counts=True)
    got = SD.estimates(value, sketch)
    assert (got >= n).all() and (got == n).mean() > 0.9


def test_texts_are_not_shuffled_after_they_are_dealt(spark):
    plan = run(spark, corpus(7))._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Scan parquet spark_catalog.default.parts_")
    # between the scans of the parts and the grouping there is a sort at most
    assert len(left) > 1 and all("hashpartitioning(_part" not in x for x in left)


def test_op13_keeps_clean_documents(spark):
    got = {r["doc_id"]: r for r in SD.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {i: (n, gone) for i, n, gone, _ in plain(rows, 13)} == {i: (r["n_words"], r["n_removed"]) for i, r in got.items()}
