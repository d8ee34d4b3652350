"""Merkle manifest against a plain build in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trolley.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """Root, and per leaf the siblings with their side, lowest level first."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(level):
                paths[k].append((p % 2, level[p ^ 1]))
            else:
                paths[k].append(None)
            at[k] = p // 2
        level = [H(*level[k:k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        mine = sorted(by[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = (mine, *tree([leaf(r) for r in mine]))
    root, upper = tree([built[n][1] for n in names]) if names else (None, [])
    out = []
    for name, up in zip(names, upper):
        mine, subroot, paths = built[name]
        for r, path in zip(mine, paths):
            whole = path + up
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for s in whole:
                h = H(h) if s is None else H(s[1], h) if s[0] else H(h, s[1])
            out.append((r[0], leaf(r), subroot, root, H(*(s[1] for s in whole if s)), h, h == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice([None, "s", "ü"]), rng.choices(langs, [9, *[1] * (len(langs) - 1)])[0], rng.choice([None, 5, 70]), "é x" * rng.randrange(3)) for k in range(n)]


CASES = {
    "one": [(7, "s", "en", 3, "abc")],
    "two trees of one": [(7, "s", "en", 3, "abc"), (8, "s", None, 3, "abc")],
    "three": rows_of(3, ["a"]),
    "256 and 257": rows_of(256, ["a"]) + [(k, "s", "b", 1, "t") for k in range(300, 557)],
    "many": rows_of(1500, ["en", None, "de", "", "Ω", "fr-long"]),
    "ties and nulls": [(5, "s", "en", 1, None)] * 40 + [(5, "s", "en", 2, "x")] * 3 + [(None, None, None, None, None)] * 5 + [(1, "1:2", "en", 1, "-"), (2, None, None, 1, "long " * 100_000)],
    "a tree each": [(k, "s", f"l{k}", 1, "t") for k in range(300)],
}


def run(spark, rows, tmp, extra=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        docs = docs.withColumns(extra)
    docs.write.parquet(tmp + "/documents.parquet")
    return merkle.op11_merkle(spark, tmp)


@pytest.mark.parametrize("case", CASES)
def test_against_plain_build(spark, tmpdir_path, case):
    got = run(spark, CASES[case], tmpdir_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(CASES[case])


def test_empty_and_clashing_columns(spark, tmpdir_path):
    assert run(spark, [], tmpdir_path + "/none").count() == 0
    clash = {"root": F.lit(1), "T": F.lit("x"), "pos": F.lit(2), "h": F.lit(3), "proof": F.lit(4), "row": F.lit(5), "salt": F.lit(6)}
    rows = rows_of(20, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clash).withColumn("leaf", F.sha2("text", 256))
    got = merkle.prove(docs, "lang", ["doc_id"])
    assert got.columns == ["doc_id", "source", "lang", "n_chars", "text", "T", "pos", "h", "row", "salt", "leaf", "subroot", "root", "proof"]
    ok = got.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert len(ok) == 20 and all(r["ok"] for r in ok)
