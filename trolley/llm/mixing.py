"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a 62-bit key, a seeded hash of its id. The high bits of the key form
blocks of a source. A source is taken in whole passes over its blocks, then a partial pass
over a seeded permutation of them; the block in which the target falls is refined by further
key bits until few keys are left, which are taken first-fit. The draws of all sources are
then split over the output shards: at each node of a binary tree, a multivariate
hypergeometric draw divides the exact block quotas of all sources between the two halves. A
shard gets the next disjoint blocks of each source's permuted order and orders its documents
by a seeded hash.

The driver holds sums per block (at most ``max_blocks``), the quotas and, per source, at most
``max_units`` keys; documents never leave the executors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import others, stage, table

KEY_BITS = 62  # so that the end of a range is a long, too
WORDS = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0. Each word becomes one
    character, so no array of words is built."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACE)), WORDS, "x")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets of sources (in code point order, null last): ``share`` of all sizes divided by
    the repeating weights; a target above ``cap`` times its size stops there and the excess
    is shared again by weight among the others until none is above."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    size = np.array(sizes, dtype=float)
    out, free, left = np.zeros(len(size)), size > 0, share * size.sum()
    while free.any():
        give = left * w / w[free].sum()
        over = free & (give > cap * size)
        if not over.any():
            out[free] = give[free]
            break
        out[over] = cap * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def split_tree(quotas: Sequence[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) counts: the quotas divided among ``shards`` by recursive
    multivariate-hypergeometric draws. Columns sum to the quotas; rows differ by one at most."""
    quotas = np.asarray(quotas, dtype=np.int64)
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    n = int(quotas.sum()) * half // shards
    left = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    return np.vstack([split_tree(left, half, rng), split_tree(quotas - left, shards - half, rng)])


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """source key (never null), word count and document key; other columns are dropped."""
    return docs.select(F.col(doc_id).alias("doc_id"), *_keys(docs, doc_id, source, text, seed))


def _keys(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null")).alias("_source"),
            word_count(F.col(text)).alias("_size"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 64 - KEY_BITS).alias("_key")]


def plan_mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None,
             seed: int = 7, shard_words: int = 20_000_000, max_sources: int = 10_000, max_blocks: int = 65_536, max_units: int = 2_048,
             block_docs: int = 256) -> tuple[DataFrame, DataFrame]:
    """Plan tables of the mix of ``sized(_source, _size, _key)``, over ``shards`` output shards
    (None: 64, or more so that a shard has about ``shard_words`` words): per source (_source, _bits,
    _at, _cut, _picked, _shard, source_size, target) and per drawn block (_source, _block,
    _shards). Raises beyond ``max_sources`` sources."""
    spark = sized.sparkSession
    by_source = (sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
                 .limit(max_sources + 1).collect())
    if len(by_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    by_source.sort(key=lambda r: (r["_source"] == "null", r["_source"]))
    names, sizes = [r["_source"] for r in by_source], [r["size"] for r in by_source]
    target = targets(sizes, weights, share, cap)
    most = max_blocks // max(1, len(names))
    bits = [max(0, min(most, r["n"] // block_docs).bit_length() - 1) for r in by_source]

    schema = "_source string, _bits int"
    with_bits = sized.join(F.broadcast(spark.createDataFrame(list(zip(names, bits, strict=True)), schema)), "_source")
    sums = (with_bits.groupBy("_source", F.expr(f"shiftright(_key, {KEY_BITS} - _bits)").alias("block"))
            .agg(F.sum("_size").alias("words")).collect())
    words: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in sums:
        words[r["_source"]][r["block"]] = r["words"]

    rng = np.random.default_rng(seed)
    drawn: list[list[int]] = []     # per source: its blocks in drawing order, -1 for the refined one
    at, need = [-1] * len(names), [0.0] * len(names)
    for i, n in enumerate(names):
        blocks = sorted(words[n])
        order = [[blocks[k] for k in rng.permutation(len(blocks))] for _ in range(int(cap) + 2)]
        passes = int(target[i] // sizes[i]) if sizes[i] else 0
        draws = [b for p in order[:passes] for b in p]
        rest = target[i] - passes * sizes[i]
        for b in order[passes] if rest > 0 else []:
            if words[n][b] > rest:
                at[i], need[i] = b, rest
                draws.append(-1)
                break
            draws.append(b)
            rest -= words[n][b]
        drawn.append(draws)
    low, high = ([0] * len(names) for _ in range(2))
    for i, b in enumerate(at):
        width = KEY_BITS - bits[i]
        low[i], high[i] = max(b, 0) << width, (max(b, 0) + 1) << width
    open_ = [i for i, b in enumerate(at) if b >= 0]
    picked: list[list[int]] = [[] for _ in names]
    while open_:
        ranges = spark.createDataFrame([(names[i], low[i], high[i]) for i in open_], "_source string, low long, high long")
        inside = sized.join(F.broadcast(ranges), "_source").filter("_key >= low and _key < high")
        units = {r["_source"]: r["n"] for r in inside.groupBy("_source").agg(F.approx_count_distinct("_key").alias("n")).collect()}
        wide = [i for i in open_ if units.get(names[i], 0) > max_units and high[i] - low[i] >= 256]
        fine = [i for i in open_ if i not in wide]
        rows: dict[str, list] = {n: [] for n in names}
        if fine:
            last = inside.filter(F.col("_source").isin([names[i] for i in fine])).groupBy("_source", "_key").agg(F.sum("_size").alias("words"))
            for r in last.collect():
                rows[r["_source"]].append((r["_key"], r["words"]))
        for i in fine:
            for key, n in sorted(rows[names[i]]):
                if 0 < n <= need[i]:
                    picked[i].append(key)
                    need[i] -= n
        if wide:
            parts = (inside.filter(F.col("_source").isin([names[i] for i in wide]))
                     .groupBy("_source", F.expr("(_key - low) div ((high - low) div 256)").alias("part")).agg(F.sum("_size").alias("words")))
            for r in parts.collect():
                rows[r["_source"]].append((r["part"], r["words"]))
        for i in wide:
            step, base = (high[i] - low[i]) // 256, low[i]
            low[i] = high[i]  # all parts fit, unless one does not
            for part, n in sorted(rows[names[i]]):
                if n > need[i]:
                    low[i], high[i] = base + part * step, base + (part + 1) * step
                    break
                need[i] -= n
        open_ = [i for i in wide if low[i] < high[i]]

    shards = shards or max(64, int(sum(target) / shard_words))
    counts = split_tree([len(d) for d in drawn], shards, rng) if names else np.zeros((1, 0), int)
    block_rows: list[tuple] = []
    source_rows: list[tuple] = []
    for i, n in enumerate(names):
        of = np.repeat(np.arange(counts.shape[0]), counts[:, i]).tolist()
        places: dict[int, list[int]] = {}
        for b, s in zip(drawn[i], of, strict=True):
            places.setdefault(b, []).append(s)
        partial = places.pop(-1, [-1])[0]
        block_rows += [(n, b, s) for b, s in places.items()]
        source_rows.append((n, bits[i], at[i], low[i], picked[i], partial, sizes[i], float(target[i])))
    return (spark.createDataFrame(source_rows, "_source string, _bits int, _at long, _cut long, _picked array<long>, _shard int, source_size long, target double"),
            spark.createDataFrame(block_rows, "_source string, _block long, _shards array<int>"))


def _drawn(keyed: DataFrame, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``keyed`` with ``shards``, the output shard of each draw of the document. Both plan
    tables have a fixed bound (sources, blocks), so they are broadcast."""
    block = F.expr(f"shiftright(_key, {KEY_BITS} - _bits)")
    part = (F.col("_block") == F.col("_at")) & ((F.col("_key") < F.col("_cut")) | F.array_contains("_picked", F.col("_key")))
    return (keyed.join(F.broadcast(plan[0]), "_source", "left").withColumn("_block", block)
            .join(F.broadcast(plan[1]), ["_source", "_block"], "left")
            .withColumn("shards", F.concat(F.coalesce("_shards", F.array().cast("array<int>")),
                                           F.when(part, F.array("_shard")).otherwise(F.array().cast("array<int>")))))


def draw_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target, taken (words
    the mix takes of the document, repeats counted) and shards (one entry per draw).

    Null sources are one source, last in order; null and empty texts have size 0. Rows with
    one id (or null ids) have one key and are drawn together; repeated rows stay repeated.
    An empty table gives no rows. Reruns give the same draws, in any partitioning."""
    sized = stage(_sized(docs, doc_id, source, text, seed), "sized")
    plan = plan_mix(sized, seed=seed, **options)
    return (_drawn(sized, plan)
            .select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                    (F.col("_size") * F.size("shards")).alias("taken"), "shards"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, **options) -> DataFrame:
    """The mix itself: one row per draw with all columns of ``docs`` (but those called draw,
    shard or shard_order), draw (number of the document's draw), shard and shard_order; rows
    of a shard lie together, in the order of shard_order. Other cases as in draw_counts."""
    keep = others(docs, {"draw", "shard", "shard_order", "shards"})
    sized = stage(_sized(docs, doc_id, source, text, seed), "sized")
    plan = plan_mix(sized, seed=seed, **options)
    keyed = docs.select(F.struct(*keep).alias("_doc"), *_keys(docs, doc_id, source, text, seed))
    return (_drawn(keyed.drop("_size"), plan).select("_doc", "_key", F.posexplode("shards").alias("draw", "shard"))
            .withColumn("shard_order", F.xxhash64(F.lit(seed + 1), "shard", "draw", "_key"))
            .repartition("shard").sortWithinPartitions("shard", "shard_order")
            .select("_doc.*", "draw", "shard", "shard_order"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
