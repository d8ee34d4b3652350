"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed five-word shingles; documents with equal sets are one class.
Rows of MinHash values are cut into bands; the number of bands is chosen for the target recall
at the threshold. The shuffle is on band hashes: each bucket links its members to its
smallest one, and the connected components of these links are the candidate groups. Inside a
group all pairs are verified on the full sets: the group is dealt in chunks, a task holds two
chunks, and returns counts and a spanning forest, never pairs. So a group of thousands of
near copies is neither gathered in one task nor written out as pairs."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.plans.joins import checked_broadcast

from .common import bounded_batches, components, link_facts, roots, stage, table

PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the longest rows for which at most ``most`` hashes find a pair at the
    threshold with probability ``recall``."""
    best = (most, 1)
    for r in range(1, most + 1):
        miss = 1 - threshold ** r
        b = math.ceil(math.log(1 - recall) / math.log(miss))
        if b * r > most:
            break
        best = (b, r)
    return best


def word_table() -> np.ndarray:
    """1 for the word characters (letters, marks, digits, underscore) of the BMP."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" or c == 95 for c in range(0x10000)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, words: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of the lower-cased text, without a loop over words: words are
    segments of one running sum of character times power."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    inside = np.zeros(len(cp) + 2, dtype=np.int8)
    inside[1:-1] = words[np.minimum(cp, 0xFFFF)] | (cp > 0xFFFF)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(cp)) - start[np.maximum(np.cumsum(edge[:-1] == 1) - 1, 0)]     # within its word
    power = powers(int((end - start).max()) + 1)
    value = np.where(inside[1:-1] > 0, (cp.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, len(power) - 1)], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mixed(total[end] - total[start] + (end - start).astype(np.uint64))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, PRIME, dtype=np.uint64))


def shingle_set(text: str | None, words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles. A text of fewer words is one
    shingle; one without words is one shingle of its characters; a null or blank text has none."""
    if text is None or not text.strip():
        return np.zeros(0, np.uint64)
    w = word_hashes(text, words)
    if not len(w):
        return np.array([int.from_bytes(blake2b(text.strip().encode("utf-8", "replace"), digest_size=8).digest())], dtype=np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * PRIME + w[i:len(w) - k + 1 + i]
    return np.unique(mixed(h))


def set_id(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2 ** 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2 ** 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(x), 512):
            v = self.a * x[k:k + 512]
            v += self.b
            np.minimum(low, v.min(1), out=low)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            h = mixed(h * PRIME + low[r::self.rows])
        return h.view(np.int64)


def overlap(a: list[np.ndarray], b: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as a matrix."""
    sizes = [len(s) for s in a + b]
    value, at = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(at)[at] > 1
    value, at = np.unique(at[often], return_inverse=True)
    row = row[often]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for start in range(0, len(value), block):
        lo, hi = np.searchsorted(at, [start, start + block])
        part = np.zeros((len(sizes), min(block, len(value) - start)), dtype=np.float32)
        part[row[lo:hi], at[lo:hi] - start] = 1
        out += part[:len(a)] @ part[len(a):].T
    return out


def _verify(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of chunks: counts (copies included) and a spanning forest."""
        same = bool(rows["same"].iloc[0])
        left = rows if same else rows[rows["left"]]
        right = left if same else rows[~rows["left"]]
        if not len(left) or not len(right) or same and len(left) < 2:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype({"links": "int64"})
        a, b = ([s.astype(np.int64) for s in side["shingles"]] for side in (left, right))
        common = overlap(a, b)
        sizes = np.add.outer([len(s) for s in a], [len(s) for s in b])
        hit = common / (sizes - common) >= threshold
        if same:
            np.fill_diagonal(hit, False)
        links, both, whole = hit @ right["n"].to_numpy(np.int64), left, hit
        if not same:
            links = np.concatenate([links, hit.T @ left["n"].to_numpy(np.int64)])
            both = pd.concat([left, right])
            whole = np.block([[np.zeros((len(a), len(a)), bool), hit], [hit.T, np.zeros((len(b), len(b)), bool)]])
        ids, some = both["node"].to_numpy(), whole.any(1)
        return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": ids[roots(whole)][some]})
    return verify


def near_texts(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text",
               chunk_rows: int = 512, chunk_shingles: int = 262_144, keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id with the same shingle set),
    n_links (other rows with a Jaccard similarity of at least ``threshold``), component_id
    (smallest id reachable by links) and kept (doc_id = component_id). With ``keys`` also
    text_key (binary digest of the text) and group_key (binary, the same for the rows of a
    group of linked texts and for no others; null where a row links with nothing by rule):
    they tell rows apart whose ids clash.

    Words are runs of letters, marks, digits and underscores, lower-cased; for texts with
    fewer see shingle_set. Null and blank texts and rows with a null id link with nothing.
    Copies and repeated rows are counted through their class, not as pairs. ``recall`` is the
    chance that a pair just at the threshold shares a band; pairs of a candidate group are
    verified whether they share one or not. Other columns are ignored."""
    bounded_batches(docs.sparkSession)
    bands, length = choose_bands(threshold, recall)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    @F.pandas_udf("node binary, size long, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, chars = MinHash(bands, length), word_table()
        for texts in batches:
            out = []    # one text at a time: the sets of a whole batch would be large
            for t in texts:
                s = shingle_set(t, chars, words)
                out.append((set_id(s), len(s), hashes.band_hashes(s)) if len(s) else (None, 0, None))
            yield pd.DataFrame(out, columns=["node", "size", "bands"])
    text_key = [F.unhex(F.sha2("text", 256)).alias("text_key")] if keys else []
    signed = stage(rows.select("doc_id", *text_key, sign("text").alias("s"))
                   .select("doc_id", *(["text_key"] if keys else []), F.when(F.col("doc_id").isNotNull(), F.col("s.node")).alias("node"), "s.size", "s.bands"), "signed")
    # the first 7 bytes name a node among candidates: a clash only adds a candidate
    short = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long").alias("k")
    nodes = stage(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"),
                                             F.first("bands").alias("bands")).withColumn("k", short), "classes")

    members = nodes.select("k", F.explode("bands").alias("band"))
    # written tables on the small side of the joins: AQE can then split a hot bucket or group
    buckets = stage(members.groupBy("band").agg(F.min("k").alias("low"), F.count("*").alias("many")).filter("many > 1").drop("many"), "buckets")
    groups = components(members.join(buckets, "band").filter("k != low").select(F.col("k").alias("a"), F.col("low").alias("b")))
    cand = stage(nodes.drop("bands").join(groups.select(F.col("node").alias("k"), F.col("component").alias("grp")), "k"), "candidates")
    layout = stage(cand.groupBy("grp").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
                   .select("grp", F.greatest(F.ceil(F.col("m") / chunk_rows), F.ceil(F.col("total") / chunk_shingles)).cast("int").alias("chunks")), "layout")
    dealt = (cand.join(layout, "grp").select("rep", "node", "n", "grp", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")))

    def reshingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, seen = word_table(), set()
        for b in batches:
            b = b.loc[np.array([bytes(k) not in seen for k in b["node"]], dtype=bool)]    # rows may repeat
            b = b.assign(shingles=[shingle_set(t, chars, words).view(np.int64) for t in b["text"]])
            mine = [set_id(s.view(np.uint64)) == bytes(k) for s, k in zip(b["shingles"], b["node"], strict=True)]  # ids may repeat with other texts
            b = b.loc[np.array(mine, dtype=bool)]
            b = b.loc[~b["node"].map(bytes).duplicated().to_numpy(dtype=bool)]
            seen.update(map(bytes, b["node"]))
            if not len(b):
                continue
            yield b.drop(columns="text")
    sets = (rows.join(checked_broadcast(dealt, 250_000), F.col("doc_id") == F.col("rep"))
            .select("node", "n", "grp", "chunks", "chunk", "text")
            .mapInPandas(reshingle, "node binary, n long, grp long, chunks int, chunk int, shingles array<long>")
            # one row per class: a row that repeats its representative was read by several tasks
            .groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "grp", "chunks", "chunk", "shingles"))))
    units = (sets.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("node", "n", "shingles", "grp", F.least("chunk", "to").alias("a"), F.greatest("chunk", "to").alias("b"),
                     (F.col("chunk") <= F.col("to")).alias("left"), (F.col("chunk") == F.col("to")).alias("same")))
    found = stage(units.groupBy("grp", "a", "b").applyInPandas(_verify(threshold), "node binary, links long, root binary"), "links")
    facts = link_facts(nodes, found, "component_id").withColumnRenamed("rep", "class_id")
    of_rows = signed.drop("size", "bands").join(facts, "node", "left")
    return (of_rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    *(["text_key", F.coalesce("root", "node").alias("group_key")] if keys else []))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))
