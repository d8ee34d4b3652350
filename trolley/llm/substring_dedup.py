"""Removal of repeated passages, with a count-min prefilter.

A window is ``width`` consecutive words. Words under a window that also starts in a document
with a smaller id go. Rows are dealt once into parts of bounded text and written as a table
bucketed by part, so that no later pass shuffles a text.

First pass: every part makes a sketch of its windows. A window is counted under the least hash
among its seven-word grams, which is the same wherever the window stands: its count is never
too low, and neighbours share it, so a sketch holds about a quarter of the windows. A part's
sketch travels in sparse form (the hashes themselves, in blocks by range) and is merged with
those of all parts, block by block, into two rows of counters. The smaller counter of a hash
overestimates in how many documents it occurs; hashes with an estimate of two or more go back to
their parts. Second pass: only windows with such a hash are grouped, by a 128-bit digest of
their words, first inside the part, then over all parts. Third pass: the words go.

A window that occurs in two documents has a true count of two, hence an estimate of at least
two: none is lost, at any width of the sketch."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trolley.session import scratch_path

from .common import bounded_batches, others, stage, table

PART_BYTES = 12_000_000     # text of one part (a longer text is a part of its own)
BLOCK_BYTES = 16_000_000    # text whose windows meet in one block of the merged sketch
GRAM = 7
NULL_ID = 2 ** 63 - 1       # a null id is larger than any
ROWS = np.random.default_rng(5).integers(0, 2 ** 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def factors(n: int, which: int) -> np.ndarray:
    """Odd 64-bit factors of the n words of a gram, one stream for each half of the digest."""
    return np.random.default_rng([11, which]).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Part:
    """Words of some texts: numbers of the words in one row, 128-bit digests of each number."""

    def __init__(self, texts: list[str | None], width: int):
        number: dict[bytes, int] = defaultdict(count().__next__)
        words = [np.fromiter(map(number.__getitem__, split(t)), dtype=np.int32) for t in texts]
        self.width, self.lengths = width, np.array([len(w) for w in words], dtype=np.int64)
        self.ids = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.digests = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in number), dtype=np.uint64).reshape(-1, 2)
        self.first = np.cumsum(self.lengths) - self.lengths
        windows = np.maximum(self.lengths - width + 1, 0)
        small = np.int32 if len(self.ids) < 2 ** 31 else np.int64
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
        self.starts = np.arange(len(self.doc), dtype=small) + np.repeat((self.first - (np.cumsum(windows) - windows)).astype(small), windows)

    def signs(self) -> np.ndarray:
        """Per window, the least hash of its grams."""
        gram = min(GRAM, self.width)
        word, n = self.digests[:, 0], len(self.ids) - gram + 1
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k, f in enumerate(factors(gram, 2)):
            total += (word * f)[self.ids[k:n + k]]
        total = mixed(total)
        low = total[self.starts].copy()
        for k in range(1, self.width - gram + 1):
            np.minimum(low, total[self.starts + k], out=low)
        return low

    def digest(self, windows: np.ndarray) -> np.ndarray:
        """128-bit digests of some windows (by number)."""
        out = np.zeros((len(windows), 2), np.uint64)
        for half in (0, 1):
            for k, f in enumerate(factors(self.width, half)):
                out[:, half] += (self.digests[:, half] * f)[self.ids[self.starts[windows] + k]]
            out[:, half] = mixed(out[:, half])
        return out


def split(text: str | None) -> list[bytes]:
    """Words of a text: runs without space, tab, line feed, vertical tab, form feed, return."""
    return text.encode().split() if text else []


def block_of(signs: np.ndarray, blocks: int) -> np.ndarray:
    return (signs >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)


def code(signs: np.ndarray, blocks: int) -> np.ndarray:
    """What the sketch keeps of a hash: its block and its lower half."""
    return block_of(signs, blocks) << np.uint64(32) | signs & np.uint64(0xFFFFFFFF)


def part_sketch(part: Part, blocks: int) -> Iterator[tuple[int, bytes]]:
    """(block, hashes): each hash once, or twice if several texts of the part hold it."""
    signs, doc = part.signs(), part.doc
    new = np.append(True, (signs[1:] != signs[:-1]) | (doc[1:] != doc[:-1])) if len(signs) else np.zeros(0, bool)
    signs, doc = signs[new], doc[new]       # neighbours mostly share their hash
    order = np.lexsort((doc, signs))
    signs, doc = signs[order], doc[order]
    other = signs[1:] != signs[:-1]
    own = np.append(True, other | (doc[1:] != doc[:-1])) if len(signs) else new
    signs, doc = signs[own], doc[own]
    third = np.zeros(len(signs), bool)
    third[2:] = signs[2:] == signs[:-2]
    signs = signs[~third]
    block = block_of(signs, blocks)
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(signs) else np.zeros(0, int)
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(signs)]):
        yield int(block[x]), signs[x:y].astype(np.uint32).tobytes()


def estimates(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Count-min estimates of ``hashes`` after adding all of ``sketch``: two rows of counters,
    four to eight times as many as there are entries."""
    bits = max(10, int(4 * len(sketch)).bit_length())
    least = np.full(len(hashes), np.iinfo(np.int64).max)
    for f in ROWS:
        column = lambda x: (mixed(x.astype(np.uint64) * f) >> np.uint64(64 - bits)).astype(np.int64)  # noqa: B023, E731
        np.minimum(least, np.bincount(column(sketch), minlength=1 << bits)[column(hashes)], out=least)
    return least


def merge_sketches(group: pa.Table) -> pa.Table:
    """Sketches of one block from all parts -> (part, block, hashes estimated in two texts)."""
    parts, block = group["part"].to_pylist(), group["block"][0].as_py()
    own = [np.frombuffer(b, dtype=np.uint32) for b in group["hashes"].to_pylist()]
    whole = np.concatenate(own)
    found = estimates(whole, whole) >= 2
    ends = np.cumsum([len(h) for h in own])
    hits = [np.unique(h[found[e - len(h):e]]).tobytes() for h, e in zip(own, ends, strict=True)]
    keep = [k for k, h in enumerate(hits) if h]
    return pa.table({"part": pa.array([parts[k] for k in keep], pa.int64()), "block": pa.array([block] * len(keep), pa.int64()),
                     "hashes": pa.array([hits[k] for k in keep], pa.binary())})


def repeated(part: Part, info: pa.Table, blocks: int) -> np.ndarray:
    """Windows of a part whose hash was estimated in two texts."""
    sets = [(b << 32) + np.frombuffer(h, dtype=np.uint32).astype(np.uint64)
            for b, h in zip(info["block"].to_pylist(), info["hashes"].to_pylist(), strict=True) if h is not None]
    if not sets or not len(part.starts):
        return np.zeros(0, np.int64)
    known = np.sort(np.concatenate(sets))
    mine = code(part.signs(), blocks)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine)


def grouped(part: Part, windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests of ``windows``, the smallest id of each, and which one each window has."""
    d = part.digest(windows).view(np.int64)
    id_ = ids[part.doc[windows]]
    order = np.lexsort((id_, d[:, 1], d[:, 0]))
    s = d[order]
    new = np.append(True, (s[1:] != s[:-1]).any(1)) if len(s) else np.zeros(0, bool)
    which = np.zeros(len(windows), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], id_[order][new], which


def ids_of(docs: pa.Table) -> np.ndarray:
    return pc.fill_null(docs["_id"], NULL_ID).to_numpy()


def remove_repeats(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words that stay, joined by one space).
    Columns of these names are replaced.

    ``doc_id`` holds integers. Windows are judged on the input: every occurrence but those in
    the document with the smallest id goes, so one inside that document only, however often,
    stays; rows with the same id are one document here, of which none goes for another. A null
    id is larger than any other and not smaller than another null. Null, empty and blank texts
    have no words; texts shorter than a window lose nothing; a text of any length is one row of
    one part. An empty table gives no row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = others(docs, {"n_words", "n_removed", "kept"})
    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), *names)
    size = given.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = max(1, min(-(-size // block_bytes), part_bytes // 4096))   # at least some hundred hashes a part and block

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, task = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = task + (before + np.cumsum(sizes) - sizes) // part_bytes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(part), *b.columns], names=["_part", *b.schema.names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    name = f"parts_{uuid.uuid4().hex}"
    buckets = min(100_000, max(spark.sparkContext.defaultParallelism, -(-2 * size // part_bytes)))
    (given.mapInArrow(deal, f"_part long, {fields}").write.bucketBy(buckets, "_part").sortBy("_part")
     .option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(name))
    parts = spark.table(name)

    def sketch(docs: pa.Table) -> pa.Table:
        rows = list(part_sketch(Part(docs["_text"].to_pylist(), width), blocks))
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "part": pa.array([docs["_part"][0].as_py()] * len(rows), pa.int64()),
                         "hashes": pa.array([h for _, h in rows], pa.binary())})
    sketches = parts.select("_part", "_text").groupBy("_part").applyInArrow(sketch, "block long, part long, hashes binary")
    hits = stage(sketches.groupBy("block").applyInArrow(merge_sketches, "part long, block long, hashes binary"), "repeated")

    def exact(docs: pa.Table, info: pa.Table) -> pa.Table:
        if not info.num_rows or not docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("part", "k", "a", "b", "low")})
        part = Part(docs["_text"].to_pylist(), width)
        digests, low, _ = grouped(part, repeated(part, info, blocks), ids_of(docs))
        return pa.table({"part": np.full(len(low), docs["_part"][0].as_py()), "k": np.arange(len(low)), "a": digests[:, 0], "b": digests[:, 1], "low": low})
    groups = (parts.select("_part", "_id", "_text").groupBy("_part").cogroup(hits.groupBy("part"))
              .applyInArrow(exact, "part long, k long, a long, b long, low long"))
    # a part sends a window once, so a group has at most as many rows as there are parts
    least = F.min("low").over(Window.partitionBy("a", "b"))
    lows = groups.withColumn("least", least).filter("least < low").select("part", "k", "least")

    def cut(docs: pa.Table, info: pa.Table) -> pa.Table:
        texts = docs["_text"].to_pylist()
        part, ids = Part(texts, width), ids_of(docs)
        windows = repeated(part, info, blocks)
        _, low, which = grouped(part, windows, ids)
        smaller = info.filter(pc.is_valid(info["least"])) if info.num_rows else info
        if smaller.num_rows:    # windows that a smaller id of another part holds, by their place among the digests
            low[smaller["k"].to_numpy()] = smaller["least"].to_numpy()
        gone = part.starts[windows[low[which] < ids[part.doc[windows]]]]
        edge = np.zeros(len(part.ids) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + width, -1)
        keep = np.cumsum(edge[:-1]) == 0
        removed = part.lengths - np.add.reduceat(np.append(keep, False).astype(np.int64), part.first) * (part.lengths > 0) if len(texts) else part.lengths
        kept = []
        for t, first, n, r in zip(texts, part.first.tolist(), part.lengths.tolist(), removed.tolist(), strict=True):
            words = split(t) if r < n else []
            kept.append(b" ".join(words if not r else compress(words, keep[first:first + n].tolist())).decode())
        return pa.table([*(docs[f"{c}"] for c in names), pa.array(part.lengths), pa.array(removed), pa.array(kept, pa.string())],
                        names=[*names, "n_words", "n_removed", "kept"])
    null = lambda kind: F.lit(None).cast(kind)
    info = hits.select("part", "block", "hashes", *(null("long").alias(c) for c in ("k", "least"))).unionByName(
        lows.select("part", null("long").alias("block"), null("binary").alias("hashes"), "k", "least"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return (parts.groupBy("_part").cogroup(info.groupBy("part"))
            .applyInArrow(cut, ", ".join([*([schema] if schema else []), "n_words long, n_removed long, kept string"])))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w) s),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM win JOIN low USING (g), unnest(range(13)) AS r(k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
