"""Benchmark decontamination: which documents hold a passage within a small edit distance of
a benchmark item.

Texts are sequences of lower-cased words. The CGK random walk copies a sequence into a longer
one and moves on at each step by a random bit of (step, word); two sequences at a small edit
distance fall into step again, so their copies differ in few places. Repeated bit sampling
takes the words at a few random places of the copy as a key. A window that starts at a word
of a document and an item with a common key are a candidate; candidates are verified with the
exact edit distance. The number of repetitions is set by simulated edits of the items
themselves, so that a passage at the largest allowed distance is found with the target recall.
It grows with the length, so long items are cut into segments: one of them holds no more than
its share of the edits, and a candidate of any is verified on the whole item.

Items so short that no edit is allowed are looked for by their exact words. Characters of scripts
written without spaces are words of their own.

Windows with too few words or word pairs of the items are left out first. This loses nothing:
within the distance, a passage has at most one foreign word and two foreign pairs per edit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, table
from .ngram_join import word_hashes, word_table

HIT = "struct<item_id:bigint,n_words:int,distance:int,last_word:int>"

# Thai and Lao, Burmese, Khmer, Han with radicals and kana
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf"
                      "\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def hashed_words(text: str, chars: np.ndarray) -> np.ndarray:
    """Hashes of the text's words; a character of an unspaced script is a word."""
    return word_hashes(text if text.isascii() else UNSPACED.sub(r" \1 ", text), chars)


@dataclass
class LengthClass:
    """Segments with between ``shortest`` and 1.25 times as many words."""
    shortest: int
    edits: int                  # most edits looked for in a segment of the class
    items: list[int]            # its segments
    known: np.ndarray           # per word number: is it in a segment of the class
    pairs: np.ndarray           # per pair number: is it in a segment of the class
    bits: np.ndarray            # (repetitions, steps, 2): factor and summand of the hash that gives the walk's bits
    places: np.ndarray          # (repetitions, samples): steps that make up the key
    keys: list[np.ndarray]      # per repetition: sorted keys of the segments
    owners: list[np.ndarray]    # per repetition: the segments of these keys


@dataclass
class Index:
    ids: list[int]
    words: list[list[int]]      # items as word numbers (1 and up; 0 is any other word)
    vocabulary: np.ndarray      # sorted word hashes
    pairs: np.ndarray           # sorted a * (words + 1) + b of adjacent word numbers; pair 0 is any other
    segments: list[tuple[int, int, int, int]]   # item, first word, words and most edits of each segment
    own: list[np.ndarray]       # pair numbers of each segment
    classes: list[LengthClass]
    rate: float


def walk(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Keys of the sequences from ``starts`` under one repetition. ``numbers`` holds 0 at each
    of ``ends``, so a sequence that is over goes on with 0."""
    at, key = starts.copy(), np.zeros(len(starts), dtype=np.uint64)
    sampled = set(places.tolist())
    for step in range(int(places.max()) + 1):
        word = numbers[at]
        if step in sampled:
            key = key * np.uint64(size) + word.astype(np.uint64)
        move = (bits[step, 0] * word.astype(np.uint64) + bits[step, 1]) >> np.uint64(63)    # a hash of (repetition, step, word)
        at = np.minimum(at + move.astype(np.int64), ends)
    return key


def segments_of(n: int, edits: int, most_words: int) -> list[tuple[int, int, int]]:
    """First word, words and most edits of the parts of about equal length, at most
    ``most_words`` words each, into which an item of ``n`` words is cut. Of ``edits`` edits at
    least one part gets no more than its share."""
    parts = -(-n // most_words)
    cuts = [n * j // parts for j in range(parts + 1)]
    return [(a, b - a, edits // parts) for a, b in zip(cuts, cuts[1:])]


def edited(item: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """The item after ``edits`` random deletions, insertions and changes of a word."""
    out = list(item)
    for _ in range(edits):
        k, what = int(rng.integers(len(out) + 1)), rng.integers(3)
        if what == 0 or k == len(out):
            out.insert(k, 0)
        elif what == 1:
            out[k] = 0
        elif len(out) > 1:
            del out[k]
    return out


def padded(seqs: list[list[int]], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences in one array, each with ``room`` zeros behind it; their starts and ends."""
    flat, starts, ends = [], [], []
    for s in seqs:
        starts.append(len(flat))
        flat += [*s, *[0] * room]
        ends.append(len(flat) - 1)
    return np.array(flat, dtype=np.int32), np.array(starts), np.array(ends)


def build_index(items: list[tuple[int, str | None]], rate: float, recall: float, samples: int, most: int, min_words: int, seed: int, segment_words: int = 64) -> Index:
    """Index of (item_id, text); items with fewer than ``min_words`` words are left out. Longer
    items than ``segment_words`` are looked for by their segments."""
    chars = word_table()
    hashed = [(i, hashed_words(t, chars)) for i, t in items if i is not None and t]
    hashed = [(i, h) for i, h in hashed if len(h) >= min_words]
    vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
    words = [(np.searchsorted(vocabulary, h) + 1).tolist() for _, h in hashed]
    rng, size, classes = np.random.default_rng(seed), len(vocabulary) + 1, []
    segments = [(k, *g) for k, w in enumerate(words) for g in segments_of(len(w), int(rate * len(w)), segment_words)]
    parts = [words[k][a:a + n] for k, a, n, _ in segments]
    adjacent = [np.array(w[:-1], dtype=np.int64) * size + np.array(w[1:], dtype=np.int64) for w in parts]
    pairs = np.unique(np.concatenate(adjacent)) if words else np.zeros(0, np.int64)
    left = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    while left:
        shortest = len(parts[left[0]])
        mine = [k for k in left if len(parts[k]) <= shortest * 1.25]
        left = left[len(mine):]
        steps = 2 * shortest
        bits = rng.integers(0, 2 ** 64, (most, steps, 2), dtype=np.uint64)
        places = np.sort(np.array([rng.choice(steps, min(samples, steps), replace=False) for _ in range(most)]), axis=1)
        some = [mine[k] for k in rng.integers(len(mine), size=256)]
        whole = padded([parts[k] for k in some], steps)
        changed = padded([edited(parts[k], segments[k][3], rng) for k in some], steps)
        missed = np.ones(len(some), dtype=bool)
        used = 0
        while used < most and missed.mean() > 1 - recall:
            missed &= walk(*whole, bits[used], places[used], size) != walk(*changed, bits[used], places[used], size)
            used += 1
        if missed.mean() > 1 - recall:
            raise ValueError(f"the recall needs more than {most} repetitions")
        known, known_pairs = np.zeros(size, dtype=bool), np.zeros(len(pairs) + 1, dtype=bool)
        for k in mine:
            known[parts[k]] = True
            known_pairs[np.searchsorted(pairs, adjacent[k]) + 1] = True
        keys, owners = [], []
        own = padded([parts[k] for k in mine], steps)
        for t in range(used):
            key = walk(*own, bits[t], places[t], size)
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            owners.append(np.array(mine)[order])
        classes.append(LengthClass(shortest, max(segments[k][3] for k in mine), mine, known, known_pairs, bits[:used].copy(), places[:used], keys, owners))
    return Index([i for i, _ in hashed], words, vocabulary, pairs, segments, [np.searchsorted(pairs, a) + 1 for a in adjacent], classes, rate)


def closest(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and the place after the
    first part that has it (bit-parallel columns of the distance matrix)."""
    m = len(item)
    full, top, masks = (1 << m) - 1, 1 << (m - 1), {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    up, down, score, best = full, 0, m, (m, 0)
    for k, w in enumerate(text):
        eq = masks.get(w, 0) if w else 0
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(xh | up) & full, up & xh
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(xv | more) & full, more & xv
        if score < best[0]:
            best = (score, k + 1)
    return best


def contaminated(texts: list[np.ndarray], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per text (word hashes): (item_id, words of the item, distance, end) of every item found."""
    out: list[list] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts])
    if not len(index.vocabulary) or not lengths.sum():
        return out
    flat = np.concatenate([np.append(t, np.uint64(0)) for t in texts])      # one place behind each text
    last = np.cumsum(lengths + 1) - 1
    first = last - lengths
    at = np.minimum(np.searchsorted(index.vocabulary, flat), len(index.vocabulary) - 1)
    numbers = np.where(index.vocabulary[at] == flat, at + 1, 0).astype(np.int32)
    numbers[last] = 0
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    size = len(index.vocabulary) + 1
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    pair = numbers[at].astype(np.int64) * size + numbers[at + 1]
    where = np.minimum(np.searchsorted(index.pairs, pair), max(0, len(index.pairs) - 1))
    pairs = np.zeros(len(flat), dtype=np.int32)
    if len(index.pairs):
        pairs[at] = np.where(index.pairs[where] == pair, where + 1, 0)
    found: set[tuple[int, int, int]] = set()    # text, item, place of its first word if nothing moved
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for c in index.classes:
        starts = np.arange(len(flat))
        for member, width, least in ((c.pairs[pairs], c.shortest - 1, c.shortest - 1 - 2 * c.edits),
                                     (c.known[numbers], c.shortest, c.shortest - c.edits)):
            total = np.concatenate([[0], np.cumsum(member)])
            starts = starts[total[np.minimum(starts + width, last[doc[starts]])] - total[starts] >= least]
        starts = starts[starts < last[doc[starts]]]
        if not len(starts):
            continue
        ends = last[doc[starts]]
        cand: dict[int, list[np.ndarray]] = {}
        for t in range(len(c.keys)):
            key = walk(numbers, starts, ends, c.bits[t], c.places[t], size)
            lo, hi = np.searchsorted(c.keys[t], key, "left"), np.searchsorted(c.keys[t], key, "right")
            hit = np.flatnonzero(hi > lo)
            for rank in range(int((hi - lo).max(initial=0))):       # items that share one key
                more = hit[hi[hit] - lo[hit] > rank]
                owner = c.owners[t][lo[more] + rank]
                for k in np.unique(owner).tolist():
                    cand.setdefault(k, []).append(starts[more[owner == k]])
        for k, parts in cand.items():       # the same bound for the pairs of the segment itself
            item, offset, n, most = index.segments[k]
            at = np.unique(np.concatenate(parts))
            own, times = np.unique(index.own[k], return_counts=True)
            local = np.zeros(len(index.pairs) + 1, dtype=np.int64)
            local[own] = np.arange(1, len(own) + 1)
            inside = local[pairs[np.minimum(at[:, None] + np.arange(n - 1), last[doc[at]][:, None])]]
            inside += np.arange(len(at))[:, None] * (len(own) + 1)
            counts = np.bincount(inside.ravel(), minlength=len(at) * (len(own) + 1)).reshape(len(at), -1)[:, 1:]
            at = at[np.minimum(counts, times).sum(1) >= n - 1 - 2 * most]
            words = index.words[item]
            if n == len(words) and int(index.rate * n) == 0:    # no edit is allowed: the first exact place of each text
                at = at[(numbers[np.minimum(at[:, None] + np.arange(n), last[doc[at]][:, None])] == np.array(words)).all(1)]
                texts_with, place = np.unique(doc[at], return_index=True)
                best.update(((int(d), item), (0, int(at[x] - first[d]) + n)) for d, x in zip(texts_with, place, strict=True))
                continue
            found.update((int(d), item, int(x) - offset) for d, x in zip(doc[at], at, strict=True))
    reach: tuple[int, int, int] = (-1, -1, -1)
    cut = {k: most for k, offset, _, most in index.segments if offset}
    for d, k, start in sorted(found):       # overlapping windows are searched together
        item = index.words[k]
        edits = int(index.rate * len(item))
        slack = edits if k not in cut else edits + cut[k]   # a segment may also be found that far from its place
        lo, hi = max(first[d], start - slack), min(last[d], start + len(item) + slack)
        if reach[:2] == (d, k):
            if hi <= reach[2]:
                continue
            lo = max(lo, reach[2] - len(item) - edits)
        reach = (d, k, int(hi))
        dist, end = closest(item, numbers[lo:hi].tolist())
        if dist <= edits and dist < best.get((d, k), (edits + 1, 0))[0]:
            best[d, k] = (dist, int(lo - first[d]) + end)
    for (d, k), (dist, end) in sorted(best.items()):
        out[d].append((index.ids[k], len(index.words[k]), dist, end))
    return out


def _hits(text: Column, spark: SparkSession, index: Index, words_at_once: int = 500_000) -> Column:
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((index.ids, index.words, index.vocabulary, index.pairs, index.segments, index.own, [vars(c) for c in index.classes], index.rate))

    @F.pandas_udf(f"array<{HIT}>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, words, vocabulary, pairs, segments, own, classes, rate = shared.value
        index, chars = Index(ids, words, vocabulary, pairs, segments, own, [LengthClass(**c) for c in classes], rate), word_table()
        names = ("item_id", "n_words", "distance", "last_word")
        for texts in batches:
            out: list[list] = []
            block, held = [], 0
            for t in texts:
                block.append(hashed_words(t, chars) if t else np.zeros(0, np.uint64))
                held += len(block[-1])
                if held > words_at_once:
                    out += contaminated(block, index)
                    block, held = [], 0
            out += contaminated(block, index) if block else []
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in found] for found in out], dtype=object)
    return hits.asNondeterministic()(text)   # else a filter on the result runs it once more


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", item_id: str = "item_id",
                       item_text: str = "text", rate: float = 0.2, recall: float = 0.99, samples: int = 2, most: int = 64,
                       min_words: int = 1, block_items: int = 2_000, seed: int = 17,
                       block_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with ``into``: array of (item_id, n_words, distance, last_word) of the items of
    which the text holds a passage with at most ``rate`` times n_words word edits, by item_id
    order within each block of items; last_word is the number of words up to the passage's end.

    ``recall`` holds for passages at the largest distance; exact passages always share all
    keys. Items of fewer than 1 / ``rate`` words are found by their exact words only. Null, empty
    and wordless texts have no hits; items with null id or text, without a word or with fewer
    than ``min_words`` words are not looked for. Repeated items
    are found each; repeated rows stay; an existing column ``into`` is replaced. The benchmark
    is a query set: it is read and broadcast in blocks of about ``block_items`` items or
    ``block_chars`` characters, whichever is less, each block against all rows. Long items are
    found by the segment that holds least edits and verified whole."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    arrays = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        index = build_index([(r["i"], r["t"]) for r in part], rate, recall, samples, most, min_words, seed)
        arrays.append(_hits(F.col(text), spark, index))
    return docs.withColumn(into, F.concat(*arrays) if len(arrays) > 1 else arrays[0])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h"))
            .select("doc_id", "h.item_id", "h.n_words", "h.distance", "h.last_word"))
