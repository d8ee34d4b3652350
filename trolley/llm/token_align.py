"""Cross-tokenizer alignment by merge path.

Two tokenizers cut the bytes of a text at different places. The ends of both token sequences,
ascending, are one merge: each distinct end closes one pair of overlapping tokens, and an end
that both sides share closes a group. Merge-path partitioning makes independent pieces of
equal work out of the merge: a binary search along evenly spaced diagonals finds how many
ends each side has contributed there, so no piece waits for another or grows with one text.
Every piece emits its overlaps; a shared end that lies across a border (one side's copy is the
last of a piece, the other's the first of the next) is stitched.

How often two token ids overlap is counted over the whole corpus: each text holds its distinct
id pairs with multiplicities, pairs are summed before their shuffle, and the counts go back to
the texts by a join on the pair."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.plans.joins import checked_broadcast

from .common import bounded_batches, others, stage, table

MARK = "▁"
PAIR_BITS = 20          # a pair is one long: id of A times 2^20 plus id of B
REMEMBERED = 150_000    # words whose tokens a task keeps, and as many that it used before these
TOGETHER = 4_000        # new words that are encoded at once
BLOCK_CHARS = 500_000     # text that is merged at once (a longer text is merged alone)
CUT = re.compile(r"(?<=\S)(?= )")     # before a space that follows a character
# a space after white space of any kind
NO_CUTS = [chr(c) + " " for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
PROBES = ("a", " a  b ", "a\n\n b\n", "x\n  y \t z", "1 2,3 's don't  !", "né ü 😀  　 字字 字")
NEW = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups", "string"),
       ("pairs", "array<long>"), ("times", "array<long>")]


def byte_alphabet() -> dict[str, int]:
    """Character of byte-level vocabularies -> byte: printable bytes stand for themselves, the
    others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A ``tokenizers`` file with a byte-level alphabet; texts come with a space in front."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(blob.decode("utf-8"))
        self.lib.encode_special_tokens = True   # their strings in a text are plain text
        self.lib.no_truncation()
        self.lib.no_padding()
        letters = byte_alphabet()
        names = [self.lib.id_to_token(i) or "" for i in range(max(self.lib.get_vocab(True).values()) + 1)]
        self.tokens = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        conf = json.loads(blob)
        pre = conf.get("pre_tokenizer") or {}
        self.cuts = (conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and all(t["special"] for t in conf.get("added_tokens") or []))

    def encode(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentencepiece model that puts a space mark before the text by itself."""

    def __init__(self, blob: bytes):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        size = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(size)]
        self.tokens = [bytes([int(t[1:-1], 16)]) if self.lib.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", t) for i, t in enumerate(names)
                            if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i)))

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text, add_bos=False, add_eos=False) if text else [self.lib.piece_to_id(MARK)]


def words_of(text: str) -> list[str]:
    """The text in parts that were each preceded by a space after a character (the first by the
    space that is put before the text); a run of spaces stays with the part behind it."""
    spaced = " " + text
    if any(c in spaced for c in NO_CUTS):
        return [c[1:] for c in CUT.split(spaced)]
    return text.split(" ")


class Encoder:
    """Ids of whole texts by either library, as 32-bit numbers in bytes. Where neither lets a
    token cross from a character into a following space, a text is the sum of its words with
    the space before each: new words are encoded many at once and remembered."""

    def __init__(self, a: bytes, b: bytes):
        self.sides = (ByteLevel(a), Pieces(b))
        self.length = [np.array([len(t) for t in s.tokens], dtype=np.int64) for s in self.sides]
        if max(map(len, self.length)) >= 1 << PAIR_BITS:
            raise ValueError(f"vocabularies of 2^{PAIR_BITS} ids and more are not supported")
        self.known: list[dict[str, bytes]] = [{}, {}]
        self.before: list[dict[str, bytes]] = [{}, {}]
        self.wrong: set[str] = set()    # words whose tokens do not spell them
        self.cuts = all(s.cuts for s in self.sides) and all(
            s.encode(p) == list(chain.from_iterable(s.encode(w) for w in words_of(p))) for s in self.sides for p in PROBES)

    def spells(self, side: int, ids, text: str) -> bool:
        return b"".join(map(self.sides[side].tokens.__getitem__, ids)) == b" " + text.encode()

    def learn(self, words: set[str], last: set[str]) -> None:
        """Tokens of ``words`` into ``known``. Words of ``last`` end in white space, which what
        follows would join, so each is encoded alone."""
        new = [w for w in words if w not in self.known[0]]
        if new and len(self.known[0]) + len(new) > REMEMBERED:
            self.before, self.known, new = self.known, [{}, {}], list(words)
        used = [w for w in new if w in self.before[0]]
        for known, before in zip(self.known, self.before, strict=True):
            known.update((w, before[w]) for w in used)
        new = [w for w in new if w not in self.known[0]]
        self.learn_alone([w for w in new if w in last])
        new = [w for w in new if w not in last] if last else new
        for k in range(0, len(new), TOGETHER):
            self.learn_together(new[k:k + TOGETHER])

    def learn_alone(self, words: list[str]) -> None:
        for w in words:
            for side, s in enumerate(self.sides):
                ids = s.encode(w)
                self.known[side][w] = np.array(ids, dtype=np.int32).tobytes()
                if not self.spells(side, ids, w):
                    self.wrong.add(w)

    def learn_together(self, words: list[str]) -> None:
        text = " ".join(words)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), dtype=np.int64) + 1)
        for side, s in enumerate(self.sides):
            ids = s.encode(text)
            flat = np.array(ids, dtype=np.int32)
            stops = np.cumsum(self.length[side][flat])
            at = np.minimum(np.searchsorted(stops, ends), len(stops) - 1)
            if not self.spells(side, ids, text) or (stops[at] != ends).any():
                return self.learn_alone(words)
            raw, cut = flat.tobytes(), (4 * np.append(0, at + 1)).tolist()
            self.known[side].update(zip(words, map(raw.__getitem__, map(slice, cut[:-1], cut[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B per non-empty text; None where either does not spell the text."""
        if not self.cuts:
            both = [[s.encode(t) for s in self.sides] for t in texts]
            return [tuple(np.array(i, dtype=np.int32).tobytes() for i in ids) if all(self.spells(k, ids[k], t) for k in (0, 1)) else None
                    for ids, t in zip(both, texts, strict=True)]
        parts = [words_of(t) for t in texts]
        self.learn(set(chain.from_iterable(parts)), {p[-1] for p in parts if not p[-1] or p[-1][-1].isspace()})
        a, b = (k.__getitem__ for k in self.known)
        out = []
        for p, t in zip(parts, texts, strict=True):
            ids = b"".join(map(a, p)), b"".join(map(b, p))
            fine = not self.wrong or self.wrong.isdisjoint(p)
            out.append(ids if fine or all(self.spells(k, np.frombuffer(ids[k], np.int32).tolist(), t) for k in (0, 1)) else None)
        return out


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the merge of two ascending arrays into pieces of ``piece`` elements: how many
    elements of each lie before every diagonal (of equal ones, that of ``a`` comes first)."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        more = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int) -> tuple[np.ndarray, ...]:
    """Distinct ends of one piece; the tokens of either side that overlap just before each;
    whether both sides end there."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")     # two ascending runs: merged in linear time
    ends, from_a = ends[order], order < len(a)
    new = np.append(True, ends[1:] != ends[:-1]) if len(ends) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    before = np.cumsum(from_a) - from_a
    return ends[at], first_a + before[at], first_b + at - before[at], np.diff(np.append(at, len(ends))) > 1


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = 65_536) -> tuple[np.ndarray, ...]:
    """(end, index in a, index in b, shared) of every overlap of two token sequences that are
    given by their strictly ascending ends, the last of which they share."""
    at_a, at_b = merge_path(a, b, piece)
    parts = [piece_overlaps(a[at_a[k]:at_a[k + 1]], b[at_b[k]:at_b[k + 1]], at_a[k], at_b[k]) for k in range(len(at_a) - 1)]
    end, i, j, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
    again = np.flatnonzero(end[1:] == end[:-1])     # a shared end across the border of two pieces
    shared[again] = True
    keep = np.ones(len(end), bool)
    keep[again + 1] = False
    return end[keep], i[keep], j[keep], shared[keep]


def digit_table(size: int) -> np.ndarray:
    """Decimal digits of each id as bytes, zeros in place of leading ones."""
    width = len(str(max(size - 1, 0)))
    ids = np.arange(size)[:, None]
    power = 10 ** np.arange(width - 1, -1, -1)
    digits = (ids // power % 10 + 48).astype(np.uint8)
    digits[(ids < power) & (power > 1)] = 0
    return digits


def spelled_groups(side: list, lasts_of: list, lasts: np.ndarray, digits: list) -> tuple[bytes, np.ndarray]:
    """All groups as text (``a1,a2|b1;a3|b2,b3``), texts behind each other, and the number of
    bytes of each text. ``lasts_of``: per side, the last token of each group; ``lasts``: the
    last group of each text."""
    sizes = [np.diff(np.append(-1, x)) for x in lasts_of]       # tokens of each group
    before = [np.append(0, x + 1) for x in lasts_of]            # tokens before each group
    places = [np.arange(len(side[0])) + np.repeat(before[1][:-1], sizes[0]), np.arange(len(side[1])) + np.repeat(before[0][1:], sizes[1])]
    width = max(d.shape[1] for d in digits)
    out = np.zeros((len(side[0]) + len(side[1]), width + 1), dtype=np.uint8)
    out[:, width] = ord(",")
    for ids, place, d, last, mark in zip(side, places, digits, lasts_of, b"|;", strict=True):
        out[place, width - d.shape[1]:width] = d[ids]
        out[place[last], width] = mark
    ends = places[1][lasts_of[1][lasts]]
    out[ends, width] = 0
    shown = out != 0
    total = np.cumsum(shown.sum(1))[ends]
    return out[shown].tobytes(), np.diff(np.append(0, total))


def align_block(texts: list[str | None], encoder: Encoder, digits: list, piece: int) -> dict[str, pa.Array]:
    """The columns of NEW for some texts."""
    given = [k for k, t in enumerate(texts) if t]
    coded = [(k, ids) for k, ids in zip(given, encoder.encode([texts[k] for k in given]), strict=True) if ids is not None]
    n = np.zeros((4, len(texts)), dtype=np.int64)
    groups, sizes = [""] * len(texts), np.zeros(len(texts), dtype=np.int64)
    pairs = times = np.zeros(0, np.int64)
    if coded:
        rows = np.array([k for k, _ in coded])
        side = [np.frombuffer(b"".join(ids[s] for _, ids in coded), dtype=np.int32).astype(np.int64) for s in (0, 1)]
        counts = [np.array([len(ids[s]) // 4 for _, ids in coded]) for s in (0, 1)]
        end, i, j, shared = overlaps(*(np.cumsum(encoder.length[s][side[s]]) for s in (0, 1)), piece)
        text = np.repeat(np.arange(len(rows)), counts[0])[i]
        lasts = np.flatnonzero(np.append(np.diff(text[shared]) > 0, True))
        n[0, rows], n[1, rows] = counts
        n[2, rows], n[3, rows] = np.bincount(text[shared], minlength=len(rows)), np.bincount(text, minlength=len(rows))
        spelled, size = spelled_groups(side, [i[shared], j[shared]], lasts, digits)
        at = np.append(0, np.cumsum(size))
        for k, row in enumerate(rows.tolist()):
            groups[row] = spelled[at[k]:at[k + 1]].decode()
        # one number per overlap, the text in front: a block has fewer than 2^23 texts
        key = np.sort(text << 2 * PAIR_BITS | side[0][i] << PAIR_BITS | side[1][j])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pairs, times = key[first] & (1 << 2 * PAIR_BITS) - 1, np.diff(np.append(first, len(key)))
        text = key >> 2 * PAIR_BITS
        sizes[rows] = np.bincount(text[first], minlength=len(rows))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (pairs, times)]
    return dict(zip([c for c, _ in NEW], [*(pa.array(x) for x in n), pa.array(groups, pa.string()), *lists], strict=True))


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: list[str] | None = None,
          piece: int = 65_536) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default; those with names of the result are
    replaced) with n_a, n_b (tokens), n_groups, n_links (overlapping pairs of tokens), groups
    (``a1,a2|b1;a3|b2,b3``, ids in order), pairs (distinct pairs of overlapping ids, as one
    number: id of A times 2^20 plus id of B) and times (overlaps of each).

    A encodes a space and the text, B the text, neither with special tokens. Null and empty
    texts, and those that the bytes of the tokens of either side do not spell, have zeros, no
    groups and no pairs. Repeated rows stay; a text of any length is encoded whole and merged
    in pieces of ``piece`` ends; no row, no result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c, _ in NEW]
    keep = others(docs.select(*keep) if keep else docs, set(names))
    blobs = spark.sparkContext.broadcast([open(f, "rb").read() for f in (a_file, b_file)])     # files of the driver, a few MB
    given = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*blobs.value)
        digits = [digit_table(len(s.tokens)) for s in encoder.sides]
        for batch in batches:
            texts, start, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held < BLOCK_CHARS and k + 1 < len(texts):
                    continue
                columns = align_block(texts[start:k + 1], encoder, digits, piece)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, k + 1 - start).columns[:-1], *columns.values()], names=[*keep, *names])
                start, held = k + 1, 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, ", ".join([*([schema] if schema else []), *(f"{c} {t}" for c, t in NEW)]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): texts that hold a pair, and whether no other pair of the same id of A is
    held by more. Rows of ``aligned`` hold distinct pairs, so a text counts once."""
    n = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", PAIR_BITS).alias("a")
    return n.join(n.groupBy(a).agg(F.max("n").alias("most")), F.shiftright(n["pair"], PAIR_BITS) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, rid: str) -> DataFrame:
    """Per text (``rid``): n_best, its links whose count is the highest of their id of A, and
    count_sum, the counts of its links. ``aligned`` is a written table."""
    facts = stage(pair_counts(aligned), "facts")
    # checked by rows and bytes; beyond, the join shuffles the pairs of each text
    links = (aligned.select(rid, F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(rid, "l.pairs", "l.times")
             .join(checked_broadcast(facts), F.col("pairs") == F.col("pair")))
    return links.groupBy(rid).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = stage(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times",
                               F.monotonically_increasing_id().alias("rid")), "aligned")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (found.drop("pairs", "times").join(score_links(found, "rid"), "rid", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
