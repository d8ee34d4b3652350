"""Nearest customers of every customer (M12, M14): an exact top-k cosine join with pruning.

Customers with equal counts are one class, and a class offers its k + 1 smallest ids, which are
all that ties can call for. Classes go to the nearest of a bounded number of pivots; a ring is
the classes of a pivot within a range of angles, and is cut in chunks of bounded size. The angle
between two vectors is at least the difference of their angles to a pivot, so a chunk whose bound
lies below a class's k-th similarity so far is skipped whole.

Consecutive chunks make up a block, one row of a table. A block first meets itself; the bounds
found there tell which other blocks it has to meet, and these are sent to it one behind the other.
Neighbouring chunks of targets and the chunks they meet are multiplied as matrices of unit vectors
in single precision. Pairs that come within its error of a target's k + 1 nearest so far are worked
out from the counts (integer dot products are exact), and only the k + 1 nearest of each target are
kept: no pairs are written."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from trolley.plans.joins import checked_broadcast
from trolley.session import cut_lineage

SLACK = 1e-6    # rounding of acos near 1 is far below this
BLOCKS = 64     # blocks of a table that has no more than BLOCK classes in each
BLOCK = 128     # most chunks of a block
COLUMNS = 2048  # categories that are multiplied at once
ROWS, MEMBERS = 512, 2048   # targets and members that are multiplied at once
DENSE = 1 << 23     # most cells of a block that is held as a matrix
SPREAD = 4      # partitions for each block, so that few hold two
CELLS = 1 << 20     # cells of a matrix of targets and rings that are sorted at once

cloudpickle.register_pickle_by_value(sys.modules[__name__])    # executors need no copy of the repository

PACKED = "block int, cls array<string>, chunk binary, size binary, cat binary, n binary, norm binary, ids binary, n_ids binary"


def _bytes(values) -> bytes:
    """Whole numbers from 0 in the smallest type that holds them, its character first; doubles as they are."""
    values = np.asarray(values)
    kind = values.dtype if values.dtype.kind == "f" else np.min_scalar_type(values.max(initial=0))
    return kind.char.encode() + np.ascontiguousarray(values, dtype=kind).tobytes()


def _array(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(packed, dtype=chr(packed[0]), offset=1).astype(kind)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Length of each list of a column and all values behind each other."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(whole.offsets.to_numpy()), whole.flatten()


def pack(table: pa.Table) -> pa.Table:
    """The classes of one block, in the order of their chunks, as one row."""
    table = table.sort_by([("at", "ascending"), ("cls", "ascending")])
    size, entries = _lists(table["cats"])
    n_ids, ids = _lists(table["ids"])
    return pa.table({"block": table["block"].slice(0, 1).cast(pa.int32()), "cls": pa.array([table["cls"].to_pylist()], pa.list_(pa.string())),
                     **{name: pa.array([_bytes(v)], pa.binary()) for name, v in (
                         ("chunk", table["at"]), ("size", size), ("cat", entries.field("c")), ("n", entries.field("n")), ("norm", table["norm"]))},
                     "ids": pa.array([np.ascontiguousarray(ids, dtype=np.int64).tobytes()], pa.binary()), "n_ids": pa.array([_bytes(n_ids)], pa.binary())})


class Block:
    """The classes of a packed row; ``chunk``: the number of each one's chunk, ascending."""

    def __init__(self, row: dict):
        of = lambda name, kind: _array(row[name], kind)
        self.chunk, self.norm = of("chunk", np.int32), of("norm", np.float64)
        self.start = np.append(0, np.cumsum(of("size", np.int32), dtype=np.int64))
        self.cat, self.n = of("cat", np.int32), of("n", np.int64)
        self.first_id = np.append(0, np.cumsum(of("n_ids", np.int32), dtype=np.int64))
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.width = int(self.cat.max(initial=-1)) + 1
        self.dense = len(self.norm) * self.width <= DENSE
        at = np.flatnonzero(np.append(True, np.diff(self.chunk) != 0))
        self.runs = {int(c): (int(a), int(b)) for c, a, b in zip(self.chunk[at], at, np.append(at[1:], len(self.chunk)), strict=True)}

    def __len__(self) -> int:
        return len(self.norm)

    @cached_property
    def counts(self) -> np.ndarray:
        """The counts as a matrix, of blocks with ``dense``."""
        out = np.zeros((len(self), self.width))
        row, cat, n = self.entries(0, len(self))
        out[row, cat] = n
        return out

    @cached_property
    def unit(self) -> np.ndarray:
        return (self.counts / self.norm[:, None]).astype(np.float32)

    def groups(self, cell: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(low, high, chunks) of the classes of consecutive chunks of one pivot, about ROWS of them."""
        group = []
        for c in self.runs:
            if group and (cell[c] != cell[group[0]] or self.runs[c][1] - self.runs[group[0]][0] > ROWS):
                yield self.runs[group[0]][0], self.runs[group[-1]][1], group
                group = []
            group.append(c)
        if group:
            yield self.runs[group[0]][0], self.runs[group[-1]][1], group

    def entries(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, category, count) of the classes from ``low`` to ``high``."""
        a, b = self.start[low], self.start[high]
        return np.repeat(np.arange(high - low), np.diff(self.start[low:high + 1])), self.cat[a:b], self.n[a:b]

    def of_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, category, count) of some classes."""
        sizes = self.start[rows + 1] - self.start[rows]
        take = np.repeat(self.start[rows] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(rows)), sizes), self.cat[take], self.n[take]


def dots(left: tuple, n_left: int, right: tuple, n_right: int) -> np.ndarray:
    """Dot products of two sets of entries, over the categories that both have."""
    shared = np.intersect1d(left[1], right[1])
    out = np.zeros((n_left, n_right))
    for k in range(0, len(shared), COLUMNS):
        some = shared[k:k + COLUMNS]
        sides = []
        for (row, cat, n), rows in ((left, n_left), (right, n_right)):
            at = np.minimum(np.searchsorted(some, cat), len(some) - 1)
            fits = some[at] == cat
            dense = np.zeros((rows, len(some)))
            dense[row[fits], at[fits]] = n[fits]
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def angles_to(block: Block, pivots: Block) -> np.ndarray:
    """Angle of every class to every pivot."""
    out = np.empty((len(block), len(pivots)))
    for low in range(0, len(block), 4096):
        high = min(low + 4096, len(block))
        cosine = dots(block.entries(low, high), high - low, pivots.entries(0, len(pivots)), len(pivots))
        out[low:high] = np.arccos(np.minimum(1.0, cosine / (block.norm[low:high, None] * pivots.norm)))
    return out


class Nearest:
    """The nearest ids of the classes of a block so far: ``far`` is minus the similarity, by
    row ascending, ties by id."""

    def __init__(self, block: Block, pivots: Block, chunks: dict, k: int, found: dict | None = None):
        self.block, self.k, self.angles, self.looked = block, k, angles_to(block, pivots), 0
        if found is None:
            self.far, self.id = np.full((len(block), k + 1), np.inf), np.zeros((len(block), k + 1), dtype=np.int64)
            self.bound = self._by_rings(chunks)     # minus a similarity that k + 1 ids are known to reach
        else:
            self.looked = found["looked"]
            self.far, self.id = (np.frombuffer(found[c], dtype=t).reshape(-1, k + 1).copy() for c, t in (("far", np.float64), ("near", np.int64)))
            self.bound = np.frombuffer(found["bound"], dtype=np.float64)

    def _by_rings(self, chunks: dict) -> np.ndarray:
        """The k + 1 nearest lie within the first chunks that hold as many, seen from their far ends:
        within k + 1 chunks at most."""
        out = np.zeros(len(self.block))
        some = np.argsort(-chunks["size"], kind="stable")[:4096]    # fewer chunks only loosen the bound
        step = max(1, CELLS // max(1, len(some)))
        for low in range(0, len(out), step):
            far = self.angles[low:low + step][:, chunks["cell"][some]] + chunks["hi"][some]
            first = np.argpartition(far, self.k, axis=1)[:, :self.k + 1] if len(some) > self.k + 1 else np.broadcast_to(np.arange(len(some)), far.shape)
            ends = np.take_along_axis(far, first, 1)
            order = np.argsort(ends, axis=1)
            held = np.cumsum(np.take_along_axis(chunks["size"][some][first], order, 1), axis=1) > self.k
            at = np.argmax(held, axis=1)[:, None]
            reach = np.take_along_axis(ends, np.take_along_axis(order, at, 1), 1)[:, 0]
            out[low:low + step] = np.where(held.any(1) & (reach < math.pi / 2), -np.cos(np.minimum(reach, math.pi / 2)), 0.0)
        return out

    def open(self, low: int, high: int, chunks: dict, which: np.ndarray) -> np.ndarray:
        """Chunks of ``which`` that may hold one of the nearest of a class from ``low`` to ``high``."""
        limit = -np.minimum(self.far[low:high, -1], self.bound[low:high]) - SLACK
        reach = np.arccos(np.clip(limit, -1.0, 1.0))[:, None]
        cell, at = np.unique(chunks["cell"][which], return_inverse=True)
        most, least = ((self.angles[low:high, cell] + sign * reach)[:, at] for sign in (1, -1))
        return which[((most >= chunks["lo"][which]) & (least <= chunks["hi"][which])).any(0)]

    def meet(self, low: int, high: int, other: Block, chunks) -> None:
        """Take in the classes of some chunks of ``other`` for the classes from ``low`` to ``high``,
        few at first, as little is known of the nearest then."""
        runs = [np.arange(*other.runs[int(c)]) for c in chunks]
        members, at, step = np.concatenate(runs) if runs else np.arange(0), 0, MEMBERS // 8
        while at < len(members):
            self._meet(low, high, other, members[at:at + step])
            at, step = at + step, min(2 * step, MEMBERS)

    def _dots(self, rows: np.ndarray, other: Block, members: np.ndarray) -> np.ndarray:
        width = min(self.block.width, other.width)
        if self.block.dense and other.dense:
            return self.block.counts[rows, :width] @ other.counts[members, :width].T
        return dots(self.block.of_rows(rows), len(rows), other.of_rows(members), len(members))

    def _meet(self, low: int, high: int, other: Block, members: np.ndarray) -> None:
        k, mine = self.k, self.block
        self.looked += (high - low) * len(members)
        limit = np.minimum(self.far[low:high, -1], np.where(self.bound[low:high] < 0, self.bound[low:high] + SLACK, np.inf))
        width = min(mine.width, other.width)
        if narrow := mine.dense and other.dense:
            # a product of unit vectors is wrong by less than (width + 4) / 2^24
            least = (-limit - (width + 8) / 2 ** 23 - 1e-6).astype(np.float32)
            run = len(members) == members[-1] - members[0] + 1
            mask = mine.unit[low:high, :width] @ other.unit[slice(members[0], members[-1] + 1) if run else members, :width].T >= least[:, None]
            at = np.flatnonzero(mask)
            if not len(at):
                return
            row, column = np.divmod(at, len(members))
            many = np.bincount(row, minlength=high - low) > 8 * (k + 1)
        else:
            many = np.ones(high - low, dtype=bool)
        found = []
        if narrow and not many.all():
            few = ~many[row]
            row, column = row[few], column[few]
            dot = np.einsum("ij,ij->i", mine.counts[low + row, :width], other.counts[members[column], :width])
            far = -(dot / (mine.norm[low + row] * other.norm[members[column]]))
            near = far <= limit[row]
            found.append((row[near], members[column[near]], far[near]))
        if many.any():
            found.append(self._among(low, np.flatnonzero(many), limit[many], other, members))
        row, member, far = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(row):
            return
        n_ids = other.first_id[member + 1] - other.first_id[member]
        at = np.repeat(other.first_id[member] - np.append(0, np.cumsum(n_ids)[:-1]), n_ids) + np.arange(n_ids.sum())
        touched = np.unique(row)
        place = np.searchsorted(touched, row)
        rows = np.concatenate([np.repeat(place, n_ids), np.repeat(np.arange(len(touched)), k + 1)])
        fars = np.concatenate([np.repeat(far, n_ids), self.far[low + touched].ravel()])
        ids = np.concatenate([other.ids[at], self.id[low + touched].ravel()])
        order = np.lexsort((ids, fars, rows))
        begin = np.searchsorted(rows[order], np.arange(len(touched)))
        best = order[begin[:, None] + np.arange(k + 1)]
        self.far[low + touched], self.id[low + touched] = fars[best], ids[best]

    def _among(self, low: int, rows: np.ndarray, limit: np.ndarray, other: Block, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, member, far) of the members that a row may take in, no more than k + 1 of a row:
        k + 1 classes by (far, smallest id) hold the k + 1 nearest ids."""
        k = self.k
        members = members[np.argsort(other.ids[other.first_id[members]], kind="stable")]    # ties: smaller id
        far = -(self._dots(low + rows, other, members) / (self.block.norm[low + rows, None] * other.norm[members]))
        mask = far <= limit[:, None]
        many = np.flatnonzero(mask.sum(1) > k + 1)
        if len(many):
            least = np.partition(far[many], k, axis=1)[:, k:k + 1]
            under, tied = far[many] < least, far[many] == least
            mask[many] = under | tied & (np.cumsum(tied, axis=1) <= k + 1 - under.sum(1, keepdims=True))
        row, column = np.nonzero(mask)
        return rows[row], members[column], far[row, column]


def _tables(counts: DataFrame, k: int, pivots: int, chunk: int, width: float):
    """Customers (id_cliente, cls), packed blocks, the facts of the chunks and the pivots."""
    kinds = counts.filter("n > 0").select("nombre_categoria").distinct()
    number = (F.row_number().over(Window.orderBy("nombre_categoria")) - 1).alias("c")  # one row per category
    numbered = counts.filter("n > 0").join(checked_broadcast(cut_lineage(kinds.select("nombre_categoria", number))), "nombre_categoria")
    vectors = (numbered.groupBy("id_cliente")
               .agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cats"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")))
    vectors = cut_lineage(vectors.withColumn("cls", F.sha2(F.to_json("cats"), 256)))
    smallest = F.row_number().over(Window.partitionBy("cls").orderBy("id_cliente"))
    classes = cut_lineage(vectors.withColumn("rk", smallest).filter(F.col("rk") <= k + 1).groupBy("cls")
                          .agg(F.array_sort(F.collect_list("id_cliente")).alias("ids"), F.first("cats").alias("cats"), F.first("norm").alias("norm")))
    some = pack(classes.orderBy(F.xxhash64("cls"), "cls").limit(pivots).select("*", F.lit(0).alias("block"), F.lit(0).alias("at")).toArrow()
                ).to_pylist() if not classes.isEmpty() else []     # no more than ``pivots`` rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = Block(some[0])
            table = pa.table({**{c: batch[c] for c in batch.schema.names}, "block": pa.array(np.zeros(len(batch), np.int32)), "at": pa.array(np.arange(len(batch), dtype=np.int32))})
            angles = angles_to(Block(pack(table).to_pylist()[0]), of) if len(batch) else np.zeros((0, 1))
            cell = angles.argmin(1)
            angle = angles[np.arange(len(batch)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.floor(angle / width).astype(np.int32)), pa.array(angle)],
                                             names=[*batch.schema.names, "cell", "ring", "angle"])
    placed = cut_lineage(classes.mapInArrow(place, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, cell int, ring int, angle double"))
    # pivots x pi/2/width rows at most
    rings = F.broadcast(cut_lineage(placed.groupBy("cell", "ring").agg(F.count("*").alias("held"))))
    dealt = placed.join(rings, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / chunk)).cast("int")).drop("held")
    facts = dealt.groupBy("cell", "ring", "part").agg(F.count("*").alias("size"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).toArrow()
    facts = facts.sort_by([(c, "ascending") for c in ("cell", "ring", "part")])     # one row per chunk
    chunks = {c: facts[c].to_numpy() for c in ("cell", "ring", "part", "size", "lo", "hi")}
    most = max(chunk, min(BLOCK * chunk, int(chunks["size"].sum()) // BLOCKS))
    chunks["block"] = (np.cumsum(chunks["size"]) - chunks["size"]) // most
    where = [(int(a), int(b), int(c), i, int(d)) for i, (a, b, c, d) in enumerate(zip(*(chunks[x] for x in ("cell", "ring", "part", "block")), strict=True))]
    at = F.broadcast(counts.sparkSession.createDataFrame(where, "cell int, ring int, part int, at int, block int"))
    blocks = cut_lineage(dealt.join(at, ["cell", "ring", "part"]).select("block", "at", "cls", "cats", "norm", "ids")
                         .repartition(_spread(chunks), "block").groupBy("block").applyInArrow(pack, PACKED))
    return vectors.select("id_cliente", "cls"), blocks, chunks, some


def _spread(chunks: dict) -> int:
    """Partitions for the blocks: a block is long work and little data, so none are put together by size."""
    return SPREAD * (int(chunks["block"].max(initial=0)) + 1)


FOUND = "looked long, meets array<int>, far binary, near binary, bound binary"


def _within(blocks: DataFrame, chunks: dict, pivots: list, k: int) -> DataFrame:
    """Blocks with the nearest of their classes among themselves and the other blocks to meet."""
    shared = blocks.sparkSession.sparkContext.broadcast((chunks, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, pivots = shared.value
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                block, number = Block(row.to_pylist()[0]), row["block"][0].as_py()
                best = Nearest(block, Block(pivots[0]), chunks, k)
                own, meets = np.array(list(block.runs)), set()
                for low, high, group in block.groups(chunks["cell"]):
                    best.meet(low, high, block, group)
                    best.meet(low, high, block, np.setdiff1d(best.open(low, high, chunks, own), group))
                others = np.flatnonzero(chunks["block"] != number)
                for low, high, _ in block.groups(chunks["cell"]):
                    for k0 in range(0, len(others), 4096):
                        meets.update(chunks["block"][best.open(low, high, chunks, others[k0:k0 + 4096])].tolist())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([best.looked], pa.int64()), pa.array([sorted(meets)], pa.list_(pa.int32())),
                                                  *(pa.array([x.tobytes()], pa.binary()) for x in (best.far, best.id, best.bound))],
                                                 names=[*row.schema.names, "looked", "meets", "far", "near", "bound"])
    return cut_lineage(blocks.mapInArrow(run, f"{PACKED}, {FOUND}"))


def _met(blocks: DataFrame, chunks: dict, pivots: list, k: int) -> DataFrame:
    """(cls, top, looked) of every class: its k + 1 nearest ids as (far, id), and the number of
    pairs that its block has looked at (with its first class)."""
    shared = blocks.sparkSession.sparkContext.broadcast((chunks, pivots))
    packed = ["chunk", "size", "cat", "n", "norm", "ids", "n_ids"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cls", "array<string>"), ("looked", "long"), ("far", "binary"), ("near", "binary"), ("bound", "binary"))]
    targets = blocks.select(F.col("block").alias("target"), F.lit(-1).alias("member"), *packed, "cls", "looked", "far", "near", "bound")
    wanted = blocks.select(F.col("block").alias("target"), F.explode("meets").alias("member"))
    members = wanted.join(blocks.select(F.col("block").alias("member"), *packed), "member").select("target", "member", *packed, *none)
    # a target and the blocks it meets follow each other; only one of them is held at a time
    stream = targets.unionByName(members).repartition(_spread(chunks), "target").sortWithinPartitions("target", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, pivots = shared.value
        best = names = None

        def result() -> pa.RecordBatch:
            looked = np.zeros(len(names), dtype=np.int64)
            looked[0] = best.looked
            known = np.isfinite(best.far)
            offsets = np.append(0, np.cumsum(known.sum(1))).astype(np.int32)
            top = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(best.far[known]), pa.array(best.id[known])], ["far", "id"]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), top, pa.array(looked)], names=["cls", "top", "looked"])
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["member"] < 0:
                    if best is not None:
                        yield result()
                    block, names = Block(row), row["cls"]
                    best = Nearest(block, Block(pivots[0]), chunks, k, row)
                    groups = list(block.groups(chunks["cell"]))
                else:
                    other = Block(row)
                    which = np.array(list(other.runs))
                    for low, high, _ in groups:
                        best.meet(low, high, other, best.open(low, high, chunks, which))
        if best is not None:
            yield result()
    return stream.mapInArrow(run, "cls string, top array<struct<far: double, id: long>>, looked long")


def _nearest_of_classes(counts: DataFrame, k: int, pivots: int, chunk: int, width: float) -> tuple[DataFrame, DataFrame]:
    """Customers (id_cliente, cls) and the nearest of every class."""
    customers, blocks, chunks, some = _tables(counts.filter("id_cliente is not null"), k, pivots, chunk, width)
    return customers, _met(_within(blocks, chunks, some, k), chunks, some, k)


def all_neighbours(counts: DataFrame, n_neighbors: int = 10, pivots: int = 64, chunk: int = 256, width: float = 0.1) -> DataFrame:
    """(target, id_cliente, sim, rank) of the nearest customers of every customer by the cosine of
    ``counts`` (id_cliente, nombre_categoria, n); ties: smaller id. Customers without a common
    category take part with similarity 0. A lone customer and an empty table give no rows; rows
    with a null customer are no customers.

    ``pivots``, ``chunk`` and ``width`` change the work, never the result."""
    customers, met = _nearest_of_classes(counts, n_neighbors, pivots, chunk, width)
    mine = F.slice(F.filter("top", lambda b: b["id"] != F.col("id_cliente")), 1, n_neighbors)
    return (customers.join(met, "cls").select(F.col("id_cliente").alias("target"), F.posexplode(mine).alias("at", "b"))
            .select("target", F.col("b.id").alias("id_cliente"), (-F.col("b.far")).alias("sim"), (F.col("at") + 1).cast("long").alias("rank")))


def pruned_share(counts: DataFrame, n_neighbors: int = 10, pivots: int = 64, chunk: int = 256, width: float = 0.1) -> float:
    """Share of all pairs of classes that ``all_neighbours`` never looks at."""
    _, met = _nearest_of_classes(counts, n_neighbors, pivots, chunk, width)
    n, looked = met.agg(F.count("*"), F.sum("looked")).first()
    return 1 - looked / (n * n) if n else math.nan
