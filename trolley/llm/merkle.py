"""Merkle manifest of a dataset with a proof for every row, by pointer jumping.

Rows of one tree (a language, a source) are ranked by a range shuffle: a tree may hold most of
the table, so no task ever sees a whole one. Levels are hashed eight at a time, 256 neighbours
a group. Every node holds the segment of siblings towards its parent (33 bytes: side and
digest). Repeated self-joins double the distance: a node whose level is a multiple of 2s takes
over the segment of its ancestor s levels up, which reaches s levels further, until every leaf
holds its siblings up to the root. Only nodes that later jumps start from are kept, so the
ancestors' side of a join shrinks with the square of its rows while the leaves' segments double.
Above the subroot of each tree lies the path of the tree of subroots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trolley.plans.joins import checked_broadcast

from .common import stage, table

SPAN = 8        # levels hashed in one grouping
RECORD = 33     # bytes of one sibling: 0 none, 1 left of the path, 2 right of it; digest
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts in one."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: list[Column]) -> Column:
    """Digest of the values in order, each as its UTF-8 byte count, a colon and the value, or
    ``-`` where it is null: no two different rows give the same text."""
    def part(c: Column) -> Column:
        v = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return digest(*map(part, columns))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (0 and up inside each tree ``t``, by ``order``) and n (rows of the
    tree). Ranges are sorted apart; the numbers before each range come from one count per
    range and tree."""
    dealt = stage(rows.repartitionByRange("t", *order).sortWithinPartitions("t", *order)
                  .withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)       # the id is the range's number times 2^33 plus the row's
    runs = dealt.groupBy("t", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    of_tree = "(partition by t order by part rows between unbounded preceding and 1 preceding)"
    runs = runs.select("t", "part", "first", F.expr(f"coalesce(sum(m) over {of_tree}, 0)").alias("before"),
                       F.expr("sum(m) over (partition by t)").alias("n"))
    return (dealt.withColumn("part", part).join(checked_broadcast(runs), ["t", "part"])
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before"))


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes below the roots as (t, g, pos, seg): level, place and sibling record; and the
    root of each tree as (t, d, root) with its depth. ``leaves(t, pos, n, h)``."""
    cur = leaves.select("t", "pos", depth(F.col("n")).alias("d"), "h")
    most = cur.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    roots, nodes, base = cur.filter("d = 0").select("t", "d", F.col("h").alias("root")), None, 0
    above = "transform(sequence(0, (size(x) - 1) div 2), k -> sha2(concat(x[2 * k], coalesce(get(x, 2 * k + 1), '')), 256))"
    while base < most:
        block = (cur.filter(F.col("d") > base).groupBy("t", "d", F.shiftright("pos", SPAN).alias("block"))
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("kids"))
                 .withColumn("up", F.least(F.lit(SPAN), F.col("d") - base))
                 .withColumn("levels", F.expr(f"aggregate(sequence(1, up), array(kids.h), (acc, i) -> concat(acc, array("
                                              f"transform(array(element_at(acc, -1)), x -> {above})[0])))")))
        block = stage(block.drop("kids"), "levels")
        seg = ("unhex(coalesce(concat(if(j % 2 = 1, '01', '02'), get(levels[i], if(j % 2 = 1, j - 1, j + 1))), "
               f"repeat('00', {RECORD})))")
        found = block.select("t", F.explode(F.expr(
            "flatten(transform(sequence(0, up - 1), i -> transform(levels[i], (h, j) -> named_struct("
            f"'g', i + {base}, 'pos', shiftleft(block, {SPAN} - i) + j, 'seg', {seg}))))")).alias("x")).select("t", "x.*")
        nodes = found if nodes is None else nodes.unionByName(found)
        top = block.select("t", F.col("block").alias("pos"), "d", F.expr("levels[up][0]").alias("h"))
        base += SPAN
        roots = roots.unionByName(top.filter(F.col("d") <= base).select("t", "d", F.col("h").alias("root")))
        cur = top
    if nodes is None:
        nodes = leaves.limit(0).select("t", F.lit(0).alias("g"), "pos", F.lit(b"").alias("seg"))
    return nodes, roots


def jump(nodes: DataFrame, height: int) -> DataFrame:
    """(t, pos, seg) of the leaves with the siblings of all levels up to the root."""
    nodes, step = stage(nodes, "nodes"), 1
    while step < height:
        level = F.col("g") % (2 * step)
        far = nodes.filter(level == step).select(F.col("t").alias("at"), (F.col("g") - step).alias("ag"), F.col("pos").alias("ap"), F.col("seg").alias("more"))
        if step >= SPAN:    # a 256th of the leaves, or far fewer; checked before it is broadcast
            far = checked_broadcast(far)
        near = nodes.filter(level == 0)
        nodes = stage(near.join(far, (F.col("t") == F.col("at")) & (F.col("g") == F.col("ag")) & (F.shiftright("pos", step) == F.col("ap")), "left")
                      .select("t", "g", "pos", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg")), "nodes")
        step *= 2
    return nodes.filter("g = 0").select("t", "pos", "seg")


def prove(rows: DataFrame, tree: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """``rows`` with subroot (of the row's tree), root (of all) and proof (binary: 33 bytes a
    level up to the root, see RECORD).

    Leaves of a tree are ordered by ``order`` (nulls first), then by digest; equal rows are
    leaves of their own. Every two neighbours give a node, the last of an odd number one of its
    own; a tree of one row is its leaf. Trees are ordered by name in UTF-8, null first; an empty
    table has no row. Columns of ``rows`` named subroot, root or proof are replaced."""
    names = [c for c in rows.columns if c.lower() not in ("subroot", "root", "proof")]
    given = rows.select(F.struct(*names).alias("row"), F.coalesce(F.concat(F.lit("1"), F.col(tree)), F.lit("0")).alias("t"),
                        F.col(leaf).alias("h"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)],
                        F.monotonically_increasing_id().alias("salt"))     # equal rows fall into several ranges
    keys = [*(f"o{k}" for k in range(len(order))), "h", "salt"]
    leaves = stage(ranked(stage(given, "leaves"), keys).select("t", "pos", "n", "h", "row"), "ranked")
    nodes, roots = grow(leaves)
    roots = stage(roots, "roots")
    tops = stage(ranked(roots.select(F.lit("").alias("t"), F.col("t").alias("o"), F.col("root").alias("h"), "d"), ["o"]), "tops")
    upper, whole = grow(tops)
    upper, whole = stage(upper, "upper"), stage(whole, "whole")
    one = whole.select("d", "root").first()
    if one is None:
        return rows.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in (("subroot", "string"), ("root", "string"), ("proof", "binary"))))
    # the path of each subroot through the tree of subroots, as a chain above its tree
    if one["d"]:
        steps = tops.select(F.col("o").alias("t"), "d", "pos", F.explode(F.sequence(F.lit(0), F.lit(one["d"] - 1))).alias("k"))
        chain = (steps.withColumn("pos", F.expr("shiftright(pos, k)")).join(upper.select(F.col("g").alias("k"), "pos", "seg"), ["k", "pos"])
                 .select("t", (F.col("d") + F.col("k")).alias("g"), F.lit(0).cast("long").alias("pos"), "seg"))
        nodes = nodes.unionByName(chain)
    height = roots.agg(F.max("d")).first()[0] + one["d"]
    proofs = jump(nodes, height)
    return (leaves.join(checked_broadcast(roots.select("t", F.col("root").alias("subroot"))), "t").join(proofs, ["t", "pos"], "left")
            .select("row.*", "subroot", F.lit(one["root"]).alias("root"), F.coalesce("seg", F.lit(b"")).alias("proof")))


def siblings(proof: Column) -> Column:
    """Array of (side, hex digest) of a proof, from the leaf to the root; empty digests where a
    node has no sibling."""
    def record(i: Column) -> Column:
        side = F.substring(F.hex(F.substring(proof, i * RECORD + 1, F.lit(1))), 2, 1)
        return F.struct(side.alias("side"), F.when(side == "0", "").otherwise(F.lower(F.hex(F.substring(proof, i * RECORD + 2, F.lit(32))))).alias("h"))
    levels = (F.octet_length(proof) / RECORD).cast("int")
    return F.when(levels > 0, F.transform(F.sequence(F.lit(0), levels - 1), record)).otherwise(F.array().cast("array<struct<side:string,h:string>>"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(siblings(proof), leaf, lambda acc, s: F.sha2(F.when(s["side"] == "1", F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"])), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select("doc_id", "lang", leaf_hash([F.col(c) for c in LEAF]).alias("leaf"),
                       leaf_hash([changed if c == "n_chars" else F.col(c) for c in LEAF]).alias("tampered"))
    found = prove(rows, "lang", ["doc_id"])
    return (found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform(siblings(F.col("proof")), lambda s: s["h"]), ""), 256).alias("proof_sha256"),
                         fold(F.col("tampered"), F.col("proof")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _leaf_sql(n_chars: str) -> str:
    part = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in LEAF) + ")"


SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY n) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n) s),
d AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 7 = 0 AS hit FROM documents, crc_table),
leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + CAST(hit AS INTEGER))")} AS changed,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2),
subs AS (SELECT tree, h AS subroot, lvl AS depth FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, tree AS pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
tops AS (SELECT h AS root, lvl AS depth FROM high WHERE n = 1),
steps AS (
  SELECT p.doc_id, p.tree, p.pos AS leaf_pos, l AS lvl, (p.pos >> l) & 1 AS odd, coalesce(s.h, '') AS sib
  FROM placed p JOIN subs USING (tree), unnest(range(depth)) AS r(l)
  LEFT JOIN low s ON s.tree = p.tree AND s.lvl = l AND s.pos = xor(p.pos >> l, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, b.depth + l, (p.tree >> l) & 1, coalesce(s.h, '')
  FROM placed p JOIN subs b USING (tree), tops t, unnest(range(t.depth)) AS r(l)
  LEFT JOIN high s ON s.lvl = l AND s.pos = xor(p.tree >> l, 1)),
folded AS (
  SELECT p.tree, p.pos, 0 AS lvl, changed AS h FROM placed p
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, sha256(CASE WHEN s.odd = 1 THEN s.sib || f.h ELSE f.h || s.sib END)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.leaf_pos = f.pos AND s.lvl = f.lvl),
ends AS (SELECT tree, pos, arg_max(h, lvl) AS folded_root FROM folded GROUP BY 1, 2),
proofs AS (SELECT tree, leaf_pos AS pos, string_agg(sib, '' ORDER BY lvl) AS path FROM steps GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, b.subroot, t.root, sha256(coalesce(path, '')) AS proof_sha256, folded_root, folded_root = t.root AS verified
FROM placed p JOIN subs b USING (tree) JOIN ends e ON e.tree = p.tree AND e.pos = p.pos LEFT JOIN proofs r ON r.tree = p.tree AND r.pos = p.pos, tops t
"""
