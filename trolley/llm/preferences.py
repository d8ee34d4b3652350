"""Chat formatting for preference training: the longest common turn prefix of a chosen and a
rejected conversation is rendered once as the prompt; what follows is the pair of masked
completions. DataFrame functions only.

The result has one row per rendered turn, so no conversation is gathered into one row or
task, however long it is. Two conversations are compared turn number by turn number through
fingerprints; the first turn number at which they differ is a ``min`` per pair, combined
before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

# Turn frame of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
FIRST = -(2 ** 63)  # place of a turn without a number: before all others


def render(role: Column, text: Column) -> Column:
    """``<|im_start|>role\\ntext<|im_end|>\\n``; frame strings inside role or text get a space
    after ``<|``, so they cannot open or close a turn. Nulls render as empty."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), clean(role), F.lit("\n"), clean(text), F.lit(CLOSE + "\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, side (``chosen`` or ``rejected``), turn, role, text; other columns
    are ignored, as are rows with another side.

    Result: pair_id, part (``prompt``, ``chosen`` or ``rejected``), turn, role, rendered,
    train. The prompt is every turn before the first turn number at which the two sides do
    not hold the same rows (role and text); it appears once. ``train`` marks the turns whose
    tokens count in the loss: assistant turns of the completions. Concatenating ``rendered``
    by turn gives the texts.

    Sides that never differ are all prompt, without completions. A missing side: all of the
    other is its completion. A null turn number stands before all others; null role and
    text compare as null and render as empty; null pair_ids form one pair. Repeated rows of
    one turn must be repeated on both sides to be common and stay repeated."""
    rows = (turns.filter("side in ('chosen', 'rejected')")
            .select("pair_id", "side", "turn", "role", "text"))
    place = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST))
    mine = lambda side, c: F.when(F.col("side") == side, c)
    print_of = [F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull()),
                F.xxhash64(F.lit(7), F.reverse("text"), F.length("text"), "role")]
    sums = [F.sum(mine(s, h.cast("decimal(20,0)"))).alias(f"{s}{k}")
            for s in ("chosen", "rejected") for k, h in enumerate(print_of)]
    counts = [F.count(mine(s, F.lit(1))).alias(f"{s}_n") for s in ("chosen", "rejected")]
    same = F.expr("chosen_n = rejected_n and chosen0 <=> rejected0 and chosen1 <=> rejected1")
    cut = (rows.groupBy("pair_id", place.alias("place")).agg(*sums, *counts)
           .groupBy(F.col("pair_id").alias("of")).agg(F.min(F.when(~same, F.col("place"))).alias("cut")))
    split = rows.join(cut, F.col("pair_id").eqNullSafe(F.col("of")), "left")
    common = F.col("cut").isNull() | (place < F.col("cut"))
    return (split.filter(~common | (F.col("side") == "chosen"))
            .select("pair_id", F.when(common, F.lit("prompt")).otherwise(F.col("side")).alias("part"), "turn", "role",
                    render(F.col("role"), F.col("text")).alias("rendered"),
                    F.when(~common & F.col("role").eqNullSafe(F.lit("assistant")), F.lit(1)).otherwise(F.lit(0)).alias("train")))


def with_rejected(turns: DataFrame) -> DataFrame:
    """Pairs from conversations without preference labels: each conversation is the chosen side
    of the pair of its id; the rejected side is the same turns with the text of its last
    assistant turn taken from another conversation, the one with the next id, or where that has
    none, the first one that has. So every turn before the answer is shared.

    A conversation without an assistant turn, and one whose answer equals the other's, has equal
    sides and is all prompt. Several assistant rows under the last number are all replaced; the
    text taken is the greatest of such. Null ids form one pair."""
    answers = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"), "text")).alias("a"))
    first = answers.filter("conv_id is not null").agg(F.min_by("a.text", "conv_id")).scalar()
    other = answers.select((F.col("conv_id") - 1).alias("of"), F.col("a.text").alias("answer"), F.lit(True).alias("found"))
    last = answers.join(other, F.col("conv_id") == F.col("of"), "left").select(
        F.col("conv_id").alias("own"), F.col("a.turn").alias("last"), F.when(F.col("found"), F.col("answer")).otherwise(first).alias("answer"))
    both = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").join(last, F.col("pair_id").eqNullSafe(F.col("own")), "left")
    here = (F.col("role") == "assistant") & (F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)) == F.col("last"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    sides = F.array(side("chosen", F.col("text")), side("rejected", F.when(here, F.col("answer")).otherwise(F.col("text"))))
    return both.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "turn", "role", "s.side", "s.text")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preference labels; see with_rejected."""
    return format_preferences(with_rejected(table(spark, sf_dir, "conversations")))


SQL = """
WITH answers AS (SELECT conv_id, max(turn) AS turn, arg_max(text, struct_pack(a := turn, b := text)) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
last AS (SELECT a.conv_id, a.turn, CASE WHEN b.conv_id IS NOT NULL THEN b.text ELSE (SELECT arg_min(text, conv_id) FROM answers) END AS answer
  FROM answers a LEFT JOIN answers b ON b.conv_id = a.conv_id + 1),
t AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, role, CASE WHEN role = 'assistant' AND c.turn = l.turn THEN l.answer ELSE c.text END
  FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id),
g AS (SELECT pair_id, turn, list(struct_pack(role := role, text := text) ORDER BY role, text) FILTER (side = 'chosen') AS c,
  list(struct_pack(role := role, text := text) ORDER BY role, text) FILTER (side = 'rejected') AS r FROM t GROUP BY ALL),
cuts AS (SELECT pair_id, min(turn) AS cut FROM g WHERE c IS DISTINCT FROM r GROUP BY pair_id)
SELECT pair_id, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS part, turn, role,
  '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered,
  CAST(NOT (cut IS NULL OR turn < cut) AND coalesce(role = 'assistant', false) AS INTEGER) AS train
FROM t LEFT JOIN cuts USING (pair_id) WHERE NOT (cut IS NULL OR turn < cut) OR side = 'chosen'
"""
