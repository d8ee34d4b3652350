"""Baskets, sampling, frequent itemsets and association rules (A17, A18, A22, A26,
M1–M4, R8, R9, F13).

Itemsets come from Spark ML's parallel FP-growth. Rules are derived here because
``FPGrowthModel.associationRules`` only emits one-item consequents: the consequents of
every frequent itemset X grow item by item, in sorted order. Moving an item from the
antecedent to the consequent never raises the confidence, so only consequents that hold
the confidence grow on. Counts of both sides are joined from the itemset table on their
sorted item arrays; downward closure guarantees that they are there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window, functions as F

from trolley.functions.labels import rule_text
from trolley.functions.numeric import round_even
from trolley.plans.joins import checked_broadcast
from trolley.schemas import BASKET_KEYS
from trolley.session import cut_lineage

def rule_order():
    """Total order of rules: lift, confidence, support (desc), then the sides."""
    return [F.desc("lift"), F.desc("confidence"), F.desc("support"),
            F.asc("antecedents"), F.asc("consequents")]


def baskets(items: DataFrame, item_col: str = "id_producto", keys=BASKET_KEYS) -> DataFrame:
    """One row per basket (day, store, customer) with its sorted distinct items.

    A basket holds at most the number of distinct items, and ``collect_set`` is merged
    map-side, so no group grows with the number of rows."""
    return (items.filter(F.col(item_col).isNotNull())
            .groupBy(*keys).agg(F.array_sort(F.collect_set(item_col)).alias("items")))


def raw_baskets(raw: DataFrame, keys=BASKET_KEYS) -> DataFrame:
    """Baskets straight from raw text lines: distinct integer tokens, empty lines dropped."""
    basket = F.trim(F.coalesce(F.col("basket_raw"), F.lit("")))
    toks = F.transform(F.split(basket, r"\s+"), lambda t: t.try_cast("long"))
    items = F.array_sort(F.array_distinct(F.filter(toks, lambda x: x.isNotNull())))
    return (raw.filter(basket != "").select(*keys, items.alias("items"))
            .filter(F.size("items") > 0))


def hash_sample_threshold(frac: float) -> str:
    """8-hex-digit bound t such that hex(md5 prefix) < t keeps ``frac`` of the keys."""
    return format(min(math.ceil(frac * 2 ** 32), 2 ** 32 - 1), "08x")


def hash_sample(df: DataFrame, frac: float, keys=BASKET_KEYS) -> DataFrame:
    """Deterministic Bernoulli sample on the key digest; independent of partitioning and
    re-runs, and reproducible in any engine with md5."""
    if frac >= 1.0:
        return df
    digest = F.substring(F.md5(F.concat_ws("|", *[F.col(k) for k in keys])), 1, 8)
    return df.filter(digest < F.lit(hash_sample_threshold(frac)))


SAMPLE_BITS = 60    # of the key digest
LEVEL_BITS = 15     # buckets of one histogram level: 2^15


def exact_sample(df: DataFrame, frac: float, keys=BASKET_KEYS) -> DataFrame:
    """M1 with an exact size: the ``round(frac * n)`` rows (half to even) with the smallest key
    digests, ties by the keys. Reruns and other partitionings give the same rows.

    The digest of the last row is found by histogram refinement: a level counts the rows of the
    bucket that holds it by their next 15 bits, so four levels of at most 32,768 counts each
    replace a global sort. Then one filter selects the rows."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k) for k in keys])), 1, SAMPLE_BITS // 4), 16, 10).cast("long")
    hashed = cut_lineage(df.withColumn("_h", digest))
    n = hashed.count()
    left = round(frac * n)
    if left >= n or left <= 0:
        return hashed.drop("_h") if left else hashed.limit(0).drop("_h")
    low, bits = 0, SAMPLE_BITS      # the last row's digest is within [low, low + 2^bits)
    while bits:
        bits -= LEVEL_BITS
        at = F.shiftright(F.col("_h") - low, bits).alias("at")
        inside = hashed.filter(F.col("_h").between(low, low + (1 << bits + LEVEL_BITS) - 1))
        running = F.sum("c").over(Window.orderBy("at"))     # over one row per bucket
        row = (inside.groupBy(at).agg(F.count(F.lit(1)).alias("c")).withColumn("run", running)
               .filter(F.col("run") >= left).orderBy("at").first())
        low, left = low + (row["at"] << bits), left - (row["run"] - row["c"])
    below = hashed.filter(F.col("_h") < low)
    last = (hashed.filter(F.col("_h") == low)       # rows with the same 60 bits: one, as good as always
            .withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(*keys))).filter(F.col("_r") <= left).drop("_r"))
    return below.unionByName(last).drop("_h")


def random_sample(df: DataFrame, frac: float, seed: int = 42) -> DataFrame:
    return df if frac >= 1.0 else df.sample(withReplacement=False, fraction=frac, seed=seed)


MOST_FREQUENT = 10_000      # frequent items that are looked for in the baskets as one array


def frequent_itemsets(bk: DataFrame, min_support: float = 0.01, n_baskets: int | None = None) -> DataFrame:
    """(items sorted, freq, support) of every itemset with support >= ``min_support``.

    Items are counted first. With less than two frequent ones there is no larger set and FP-growth
    is not run; else it gets the frequent items of each basket (of all of them, where they are too
    many for one array). The other items are in no frequent set."""
    total, filled = bk.agg(F.count(F.lit(1)), F.count("items")).first()
    n = n_baskets if n_baskets is not None else total
    support = (F.col("freq").cast("double") / F.lit(float(max(n, 1)))).alias("support")
    ones = cut_lineage(bk.select(F.explode("items").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
                       .filter(F.col("freq") >= math.ceil(min_support * filled)))
    frequent = ones.count()
    if frequent < 2:
        return ones.select(F.array("x").alias("items"), "freq", support)
    held = bk.select("items")
    if frequent <= MOST_FREQUENT:
        held = held.select(F.array_intersect("items", ones.select(F.collect_list("x")).scalar()).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(held)
    return model.freqItemsets.select(
        F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"), support)


def itemsets_of_few(bk: DataFrame, least: int, n_baskets: int) -> DataFrame:
    """``frequent_itemsets`` that at least ``least`` baskets hold, where that is so few that almost
    every item is frequent: items and pairs are counted, and FP-growth gets what frequent pairs
    leave of each basket. The items of a larger set are pairwise frequent in every basket that holds
    it, so each is in two frequent pairs at least; only such items are paired a second time."""
    held = bk.select(F.monotonically_increasing_id().alias("b"), "items")     # ids are used inside one job only
    counted = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
    ones = counted(held.select(F.explode("items").alias("x")), "x")

    def pairs(df: DataFrame) -> DataFrame:
        each = df.filter(F.size("items") > 1).select("b", "items", F.posexplode("items").alias("i", "x"))
        return each.select("b", "x", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("y"))
    twos = cut_lineage(counted(pairs(held), "x", "y"))
    often = (twos.select(F.explode(F.array("x", "y")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("x"))
    few = (held.select("b", F.explode("items").alias("x")).join(checked_broadcast(cut_lineage(often)), "x", "left_semi")
           .groupBy("b").agg(F.array_sort(F.collect_list("x")).alias("items")).filter(F.size("items") >= 3))
    left = (pairs(few).join(checked_broadcast(twos.select("x", "y")), ["x", "y"]).groupBy("b")
            .agg(F.array_sort(F.array_union(F.collect_set("x"), F.collect_set("y"))).alias("items")).filter(F.size("items") >= 3))
    left = cut_lineage(left)
    found = (ones.select(F.array("x").alias("items"), "freq")).unionByName(twos.select(F.array("x", "y").alias("items"), "freq"))
    n = left.count()
    if n >= least:
        found = found.unionByName(frequent_itemsets(left, (least - 0.5) / n, n).select("items", "freq").filter(F.size("items") >= 3))
    return found.withColumn("support", F.col("freq").cast("double") / F.lit(float(max(n_baskets, 1))))


def association_rules(itemsets: DataFrame, n_baskets: int, min_confidence: float = 0.3,
                      digits: int = 10) -> DataFrame:
    """Every split of every frequent itemset into antecedent -> consequent with
    confidence >= ``min_confidence``; support, confidence, lift as doubles. Itemsets (sorted
    arrays) may have any size; each level is written to the checkpoint folder."""
    fi = itemsets.select("items", "freq")
    n = float(max(n_baskets, 1))
    side = checked_broadcast(fi)
    ante = side.select(F.col("items").alias("antecedents"), F.col("freq").alias("ant_freq"))
    cons = side.select(F.col("items").alias("consequents"), F.col("freq").alias("cons_freq"))
    confidence = F.col("freq").cast("double") / F.col("ant_freq").cast("double")

    def held(grown: DataFrame) -> DataFrame:
        return (grown.withColumn("antecedents", F.array_except("items", "consequents")).join(ante, "antecedents")
                .withColumn("confidence", confidence).filter(F.col("confidence") >= F.lit(float(min_confidence)))
                .select("items", "freq", "antecedents", "consequents", "confidence"))
    longest = fi.agg(F.max(F.size("items"))).first()[0] or 0
    level = cut_lineage(held(fi.filter(F.size("items") >= 2)
                             .select("items", "freq", F.explode("items").alias("x")).withColumn("consequents", F.array("x"))))
    levels = [level]
    for size in range(2, longest):   # consequents of ``size`` items
        grown = (level.filter(F.size("items") > size)
                 .select("items", "freq", "consequents", F.explode(F.filter("items", lambda x: x > F.element_at("consequents", -1))).alias("x"))
                 .select("items", "freq", F.concat("consequents", F.array("x")).alias("consequents")))
        level = cut_lineage(held(grown))
        if level.isEmpty():
            break
        levels.append(level)
    rules = reduce(DataFrame.unionByName, levels).join(cons, "consequents")
    support = F.col("freq").cast("double") / F.lit(n)
    lift = F.col("confidence") / (F.col("cons_freq").cast("double") / F.lit(n))
    return rules.select("antecedents", "consequents",
                        round_even(support, digits).alias("support"),
                        round_even(F.col("confidence"), digits).alias("confidence"),
                        round_even(lift, digits).alias("lift"))


def compute_association_rules(items: DataFrame, item_col: str = "id_producto",
                              sample_frac: float = 1.0, min_support: float = 0.01,
                              min_confidence: float = 0.3, sample: str = "hash",
                              seed: int = 42, keys=BASKET_KEYS, min_baskets: int | None = None,
                              counted: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(M1 ->) A17 -> M2 -> M3 as one job, over all baskets unless the caller asks for a
    sample (``hash``: by digest; ``exact``: of exact size; ``random``). The baskets are checkpointed into the shared
    checkpoint folder: FP-growth and the basket count then read them once each and a
    lost executor re-reads the checkpoint instead of recomputing the flat table.
    ``min_baskets`` states the support as a number of baskets instead of a share.
    ``counted``: ((x, freq) of every item, number of baskets) of ``items``, where the caller has them;
    by a share of all baskets, these are then made of frequent items only, and not at all where
    less than two are frequent."""
    if counted is not None and min_baskets is None and sample_frac >= 1.0 and (least := math.ceil(min_support * counted[1])) >= 1:
        ones, n = cut_lineage(counted[0].filter(F.col("freq") >= least)), counted[1]
        found = ones.select(F.array("x").alias("items"), "freq")
        if ones.count() >= 2:
            held = items.join(checked_broadcast(ones.select(F.col("x").alias(item_col))), item_col, "left_semi")
            bk = cut_lineage(baskets(held, item_col, keys).filter(F.size("items") >= 2))
            found = found.unionByName(frequent_itemsets(bk, (least - 0.5) / max(bk.count(), least), n).select("items", "freq").filter(F.size("items") >= 2))
        return association_rules(cut_lineage(found), n, min_confidence)
    bk = baskets(items, item_col, keys)
    if sample_frac < 1.0:
        bk = (hash_sample(bk, sample_frac, keys) if sample == "hash" else exact_sample(bk, sample_frac, keys) if sample == "exact"
              else random_sample(bk, sample_frac, seed))
    bk = cut_lineage(bk)
    n = bk.count()
    fi = cut_lineage(frequent_itemsets(bk, min_support, n) if min_baskets is None else itemsets_of_few(bk, min_baskets, n))
    return association_rules(fi, n, min_confidence)


# ---------------------------------------------------------------- queries on a rules table

def validate_top_n(top_n: int, upper: int) -> None:
    """1 <= top_n <= upper (50 for rules, 20 for customer recommendations)."""
    if not 1 <= int(top_n) <= upper:
        raise ValueError(f"top_n must be within 1..{upper}")


def recommend_for_product(rules: DataFrame, product_id, top_n: int = 5) -> DataFrame:
    """Rules whose antecedent holds ``product_id``, best lift first (P6 + O3)."""
    validate_top_n(top_n, 50)
    return (rules.filter(F.array_contains("antecedents", F.lit(product_id)))
            .orderBy(*rule_order()).limit(top_n))


def recommend_for_products(rules: DataFrame, top_n: int = 5) -> DataFrame:
    """Batch form of M4: the best ``top_n`` rules for every antecedent product.

    ``row_number() <= n`` lets Spark insert a per-task group limit before the
    shuffle, so a product found in many rules sends at most n rows per task."""
    w = Window.partitionBy("product").orderBy(*rule_order())
    return (rules.select(F.explode("antecedents").alias("product"), "*")
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_n))


def rule_products(rules: DataFrame) -> DataFrame:
    """Sorted distinct items that occur in some antecedent."""
    return rules.select(F.explode("antecedents").alias("id_producto")).distinct().orderBy("id_producto")


def best_rule(rules: DataFrame, product_id) -> DataFrame:
    """First (best-lift) rule of a product: lift, confidence, support."""
    return recommend_for_product(rules, product_id, 1).select("lift", "confidence", "support")


def rules_profile(rules: DataFrame) -> DataFrame:
    """Number of rules, mean lift, mean confidence."""
    return rules.agg(F.count(F.lit(1)).alias("n_rules"),
                     round_even(F.avg("lift"), 4).alias("mean_lift"),
                     round_even(F.avg("confidence"), 4).alias("mean_confidence"))


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """Global best rules by lift."""
    return rules.orderBy(*rule_order()).limit(n)


def rules_display(rules: DataFrame) -> DataFrame:
    """'P3, P21' texts and fixed-decimal numbers for display."""
    return rules.select(rule_text(F.col("antecedents")).alias("si_compra"),
                        rule_text(F.col("consequents")).alias("recomendar"),
                        F.format_number("lift", 3).alias("lift"),
                        F.format_number("confidence", 3).alias("confianza"),
                        F.format_number("support", 3).alias("soporte"))
