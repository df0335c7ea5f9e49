"""Problem 3: items that appear together in a basket, with lift and pointwise mutual information.

Plan: distinct (kind, basket, item) rows; counts of baskets and of items; items that cannot reach the support
are dropped (exact: a pair is never more frequent than its rarer item); the rest get dense numbers and are
gathered per basket and cut into blocks. A basket of one block gives its pairs where it is. The blocks of larger ones
are sent out by (basket, block, other block), so that every two blocks meet in a task of their own, and no task makes more
than BLOCK * BLOCK pairs from one row; pairs are counted with map-side combining. After the support filter a basket holds
at most ``1000 / per_thousand`` times the mean basket size of items, which bounds the one row that it is gathered in.

Defined results: null items, null baskets and items shorter than ``shortest`` don't count; a repeated item
counts once per basket; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.core.session import table
from litforge.core.text import normal_form

#: Items in a block of a basket.
BLOCK = 128


def pair_lift(items: DataFrame, least: int = 4, per_thousand: int = 1, lift: float = 3.0, shortest: int = 2) -> DataFrame:
    """Pairs of ``items(kind, basket, item)`` with n >= least, 1000 n >= per_thousand N and n N >= lift n_a n_b.

    Columns: kind, item_a, item_b, n, n_a, n_b, n_baskets, lift, pmi (natural logarithm); item_a < item_b.
    """
    rows = items.select("kind", "basket", "item").where(F.col("kind").isNotNull() & F.col("basket").isNotNull() & (F.length("item") >= shortest)).distinct()
    baskets = rows.select("kind", "basket").distinct().groupBy("kind").agg(F.count("*").alias("n_baskets"))
    counts = rows.groupBy("kind", "item").agg(F.count("*").alias("n_item"))
    frequent = (
        counts.join(F.broadcast(baskets), "kind")  # one row per kind of basket
        .where((F.col("n_item") >= least) & (F.col("n_item") * 1000 >= F.col("n_baskets") * per_thousand))
        .select("kind", "item", "n_item", "n_baskets")
    )
    gathered = (
        rows.join(frequent.select("kind", "item"), ["kind", "item"], "left_semi")
        .groupBy("kind", "basket")
        .agg(F.array_sort(F.collect_list("item")).alias("all"))
        .where(F.size("all") > 1)
    )
    n_blocks = F.ceil(F.size("all") / F.lit(BLOCK)).cast("int")
    ascending = lambda ys: F.explode(F.filter(ys, lambda y: y > F.col("item_a")))
    small = gathered.where(n_blocks == 1).select("kind", F.explode("all").alias("item_a"), "all").select("kind", "item_a", ascending("all").alias("item_b"))
    cuts = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice("all", i * BLOCK + 1, F.lit(BLOCK)))
    blocks = gathered.where(n_blocks > 1).select("kind", "basket", n_blocks.alias("n_blocks"), F.posexplode(cuts).alias("block", "items"))
    left = blocks.select("kind", "basket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)).alias("j"), F.col("items").alias("xs"))
    right = blocks.select("kind", "basket", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("items").alias("ys"))
    met = left.join(right, ["kind", "basket", "i", "j"]).select("kind", F.explode("xs").alias("item_a"), "ys")
    pairs = small.unionByName(met.select("kind", "item_a", ascending("ys").alias("item_b")))
    together = pairs.groupBy("kind", "item_a", "item_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a = frequent.select("kind", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n_baskets")
    b = frequent.select("kind", F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    ratio = F.col("n").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        together.join(a, ["kind", "item_a"])
        .where(F.col("n") * 1000 >= F.col("n_baskets") * per_thousand)
        .join(b, ["kind", "item_b"])
        .where(F.col("n").cast("double") * F.col("n_baskets") >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
        .select("kind", "item_a", "item_b", "n", "n_a", "n_b", "n_baskets", F.round(ratio, 6).alias("lift"), F.round(F.log(ratio), 6).alias("pmi"))
    )


def term_baskets(spark, sf_dir: str) -> DataFrame:
    """Terms of articles and of analysis runs as baskets; negated rows don't count."""
    article = table(spark, sf_dir, "entities").where(~F.coalesce("negated", F.lit(False)))
    run = table(spark, sf_dir, "term_groups").where(~F.coalesce("negated", F.lit(False)))
    return article.select(F.lit("article").alias("kind"), F.col("article_id").alias("basket"), normal_form(F.col("text")).alias("item")).unionByName(
        run.select(F.lit("run").alias("kind"), F.col("run_id").alias("basket"), normal_form(F.col("display")).alias("item"))
    )
