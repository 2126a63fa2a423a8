"""Shares over editions: trends, movers, shifts inside a topic, new items.

Editions differ in size, so shares per 1,000 are compared, never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.stats import Z_99, per_thousand, two_proportion_z


def edition_counts(rows: DataFrame, edition: list[str], item: str, doc: str) -> DataFrame:
    """(edition.., item, n, total): documents with the item, and all documents, per edition.

    ``rows`` has one row per (document, item) or more; documents without an item have a null
    item and count in the total only.
    """
    totals = rows.groupBy(*edition).agg(F.count_distinct(doc).alias("total"))
    counts = rows.where(F.col(item).isNotNull()).groupBy(*edition, item).agg(F.count_distinct(doc).alias("n"))
    return counts.join(totals, edition)


def share_trend(counts: DataFrame, item: str, order: str, venue: list[str] | None = None) -> DataFrame:
    """Share per 1,000 and its change against the edition before, within a venue.

    Adds per_1k, change, z and significant_99; the first edition has null for the last three.
    """
    w = Window.partitionBy(*(venue or []), item).orderBy(order)
    n0, t0 = F.lag("n").over(w), F.lag("total").over(w)
    share = per_thousand(F.col("n"), F.col("total"))
    out = counts.withColumn("n0", n0).withColumn("t0", t0).withColumn("per_1k", share)
    z = F.when(F.col("t0").isNotNull(), two_proportion_z(F.col("n0"), F.col("t0"), F.col("n"), F.col("total")))
    out = out.withColumn("change", F.col("per_1k") - per_thousand(F.col("n0"), F.col("t0"))).withColumn("z", z)
    return out.withColumn("change", F.when(F.col("t0").isNotNull(), F.col("change"))).withColumn("significant_99", F.abs("z") >= Z_99).drop("n0", "t0")


def last_editions(rows: DataFrame, venue: str, order: str, keep: int = 2) -> DataFrame:
    """The rows of the last editions of each venue, with ``age`` 0 for the newest."""
    editions = rows.select(venue, order).distinct()
    w = Window.partitionBy(venue).orderBy(F.col(order).desc())
    aged = editions.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < keep)
    return rows.join(aged, [venue, order])


def paired(counts: DataFrame, keys: list[str], side: Column, totals: DataFrame | None = None, total_keys: list[str] | None = None) -> DataFrame:
    """Counts of the older (side 0) and newer side (1) beside one another: n0, n1, t0, t1."""
    c = counts.withColumn("_s", side)
    n = c.groupBy(*keys).agg(F.sum(F.when(F.col("_s") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("_s") == 1, F.col("n")).otherwise(0)).alias("n1"))
    if totals is None:
        return n
    return n.join(totals, total_keys) if total_keys else n.crossJoin(F.broadcast(totals))


def material(n0: Column, n1: Column, t0: Column, t1: Column, delta: float, ratio: float) -> Column:
    """A change that matters: a difference per 1,000, or a ratio of a share that is not 0."""
    a, b = per_thousand(n0, t0), per_thousand(n1, t1)
    low, high = F.least(a, b), F.greatest(a, b)
    return (F.abs(a - b) >= delta) | ((low > 0) & (high >= ratio * low))


def movers(pairs: DataFrame, delta: float = 2.0, ratio: float = 1.5, bar: float = Z_99) -> DataFrame:
    """Adds share0, share1, z and direction: 'rising', 'new', 'falling' or 'steady'."""
    n0, n1, t0, t1 = (F.col(c) for c in ("n0", "n1", "t0", "t1"))
    z = two_proportion_z(n0, t0, n1, t1)
    out = pairs.withColumn("share0", per_thousand(n0, t0)).withColumn("share1", per_thousand(n1, t1)).withColumn("z", z)
    real = (F.abs("z") >= bar) & material(n0, n1, t0, t1, delta, ratio)
    direction = F.when(~real, "steady").when((n0 == 0) & (n1 > 0), "new").when(F.col("z") > 0, "rising").otherwise("falling")
    return out.withColumn("direction", direction)


def mover_sections(lanes: DataFrame, item: str, venue: str, cap: int = 5) -> DataFrame:
    """Items whose moving venues agree, ranked within rising, new and falling.

    An item that rises in one venue and falls in another has no section.  Sections are ranked
    by the number of venues and the largest |z|; new ones by their pooled share instead.
    """
    moving = lanes.where("direction <> 'steady'")
    up = F.col("direction").isin("rising", "new")
    per_item = moving.groupBy(item).agg(
        F.count(F.when(up, 1)).alias("up"), F.count(F.when(~up, 1)).alias("down"), F.min(F.when(up, F.col("direction"))).alias("kind"),
        F.max(F.abs("z")).alias("max_z"), F.sum("n1").alias("n1"), F.sum("t1").alias("t1"),
    )
    per_item = per_item.where("up = 0 or down = 0").withColumn("section", F.when(F.col("down") > 0, "falling").otherwise(F.col("kind")))
    per_item = per_item.withColumn("venues", F.col("up") + F.col("down")).withColumn("share", per_thousand(F.col("n1"), F.col("t1")))
    key = F.when(F.col("section") == "new", F.col("share")).otherwise(F.col("max_z"))
    first = F.when(F.col("section") == "rising", F.col("venues")).otherwise(F.lit(0))
    w = Window.partitionBy("section").orderBy(first.desc(), key.desc(), item)
    return per_item.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("section", "rank", item, "venues", "max_z", "share")


def inside_shifts(pairs: DataFrame, topic: str, item: str, least: int = 6, delta: float = 30.0, ratio: float = 1.5, top: int = 4, bar: float = Z_99) -> DataFrame:
    """What shifted inside each topic: moved, appeared or vanished items, strongest first.

    ``pairs`` has n0, n1 of (topic, item) and t0, t1 of the topic.  Appearing and vanishing
    items rank as |z| = 3.
    """
    out = movers(pairs.where(F.col("n0") + F.col("n1") >= least), delta, ratio, bar)
    kind = F.when((F.col("n0") <= 1) & (F.col("n1") >= 8), "appeared").when((F.col("n1") <= 1) & (F.col("n0") >= 8), "vanished").when(F.col("direction") != "steady", "moved")
    z = F.when(kind == "appeared", 3.0).when(kind == "vanished", -3.0).otherwise(F.col("z"))
    out = out.withColumn("kind", kind).where("kind is not null").withColumn("z", z)
    w = Window.partitionBy(topic).orderBy(F.abs("z").desc(), item)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(topic, "rank", item, "kind", "n0", "n1", "z")


def fresh_items(pairs: DataFrame, least: int = 6) -> DataFrame:
    """Items unseen before and named often enough now."""
    return pairs.where((F.col("n0") == 0) & (F.col("n1") >= least))


def adjusted_p(df: DataFrame, p: str, by: list[str], ties: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values as column p_adjusted, an option beside the plain z test."""
    w = Window.partitionBy(*by)
    out = df.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p, ties)))
    out = out.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    down = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_m", "_r", "_q")
