"""Records: latest deliveries, duplicate entries, identifiers, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``; equal ones are settled by ``ties``, else by title or content."""
    settle = [F.col(t) for t in ties] or ([F.col("title")] if "title" in rows.columns else [])
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *settle)
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_duplicates(rows: DataFrame, key: Column, id_col: str, best: list[Column], fill: list[str], any_of: list[str]) -> DataFrame:
    """One record per key.

    The best row, by ``best`` and then the id, keeps its id; fields of ``fill`` come from the
    first row, in that order, that has them; flags of ``any_of`` are set if any row has them.
    The other ids are listed in ``duplicate_ids``.  Rows with a null key stay alone.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(best)], F.col(id_col).alias("oid"))
    r = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("\x00"), F.col(id_col).cast("string")))).withColumn("_order", order)
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in fill]
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of]
    g = r.groupBy("_key").agg(F.min_by(id_col, "_order").alias(id_col), *picks, *flags, F.array_sort(F.collect_set(id_col)).alias("_ids"))
    return g.withColumn("duplicate_ids", F.array_remove("_ids", F.col(id_col))).drop("_key", "_ids")


def global_ids(rows: DataFrame, *order: str, name: str = "gid") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without moving all rows into one task.

    Rows are range-partitioned and sorted; the size of each partition gives its offset.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from papyrine.session import cut

    r = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = r.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_o")
    rank = Window.partitionBy("_p").orderBy("_i")
    return r.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_o") + F.row_number().over(rank) - 1).cast("long")).drop("_p", "_i", "_o")


def coverage(rows: DataFrame, by: str, *fields: str) -> DataFrame:
    """Per group, how many rows there are and what share of them has each field."""
    share = [F.round(F.avg(F.col(f).isNotNull().cast("double")), 6).alias(f"has_{f}") for f in fields]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *share)


def require_coverage(rows: DataFrame, field: str, least: float = 0.9) -> DataFrame:
    """The rows, unless too few of them have the field; then an error names the share."""
    has, n = rows.agg(F.count(field), F.count("*")).first()
    if n and has / n < least:
        raise ValueError(f"only {has} of {n} rows have {field}")
    return rows


#: Ranges of the hash in which a stratum is counted before it is ranked.
RANGES = 4096


def stratified_sample(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 11) -> DataFrame:
    """Of every stratum the share given, one row at least: those with the smallest seeded hash of the key.

    Rows are counted by stratum and hash range first; whole ranges below the cut are taken, and only
    the range that holds the cut is ranked, so a stratum of most rows is never sorted in one task.
    """
    r = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_b", F.floor((F.col("_h") / 2.0**63 + 1) * (RANGES / 2)).cast("int"))
    c = r.groupBy(stratum, "_b").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(stratum)
    upto = total.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_k", F.greatest(F.lit(1), F.round(F.sum("_n").over(total) * share)))
    c = c.where(F.col("_before") < F.col("_k")).withColumn("_whole", F.col("_before") + F.col("_n") <= F.col("_k")).select(F.col(stratum).alias("_s"), "_b", "_before", "_k", "_whole")
    r = r.join(c.withColumnRenamed("_b", "_b2"), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2")))
    whole = r.where("_whole").select(*rows.columns)
    edge = r.where("not _whole").withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)))
    return whole.unionByName(edge.where("_before + _r <= _k").select(*rows.columns))


def intern(rows: DataFrame, term: str, position: str) -> DataFrame:
    """(term, id): terms numbered in the order in which they are first seen."""
    first = rows.where(F.col(term).isNotNull()).groupBy(term).agg(F.min(position).alias("first"))
    return global_ids(first, "first", term, name="id").select(term, "id")


def budget_text(chunks: DataFrame, doc: str, priority: str, position: str, text: str, most: int) -> DataFrame:
    """Chunks of each document in order until ``most`` characters are used; the last one is cut."""
    w = Window.partitionBy(doc).orderBy(priority, position).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return chunks.withColumn("_u", used).where(F.col("_u") < most).withColumn("kept", F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_u")).cast("int"))).drop("_u")


def fields_from(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the first frame, empty ones filled from the second (left join, field by field)."""
    other = secondary.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    filled = [F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.nullif(F.trim(F.col(f"_{f}")), F.lit(""))).alias(f) for f in fields]
    rest = [c for c in primary.columns if c not in fields]
    return primary.join(other, key, "left").select(*rest, *filled)
