"""Which (field, technique) cell is filled next: sparse cells, scorers and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, field: str, technique: str, doc: str, least_field: int, least_technique: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observed (field, technique, n), and the fields (nf) and techniques (nt) that are large enough.

    Rows have a null field where a document declares none: a technique is established by its use anywhere.
    """
    f = rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.count_distinct(doc).alias("nf")).where(F.col("nf") >= least_field)
    t = rows.where(F.col(technique).isNotNull()).groupBy(technique).agg(F.count_distinct(doc).alias("nt")).where(F.col("nt") >= least_technique)
    c = rows.join(f.select(field), field, "left_semi").join(t.select(technique), technique, "left_semi").groupBy(field, technique).agg(F.count_distinct(doc).alias("n"))
    return c, f, t


def empty_cells(observed: DataFrame, fields: DataFrame, techniques: DataFrame, field: str, technique: str) -> DataFrame:
    """Cells of the grid with no document.  The grid is the wanted result; both axes are short lists of kept labels."""
    return fields.crossJoin(techniques).join(observed.select(field, technique), [field, technique], "left_anti")


#: Observed cells, and labels of an axis, up to which similarities are multiplied as matrices at once.
CELLS_AT_ONCE, LABELS_AT_ONCE = 200_000, 2_000


def _overlap_at_once(rows: list, field: str, technique: str, spark) -> DataFrame | None:
    """:func:`overlap_scores` of few cells by matrix products; None where an axis is long."""
    import numpy as np
    import pandas as pd

    fs, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if max(len(fs), len(ts)) > LABELS_AT_ONCE:
        return None
    at_f, at_t = {f: i for i, f in enumerate(fs)}, {t: i for i, t in enumerate(ts)}
    m = np.zeros((len(fs), len(ts)))
    m[[at_f[r[0]] for r in rows], [at_t[r[1]] for r in rows]] = 1

    def jaccard(x: np.ndarray) -> np.ndarray:
        both, size = x @ x.T, x.sum(axis=1)
        j = both / np.maximum(size[:, None] + size[None, :] - both, 1)
        np.fill_diagonal(j, 0)
        return j

    cf = jaccard(m) @ m + m @ jaccard(m.T)
    i, j = np.nonzero(cf)
    return spark.createDataFrame(pd.DataFrame({field: [fs[k] for k in i], technique: [ts[k] for k in j], "cf": cf[i, j]}), f"{field} string, {technique} string, cf double")


def overlap_scores(observed: DataFrame, field: str, technique: str, at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """(field, technique, cf): for every cell, the Jaccard similarity of its field to the fields that use
    the technique, plus that of its technique to the techniques of the field.

    Up to ``at_once`` observed cells of text labels are multiplied as matrices; beyond, similarities are joined.
    """
    from papyrine.session import bounded_rows

    if at_once and dict(observed.dtypes)[field] == dict(observed.dtypes)[technique] == "string":
        rows = bounded_rows(observed.select(field, technique).where(F.col(field).isNotNull() & F.col(technique).isNotNull()).distinct(), at_once)
        if rows and (out := _overlap_at_once(rows, field, technique, observed.sparkSession)) is not None:
            return out
    o = observed.select(F.col(field).alias("f"), F.col(technique).alias("t"))

    def jaccard(a: str, b: str) -> DataFrame:
        size = o.groupBy(a).agg(F.count("*").alias("s"))
        x, y = o.select(F.col(a).alias("x"), b), o.select(F.col(a).alias("y"), b)
        both = x.join(y, b).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("k"))
        both = both.join(size.select(F.col(a).alias("x"), F.col("s").alias("sx")), "x").join(size.select(F.col(a).alias("y"), F.col("s").alias("sy")), "y")
        return both.select("x", "y", (F.col("k") / (F.col("sx") + F.col("sy") - F.col("k"))).alias("j"))

    jf, jt = jaccard("f", "t"), jaccard("t", "f")
    one = jf.join(o.withColumnRenamed("f", "y"), "y").groupBy(F.col("x").alias("f"), "t").agg(F.sum("j").alias("a"))
    two = jt.join(o.withColumnRenamed("t", "y"), "y").groupBy("f", F.col("x").alias("t")).agg(F.sum("j").alias("b"))
    cf = one.join(two, ["f", "t"], "full").select("f", "t", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("cf"))
    return cf.select(F.col("f").alias(field), F.col("t").alias(technique), "cf")


def profiles(terms: DataFrame, key: str, doc: str, term: str, idf: DataFrame) -> DataFrame:
    """(key, term, w): document counts times ``idf`` (term, idf), of length 1."""
    tf = terms.groupBy(key, term).agg(F.count_distinct(doc).alias("tf")).join(idf, term)
    w = tf.withColumn("w", F.col("tf") * F.col("idf")).withColumn("l", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))))
    return w.where("l > 0").select(F.col(key).alias("key"), F.col(term).alias("term"), (F.col("w") / F.col("l")).alias("w"))


def banded_idf(terms: DataFrame, doc: str, term: str, total: DataFrame, least: int = 3, most_share: float = 0.02) -> DataFrame:
    """(term, idf): ln(n / df) of the terms in ``least`` documents or more, and in ``most_share`` of them at most."""
    df = terms.groupBy(term).agg(F.count_distinct(doc).alias("df")).crossJoin(F.broadcast(total))
    return df.where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("n"))).select(term, F.log(F.col("n") / F.col("df")).alias("idf"))


def profile_cosine(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, cosine) of sparse profiles that share a term."""
    x, y = a.select(F.col("key").alias(left), "term", F.col("w").alias("wa")), b.select(F.col("key").alias(right), "term", F.col("w").alias("wb"))
    return x.join(y, "term").groupBy(left, right).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def matched_terms(a: DataFrame, b: DataFrame, cells: DataFrame, left: str, right: str, top: int = 6) -> DataFrame:
    """(left, right, rank, term): the terms that give a cell most of its cosine."""
    x, y = a.select(F.col("key").alias(left), "term", F.col("w").alias("wa")), b.select(F.col("key").alias(right), "term", F.col("w").alias("wb"))
    m = cells.select(left, right).join(x, left).join(y, [right, "term"]).withColumn("p", F.col("wa") * F.col("wb"))
    w = Window.partitionBy(left, right).orderBy(F.col("p").desc(), "term")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(left, right, "rank", "term")


def evidence(matched: DataFrame, texts: DataFrame, cell: list[str], key: str, doc: str, text: str, most: int = 2) -> DataFrame:
    """(cell.., place, doc, sentence, terms): the shortest sentences of a cell's ``key`` that hold a matched term.

    ``texts`` has (key, doc, text); ``matched`` comes from :func:`matched_terms`.
    """
    terms = matched.groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    t = terms.join(texts.select(key, doc, F.col(text).alias("sentence")).where("sentence is not null"), key)
    t = t.withColumn("terms", F.filter("terms", lambda w: F.contains(F.lower("sentence"), w))).where("size(terms) > 0")
    w = Window.partitionBy(*cell).orderBy(F.length("sentence"), doc)
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*cell, "place", doc, "sentence", "terms")


def scores(cells: DataFrame, seed: int = 0) -> DataFrame:
    """Adds the six scorers to cells with nf, nt, cf, lim and n_fields, the fields that use the technique.

    ``random`` is a seeded hash, ``pa`` the product of sizes, ``lim_cf`` the product of both scaled to 0..1,
    ``lim_spec`` lim over ln(2 + n_fields).
    """
    span = cells.agg(F.min("lim").alias("l0"), F.max("lim").alias("l1"), F.min("cf").alias("c0"), F.max("cf").alias("c1"))
    scaled = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(0.0))
    out = cells.crossJoin(F.broadcast(span))
    field, technique = cells.columns[:2]
    return out.select(
        *cells.columns, (F.xxhash64(F.lit(seed), field, technique) / F.lit(2.0**63)).alias("random"), (F.col("nf") * F.col("nt")).cast("double").alias("pa"),
        (scaled("lim", "l0", "l1") * scaled("cf", "c0", "c1")).alias("lim_cf"), (F.col("lim") / F.log(2.0 + F.col("n_fields"))).alias("lim_spec"),
    )


SCORERS = ("random", "pa", "cf", "lim", "lim_cf", "lim_spec")


def evaluate(cells: DataFrame, scorers: tuple[str, ...], hit: str, *ties: str, at: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """(scorer, candidates, hits, base_rate, p_k.., average_precision), a row for each scorer, without cells too; ties in a stated order.

    All scorers are ranked in one pass over ranges of (scorer, score), so no task sorts the whole grid: a
    range knows its rows from its own order, and those before it from the sizes of the ranges.
    """
    from papyrine.session import cut

    long = cells.select(*ties, F.col(hit).cast("int").alias("_h"), F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("score")) for s in scorers])).alias("s")).select(*ties, "_h", "s.scorer", (-F.col("s.score")).alias("_s"))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["scorer", "_s", *ties]
    r = cut(long.repartitionByRange(n, *order).sortWithinPartitions(*order).select("scorer", "_h", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    sizes = r.groupBy("scorer", "_p").agg(F.count("*").alias("_n"), F.sum("_h").alias("_k"))
    before = Window.partitionBy("scorer").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("scorer", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"))
    inside = Window.partitionBy("scorer", "_p").orderBy("_i")
    r = r.join(F.broadcast(sizes), ["scorer", "_p"]).withColumn("_r", F.col("_n0") + F.row_number().over(inside)).withColumn("_k", F.col("_k0") + F.sum("_h").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = F.sum("_h")
    out = r.groupBy("scorer").agg(
        F.count("*").alias("candidates"), hits.cast("long").alias("hits"), F.avg("_h").alias("base_rate"),
        *[(F.sum(F.when(F.col("_r") <= k, F.col("_h")).otherwise(0)) / k).alias(f"p_{k}") for k in at],
        F.coalesce(F.try_divide(F.sum(F.when(F.col("_h") == 1, F.col("_k") / F.col("_r"))), hits), F.lit(0.0)).alias("average_precision"),
    )
    every = cells.sparkSession.createDataFrame([(s,) for s in scorers], "scorer string")
    return every.join(out, "scorer", "left").fillna(0, ["candidates", *[f"p_{k}" for k in at], "average_precision"])
