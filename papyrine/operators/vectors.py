"""Vectors: nearest neighbours, centroids, components, compaction, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import bounded_rows, cut

#: Most groups whose centroids are sent to every task.
MOST_GROUPS = 10_000
#: Rows of a block of vectors that are multiplied at once.
BLOCK = 1024
#: Rows of a query set that go to every task at once.
HELD = 50_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalise(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _pack(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.k for r in rows], np.int64), np.array([np.asarray(r.v, np.float64) for r in rows])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _held_blocks(rows: DataFrame, key: str, vec: str, block: int) -> Iterator[DataFrame]:
    """Parts of at most about ``block`` rows each, by the hash of the key."""
    r = rows.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v")).where("k is not null and v is not null")
    n = r.count()
    parts = max(1, -(-n // block))
    if n:
        r = cut(r) if parts > 1 else r
        for i in range(parts):
            yield r.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i) if parts > 1 else r


def _better(q: np.ndarray, key: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, key, sim) the k best of each query; ties, to nine digits, by the smaller key."""
    order = np.lexsort((key, -np.round(sim, 9), q))
    q, key, sim = q[order], key[order], sim[order]
    start = np.r_[True, q[1:] != q[:-1]]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], key[keep], sim[keep]


def knn(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(key, rank, neighbour, sim): the k nearest by dot product, itself left out, ties by the smaller key.

    Exact.  The queries go to the tasks in blocks of at most ``held`` rows; for each block the vectors are read
    once, where they are, and multiplied in pieces of ``block`` rows.  A task keeps k rows for each query,
    so that, and no vector, is shuffled; a window with a pushed group limit merges the tasks.  Every block of
    queries costs one more pass over the vectors, whatever their number.
    """
    spark = vectors.sparkSession
    corpus = vectors.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v")).where("k is not null and v is not null")
    near = None
    for part in _held_blocks(queries, key, vec, held):
        sent = spark.sparkContext.broadcast(_pack(part.collect()))  # ``held`` rows at most, or a little more

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qk, qv = sent.value
            low = np.full(len(qk), -np.inf)  # the k-th best of each query so far
            found = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64))
            for b in batches:
                ck_all, cv_all = np.asarray(b.column(0)), _matrix(b.column(1))
                for i in range(0, len(ck_all), block):
                    ck, cv = ck_all[i : i + block], cv_all[i : i + block]
                    new = [found]
                    for j in range(0, len(qk), block):
                        s = qv[j : j + block] @ cv.T
                        s[qk[j : j + block, None] == ck[None, :]] = -np.inf
                        bar = low[j : j + block]
                        if s.shape[1] > k:
                            bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        r, c = np.nonzero((s >= bar[:, None] - 1e-8) & np.isfinite(s))
                        new.append((r + j, ck[c], s[r, c]))
                    found = _better(*(np.concatenate(x) for x in zip(*new)), k)
                    full = np.bincount(found[0], minlength=len(qk)) == k
                    least = np.full(len(qk), np.inf)
                    np.minimum.at(least, found[0], found[2])
                    low = np.where(full, least, -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(qk[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["key", "neighbour", "sim"])

        one = corpus.mapInArrow(best, "key long, neighbour long, sim double")
        near = one if near is None else near.union(one)
    if near is None:
        near = spark.createDataFrame([], "key long, neighbour long, sim double")
    w = Window.partitionBy("key").orderBy(F.round("sim", 9).desc(), "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("key").alias(key), "rank", "neighbour", "sim")


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, centroid): mean vectors of length 1; the dimensions are averaged side by side."""
    p = vectors.select(group, F.posexplode(vec).alias("pos", "x"))
    m = p.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    return c.select(group, normalise(F.col("c")).alias("centroid"))


def expand_topics(vectors: DataFrame, members: DataFrame, key: str, group: str, vec: str, quantile: float = 0.7, floor: float = 0.62, most: int = 200) -> DataFrame:
    """(group, key, sim): documents outside a group that are as near to its centroid as its upper members.

    The bar is the members' quantile, ``floor`` at least; as many as there are members, ``most`` at most.
    """
    m = members.join(vectors, key).select(group, key, vec)
    size = m.groupBy(group).agg(F.count("*").alias("n")).where("n >= 3")
    c = centroids(m.join(size, group, "left_semi"), group, vec)
    own = m.join(c, group).select(group, dot(F.col(vec), F.col("centroid")).alias("s")).groupBy(group).agg(F.percentile("s", quantile).alias("p"))
    bar = own.join(size, group).select(group, F.greatest(F.col("p"), F.lit(floor)).alias("bar"), F.least(F.lit(most), F.col("n")).alias("cap"))
    goal = c.join(bar, group)
    # one centroid per group against all vectors: where the groups are few, as they are meant to be, the vectors stay where they are
    if bounded_rows(goal.select(group), MOST_GROUPS) is not None:
        goal = F.broadcast(goal)
    s = vectors.crossJoin(goal).select(group, key, dot(F.col(vec), F.col("centroid")).alias("sim"), "bar", "cap").where(F.col("sim") >= F.col("bar"))
    s = s.join(members.select(group, key), [group, key], "left_anti")
    w = Window.partitionBy(group).orderBy(F.col("sim").desc(), key)
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("cap")).select(group, key, "sim")


def near_pairs(vectors: DataFrame, key: str, vec: str, least: float, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(a, b, sim), a < b: pairs at least so similar, exactly; vectors meet in blocks as in :func:`knn`."""
    spark = vectors.sparkSession
    corpus = vectors.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v")).where("k is not null and v is not null")
    out = None
    for part in _held_blocks(vectors, key, vec, held):
        sent = spark.sparkContext.broadcast(_pack(part.collect()))

        def close(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qk, qv = sent.value
            for b in batches:
                ck, cv = np.asarray(b.column(0)), _matrix(b.column(1))
                for i in range(0, len(ck), block):
                    for j in range(0, len(qk), block):
                        s = qv[j : j + block] @ cv[i : i + block].T
                        r, c = np.nonzero((s >= least) & (qk[j : j + block, None] < ck[None, i : i + block]))
                        yield pa.RecordBatch.from_arrays([pa.array(qk[r + j]), pa.array(ck[c + i]), pa.array(s[r, c])], names=["a", "b", "sim"])

        one = corpus.mapInArrow(close, "a long, b long, sim double")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "a long, b long, sim double")


def compact_vectors(vectors: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """(key, code): leading principal components of length 1 as bytes with one common scale (column scale)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    p = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v).transform(v).select(key, normalise(vector_to_array("_p")).alias("p"))
    scale = p.select(F.max(F.array_max(F.transform("p", lambda x: F.abs(x)))).alias("scale"))
    return p.crossJoin(F.broadcast(scale)).select(key, F.transform("p", lambda x: F.bround(x / F.col("scale") * 127).cast("tinyint")).alias("code"), "scale")


def expand_codes(codes: DataFrame, key: str) -> DataFrame:
    """Codes back to vectors of length 1."""
    return codes.select(key, normalise(F.transform("code", lambda b: b.cast("double") / 127 * F.col("scale"))).alias("vec"))


def regions(vectors: DataFrame, key: str, vec: str, k: int, seed: int = 7) -> DataFrame:
    """(key, region) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select(key, F.col("prediction").alias("region"))


def layout(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, x, y): two principal components scaled to 0..1.  A linear layout, no neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    p = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).select(key, vector_to_array("_p").alias("p"))
    r = p.agg(*[f(F.col("p")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), (F.col("p")[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))).otherwise(0.0) for i in (0, 1)]
    return p.crossJoin(F.broadcast(r)).select(key, scaled[0].alias("x"), scaled[1].alias("y"))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """Labels of spherical k-means without chance: the first centres are rows floor(j * n / k)."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[[j * len(x) // k for j in range(k)]]
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = np.argmax(x @ centres.T, axis=1)
        if (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c = x[labels == j].sum(axis=0)
                centres[j] = c / max(np.linalg.norm(c), 1e-12)
    return labels


def group_selection(x: np.ndarray, most: int = 6, largest: float = 0.6) -> np.ndarray:
    """Groups of a small selection: the number whose largest group is smallest; 0 for all if none fits."""
    n = len(x)
    best, size = np.zeros(n, int), 2.0
    for k in range(2, min(most, n // 3) + 1):
        labels = spherical_kmeans(x, k)
        counts = np.bincount(labels, minlength=k)
        share = counts.max() / n
        if counts.min() >= 3 and share <= largest and share < size:
            best, size = labels, share
    return best


def _large_groups(vectors: DataFrame, part: str, key: str, vec: str, most: int = 6, largest: float = 0.6, rounds: int = 40) -> DataFrame:
    """(part, key, group) as :func:`group_selection` gives them, each round one aggregate over all parts."""
    order = Window.partitionBy(part).orderBy(key)
    x = vectors.select(part, key, F.transform(vec, lambda v: v.cast("double")).alias("x"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy(part)).alias("n"))
    size = F.greatest(F.sqrt(dot(F.col("x"), F.col("x"))), F.lit(1e-12))
    x = cut(x.withColumn("size", size).withColumn("x", F.transform("x", lambda v: v / F.col("size"))).drop("size"))
    chosen = x.select(part, F.lit(0).alias("k"), F.lit(2.0).alias("share")).distinct()
    kept = x.select(part, key, F.lit(0).alias("k"), F.lit(0).alias("label"))
    for k in range(2, most + 1):
        rows = x.where(F.col("n") >= 3 * k)
        first = F.array(*[F.floor(F.col("n") * j / k) for j in range(k)])
        centres = cut(rows.where(F.array_contains(first, F.col("i").cast("long"))).select(part, (F.array_position(first, F.col("i").cast("long")) - 1).cast("int").alias("j"), F.col("x").alias("c")))
        labels = rows.select(part, key, "x", F.lit(-1).alias("label"))
        for _ in range(rounds):
            all_centres = centres.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda e: e["c"]).alias("cs"))
            sims = labels.join(all_centres, part).withColumn("sims", F.transform("cs", lambda c: dot(F.col("x"), c)))
            new = cut(sims.select(part, key, "x", F.col("label").alias("old"), (F.array_position("sims", F.array_max("sims")) - 1).cast("int").alias("label")))
            labels = new.drop("old")
            if new.where("label <> old").isEmpty():
                break
            moved = labels.select(part, F.col("label").alias("j"), F.posexplode("x").alias("pos", "v")).groupBy(part, "j", "pos").agg(F.sum("v").alias("v")).groupBy(part, "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("m"))
            moved = moved.withColumn("size", F.greatest(F.sqrt(dot(F.col("m"), F.col("m"))), F.lit(1e-12))).select(part, "j", F.transform("m", lambda v: v / F.col("size")).alias("m"))
            centres = cut(centres.join(moved, [part, "j"], "left").select(part, "j", F.coalesce("m", "c").alias("c")))
        counts = labels.groupBy(part, "label").agg(F.count("*").alias("c")).groupBy(part).agg(F.count("*").alias("groups"), F.min("c").alias("least"), (F.max("c") / F.sum("c")).alias("share"))
        chosen = chosen.union(counts.where((F.col("groups") == k) & (F.col("least") >= 3) & (F.col("share") <= largest)).select(part, F.lit(k), "share"))
        kept = kept.union(labels.select(part, key, F.lit(k), "label"))
    best = chosen.groupBy(part).agg(F.min(F.struct("share", "k"))["k"].alias("k"))
    return kept.join(best, [part, "k"]).select(part, key, F.col("label").cast("long").alias("group"))


def selection_groups(vectors: DataFrame, part: str, key: str, vec: str, most_rows: int = 400) -> DataFrame:
    """(part, key, group) of each selection; one of at most ``most_rows`` documents is grouped in one task.

    Larger ones are grouped by the same rounds as aggregates over all tasks.
    """
    kinds = dict(vectors.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
        return pd.DataFrame({part: pdf[part], key: pdf[key], "group": group_selection(x)})

    def in_one_task(rows: DataFrame) -> DataFrame:
        return rows.groupBy(part).applyInPandas(run, f"{part} {kinds[part]}, {key} {kinds[key]}, group long")

    large = cut(vectors.groupBy(part).agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select(part))
    if large.isEmpty():
        return in_one_task(vectors)
    return in_one_task(vectors.join(large, part, "left_anti")).union(_large_groups(vectors.join(large, part, "left_semi"), part, key, vec))
