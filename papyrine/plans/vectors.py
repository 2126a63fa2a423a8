"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions.stats import min_max
from papyrine.operators import vectors as V
from papyrine.operators.components import components
from papyrine.session import table


def _e(spark, d):
    return table(spark, d, "embeddings")


_D = "list_dot_product({0}::double[], {1}::double[])"


def knn_exact(spark, d):
    """Every row whose id is divisible by 100 is searched for among all rows."""
    e = _e(spark, d)
    return V.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 20).select("vec_id", "rank", "neighbour", F.round("sim", 6).alias("sim"))


_KNN = f"k as (select a.vec_id, b.vec_id as neighbour, {_D.format('a.embedding', 'b.embedding')} as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.vec_id % 100 = 0), r as (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, neighbour) as rank from k)"
KNN_EXACT = f"with {_KNN} select vec_id, rank::int as rank, neighbour, round(sim, 6) as sim from r where rank <= 20"


def cross_label_rate(spark, d):
    e = _e(spark, d)
    n = V.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    a, b = e.select("vec_id", "label"), e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other"))
    return n.join(a, "vec_id").join(b, "neighbour").groupBy("label").agg(F.round(F.avg((F.col("label") != F.col("other")).cast("double")), 6).alias("cross_rate"), F.count("*").alias("n"))


CROSS_LABEL_RATE = f"with {_KNN} select e.label, round(avg((e.label <> o.label)::int), 6) as cross_rate, count(*) as n from r join embeddings e using (vec_id) join embeddings o on o.vec_id = r.neighbour where rank <= 5 group by 1"


def topic_expand(spark, d):
    e = _e(spark, d)
    m = e.where("vec_id % 2 = 0").select("label", "vec_id")  # the even half of each label is its explicit membership
    x = V.expand_topics(e.select("vec_id", "embedding"), m, "vec_id", "label", "embedding", 0.7, 0.2, 50)
    return x.select("label", "vec_id", F.round("sim", 6).alias("sim"))


TOPIC_EXPAND = """with m as (select label, vec_id, embedding from embeddings where vec_id % 2 = 0), n as (select label, count(*) as n from m group by 1 having count(*) >= 3),
x as (select label, i, avg(embedding[i]::double) as c from m, range(1, 65) t(i) where label in (select label from n) group by 1, 2),
c0 as (select label, list(c order by i) as c from x group by 1), c as (select label, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) as c from c0),
o as (select label, quantile_cont(list_dot_product(embedding::double[], c), 0.7) as p from m join c using (label) group by 1),
g as (select label, c, greatest(p, 0.2) as bar, least(50, n) as cap from c join o using (label) join n using (label)),
s as (select g.label, e.vec_id, list_dot_product(e.embedding::double[], c) as sim, bar, cap from embeddings e, g),
r as (select *, row_number() over (partition by label order by sim desc, vec_id) as r from s where sim >= bar and (label, vec_id) not in (select label, vec_id from m))
select label, vec_id, round(sim, 6) as sim from r where r <= cap"""


def twin_components(spark, d):
    p = V.near_pairs(_e(spark, d), "vec_id", "embedding", 0.42).select("a", "b")
    key = F.xxhash64("a", "b").alias("key")
    c = components(p.select(F.col("a").alias("node"), key).union(p.select("b", key)))
    return c.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))


TWIN_COMPONENTS = f"""with recursive p as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id and {_D.format('a.embedding', 'b.embedding')} >= 0.42),
r(a, b) as (select a, a as b from p union select r.a, p.b from r join p on r.b = p.a), g as (select a as node, min(b) as component from r group by 1)
select component, count(*) as n, max(node) as last from g group by 1"""


def label_centroids(spark, d):
    """Similarity of the labels' centroids to one another."""
    c = V.centroids(_e(spark, d), "label", "embedding")
    other = c.select(F.col("label").alias("other"), F.col("centroid").alias("c2"))
    return c.join(other, F.col("label") < F.col("other")).select("label", "other", F.round(V.dot(F.col("centroid"), F.col("c2")), 6).alias("sim"))


LABEL_CENTROIDS = """with x as (select label, i, avg(embedding[i]::double) as c from embeddings, range(1, 65) t(i) group by 1, 2), c0 as (select label, list(c order by i) as c from x group by 1),
c as (select label, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) as c from c0) select a.label, b.label as other, round(list_dot_product(a.c, b.c), 6) as sim from c a join c b on a.label < b.label"""


def pca_int8(spark, d):
    return V.compact_vectors(_e(spark, d), "vec_id", "embedding", 16).select("vec_id", F.col("code").cast("array<int>").alias("code"), F.round("scale", 6).alias("scale"))


def kmeans_regions(spark, d):
    return V.regions(_e(spark, d), "vec_id", "embedding", 10)


def layout(spark, d):
    return V.layout(_e(spark, d), "vec_id", "embedding")


def set_groups(spark, d):
    return V.selection_groups(_e(spark, d).select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 100_000)


def minmax_scale(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return min_max(e, "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


MINMAX_SCALE = "select event_id, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0 end, 6) as scaled from events window w as (partition by event_type)"

QUERIES = [
    ("knn_exact", knn_exact, KNN_EXACT),
    ("cross_label_rate", cross_label_rate, CROSS_LABEL_RATE),
    ("topic_expand", topic_expand, TOPIC_EXPAND),
    ("twin_components", twin_components, TWIN_COMPONENTS),
    ("label_centroids", label_centroids, LABEL_CENTROIDS),
    ("pca_int8", pca_int8, None),
    ("kmeans_regions", kmeans_regions, None),
    ("layout", layout, None),
    ("set_groups", set_groups, None),
    ("minmax_scale", minmax_scale, MINMAX_SCALE),
]
