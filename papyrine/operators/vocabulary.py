"""Vocabulary: alias learning, folding of spellings, topics and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as X

_PAREN = r"^(.+?)\s*\(\s*([^)]{2,40})\s*\)\s*$"


def learn_aliases(counts: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """(name, n, canonical): what each surface form stands for, learned from the counts alone.

    'long (SHORT)' teaches that SHORT stands for its most frequent long form; a plural is its
    singular only where the singular occurs; then an acronym is looked up once more.
    """
    b = counts.select(F.col(name).alias("name"), F.col(n).alias("n"), X.basic(F.col(name)).alias("b"))
    b = b.withColumn("long", X.basic(F.regexp_extract("b", _PAREN, 1))).withColumn("short", X.basic(F.regexp_extract("b", _PAREN, 2)))
    glossed = (F.col("long") != "") & (F.col("short") != "") & (F.col("long") != F.col("short"))
    told = b.where(glossed).groupBy("short", "long").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("short").orderBy(F.col("n").desc(), "long")
    acronyms = told.withColumn("r", F.row_number().over(best)).where("r = 1").select("short", "long")
    surfaces = b.select(F.explode(F.when(glossed, F.array("long", "short")).otherwise(F.array("b"))).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    exists = surfaces.where("n > 0").select(F.col("t").alias("single"))
    c = surfaces.select("t").join(acronyms, F.col("t") == F.col("short"), "left").select("t", F.coalesce("long", "t").alias("c"))
    endings = (("ies", "y"), ("ses", "s"), ("s", ""))
    for i, (ending, put) in enumerate(endings):
        fits = F.col("c").endswith(ending) & (F.length("c") > len(ending) + 2)
        c = c.withColumn(f"s{i}", F.when(fits, F.concat(F.expr(f"left(c, length(c) - {len(ending)})"), F.lit(put))))
        c = c.join(exists.withColumnRenamed("single", f"e{i}"), F.col(f"s{i}") == F.col(f"e{i}"), "left")
    c = c.select("t", F.coalesce("e0", "e1", "e2", "c").alias("c"))
    c = c.join(acronyms, F.col("c") == F.col("short"), "left").select("t", F.coalesce("long", "c").alias("canonical"))
    target = F.when(F.regexp_extract("b", _PAREN, 1) != "", F.col("long")).otherwise(F.col("b"))
    return b.withColumn("t", target).join(c, "t", "left").select("name", "n", F.coalesce("canonical", "t").alias("canonical"))


def fold_surfaces(counts: DataFrame, key: Column, name: str = "name", n: str = "n") -> DataFrame:
    """(key, surface, n, surfaces): spellings of one key under the commonest, ties by name."""
    g = counts.withColumn("key", key).where("key <> ''")
    w = Window.partitionBy("key").orderBy(F.col(n).desc(), name)
    top = g.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", F.col(name).alias("surface"))
    total = g.groupBy("key").agg(F.sum(n).alias("n"), F.count("*").alias("surfaces"))
    return total.join(top, "key")


def building_blocks(mentions: DataFrame, doc: str, name: str, least: int) -> DataFrame:
    """(key, surface, n): method names by key, an acronym folded into its full name.

    An acronym counts for the full name it glosses most often; a document counts once per key.
    """
    from papyrine.session import cut

    k = X.method_key(F.col(name))
    m = mentions.select(F.col(doc).alias("doc"), F.col(name).alias("name"), k["key"].alias("key"), k["acronym"].alias("acronym")).where("key <> ''")
    # one row for each document, name and key, with the mentions; the counts below are over these
    m = cut(m.groupBy("doc", "name", "key", "acronym").agg(F.count("*").alias("c")))
    told = m.where("acronym is not null and acronym <> key").groupBy("acronym", "key").agg(F.count_distinct("doc").alias("n"))
    w = Window.partitionBy("acronym").orderBy(F.col("n").desc(), "key")
    full = told.withColumn("r", F.row_number().over(w)).where("r = 1").select("acronym", F.col("key").alias("full"))
    folded = m.select("doc", "name", "key", "c").join(full.withColumnRenamed("acronym", "key"), "key", "left").withColumn("key", F.coalesce("full", "key"))
    counts = folded.groupBy("key").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= least)
    names = folded.groupBy("key", "name").agg(F.sum("c").alias("c"))
    best = Window.partitionBy("key").orderBy(F.col("c").desc(), "name")
    surface = names.withColumn("r", F.row_number().over(best)).where("r = 1").select("key", F.col("name").alias("surface"))
    return counts.join(surface, "key")


def word_ends(label: Column) -> Column:
    """All beginnings and endings of whole words, the label itself left out."""
    w = F.split(label, " ")
    n = F.size(w)
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.transform(cuts, lambda i: F.array_join(F.slice(w, F.lit(1), i), " "))
    tails = F.transform(cuts, lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.array_distinct(F.concat(heads, tails))


def find_parents(labels: DataFrame, vocabulary: DataFrame, size: str | None = None) -> DataFrame:
    """(label, parent): the longest vocabulary label that begins or ends the label at a word boundary.

    A label's beginnings and endings are its own few strings, so this is an equality join, not a
    comparison of every label with every vocabulary entry.  With ``size`` a parent must be as
    large as its child.
    """
    ends = labels.select("label", *([F.col(size).alias("own")] if size else []), F.explode(word_ends(F.col("label"))).alias("parent"))
    v = vocabulary.select(F.col("label").alias("parent"), *([F.col(size).alias("other")] if size else []))
    hit = ends.join(v, "parent")
    if size:
        hit = hit.where("other >= own")
    return hit.groupBy("label").agg(F.max_by("parent", F.struct(F.length("parent"), "parent")).alias("parent"))


def fold_labels(labels: DataFrame, vocabulary: DataFrame, least: int = 8) -> DataFrame:
    """(label, topic): vocabulary labels that stand inside another label as whole words.

    Every run of words of the label is looked up, so the join is on equality; runs are as long as the longest
    vocabulary label.
    """
    w = F.split("label", " ")
    n = F.size(w)
    most_words = vocabulary.agg(F.coalesce(F.max(F.size(F.split("label", " "))), F.lit(1)).alias("n")).first().n
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + most_words - 1)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    parts = labels.select("label", F.explode(F.array_distinct(runs)).alias("topic"))
    v = vocabulary.select(F.col("label").alias("topic")).where(F.length("topic") >= least)
    return parts.join(v, "topic").where("label <> topic").select("label", "topic")


def discover_topics(members: DataFrame, doc: str, label: str, edition: str, totals: DataFrame, least_share: float, least_docs: int) -> DataFrame:
    """(label, max_share, max_n, n): labels large enough in one edition at least, by share and by count."""
    per = members.groupBy(label, edition).agg(F.count_distinct(doc).alias("n")).join(totals, edition)
    g = per.groupBy(label).agg(F.max(1000.0 * F.col("n") / F.greatest("total", F.lit(1))).alias("max_share"), F.max("n").alias("max_n"), F.sum("n").alias("n"))
    return g.where((F.col("max_share") >= least_share) & (F.col("max_n") >= least_docs))


def topic_membership(members: DataFrame, topics: DataFrame, parents: DataFrame, folded: DataFrame) -> DataFrame:
    """(topic, doc, kind): 1 by its own label, 2 through a narrower one; 1 wins, the two never merge.

    members: doc, label; topics: label; parents: label, parent; folded: label, topic.
    """
    own = members.join(topics.select("label"), "label").select(F.col("label").alias("topic"), "doc", F.lit(1).alias("kind"))
    via = members.join(parents, "label").join(topics.select(F.col("label").alias("parent")), "parent").select(F.col("parent").alias("topic"), "doc", F.lit(2).alias("kind"))
    inside = members.join(folded, "label").select("topic", "doc", F.lit(2).alias("kind")).join(topics.select(F.col("label").alias("topic")), "topic", "left_semi")
    return own.unionByName(via).unionByName(inside).groupBy("topic", "doc").agg(F.min("kind").alias("kind"))
