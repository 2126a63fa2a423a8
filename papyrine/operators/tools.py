"""The query surface an agent sees: fourteen named tools over a store of frames.

A tool takes plain arguments and returns a DataFrame; unknown names and ids give an empty frame, and
``call`` turns a wrong tool or argument into a one-row frame with an ``error`` column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import selection as S
from papyrine.operators import trends as T
from papyrine.operators import vectors as V
from papyrine.operators import verification as Ver


@dataclass
class Store:
    """The frames the tools read; any of them may be None, then its tools give empty results.

    papers: gid, venue, year, title, authors, abstract, url; topics: topic, gid, kind;
    facts: gid, limitation, claim, attack (what is claimed and proposed, as one text), methods, datasets; sections: gid, pos, heading, bucket, text;
    edges: citing, cited, sentence; vectors: gid, vec; links: gid, kind, repo, own;
    cells: field, technique, score; postings: term, doc, df.
    """

    papers: DataFrame
    topics: DataFrame | None = None
    facts: DataFrame | None = None
    sections: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    links: DataFrame | None = None
    cells: DataFrame | None = None
    postings: DataFrame | None = None


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("year").desc(), "gid").limit(limit)


def search_papers(s: Store, query: str, limit: int = 10) -> DataFrame:
    """Papers by their words: ranked over the index if there is one, else every word in title or abstract."""
    words, limit = query.lower().split(), min(limit, 50)
    if s.postings is not None:
        hits = S.search_ranked(s.postings, s.papers.agg(F.count("*").alias("n")), words, limit)
        return hits.join(s.papers.select(F.col("gid").alias("doc"), "title", "venue", "year"), "doc").select(F.col("doc").alias("gid"), "title", "venue", "year", "score")
    hits = S.search_text(s.papers, "gid", F.concat_ws(" ", "title", "abstract"), words)
    return _newest(s.papers.join(hits, "gid", "left_semi"), limit).select("gid", "title", "venue", "year", F.lit(1.0).alias("score"))


def similar_papers(s: Store, gid: int, limit: int = 10) -> DataFrame:
    q = s.vectors.where(F.col("gid") == gid)
    n = V.knn(s.vectors, q, "gid", "vec", min(limit, 30))
    return n.join(s.papers.select(F.col("gid").alias("neighbour"), "title"), "neighbour", "left").select(F.col("neighbour").alias("gid"), "title", "sim", "rank")


def get_paper(s: Store, gid: int) -> DataFrame:
    p = s.papers.where(F.col("gid") == gid)
    topics = s.topics.where(F.col("gid") == gid).groupBy("gid").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    cites = s.edges.where(F.col("citing") == gid).agg(F.count("*").alias("cites"))
    cited = s.edges.where(F.col("cited") == gid).agg(F.count("*").alias("cited_by"))
    return p.join(topics, "gid", "left").crossJoin(cites).crossJoin(cited)


def list_topics(s: Store) -> DataFrame:
    t = s.topics.join(s.papers.select("gid", "venue", "year"), "gid")
    return t.groupBy("topic").agg(F.count(F.when(F.col("kind") == 1, 1)).alias("direct"), F.count("*").alias("total"), F.count_distinct("venue", "year").alias("editions"))


def topic_papers(s: Store, topic: str, limit: int = 50) -> DataFrame:
    t = s.topics.where(F.col("topic") == topic.lower()).select("gid", "kind")
    return _newest(s.papers.join(t, "gid"), min(limit, 200)).select("gid", "title", "venue", "year", "kind")


def field_cards(s: Store, topic: str | None = None, query: str | None = None, limit: int = 20) -> DataFrame:
    """What the papers of a topic, or of a search, say: limitation, claim, methods, datasets."""
    chosen = topic_papers(s, topic, 200).select("gid") if topic else search_papers(s, query or "", 50).select("gid")
    c = s.papers.join(chosen, "gid", "left_semi").join(s.facts, "gid")
    return _newest(c, min(limit, 60)).select("gid", "title", "venue", "year", "limitation", "claim", F.slice(F.array_distinct("methods"), 1, 4).alias("methods"), F.slice(F.array_distinct("datasets"), 1, 4).alias("datasets"))


def field_trend(s: Store, topic: str) -> DataFrame:
    totals = s.papers.groupBy("venue", "year").agg(F.count("*").alias("total"))
    n = s.topics.where(F.col("topic") == topic.lower()).join(s.papers.select("gid", "venue", "year"), "gid").groupBy("venue", "year").agg(F.count("*").alias("n"))
    c = totals.join(n, ["venue", "year"], "left").select("venue", "year", "total", F.coalesce("n", F.lit(0)).alias("n"), F.lit(topic.lower()).alias("topic"))
    return T.share_trend(c, "topic", "year", ["venue"])


def gap_scan(s: Store, topic: str) -> DataFrame:
    """Failure terms of a topic's stated limitations: how many papers name each, how many of these attack it."""
    f = s.facts.join(s.topics.where(F.col("topic") == topic.lower()).select("gid").distinct(), "gid", "left_semi").join(s.papers.select("gid", "year"), "gid")
    return S.gap_scan(f, "gid", "limitation", "attack" if "attack" in f.columns else "claim", "year", topic)


def paper_text(s: Store, gid: int, section: str | None = None, most: int = 12_000) -> DataFrame:
    from papyrine.operators.records import budget_text

    t = s.sections.where(F.col("gid") == gid)
    if section:
        t = t.where(F.col("bucket") == section.lower())
    return budget_text(t.withColumn("_p", F.lit(0)), "gid", "_p", "pos", "text", most).select("gid", "pos", "heading", "bucket", "kept").orderBy("pos")


def verify_quote(s: Store, gid: int, quote: str) -> DataFrame:
    """The first place that holds the quote: limitation, claim, abstract or full text."""
    p = s.papers.where(F.col("gid") == gid).join(s.facts, "gid", "left")
    body = s.sections.where(F.col("gid") == gid).groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("body"))
    role = Ver.quote_role(F.lit(quote), [("limitation", F.col("limitation")), ("claim", F.col("claim")), ("abstract", F.col("abstract")), ("full text", F.col("body"))])
    return p.join(body, "gid", "left").select("gid", role.isNotNull().alias("verified"), role.alias("role"))


def blue_ocean(s: Store, field: str | None = None, k: int = 10) -> DataFrame:
    """Empty cells by score; a field fits if it contains the words asked for, or the other way round."""
    c = s.cells
    if field:
        f = F.lit(field.lower())
        c = c.where(F.contains(F.lower("field"), f) | F.contains(f, F.lower("field")))
    return c.orderBy(F.col("score").desc(), "field", "technique").limit(min(k, 25))


def paper_resources(s: Store, gid: int) -> DataFrame:
    """Links of a paper; a row that says so where its text was not read, since that proves no absence."""
    read = s.sections.where(F.col("gid") == gid).limit(1).count() > 0
    return s.links.where(F.col("gid") == gid).select("gid", "kind", "repo", "own", F.lit(read).alias("text_read"))


def benchmark_info(s: Store, name: str, limit: int = 20) -> DataFrame:
    key = X.dataset_key(F.lit(name))
    u = s.facts.select("gid", F.explode("datasets").alias("dataset")).where(X.dataset_key(F.col("dataset")) == key)
    return _newest(s.papers.join(u, "gid"), min(limit, 100)).select("gid", "title", "venue", "year", "dataset")


def get_citations(s: Store, gid: int, limit: int = 40) -> DataFrame:
    """Both directions with a context sentence where one was found, first one per pair."""
    w = Window.partitionBy("citing", "cited").orderBy("sentence")
    e = s.edges.where((F.col("citing") == gid) | (F.col("cited") == gid)).withColumn("n", F.row_number().over(w)).where("n = 1")
    e = e.withColumn("direction", F.when(F.col("citing") == gid, "cites").otherwise("cited by")).withColumn("gid", F.when(F.col("citing") == gid, F.col("cited")).otherwise(F.col("citing")))
    side = Window.partitionBy("direction").orderBy("gid")
    return e.withColumn("r", F.row_number().over(side)).where(F.col("r") <= limit).join(s.papers.select("gid", "title"), "gid", "left").select("direction", "gid", "title", "sentence")


TOOLS: dict[str, Callable] = {
    f.__name__: f
    for f in (search_papers, similar_papers, get_paper, list_topics, topic_papers, field_cards, field_trend, gap_scan, paper_text, verify_quote, blue_ocean, paper_resources, benchmark_info, get_citations)
}


def call(spark: SparkSession, store: Store, tool: str, **arguments) -> DataFrame:
    """Run a tool by name; what goes wrong is an answer, not an exception."""
    try:
        return TOOLS[tool](store, **arguments)
    except KeyError:
        return spark.createDataFrame([(f"no tool named {tool}",)], "error string")
    except (TypeError, AttributeError) as e:
        return spark.createDataFrame([(f"{tool}: {e}",)], "error string")


def recompute(spark: SparkSession, store: Store, tool: str, claim: float, column: str, allowed: tuple[str, ...] = ("field_trend", "list_topics", "gap_scan", "topic_papers", "benchmark_info", "get_citations", "get_paper", "blue_ocean"), **arguments) -> str:
    """'ok' if the tool, run again, yields the figure in a column; 'no' if not; 'na' if it is not to be run or fails."""
    if tool not in allowed:
        return "na"
    df = call(spark, store, tool, **arguments)
    if "error" in df.columns or column not in df.columns:
        return "na"
    hit = df.where(Ver.rounds_to(F.lit(repr(claim).removesuffix(".0")), F.array(F.col(column).cast("double")))).limit(1).count()
    return "ok" if hit else "no"
