"""Search and faceted selection over a collection, and the views of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as X


def term_index(docs: DataFrame, doc: str, text: str, least: int = 2, least_pair: int = 5, most_share: float = 0.15) -> DataFrame:
    """(term, doc): postings of the terms that connect and discriminate.

    A word must be in ``least`` documents and under ``most_share`` of them, a pair in ``least_pair``.
    """
    t = docs.select(F.col(doc).alias("doc"), F.explode(X.index_terms(F.col(text))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    df = t.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    pair = F.contains("term", F.lit(" "))
    kept = df.where(F.when(pair, F.col("df") >= least_pair).otherwise(F.col("df") >= least) & (F.col("df") < most_share * F.col("n")))
    return t.join(kept.select("term", "df"), "term")


def search_all(postings: DataFrame, words: list[str]) -> DataFrame:
    """Documents that have, for every word, a term that begins with it."""
    hits = postings.select("doc", F.explode(F.array(*[F.when(F.col("term").startswith(w.lower()), F.lit(i)) for i, w in enumerate(words)])).alias("w")).where("w is not null")
    return hits.groupBy("doc").agg(F.count_distinct("w").alias("k")).where(F.col("k") == len(words)).select("doc")


def search_text(docs: DataFrame, doc: str, text: Column, words: list[str]) -> DataFrame:
    """Documents whose text contains every word, in any case (scan without an index)."""
    low = F.lower(text)
    cond = F.lit(True)
    for w in words:
        cond = cond & F.contains(low, F.lit(w.lower()))
    return docs.where(cond).select(doc)


def search_ranked(postings: DataFrame, n_docs: DataFrame, words: list[str], limit: int = 50) -> DataFrame:
    """(doc, score): best documents by the sum of ln(1 + N / df) over matched terms, ties by doc."""
    cond = F.lit(False)
    for w in words:
        cond = cond | F.col("term").startswith(w.lower())
    s = postings.where(cond).crossJoin(F.broadcast(n_docs)).groupBy("doc").agg(F.sum(F.log(1 + F.col("n") / F.col("df"))).alias("score"))
    return s.orderBy(F.col("score").desc(), "doc").limit(limit)


def search_set(postings: DataFrame, n_docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, doc, score): :func:`search_ranked` of every row of ``queries`` (query, words) in one pass.

    A word is looked up among the beginnings of the vocabulary's terms by equality; the terms are few beside their
    postings, so these are joined once.  A query's own document is left out.
    """
    words = queries.select("query", F.explode(F.array_distinct("words")).alias("w"))
    vocabulary = postings.groupBy("term").agg(F.first("df").alias("df"))
    starts = vocabulary.select("term", "df", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))).alias("w"))
    terms = words.join(starts, "w").select("query", "term", "df").distinct()
    weight = F.log(1 + F.col("n") / F.col("df"))
    hits = terms.crossJoin(F.broadcast(n_docs)).select("query", "term", weight.alias("weight")).join(postings.select("term", "doc"), "term").where("query <> doc")
    s = hits.groupBy("query", "doc").agg(F.round(F.sum("weight"), 9).alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query", "rank", "doc", "score")


def suggest(vocabulary: DataFrame, word: str, most: int = 2) -> DataFrame:
    """Terms within ``most`` edits of a word, nearest first: typo tolerance of the search."""
    w = F.lit(word.lower())
    return vocabulary.withColumn("edits", F.levenshtein("term", w, most)).where("edits >= 0").select("term", "edits")


def select_facets(items: DataFrame, facets: dict[str, list], leave_out: str | None = None) -> DataFrame:
    """Rows that fit every facet: any of the values inside one, all facets together.

    Facet columns may be arrays.  ``leave_out`` skips one facet, for the counts beside its chips.
    """
    kinds = dict(items.dtypes)
    for name, values in facets.items():
        if name == leave_out or not values:
            continue
        cond = F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if kinds[name].startswith("array") else F.col(name).isin(*values)
        items = items.where(cond)
    return items


def chip_counts(items: DataFrame, facets: dict[str, list], doc: str) -> DataFrame:
    """(facet, value, n): for every chip, how many documents it would leave, its own facet ignored.

    One pass: a document counts for a facet if no other facet excludes it.
    """
    kinds = dict(items.dtypes)

    def excluded(name: str) -> Column:
        values = facets[name]
        if not values:
            return F.lit(0)
        fits = F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if kinds[name].startswith("array") else F.col(name).isin(*values)
        return (~F.coalesce(fits, F.lit(False))).cast("int")

    def chip(name: str):
        return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))

    out = F.lit(0)
    for name in facets:
        out = out + excluded(name)
    chips = []
    for name in facets:
        values = F.transform(name, lambda v: v.cast("string")) if kinds[name].startswith("array") else F.array(F.col(name).cast("string"))
        chips.append(F.when(out - excluded(name) == 0, F.transform(values, chip(name))).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    empty = F.array().cast("array<struct<facet:string,value:string>>")
    rows = items.select(doc, F.explode(F.concat(*[F.coalesce(c, empty) for c in chips])).alias("c")).select(doc, "c.facet", "c.value")
    return rows.where("value is not null").groupBy("facet", "value").agg(F.count_distinct(doc).alias("n"))


def top_values(members: DataFrame, value: str, doc: str, top: int, least: int = 1, total: DataFrame | None = None) -> DataFrame:
    """(value, n, share): the most frequent values of a selection, ties by value."""
    g = members.groupBy(value).agg(F.count_distinct(doc).alias("n")).where(F.col("n") >= least)
    if total is not None:
        g = g.crossJoin(F.broadcast(total)).withColumn("share", 1000.0 * F.col("n") / F.greatest("total", F.lit(1))).drop("total")
    return g.orderBy(F.col("n").desc(), value).limit(top)


def stands_on(edges: DataFrame, selection: DataFrame, citing: str, cited: str, least: int = 3, top: int = 5) -> DataFrame:
    """What the selected documents cite most."""
    e = edges.join(selection.select(F.col(selection.columns[0]).alias(citing)), citing, "left_semi")
    return e.groupBy(cited).agg(F.count_distinct(citing).alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), cited).limit(top)


def named_first(rows: DataFrame, name: str) -> list[Column]:
    """Sort keys: named rows before unnamed ones, then by name."""
    return [F.col(name).isNull().asc(), F.lower(name).asc(), F.col(name).asc()]


def cluster_labels(tokens: DataFrame, cluster: str, doc: str, term: str, least_share: float = 0.05, least: int = 3, top: int = 4) -> DataFrame:
    """(cluster, rank, term, score): terms frequent inside and rare outside a cluster.

    score = (c / n) * (c / max(total - c, 1)) with c the documents of the cluster with the term.
    """
    c = tokens.groupBy(cluster, term).agg(F.count_distinct(doc).alias("c"))
    n = tokens.groupBy(cluster).agg(F.count_distinct(doc).alias("n"))
    everywhere = Window.partitionBy(term)
    s = c.withColumn("total", F.sum("c").over(everywhere)).join(n, cluster).where(F.col("c") >= F.greatest(F.lit(least), least_share * F.col("n")))
    s = s.withColumn("score", F.col("c") / F.col("n") * (F.col("c") / F.greatest(F.col("total") - F.col("c"), F.lit(1))))
    w = Window.partitionBy(cluster).orderBy(F.col("score").desc(), term)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(cluster, "rank", term, "c", "score")


def gap_terms(members: DataFrame, doc: str, failure: str, label: str = "", least: int = 3, part: int = 60) -> DataFrame:
    """(term, df): failure terms in max(least, n / part) documents or more, and at most half of them.

    n counts the documents that state a failure.  A word is dropped where a pair that contains it has
    60 percent of its documents.
    """
    stated = members.where(F.length(F.coalesce(F.col(failure), F.lit(""))) > 0)
    terms = stated.select(doc, F.explode(X.failure_terms(F.col(failure), label)).alias("term"))
    df = terms.groupBy("term").agg(F.count_distinct(doc).alias("df")).crossJoin(F.broadcast(stated.agg(F.count_distinct(doc).alias("n"))))
    band = df.where((F.col("df") >= F.greatest(F.lit(least), F.floor(F.col("n") / part))) & (F.col("df") <= F.col("n") / 2)).select("term", "df")
    # a term of the band is in a sixtieth of the documents, so there are 60 times the terms of one sentence at most
    pairs = band.where(F.contains("term", F.lit(" "))).select(F.col("term").alias("pair"), F.col("df").alias("pdf"))
    alone = band.where(~F.contains("term", F.lit(" ")))
    heavy = alone.join(F.broadcast(pairs), F.contains("pair", "term") & (F.col("pdf") >= 0.6 * F.col("df"))).select("term").distinct()
    return band.join(heavy, "term", "left_anti")


def pick_disjoint(candidates: list[str], top: int = 10) -> list[str]:
    """Of terms in order, those that neither contain nor are contained in one picked before."""
    picked: list[str] = []
    for term in candidates:
        if len(picked) == top:
            break
        if not any(term in p or p in term for p in picked):
            picked.append(term)
    return picked


def gap_scan(members: DataFrame, doc: str, failure: str, attack: str, year: str, label: str = "", least: int = 3, top: int = 10) -> DataFrame:
    """(rank, term, named, attacked, motivation, years, doc, sentence): failures of a field, who names and who attacks them.

    The leading failure terms that do not contain one another and that ``least`` documents name verbatim.
    A namer attacks a failure if its ``attack`` text has the term, else it only cites it as motivation.  ``years``
    is 'year:n' of the namers in order, ``sentence`` the shortest that names the term.  Unattacked terms come
    first, then the most named.

    The choice is sequential and made on the driver, over all terms of the band, whose number does not grow
    with the documents; terms too seldom named verbatim are set aside in turn until ten hold.
    """
    spark = members.sparkSession
    stated = members.where(F.length(F.coalesce(F.col(failure), F.lit(""))) > 0).select(F.col(doc).alias("_doc"), F.col(failure).alias("_l"), F.lower(F.coalesce(F.col(attack), F.lit(""))).alias("_a"), F.col(year).alias("_y"))
    order = [r.term for r in gap_terms(members, doc, failure, label, least).orderBy(F.col("df").desc(), "term").collect()]

    def named(terms: list[str]) -> DataFrame:
        t = spark.createDataFrame([(x,) for x in terms], "term string")
        return stated.crossJoin(F.broadcast(t)).where(F.contains(F.lower("_l"), F.col("term")))

    known: dict[str, int] = {}
    while True:
        picked = pick_disjoint([t for t in order if known.get(t, least) >= least], top)
        new = [t for t in picked if t not in known]
        if not new:
            break
        known |= dict.fromkeys(new, 0) | {r["term"]: r["count"] for r in named(new).groupBy("term").count().collect()}
    rows = named(picked)
    attacked = F.contains("_a", F.col("term"))
    n = rows.groupBy("term").agg(
        F.count("*").alias("named"), F.count(F.when(attacked, 1)).alias("attacked"), F.min_by(F.struct("_doc", "_l"), F.struct(F.length("_l"), "_doc")).alias("rep")
    )
    years = rows.groupBy("term", "_y").agg(F.count("*").alias("k")).groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_y", "k"))), lambda x: F.concat_ws(":", x["_y"].cast("string"), x["k"].cast("string"))), " ").alias("years"))
    place = Window.orderBy((F.col("attacked") > 0).cast("int"), F.col("named").desc(), "term")  # ten rows
    out = n.join(years, "term").withColumn("rank", F.row_number().over(place))
    return out.select("rank", "term", "named", "attacked", (F.col("named") - F.col("attacked")).alias("motivation"), "years", F.col("rep._doc").alias(doc), F.col("rep._l").alias("sentence"))
