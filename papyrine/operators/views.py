"""Views over the corpus: facet filters, what changed between editions, registries, exports, conversations, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.functions.stats import Z_99, per_thousand, two_proportion_z

# --- facet filters --------------------------------------------------------------------------


def visible(rows: DataFrame) -> DataFrame:
    """Rows that are not hidden; a row that does not say is visible."""
    return rows.where(F.coalesce(F.col("visible"), F.lit(True))) if "visible" in rows.columns else rows


def with_children(uses: DataFrame, parents: DataFrame, method: str, doc: str = "doc", name: str = "name") -> DataFrame:
    """Documents that use a method or one of its direct children; ``parents`` has label, parent."""
    wanted = parents.where(F.col("parent") == method).select(F.col("label").alias(name)).union(parents.sparkSession.range(1).select(F.lit(method).alias(name))).distinct()
    return uses.join(wanted, name, "left_semi").select(doc).distinct()


def stating(limits: DataFrame, words: str, doc: str = "doc", term: str = "term") -> DataFrame:
    """Documents one of whose failure terms contains the words."""
    return limits.where(F.contains(term, F.lit(words.lower()))).select(doc).distinct()


def citing(edges: DataFrame, cited) -> DataFrame:
    """Documents that cite one document."""
    return edges.where(F.col("cited") == cited).select(F.col("citing").alias("doc")).distinct()


def with_word(postings: DataFrame, haystack: DataFrame, word: str) -> DataFrame:
    """Documents with an index term that begins with a word, or whose names (doc, text) contain it."""
    w = F.lit(word.lower())
    return postings.where(F.startswith("term", w)).select("doc").union(haystack.where(F.contains(F.lower("text"), w)).select("doc")).distinct()


def without_denied(rows: DataFrame, name: str, denied: DataFrame) -> DataFrame:
    """Rows whose dataset is not on a list of things that are none (``denied.key``, folded keys)."""
    return rows.withColumn("_k", X.dataset_key(F.col(name))).join(denied.select(F.col("key").alias("_k")), "_k", "left_anti").drop("_k")


# --- what changed between two editions of a venue --------------------------------------------

#: Documents of both editions together that an item of an axis must have.
LEAST = {"topic": 12, "task": 8, "method": 12, "dataset": 8}


def changed_rows(items: DataFrame, totals: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """(venue, axis, item, shown, n0, n1, share0, share1): items of the older and of the newer edition.

    ``items`` has venue, side (0 older, 1 newer), doc, axis, item, shown: spellings that share an item count
    a document once, and the most frequent one is shown.  ``totals`` has venue, t0, t1.
    """
    least = least or LEAST
    once = items.where("item is not null").groupBy("venue", "side", "doc", "axis", "item").agg(F.min("shown").alias("shown"))
    names = items.where("item is not null").select("venue", "axis", "item", "shown", "doc").distinct().groupBy("venue", "axis", "item", "shown").agg(F.count("*").alias("c"))
    names = names.groupBy("venue", "axis", "item").agg(F.min_by("shown", F.struct(-F.col("c"), "shown")).alias("shown"))
    n = once.groupBy("venue", "axis", "item").agg(F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
    bar = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    n = n.where(F.col("n0") + F.col("n1") >= F.element_at(bar, F.col("axis"))).join(totals, "venue").join(names, ["venue", "axis", "item"])
    return n.select("venue", "axis", "item", "shown", "n0", "n1", per_thousand(F.col("n0"), F.col("t0")).alias("share0"), per_thousand(F.col("n1"), F.col("t1")).alias("share1"))


def rolled_up(uses: DataFrame, parents: DataFrame, name: str = "item") -> DataFrame:
    """Names replaced by their top-level parent, where they have one; ``parents`` has label, parent."""
    p = parents.select(F.col("label").alias(name), F.col("parent").alias("_p"))
    return uses.join(p, name, "left").withColumn(name, F.coalesce("_p", name)).drop("_p")


def pooled_movers(changed: DataFrame, totals: DataFrame, axis: str = "topic", least_share: float = 3.0, delta: float = 2.0, ratio: float = 1.5, bar: float = Z_99, top: int = 8) -> DataFrame:
    """(rank, item, n0, n1, share0, share1, z, tag): what moved most over all venues taken together.

    The larger share must be ``least_share`` per 1,000, |z| ``bar`` or more (by default 99 percent), and the change material.  tag is
    'new' or 'gone' where two documents or fewer are on one side.
    """
    t = totals.agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    n = changed.where(F.col("axis") == axis).groupBy("item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).crossJoin(F.broadcast(t))
    s0, s1 = per_thousand(F.col("n0"), F.col("t0")), per_thousand(F.col("n1"), F.col("t1"))
    n = n.withColumn("share0", s0).withColumn("share1", s1).withColumn("z", two_proportion_z(F.col("n0"), F.col("t0"), F.col("n1"), F.col("t1")))
    low, high = F.least("share0", "share1"), F.greatest("share0", "share1")
    material = (high - low >= delta) | F.when(low > 0, high >= ratio * low).otherwise(F.lit(True))
    tag = F.when((F.col("n0") <= 2) & (F.col("n1") > 2), "new").when((F.col("n1") <= 2) & (F.col("n0") > 2), "gone").otherwise("")
    place = Window.orderBy(F.abs("z").desc(), "item")
    best = n.where((high >= least_share) & (F.abs("z") >= bar) & material).withColumn("tag", tag).orderBy(F.abs("z").desc(), "item").limit(top)
    return best.withColumn("rank", F.row_number().over(place)).select("rank", "item", "n0", "n1", "share0", "share1", "z", "tag")


def carriers(shifts: DataFrame, items: DataFrame, docs: DataFrame, topic: str, item: str, doc: str, most: int = 4) -> DataFrame:
    """(topic, item, place, doc): for the leading shift of each topic, documents that carry it; orals first, then by title.

    ``items`` has topic, item, doc of the newest editions; ``docs`` has doc, oral, title.
    """
    lead = shifts.where("rank = 1").select(topic, item)
    hits = items.select(topic, item, doc).distinct().join(lead, [topic, item], "left_semi").join(docs, doc)
    w = Window.partitionBy(topic, item).orderBy(F.col("oral").desc(), "title", doc)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(topic, item, "place", doc)


def set_card(members: DataFrame, totals: DataFrame, uses: DataFrame, least: int = 2, top: int = 4) -> tuple[DataFrame, DataFrame]:
    """Per edition the size and share of a selection, and its leading (axis, item) with ``least`` documents.

    members: doc, venue, year; totals: venue, year, total; uses: doc, axis, item, methods already rolled up.
    """
    size = totals.join(members.groupBy("venue", "year").agg(F.count_distinct("doc").alias("n")), ["venue", "year"], "left").fillna({"n": 0})
    size = size.select("venue", "year", "n", per_thousand(F.col("n"), F.col("total")).alias("share"))
    c = uses.join(members.select("doc"), "doc", "left_semi").groupBy("axis", "item").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("axis").orderBy(F.col("n").desc(), "item")
    return size, c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("axis", "rank", "item", "n")


# --- registries ------------------------------------------------------------------------------


def link_metadata(links: DataFrame, metadata: DataFrame) -> DataFrame:
    """Links with what is known of their repository, by host and name; metadata has host, repo, ..."""
    return links.join(metadata, ["host", "repo"], "left")


#: Fields of a repository that are shown.
SHOWN = ("stars", "pushed", "license", "archived", "downloads", "likes", "modified", "gated")


def public_fields(metadata: DataFrame) -> DataFrame:
    """(host, repo, checked, status, ..): the shown fields; of a repository that is gone only its status.

    A table without one of the columns gives null for it.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in metadata.columns else F.lit(False)
    fields = [F.when(~gone, F.col(c)).alias(c) for c in SHOWN if c in metadata.columns]
    return metadata.select("host", "repo", F.col("at").alias("checked"), F.when(gone, "not found").alias("status"), *fields)


def worklist(links: DataFrame, known: DataFrame, hosts: tuple[str, ...] = ("gh", "hfd", "hfm")) -> DataFrame:
    """(host, repo) still to be looked up; what is known stays as it is."""
    return links.where(F.col("host").isin(*hosts)).select("host", "repo").distinct().join(known.select("host", "repo"), ["host", "repo"], "left_anti")


def resource_coverage(papers: DataFrame, read: DataFrame, links: DataFrame, doc: str = "doc") -> DataFrame:
    """(venue, year, papers, fulltext, code, data, model, page): how many papers were read and release what.

    papers: doc, venue, year; read: doc of the papers whose text was read; links: doc, own, kind.
    """
    own = links.where("own").groupBy(doc).agg(*[F.max(F.col("kind") == k).alias(k) for k in ("code", "data", "model", "page")])
    p = papers.join(read.select(doc).distinct().withColumn("_read", F.lit(True)), doc, "left").join(own, doc, "left")
    return p.groupBy("venue", "year").agg(
        F.count("*").alias("papers"), F.count("_read").alias("fulltext"), *[F.count(F.when(F.col(k) & F.col("_read"), 1)).alias(k) for k in ("code", "data", "model", "page")]
    )


def external_ids(papers: DataFrame, preprint: str = "arxiv_base", found: DataFrame | None = None) -> DataFrame:
    """papers with a preprint, and doi, s2, oa: ids found elsewhere by that preprint; a DOI stands for every preprint."""
    p = papers.where(F.col(preprint).isNotNull())
    default = F.concat(F.lit("10.48550/arXiv."), F.col(preprint))
    if found is None:
        return p.select("*", default.alias("doi"))
    ids = found.select(F.col("id").alias(preprint), F.col("doi").alias("_doi"), *[c for c in ("s2", "oa") if c in found.columns])
    return p.join(ids, preprint, "left").withColumn("doi", F.coalesce("_doi", default)).drop("_doi")


def topics_named_as_methods(topics: DataFrame, methods: DataFrame) -> DataFrame:
    """(topic, method): topic labels that are methods too, by their canonical key."""
    t = topics.select("topic", X.canon(F.col("topic")).alias("k"))
    m = methods.select("method", X.canon(F.col("method")).alias("k")).groupBy("k").agg(F.min("method").alias("method"))
    return t.join(m, "k").select("topic", "method")


# --- citations -------------------------------------------------------------------------------


def reference_head(reference: Column) -> Column:
    """struct(name, year) of 'Name et al. (2025b) ...'; null where a reference does not begin so."""
    head = r"^\s*(.{2,70}?)[\s ]*\((\d{4}[a-z]?)\)"
    name, year = F.regexp_extract(reference, head, 1), F.regexp_extract(reference, head, 2)
    return F.when((F.length(name) >= 3) & name.rlike("[A-Za-z]"), F.struct(name.alias("name"), year.alias("year")))


def citation_marker(reference: Column) -> Column:
    """A pattern of the in-text mark of a reference, blanks flexible, 'and' or '&', the year in brackets or after a comma."""
    head = reference_head(reference)
    quoted = F.regexp_replace(head["name"], r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    blank = F.regexp_replace(F.regexp_replace(quoted, r"\s+and\s+", "\x01"), r"[\s ]+", "\x02")
    name = F.replace(F.replace(blank, F.lit("\x01"), F.lit(r"[\s ]+(?:and|&)[\s ]+")), F.lit("\x02"), F.lit(r"[\s ]+"))
    return F.concat(name, F.lit(r"[\s ]*(?:\([\s ]*|,[\s ]*)"), head["year"], F.lit(r"(?![0-9a-z])"))


def cited_sentences(sentences: DataFrame, references: DataFrame, doc: str, sentence: str, reference: str) -> DataFrame:
    """(doc, reference, sentence): sentences of a document that hold the mark of one of its references."""
    m = references.select(doc, reference, citation_marker(F.col(reference)).alias("_m")).where("_m is not null")
    return sentences.join(m, doc).where(F.expr(f"{sentence} rlike _m")).select(doc, reference, sentence)


def governing_reference(cites: DataFrame, references: DataFrame, doc: str, cite: str, reference: str, titles: DataFrame | None = None) -> DataFrame:
    """(doc, cite, reference, target): the reference a 'Name et al. (2024)' of a sentence stands for, and the paper it is.

    The first reference of the document that holds the surname and the year; its target is the paper whose title
    (``titles``: target, title) it contains as whole words, the longest, else the preprint number it gives.
    """
    c = cites.select(doc, cite, F.lower(F.regexp_extract(cite, r"([A-Z][\p{L}'’-]+)", 1)).alias("_n"), F.regexp_extract(cite, r"(\d{4}[a-z]?)", 1).alias("_y")).where("_n <> '' and _y <> ''").distinct()
    r = references.select(doc, reference).distinct()
    hit = c.join(r, doc).where(F.contains(F.lower(reference), F.col("_n")) & F.contains(reference, F.col("_y"))).groupBy(doc, cite).agg(F.min(reference).alias(reference))
    number = F.nullif(F.regexp_extract(reference, r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})", 1), F.lit(""))
    if titles is None:
        return hit.select(doc, cite, reference, number.alias("target"))
    from papyrine.operators.matching import contained_in

    keys = hit.select(reference).distinct().withColumn("_body", X.norm(F.col(reference)))
    found = contained_in(titles.select("target", X.norm(F.col("title")).alias("_t")), keys, "target", "_t", reference, "_body", most_hits=None)
    best = found.join(titles, "target").groupBy(reference).agg(F.max_by("target", F.struct(F.length("title"), "target")).cast("string").alias("_target"))
    return hit.join(best, reference, "left").select(doc, cite, reference, F.coalesce("_target", number).alias("target"))


# --- text ------------------------------------------------------------------------------------

# Accents that stand before their letter, and the combining marks that follow it (fixed values).
_MARKS = (("ˆ", "̂"), ("˜", "̃"), ("¯", "̄"), ("˙", "̇"))


def compose_accents(c: Column) -> Column:
    """'ˆV' as V with a combining mark; LaTeX quotes become typographic ones."""
    c = F.replace(F.replace(c, F.lit("``"), F.lit("“")), F.lit("''"), F.lit("”"))
    for sign, mark in _MARKS:
        c = F.regexp_replace(c, sign + "([A-Za-z])", "$1" + mark)
    return c


def display(c: Column, abbreviations: list[tuple[str, str]], acronyms: dict[str, str]) -> Column:
    """A label as it is shown: long names abbreviated, acronyms in their usual case, the first letter a capital."""
    for pattern, to in abbreviations:
        c = F.regexp_replace(c, "(?i)" + pattern, to)
    known = F.create_map(*[F.lit(x) for kv in acronyms.items() for x in kv])
    words = F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w))
    s = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def title_head(title: Column) -> Column:
    """The part before a colon, in lower case: enough to spot a paper in a sentence."""
    return F.lower(F.trim(F.element_at(F.split(title, "[:：]"), 1)))


# --- facts -----------------------------------------------------------------------------------

SPAN_FIELDS = ("limitation", "key_change", "result_claim")


def _held(span: Column, source: Column, least: int = 25) -> Column:
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"(\w)-\s+(\w)", "$1$2"), r"\s+", " ")))
    bare = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(\w)-\s+(\w)", "$1$2"), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))
    return F.coalesce((F.length(plain(span)) >= least) & (F.contains(plain(source), plain(span)) | F.contains(bare(source), bare(span))), F.lit(False))


def finalize(rows: DataFrame, source: str) -> DataFrame:
    """Facts verified in place: adds kept, dropped and inconsistent.

    Spans of ``novelty_spans`` and the single sentences stay only where the source holds them, whole, in any case and
    broken at hyphens or not.  A blank sentence is null and counts as neither.  A record of unknown type that proposes a
    method contradicts itself.
    """
    src = F.col(source)
    spans = F.coalesce(F.col("novelty_spans"), F.array().cast("array<string>"))
    good = F.filter(spans, lambda s: _held(s, src))
    kept, dropped = F.size(good), F.size(spans) - F.size(good)
    fields = {}
    for f in SPAN_FIELDS:
        given = F.length(F.trim(F.coalesce(F.col(f), F.lit("")))) > 0
        ok = given & _held(F.col(f), src)
        fields[f] = F.when(ok, F.trim(F.col(f)))
        kept, dropped = kept + ok.cast("int"), dropped + (given & ~ok).cast("int")
    clash = (F.col("contribution_type") == "unknown") & F.exists("methods", lambda m: m["role"] == "proposed")
    out = rows.withColumn("kept", kept).withColumn("dropped", dropped).withColumn("inconsistent", F.coalesce(clash, F.lit(False)))
    return out.withColumns({"novelty_spans": F.transform(good, lambda s: F.trim(s)), **fields})


def source_text(rows: DataFrame, *fields: str) -> Column:
    """All held text of a record as one padded, normalised string: a quote is looked up in it as whole words."""
    return F.concat(F.lit(" "), X.norm(F.concat_ws(" ", *fields)), F.lit(" "))


# --- search by meaning -----------------------------------------------------------------------


def semantic_extras(hits: DataFrame, vectors: DataFrame, doc: str, vec: str, most_seeds: int = 40, least: int = 3, share: float = 0.6, cap: int = 60) -> DataFrame:
    """(doc, sim): documents close in meaning to the best lexical hits (doc, score), hits left out.

    The centre is that of the ``most_seeds`` best hits that have a vector.  A document must lie as close to it as the seed at
    ``share`` of their order does; with fewer than ``least`` seeds there are none.
    """
    from papyrine.session import cut

    seeds = cut(hits.join(vectors.select(doc), doc, "left_semi").orderBy(F.col("score").desc(), doc).limit(most_seeds).select(doc))
    v = vectors.select(doc, F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    parts = v.join(F.broadcast(seeds), doc, "left_semi").select(F.posexplode("_v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    centre = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_c"))
    length = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x))
    dots = v.crossJoin(F.broadcast(centre)).select(doc, F.round(F.aggregate(F.zip_with("_v", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / length, 9).alias("sim"))
    own = dots.join(F.broadcast(seeds), doc, "left_semi").agg(F.sort_array(F.collect_list("sim"), False).alias("_own"))
    bar = own.where(F.size("_own") >= least).select(F.get("_own", F.floor(F.size("_own") * share).cast("int")).alias("_bar"))
    far = dots.join(hits.select(doc), doc, "left_anti").crossJoin(F.broadcast(bar)).where("sim >= _bar")
    return far.orderBy(F.col("sim").desc(), doc).limit(cap).select(doc, "sim")


# --- exports, conversations, spending, grading -----------------------------------------------


def export_rows(papers: DataFrame, cards: DataFrame, ids: DataFrame, links: DataFrame, datasets: DataFrame, key: str = "gid") -> DataFrame:
    """One flat row per paper: record, card, external ids, own links and where its benchmarks are, lists joined.

    Five left joins by ``key``; papers without a part keep their row.  cards: limitation, key_change, novelty, result_claim,
    proposes, builds_on, tasks, data (arrays); links: own, kind, url; datasets: name, place.
    """
    join = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    own = links.where("own").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "url"))), ", ").alias("links"))
    where = datasets.where("place is not null").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "name", "place"))), ", ").alias("benchmark_urls"))
    out = papers.join(cards, key, "left").join(ids.select(key, "doi"), key, "left").join(own, key, "left").join(where, key, "left")
    return out.select(
        key, "venue", "year", F.coalesce("title", F.lit("")).alias("title"), join(F.col("authors")).alias("authors"), F.coalesce("url", F.lit("")).alias("url"), "doi",
        F.coalesce("limitation", F.lit("")).alias("limitation"), F.coalesce("key_change", F.try_element_at("novelty", F.lit(1)), F.lit("")).alias("key_change"),
        F.coalesce("result_claim", F.lit("")).alias("result_claim"), *[join(F.col(c)).alias(c) for c in ("proposes", "builds_on", "tasks", "data")],
        F.coalesce("links", F.lit("")).alias("links"), F.coalesce("benchmark_urls", F.lit("")).alias("benchmark_urls"),
    )


def corpus_stamp(papers: DataFrame) -> DataFrame:
    """(editions, papers): the editions held, in order, and how many papers."""
    edition = F.concat(F.lower("venue"), F.lit("-"), F.col("year").cast("string"))
    return papers.agg(F.array_join(F.array_sort(F.collect_set(edition)), ", ").alias("editions"), F.count("*").alias("papers"))


def conversation_turns(segments: DataFrame) -> DataFrame:
    """(conv, turn, answer, citations, verified, figures, placed) of segments (conv, turn, pos, kind, text, title, ok).

    kind is 'p' prose, 'c' a cited quote, 'n' a figure.  A quote stands in the answer as the title of its paper in square
    brackets; verified and placed count those that a check has passed.
    """
    shown = F.when(F.col("kind") == "c", F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]"))).otherwise(F.coalesce("text", F.lit("")))
    n = lambda k, ok: F.count(F.when((F.col("kind") == k) & (F.col("ok") if ok else F.lit(True)), 1))
    return segments.groupBy("conv", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]), "").alias("answer"),
        n("c", False).alias("citations"), n("c", True).alias("verified"), n("n", False).alias("figures"), n("n", True).alias("placed"),
    )


def rendered(segments: DataFrame) -> DataFrame:
    """(conv, turn, text): segments as the text a grader reads.

    A quote that is the title of its paper is that title in bold, any other the quote and the title; what was not verified says so.
    """
    mark = F.when(F.coalesce(F.col("ok"), F.lit(False)), "").otherwise(" [UNVERIFIED]")
    title = F.coalesce("title", F.lit(""))
    cite = F.when((title != "") & (X.norm(F.col("text")) == X.norm(title)), F.concat(F.lit("**"), title, F.lit("**"), mark)).otherwise(
        F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('" — '), title, mark)
    )
    shown = F.when(F.col("kind") == "c", cite).otherwise(F.coalesce("text", F.lit("")))
    return segments.groupBy("conv", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]), "").alias("text"))


def anchor_totals(segments: DataFrame, least: int = 13) -> DataFrame:
    """(conv, turn, named, anchored): sentences of the prose that name a cited paper, and those that its quote follows.

    A paper is named by the head of its title, of ``least`` letters or more; the quote must follow the last sentence of the segment.
    """
    heads = segments.where("kind = 'c' and title is not null").groupBy("conv", "turn").agg(F.collect_set(title_head(F.col("title"))).alias("heads"))
    nxt = F.lead("kind").over(Window.partitionBy("conv", "turn").orderBy("pos"))
    prose = segments.withColumn("next", nxt).where("kind = 'p'").join(heads, ["conv", "turn"])
    s = prose.select("conv", "turn", "next", "heads", F.regexp_extract_all(F.rtrim("text"), F.lit(r"([^.!?\n]+[.!?\n]|[^.!?\n]+$)"), F.lit(1)).alias("s"))
    s = s.select("conv", "turn", "next", "heads", F.size("s").alias("n"), F.posexplode("s").alias("i", "sentence"))
    named = s.where(F.exists("heads", lambda h: (F.length(h) >= least) & F.contains(F.lower("sentence"), h)))
    last = (F.col("next") == "c") & (F.col("i") == F.col("n") - 1)
    return named.groupBy("conv", "turn").agg(F.count("*").alias("named"), F.count(F.when(last, 1)).alias("anchored"))


def spending(ledger: DataFrame, prices: list[tuple[str, float, float]], unknown: tuple[float, float], day_cap: float, month_cap: float) -> DataFrame:
    """(day, calls, usd, month_usd, day_left, month_left) of a ledger (day, model, tokens_in, tokens_out).

    ``prices`` are per million tokens in and out, by the first name that the model's contains; an unknown model costs ``unknown``.
    """
    m = F.lower(F.coalesce("model", F.lit("")))
    cost = None
    for name, a, b in prices:
        c = (F.col("tokens_in") * a + F.col("tokens_out") * b) / 1e6
        cost = F.when(F.contains(m, F.lit(name)), c) if cost is None else cost.when(F.contains(m, F.lit(name)), c)
    rest = (F.col("tokens_in") * unknown[0] + F.col("tokens_out") * unknown[1]) / 1e6
    usd = rest if cost is None else cost.otherwise(rest)
    d = ledger.groupBy("day").agg(F.count("*").alias("calls"), F.sum(usd).alias("usd"))
    month = Window.partitionBy(F.substring("day", 1, 7)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("month_usd", F.sum("usd").over(month))
    zero = F.lit(0.0)
    return d.select("day", "calls", "usd", "month_usd", F.greatest(zero, day_cap - F.col("usd")).alias("day_left"), F.greatest(zero, month_cap - F.col("month_usd")).alias("month_left"))


def summary(grades: DataFrame, system: str, means: dict[str, str], sums: list[str], kind: str = "type") -> DataFrame:
    """(system, n, ..): a row per system, sums over all answers and means over those of a type that have a value.

    ``means`` maps a name to 'field' or 'type:field'.
    """
    out = [F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in sums]]
    for name, source in means.items():
        t, _, field = source.rpartition(":")
        value = F.col(field).cast("double")
        out.append(F.round(F.avg(F.when(F.col(kind) == t, value) if t else value), 3).alias(name))
    return grades.groupBy(system).agg(*out)


def metric_table(summaries: DataFrame, system: str) -> DataFrame:
    """(metric, system, value): summaries turned round, one row per metric and system."""
    names = [c for c in summaries.columns if c != system]
    return summaries.select(system, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("m.metric", system, "m.value")


def quoted_anywhere(quotes: DataFrame, texts: DataFrame, quote: str, quote_id: str, text_id: str, text: str, least: int = 20) -> DataFrame:
    """(quote_id, text_id): the first text of the whole corpus that holds a quote as whole words."""
    from papyrine.operators.matching import contained_in

    q = quotes.select(quote_id, X.norm(F.col(quote)).alias("_q"))
    t = texts.select(text_id, X.norm(F.col(text)).alias("_t"))
    return contained_in(q, t, quote_id, "_q", text_id, "_t", least=least, most_hits=None, first=True).select(quote_id, text_id)


def fetched(files: DataFrame, key: str, content: str, magic: bytes = b"%PDF", least: int = 8_000) -> DataFrame:
    """Files of binary ``content`` that begin with ``magic`` and have ``least`` bytes or more, one for each key."""
    ok = files.where((F.length(content) >= least) & (F.substring(content, 1, len(magic)) == F.lit(magic)))
    return ok.dropDuplicates([key])


def benchmark_places(mentions: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """(mentions.., listed, place, host): where a benchmark is to be found, by its folded name or an alias.

    ``registry`` has pos, name, aliases, hf, gh, url, hf_ok, gh_ok; of entries that share a key the first wins.  A checked
    dataset address comes before a checked repository, before any other address.
    """
    r = registry.select("pos", F.col("name").alias("listed"), "hf", "gh", "url", "hf_ok", "gh_ok", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    r = r.withColumn("_k", X.dataset_key(F.col("surface"))).where("_k <> ''")
    hf, gh = F.col("hf").isNotNull() & F.coalesce("hf_ok", F.lit(False)), F.col("gh").isNotNull() & F.coalesce("gh_ok", F.lit(False))
    place = F.when(hf, F.concat(F.lit("https://huggingface.co/datasets/"), "hf")).when(gh, F.concat(F.lit("https://github.com/"), "gh")).otherwise(F.col("url"))
    host = F.when(hf, "huggingface").when(gh, "github").when(F.col("url").isNotNull(), "web")
    first = r.groupBy("_k").agg(F.min_by(F.struct("listed", place.alias("place"), host.alias("host")), "pos").alias("r"))
    return mentions.withColumn("_k", X.dataset_key(F.col(name))).join(first, "_k", "left").select(*mentions.columns, "r.listed", "r.place", "r.host")


def concept_labels(concepts: DataFrame, fallback: DataFrame, cluster: str, doc: str, term: str, least: int = 2, top: int = 3) -> DataFrame:
    """(cluster, rank, term): names frequent inside a cluster and rare outside, ``least`` documents or more.

    A cluster with fewer than two takes labels (cluster, rank, term) of ``fallback`` after its own.
    """
    once = concepts.select(cluster, doc, term).distinct()
    c = once.groupBy(cluster, term).agg(F.count("*").alias("c"))
    total = c.groupBy(term).agg(F.sum("c").alias("total"))
    n = concepts.groupBy(cluster).agg(F.count_distinct(doc).alias("n"))
    s = c.where(F.col("c") >= least).join(total, term).join(n, cluster)
    score = F.round(F.col("c") / F.col("n") * (F.col("c") / F.greatest(F.col("total") - F.col("c"), F.lit(1))), 12)
    w = Window.partitionBy(cluster).orderBy(score.desc(), F.col("c").desc(), F.col(term).desc())
    own = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(cluster, "rank", term)
    few = n.select(cluster).join(own.groupBy(cluster).agg(F.count("*").alias("k")), cluster, "left").where(F.coalesce("k", F.lit(0)) < 2).select(cluster)
    more = fallback.join(few, cluster, "left_semi").select(cluster, (F.col("rank") + 100).alias("rank"), term)
    every = Window.partitionBy(cluster).orderBy("rank")
    return own.union(more).withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)


def group_labels(groups: DataFrame, terms: DataFrame, part: str, doc: str, group: str, term: str, top: int = 3) -> DataFrame:
    """(part, group, labels): terms distinctive of a group inside its selection, none inside another.

    Score (pa + 0.02) / (pb + 0.02) * ln(1 + c) of the shares inside and outside the group; c is 2 at least.
    """
    size = groups.groupBy(part, group).agg(F.count_distinct(doc).alias("n"))
    whole = size.groupBy(part).agg(F.sum("n").alias("all"))
    t = groups.join(terms.select(doc, term).distinct(), doc)
    c = t.groupBy(part, group, term).agg(F.count_distinct(doc).alias("c"))
    total = c.groupBy(part, term).agg(F.sum("c").alias("total"))
    s = c.where("c >= 2").join(total, [part, term]).join(size, [part, group]).join(whole, part)
    pa, pb = F.col("c") / F.col("n"), (F.col("total") - F.col("c")) / F.greatest(F.col("all") - F.col("n"), F.lit(1))
    s = s.withColumn("score", F.round((pa + 0.02) / (pb + 0.02) * F.log1p("c"), 9))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(term).alias("t"))))
    empty = F.array().cast("array<string>")
    pick = lambda held, x: F.when((F.size(held) < top) & ~F.exists(held, lambda h: F.contains(h, x["t"]) | F.contains(x["t"], h)), F.concat(held, F.array(x["t"]))).otherwise(held)
    return s.groupBy(part, group).agg(F.aggregate(order, empty, pick).alias("labels"))


def title_grades(answers: DataFrame, papers: DataFrame, answer: str, text: str, paper: str, title: str) -> DataFrame:
    """(answer, matched, phantom, phantom_rate): marked pieces of an answer that are titles held, and those that only look like one."""
    from papyrine.operators.extraction import markdown_pieces, titleish

    p = answers.select(answer, F.explode(F.array_distinct(markdown_pieces(F.col(text)))).alias("piece")).withColumn("_k", X.norm(F.col("piece")))
    known = papers.select(X.norm(F.col(title)).alias("_k"), F.col(paper).alias("_p")).where("_k <> ''").groupBy("_k").agg(F.min("_p").alias("_p"))
    m = p.join(known, "_k", "left")
    g = m.groupBy(answer).agg(F.count_distinct("_p").alias("matched"), F.count_distinct(F.when(F.col("_p").isNull() & titleish(F.col("piece")), F.col("_k"))).alias("phantom"))
    g = answers.select(answer).distinct().join(g, answer, "left").fillna(0, ["matched", "phantom"])
    return g.select(answer, "matched", "phantom", F.try_divide(F.col("phantom"), F.col("phantom") + F.col("matched")).alias("phantom_rate"))
