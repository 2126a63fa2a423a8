"""Matching queries: papers against preprints, quotes against texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import matching as M
from papyrine.operators import records as Rec
from papyrine.operators import verification as Ver
from papyrine.session import cut, table

_P = "p as (select event_id, title, abstract from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at").select("event_id", "title", "abstract")


def exact_match(spark, d):
    return M.exact_match(_papers(spark, d), table(spark, d, "arxiv_index").select("arxiv_base", "title"), X.norm(F.col("title")), "arxiv_base", "event_id")


EXACT_MATCH = f"with {_P}, r as (select {_NORM.format('title')} as k, min(arxiv_base) as arxiv_base from arxiv_index group by 1) select event_id, arxiv_base from p join r on {_NORM.format('title')} = k where k <> ''"


def fuzzy_match(spark, d):
    m = M.fuzzy_match(_papers(spark, d), table(spark, d, "arxiv_index").select("arxiv_base", "title"), "event_id", "arxiv_base")
    return m.withColumn("score", F.round("score", 6))


_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 2 and x not in ('the','and','for','with','via','from','into','using','based')))"
FUZZY_MATCH = f"""with {_P}, l as (select event_id, {_NORM.format('title')} as key from p), l2 as (select *, {_TOK.format('key')} as tk from l),
r as (select {_NORM.format('title')} as key, min(arxiv_base) as arxiv_base from arxiv_index group by 1), r2 as (select *, {_TOK.format('key')} as tk from r),
e as (select event_id, r.arxiv_base from l join r on l.key = r.key and l.key <> ''),
s as (select event_id, r2.arxiv_base, len(list_intersect(l2.tk, r2.tk))::double / len(list_distinct(list_concat(l2.tk, r2.tk))) as score
  from l2 join r2 on len(list_intersect(l2.tk, r2.tk))::double / greatest(len(list_distinct(list_concat(l2.tk, r2.tk))), 1) >= 0.85 where event_id not in (select event_id from e)),
t as (select * from (select *, lead(score) over w as second, row_number() over w as n from s window w as (partition by event_id order by score desc, arxiv_base)) where n = 1)
select event_id, case when e.arxiv_base is not null then 'exact' when len(tk) = 0 then 'no-tokens' when t.score is null then 'none' when second >= t.score - 0.05 then 'ambiguous' else 'fuzzy' end as outcome,
  coalesce(e.arxiv_base, case when second >= t.score - 0.05 then null else t.arxiv_base end) as arxiv_base, round(case when e.arxiv_base is not null then 1.0 else coalesce(t.score, 0.0) end, 6) as score
from l2 left join e using (event_id) left join t using (event_id)"""


def resolved_bridge(spark, d):
    """Papers by the preprint an earlier run had found, first one wins."""
    r = table(spark, d, "resolved").where("arxiv_base is not null").groupBy("arxiv_base").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    a = table(spark, d, "arxiv_index").groupBy("arxiv_base").agg(F.count("*").alias("versions"))
    return r.join(a, "arxiv_base", "left").select("arxiv_base", "event_id", "n", F.coalesce("versions", F.lit(0)).alias("versions"), F.concat(F.lit("10.48550/arXiv."), "arxiv_base").alias("doi"))


RESOLVED_BRIDGE = """with r as (select arxiv_base, min(event_id) as event_id, count(*) as n from resolved where arxiv_base is not null group by 1), a as (select arxiv_base, count(*) as versions from arxiv_index group by 1)
select arxiv_base, event_id, n, coalesce(versions, 0) as versions, '10.48550/arXiv.' || arxiv_base as doi from r left join a using (arxiv_base)"""


def title_mentions(spark, d):
    """Documents in whose text the title of a paper stands, generic titles left out."""
    p = _papers(spark, d).groupBy(X.norm(F.col("title")).alias("title")).agg(F.min("event_id").alias("event_id"))
    t = table(spark, d, "documents").select("doc_id", X.norm(F.col("text")).alias("body"))
    return M.contained_in(p, t, "event_id", "title", "doc_id", "body")


TITLE_MENTIONS = f"""with {_P}, n as (select {_NORM.format('title')} as title, min(event_id) as event_id from p group by 1 having length({_NORM.format('title')}) >= 25),
t as (select doc_id, ' ' || {_NORM.format('text')} || ' ' as body from documents),
h as (select doc_id, event_id from n join t on contains(body, ' ' || title || ' '))
select doc_id, event_id from h where event_id in (select event_id from h group by 1 having count(*) <= 200)"""


def citation_degrees(spark, d):
    """Paper to paper: a document of one paper that holds the title of another; degrees both ways."""
    docs = table(spark, d, "documents").select("doc_id", F.col("event_id").alias("citing"))
    e = title_mentions(spark, d).join(docs, "doc_id").where("citing is not null and citing <> event_id").select("citing", F.col("event_id").alias("cited")).distinct()
    e = cut(e)  # read twice; the texts are read once
    a = e.groupBy(F.col("citing").alias("event_id")).agg(F.count("*").alias("cites"))
    b = e.groupBy(F.col("cited").alias("event_id")).agg(F.count("*").alias("cited_by"))
    return a.join(b, "event_id", "full").select("event_id", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


CITATION_DEGREES = TITLE_MENTIONS.replace("select doc_id, event_id from h where", ", g as (select doc_id, event_id from h where").rstrip() + """),
e as (select distinct documents.event_id as citing, g.event_id as cited from g join documents using (doc_id) where documents.event_id is not null and documents.event_id <> g.event_id),
a as (select citing as event_id, count(*) as cites from e group by 1), b as (select cited as event_id, count(*) as cited_by from e group by 1)
select event_id, coalesce(cites, 0) as cites, coalesce(cited_by, 0) as cited_by from a full join b using (event_id)"""


def sentence_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(M.sentences(F.col("text"))).alias("pos", "sentence"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


def method_contexts(spark, d):
    """Sentences of an abstract that name a method the paper builds on."""
    f = Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model")
    names = f.select(F.col("event_id").alias("paper"), F.explode("facts.methods.name").alias("mark")).where(F.length("mark") >= 6).distinct()
    docs = _papers(spark, d).where("abstract is not null").select(F.col("event_id").cast("string").alias("event_id"), "abstract")
    marks = names.select(F.col("paper").cast("string").alias("paper"), F.col("mark").alias("cited"), "mark")
    return M.mention_contexts(docs, "event_id", "abstract", marks, "paper", "cited", "mark")


def verify_evidence(spark, d):
    """Evidence spans of the extraction checked against the abstract: kept, kept without punctuation, or dropped."""
    f = Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model")
    spans = f.select("event_id", F.posexplode("facts.methods.evidence").alias("pos", "span")).where("span is not null")
    src = _papers(spark, d).select("event_id", F.col("abstract").alias("source"))
    v = Ver.verify_spans(spans.join(src, "event_id"), "span", "source")
    return v.groupBy("verdict").agg(F.count("*").alias("n"))


_MN = "trim(regexp_replace(regexp_replace(lower({0}), '([a-z0-9])- +([a-z0-9])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
_NP = "trim(regexp_replace(regexp_replace({0}, '[^\\pL\\pN\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
VERIFY_EVIDENCE = f"""with {_P}, f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1),
s as (select event_id, unnest(facts.methods).evidence as span from f), j as (select {_MN.format('span')} as a, {_MN.format('abstract')} as b from s join p using (event_id) where span is not null)
select case when length(a) < 25 then 'dropped' when coalesce(contains(b, a), false) then 'kept' when coalesce(contains({_NP.format('b')}, {_NP.format('a')}), false) then 'kept-loose' else 'dropped' end as verdict, count(*) as n from j group by 1"""


def verify_quotes(spark, d):
    """Test items quoted by documents: which document holds the whole item, and in which section."""
    items = table(spark, d, "eval_items").select("item_id", X.norm(F.col("text")).alias("quote"))
    t = table(spark, d, "documents").select("doc_id", X.norm(F.col("text")).alias("body"))
    hits = M.contained_in(items, t, "item_id", "quote", "doc_id", "body", 20, None)
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("section", F.lit("?")).alias("section"))
    return hits.join(docs, "doc_id").groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.min("section").alias("section"))


VERIFY_QUOTES = f"""with q as (select item_id, {_NORM.format('text')} as quote from eval_items), t as (select doc_id, coalesce(section, '?') as section, ' ' || {_NORM.format('text')} || ' ' as body from documents)
select item_id, count(*) as n_docs, min(doc_id) as first_doc, min(section) as section from q join t on contains(body, ' ' || quote || ' ') group by 1"""


def verify_mutations(spark, d):
    """The verifier's own test: a title as it is, with a word swapped, spliced, and with half of another."""
    p = _papers(spark, d).select("event_id", X.norm(F.col("title")).alias("own")).where(F.size(F.split("own", " ")) >= 6)
    other = p.select((F.col("event_id") + 1).alias("event_id"), F.col("own").alias("other"))
    return Ver.mutation_rates(p.join(other, "event_id", "left"), "own", "other")


VERIFY_MUTATIONS = f"""with {_P}, a as (select event_id, {_NORM.format('title')} as own, string_split({_NORM.format('title')}, ' ') as w from p), b as (select * from a where len(w) >= 6),
c as (select b.own, b.w, o.w as x from b left join b o on o.event_id + 1 = b.event_id),
m as (select unnest(['own', 'swap', 'drop', 'splice']) as edit, unnest([own, array_to_string(list_concat(w[1:2], list_concat([w[4]], list_concat([w[3]], w[5:]))), ' '), array_to_string(list_concat(w[1:2], w[5:]), ' '),
  case when x is not null then array_to_string(list_concat(w[1:3], x[4:]), ' ') end]) as quote, own from c)
select edit, count(quote) as n, count(*) filter (contains(' ' || own || ' ', ' ' || quote || ' ')) as accepted from m where quote is not null group by 1"""

QUERIES = [
    ("exact_match", exact_match, EXACT_MATCH),
    ("fuzzy_match", fuzzy_match, FUZZY_MATCH),
    ("resolved_bridge", resolved_bridge, RESOLVED_BRIDGE),
    ("title_mentions", title_mentions, TITLE_MENTIONS),
    ("citation_degrees", citation_degrees, CITATION_DEGREES),
    ("sentence_split", sentence_split, None),
    ("method_contexts", method_contexts, None),
    ("verify_evidence", verify_evidence, VERIFY_EVIDENCE),
    ("verify_quotes", verify_quotes, VERIFY_QUOTES),
    ("verify_mutations", verify_mutations, VERIFY_MUTATIONS),
]
