"""Record queries: duplicate entries, identifiers, keys, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import records as Rec
from papyrine.session import table

_LATEST = """with p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"""


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def record_dedup(spark, d):
    p = _papers(spark, d)
    best = [F.col("abstract").isNull().cast("int"), (~F.coalesce("is_oral", F.lit(False))).cast("int")]
    key = F.concat_ws("|", "venue", F.col("year").cast("string"), X.dedupe_key(F.col("title")))
    m = Rec.merge_duplicates(p, key, "event_id", best, ["abstract", "topic_raw", "openreview_id", "decision"], ["is_oral", "is_spotlight"])
    return m.select("event_id", F.length("abstract").alias("abstract_chars"), "topic_raw", "openreview_id", "decision", "is_oral", "is_spotlight", F.array_join(F.transform("duplicate_ids", lambda x: x.cast("string")), ";").alias("duplicates"))


RECORD_DEDUP = _LATEST + r""",
k as (select *, concat_ws('|', venue, year::varchar, regexp_replace(lower(title), '[^\pL\pN_]+', '', 'g')) as key,
  struct_pack(a := (abstract is null)::int, b := (not coalesce(is_oral, false))::int, c := event_id) as o from p),
g as (select key, arg_min(event_id, o) as event_id, arg_min(abstract, o) filter (abstract is not null) as abstract, arg_min(topic_raw, o) filter (topic_raw is not null) as topic_raw,
  arg_min(openreview_id, o) filter (openreview_id is not null) as openreview_id, arg_min(decision, o) filter (decision is not null) as decision,
  coalesce(bool_or(is_oral), false) as is_oral, coalesce(bool_or(is_spotlight), false) as is_spotlight, list_sort(list(distinct event_id)) as ids from k group by key)
select event_id, length(abstract) as abstract_chars, topic_raw, openreview_id, decision, is_oral, is_spotlight,
  array_to_string(list_filter(ids, lambda x: x <> event_id), ';') as duplicates from g"""


def record_gid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return Rec.global_ids(docs, "source", "doc_id").select("gid", "source", "doc_id")


RECORD_GID = "select row_number() over (order by coalesce(source, ''), doc_id) - 1 as gid, coalesce(source, '') as source, doc_id from documents"


def coverage_gate(spark, d):
    p = Rec.require_coverage(_papers(spark, d), "abstract", 0.5)
    return Rec.coverage(p, "venue", "abstract", "topic_raw", "decision", "institution")


COVERAGE_GATE = _LATEST + """ select venue, count(*) as n, round(avg((abstract is not null)::int), 6) as has_abstract, round(avg((topic_raw is not null)::int), 6) as has_topic_raw,
round(avg((decision is not null)::int), 6) as has_decision, round(avg((institution is not null)::int), 6) as has_institution from p group by 1"""


def title_keys(spark, d):
    p = _papers(spark, d)
    t = F.col("title")
    return p.select("event_id", X.norm(t).alias("norm"), X.dedupe_key(t).alias("dedupe"), X.basic(t).alias("basic"), X.canon(t).alias("canon"), X.slug(t).alias("slug"), X.squeeze(t).alias("squeezed"), F.array_join(X.title_tokens(t), " ").alias("tokens"))


TITLE_KEYS = _LATEST + r""",
b as (select event_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as norm,
  trim(regexp_replace(regexp_replace(lower(trim(title)), '[\s.,;:]+$', ''), '[\s\-_/]+', ' ', 'g')) as basic from p),
c as (select *, trim(regexp_replace(regexp_replace(basic, '\b(tasks?|problems?|applications?)\b', '', 'g'), '\s+', ' ', 'g')) as c0 from b)
select event_id, norm, regexp_replace(lower(title), '[^\pL\pN_]+', '', 'g') as dedupe, basic,
  case when length(c0) > 3 and not regexp_matches(c0, '(ics|ss|us|sis|is|as)$') then regexp_replace(c0, '([a-z])s$', '\1') else c0 end as canon,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') as slug, trim(regexp_replace(title, '\s+', ' ', 'g')) as squeezed,
  (select string_agg(t, ' ' order by i) from (select t, min(i) as i from (select unnest(string_split(norm, ' ')) as t, generate_subscripts(string_split(norm, ' '), 1) as i)
    where length(t) > 2 and t not in ('the','and','for','with','via','from','into','using','based') group by t)) as tokens
from c"""


def topic_split(spark, d):
    p = _papers(spark, d)
    s = X.split_topic(F.col("topic_raw"))
    return p.select("event_id", s["area"].alias("area"), s["subarea"].alias("subarea"), X.submission_id(F.col("paper_url")).alias("submission"))


TOPIC_SPLIT = _LATEST + r""",
s as (select event_id, paper_url, list_filter(list_transform(string_split(topic_raw, '->'), lambda x: trim(x)), lambda x: x <> '') as parts from p)
select event_id, parts[1] as area, parts[2] as subarea, nullif(regexp_extract(paper_url, '[?&]id=([A-Za-z0-9_-]+)', 1), '') as submission from s"""


def institution_names(spark, d):
    """Affiliations cleaned and looked up in the alias table, which is joined by its exact lower-case form."""
    raw = _papers(spark, d).select("institution").where("institution is not null").groupBy("institution").agg(F.count("*").alias("n"))
    clean = raw.withColumn("clean", X.institution(F.col("institution"))).where("clean is not null")
    alias = table(spark, d, "institution_aliases").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    named = clean.join(alias, F.lower("clean") == F.col("alias"), "left").withColumn("name", F.coalesce("canonical", "clean"))
    return named.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))


INSTITUTION_NAMES = _LATEST + r""",
r as (select institution, count(*) as n from p where institution is not null group by 1),
s as (select *, regexp_replace(trim(trim(regexp_replace(institution, '\s+', ' ', 'g')), ', '), '(?i)\s*,?\s*(inc\.?|ltd\.?|llc)\s*$', '') as s from r),
t as (select *, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') as parts from s),
c as (select n, nullif(case when len(parts) > 1 and len(list_distinct(list_transform(parts, lambda x: lower(x)))) = 1 then parts[1] else s end, '') as clean from t),
a as (select alias, min(canonical) as canonical from institution_aliases group by 1)
select coalesce(canonical, clean) as name, sum(n)::bigint as n, count(*) as spellings from c left join a on lower(clean) = alias where clean is not null group by 1"""


def track_class(spark, d):
    """Track of a source URL by the first pattern that fits; the URLs are built from venue and track."""
    p = _papers(spark, d)
    url = F.concat(F.lit("https://host/group?id="), "venue", F.lit(".cc/"), F.col("year").cast("string"), F.when(F.col("track") == "main", "/Conference").when(F.col("track") == "position", "/Position_Paper_Track").otherwise("/x"))
    c = p.select(X.classify(url, X.TRACK_RULES, "other").alias("track_class"), "track")
    return c.groupBy("track", "track_class").agg(F.count("*").alias("n"))


TRACK_CLASS = _LATEST + r""",
u as (select track, 'https://host/group?id=' || venue || '.cc/' || year || case track when 'main' then '/Conference' when 'position' then '/Position_Paper_Track' else '/x' end as url from p)
select track, case when regexp_matches(url, '(?i)/\d{4}/Conference') then 'main' when regexp_matches(url, '(?i)Position_Paper_Track') then 'position'
 when regexp_matches(url, '(?i)^TMLR') then 'tmlr-journal' when regexp_matches(url, '(?i)JmlrOrg') then 'jmlr-journal' when regexp_matches(url, '(?i)ANN-STATS') then 'annals-stats' else 'other' end as track_class,
 count(*) as n from u group by 1, 2"""


def latest_facts(spark, d):
    f = table(spark, d, "facts_abstract").where("ok")
    last = Rec.latest(f, "event_id", "extracted_at", "source", "model")
    return last.select("event_id", "source", "model", "facts.domain", "facts.contribution_type", F.size("facts.methods").alias("n_methods"), F.size("facts.datasets").alias("n_datasets"))


LATEST_FACTS = """with f as (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok)
select event_id, source, model, facts.domain as domain, facts.contribution_type as contribution_type, coalesce(len(facts.methods), -1) as n_methods, coalesce(len(facts.datasets), -1) as n_datasets from f where rn = 1"""


def fields_merged(spark, d):
    """The abstract's fields lead; a field that is empty there comes from the longest document of the paper."""
    p = _papers(spark, d).select("event_id", "abstract", "topic_raw")
    docs = table(spark, d, "documents").where("event_id is not null and section = 'abstract'")
    best = docs.groupBy("event_id").agg(F.max_by("text", F.struct("n_chars", F.col("doc_id"))).alias("abstract"), F.lit(None).cast("string").alias("topic_raw"))
    return Rec.fields_from(p, best, "event_id", ["abstract", "topic_raw"]).select("event_id", F.length("abstract").alias("chars"), "topic_raw")


FIELDS_MERGED = _LATEST + """,
b as (select event_id, arg_max(text, struct_pack(a := n_chars, b := doc_id)) as text from documents where event_id is not null and section = 'abstract' group by 1)
select event_id, length(coalesce(nullif(trim(abstract), ''), nullif(trim(text), ''))) as chars, nullif(trim(topic_raw), '') as topic_raw from p left join b using (event_id)"""


def budget_text(spark, d):
    """Texts of a paper in order of section until 4,000 characters are used."""
    c = table(spark, d, "documents").where("event_id is not null").select("event_id", F.coalesce("section", F.lit("~")).alias("section"), "doc_id", "text")
    b = Rec.budget_text(c, "event_id", "section", "doc_id", "text", 4000)
    return b.groupBy("event_id").agg(F.count("*").alias("chunks"), F.sum(F.length("kept")).alias("chars"), F.max_by("doc_id", F.struct("section", "doc_id")).alias("last_doc"))


BUDGET_TEXT = """with c as (select event_id, coalesce(section, '~') as section, doc_id, text from documents where event_id is not null),
u as (select *, coalesce(sum(length(text)) over (partition by event_id order by section, doc_id rows between unbounded preceding and 1 preceding), 0) as used from c)
select event_id, count(*) as chunks, sum(least(length(text), 4000 - used))::bigint as chars, arg_max(doc_id, struct_pack(a := section, b := doc_id)) as last_doc from u where used < 4000 group by 1"""


def interned_topics(spark, d):
    return Rec.intern(_papers(spark, d), "subarea", "event_id").withColumnRenamed("subarea", "term")


INTERNED_TOPICS = _LATEST + ", f as (select subarea as term, min(event_id) as first from p where subarea is not null group by 1) select term, row_number() over (order by first, term) - 1 as id from f"


def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    return Rec.stratified_sample(docs, "lang", "doc_id", 0.1)


QUERIES = [
    ("record_dedup", record_dedup, RECORD_DEDUP),
    ("record_gid", record_gid, RECORD_GID),
    ("coverage_gate", coverage_gate, COVERAGE_GATE),
    ("title_keys", title_keys, TITLE_KEYS),
    ("topic_split", topic_split, TOPIC_SPLIT),
    ("institution_names", institution_names, INSTITUTION_NAMES),
    ("track_class", track_class, TRACK_CLASS),
    ("latest_facts", latest_facts, LATEST_FACTS),
    ("fields_merged", fields_merged, FIELDS_MERGED),
    ("budget_text", budget_text, BUDGET_TEXT),
    ("interned_topics", interned_topics, INTERNED_TOPICS),
    ("stratified_sample", stratified_sample, None),
]
