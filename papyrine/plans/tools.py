"""Tool queries over a store built from the tables, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import records as Rec
from papyrine.operators import tools as Tool
from papyrine.plans import selection as Sel
from papyrine.session import table
from papyrine.sources import files

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"
_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"


def _attack():
    """What a paper claims, proposes and works on, as one text."""
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), " ")
    return F.concat_ws(" ", "facts.key_change", F.array_join("facts.novelty_spans", " "), names(F.filter("facts.methods", lambda m: m["role"] == "proposed")), names(F.col("facts.tasks")))


def store(spark, d) -> Tool.Store:
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")
    f = Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model")
    papers = p.select(F.col("event_id").alias("gid"), "venue", "year", "title", "authors", "abstract", F.col("paper_url").alias("url"))
    topics = p.where("subarea is not null").select(F.lower("subarea").alias("topic"), F.col("event_id").alias("gid"), F.lit(1).alias("kind"))
    facts = f.select(F.col("event_id").alias("gid"), F.col("facts.limitation").alias("limitation"), F.col("facts.key_change").alias("claim"), _attack().alias("attack"), F.col("facts.methods.name").alias("methods"), F.col("facts.datasets.name").alias("datasets"))
    docs = table(spark, d, "documents").where("event_id is not null")
    sections = docs.select(F.col("event_id").alias("gid"), F.col("doc_id").alias("pos"), F.col("section").alias("heading"), F.col("section").alias("bucket"), "text")
    dup = p.select(F.col("event_id").alias("citing"), F.explode("duplicate_event_ids").alias("cited")).where("citing <> cited").withColumn("sentence", F.lit(None).cast("string"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("vec"))
    links = papers.where("url is not null").select("gid", F.lit("page").alias("kind"), F.col("url").alias("repo"), (F.col("year") == 2026).alias("own"))
    cells = p.where("area is not null and subarea is not null").groupBy(F.lower("area").alias("field"), F.lower("subarea").alias("technique")).agg(F.count("*").cast("double").alias("score"))
    return Tool.Store(papers, topics, facts, sections, dup, vectors, links, cells, None)


def tool_topics(spark, d):
    return Tool.list_topics(store(spark, d))


TOOL_TOPICS = f"with {_P} select lower(subarea) as topic, count(*) as direct, count(*) as total, count(distinct venue || year) as editions from p where subarea is not null group by 1"


def tool_search(spark, d):
    """Papers with every word in title or abstract, newest first."""
    return Tool.search_papers(store(spark, d), "policy Rank", 50).select("gid", "title", "venue", "year")


TOOL_SEARCH = f"with {_P} select event_id as gid, title, venue, year from p where contains(lower(concat_ws(' ', title, abstract)), 'policy') and contains(lower(concat_ws(' ', title, abstract)), 'rank') order by year desc, gid limit 50"


def tool_search_index(spark, d):
    """The same search over an index: papers ranked by the terms that begin with a word."""
    from papyrine.operators import selection as S

    s = store(spark, d)
    s.postings = S.term_index(s.papers.where("abstract is not null").select("gid", "abstract"), "gid", "abstract").select("term", "doc", "df")
    return Tool.search_papers(s, "graph noisy", 20).select("gid", "title", F.round("score", 6).alias("score"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.SEARCH_STOP) + "]"
_POSTS = f"""a as (select event_id as doc, regexp_extract_all(lower(abstract), '[a-z][a-z0-9\\-]{{2,}}') as w from p where abstract is not null),
t as (select distinct doc, unnest(list_concat(list_filter(w, lambda x: not list_contains({_STOP}, x)), list_transform(list_filter(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]), lambda x: not list_has_any(x, {_STOP})), lambda x: x[1] || ' ' || x[2]))) as term from a),
k as (select term, count(*) as df from t group by 1 having case when contains(term, ' ') then count(*) >= 5 else count(*) >= 2 end and count(*) < 0.15 * (select count(*) from a)), x as (select term, doc, df from t join k using (term))"""
TOOL_SEARCH_INDEX = f"""with {_P}, {_POSTS}, s as (select doc, sum(ln(1 + (select count(*) from p)::double / df)) as s from x where starts_with(term, 'graph') or starts_with(term, 'noisy') group by 1 order by s desc, doc limit 20)
select doc as gid, title, round(s, 6) as score from s join p on event_id = doc"""


def tool_get_paper(spark, d):
    """The first paper with its topics and how often it cites and is cited."""
    s = store(spark, d)
    gid = s.papers.agg(F.min("gid")).first()[0]
    return Tool.get_paper(s, gid if gid is not None else -1).select("gid", "title", "venue", "year", F.array_join("topics", "; ").alias("topics"), "cites", "cited_by")


TOOL_GET_PAPER = f"""with {_P}, g as (select min(event_id) as g from p), e as (select event_id as citing, unnest(duplicate_event_ids) as cited from p)
select event_id as gid, title, venue, year, lower(subarea) as topics, (select count(*) from e where citing = g and citing <> cited) as cites, (select count(*) from e where cited = g and citing <> cited) as cited_by from p, g where event_id = g"""


def tool_blue_ocean(spark, d):
    """The leading cells of the fields whose name contains a word."""
    return Tool.blue_ocean(store(spark, d), "learning", 25)


TOOL_BLUE_OCEAN = f"with {_P} select lower(area) as field, lower(subarea) as technique, count(*)::double as score from p where area is not null and subarea is not null and (contains(lower(area), 'learning') or contains('learning', lower(area))) group by 1, 2 order by score desc, field, technique limit 25"


def tool_paper_resources(spark, d):
    """Links of the first paper that has any, and whether its text was read."""
    s = store(spark, d)
    gid = s.links.agg(F.min("gid")).first()[0]
    return Tool.paper_resources(s, gid if gid is not None else -1)


TOOL_PAPER_RESOURCES = f"with {_P}, g as (select min(event_id) as g from p where paper_url is not null) select event_id as gid, 'page' as kind, paper_url as repo, year = 2026 as own, g in (select event_id from documents where event_id is not null) as text_read from p, g where event_id = g"


def tool_gap_scan(spark, d):
    """Failures that the papers of the largest area name, and who attacks them."""
    s = store(spark, d)
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at").where("area is not null")
    s.topics = p.select(F.lower("area").alias("topic"), F.col("event_id").alias("gid"), F.lit(1).alias("kind"))
    top = s.topics.groupBy("topic").agg(F.count_distinct("gid").alias("n")).orderBy(F.col("n").desc(), "topic").limit(1).collect()
    return Tool.gap_scan(s, top[0].topic if top else "")


_AREA = "(select lower(area) from p where area is not null group by 1 order by count(*) desc, 1 limit 1)"
TOOL_GAP_SCAN = f"with recursive {_P}, {_F}, " + Sel.gap_sql(Sel.MEMBERS + f" where lower(area) = {_AREA}", f"regexp_extract_all({_AREA}, '[a-z][a-z\\-]{{2,}}')") + Sel.GAP_SCAN_TAIL.replace("years, event_id, sentence from s", "years, event_id as gid, sentence from s")


def tool_topic_papers(spark, d):
    return Tool.topic_papers(store(spark, d), "Bila Caches", 200)


TOOL_TOPIC_PAPERS = f"with {_P} select event_id as gid, title, venue, year, 1 as kind from p where lower(subarea) = 'bila caches' order by year desc, gid limit 200"


def tool_field_trend(spark, d):
    t = Tool.field_trend(store(spark, d), "Bila Caches")
    return t.select("venue", "year", "n", "total", F.round("per_1k", 6).alias("per_1k"), F.round("z", 6).alias("z"))


TOOL_FIELD_TREND = f"""with {_P}, t as (select venue, year, count(*) as total, count(*) filter (lower(subarea) = 'bila caches') as n from p group by 1, 2),
l as (select *, lag(n) over w as n0, lag(total) over w as t0 from t window w as (partition by venue order by year)), s as (select *, (n + n0)::double / (total + t0) as p from l)
select venue, year, n, total, round(1000.0 * n / total, 6) as per_1k, round(case when t0 is null then null when p * (1 - p) * (1.0 / t0 + 1.0 / total) > 1e-12 then (n::double / total - n0::double / t0) / sqrt(p * (1 - p) * (1.0 / t0 + 1.0 / total)) else 0 end, 6) as z from s"""


def tool_field_cards(spark, d):
    c = Tool.field_cards(store(spark, d), topic="Bila Caches", limit=60)
    return c.select("gid", "title", "limitation", F.array_join(F.filter("methods", lambda x: x.isNotNull()), "; ").alias("methods"))


TOOL_FIELD_CARDS = f"""with {_P}, {_F}, t as (select event_id, title, year from p where lower(subarea) = 'bila caches' order by year desc, event_id limit 200),
c as (select event_id as gid, title, year, facts.limitation as limitation, list_transform(facts.methods, lambda x: x.name) as m from t join f using (event_id)),
u as (select gid, i, m[i] as name from c, range(1, 100) r(i) where i <= len(m)), v as (select gid, name, min(i) as i from u group by 1, 2), w as (select *, row_number() over (partition by gid order by i) as r from v),
g as (select gid, string_agg(name, '; ' order by i) as methods from w where r <= 4 and name is not null group by 1)
select gid, title, limitation, coalesce(methods, case when m is not null then '' end) as methods from c left join g using (gid) order by year desc, gid limit 60"""


def tool_citations(spark, d):
    s = store(spark, d)
    first = s.edges.agg(F.min("citing")).first()[0]
    return Tool.get_citations(s, first if first is not None else -1).select("direction", "gid", "title")


TOOL_CITATIONS = f"""with {_P}, e as (select distinct citing, cited from (select event_id as citing, unnest(duplicate_event_ids) as cited from p) where citing <> cited), o as (select min(citing) as g from e),
x as (select case when citing = g then 'cites' else 'cited by' end as direction, case when citing = g then cited else citing end as gid from e, o where citing = g or cited = g)
select direction, gid, title from x left join p on p.event_id = gid"""


def tool_benchmark(spark, d):
    return Tool.benchmark_info(store(spark, d), "the VubrieskkBench dataset", 100)


TOOL_BENCHMARK = f"""with {_P}, {_F}, u as (select event_id, unnest(facts.datasets).name as dataset from f)
select event_id as gid, title, venue, year, dataset from p join u using (event_id) where regexp_replace(regexp_replace(regexp_replace(lower(dataset), '^(the|a)\\s+', ''), '\\s+(benchmark|dataset|corpus|suite)s?$', ''), '[^a-z0-9+]', '', 'g') = 'vubrieskkbench' order by year desc, gid limit 100"""


def tool_paper_text(spark, d):
    s = store(spark, d)
    gid = s.sections.agg(F.min("gid")).first()[0]
    t = Tool.paper_text(s, gid if gid is not None else -1)
    return t.select("gid", "pos", F.length("kept").alias("chars"))


TOOL_PAPER_TEXT = """with s as (select event_id as gid, doc_id as pos, text from documents where event_id = (select min(event_id) from documents)), u as (select *, coalesce(sum(length(text)) over (order by pos rows between unbounded preceding and 1 preceding), 0) as used from s)
select gid, pos, least(length(text), 12000 - used)::bigint as chars from u where used < 12000"""


def tool_similar(spark, d):
    return Tool.similar_papers(store(spark, d), 1, 10).select("gid", F.round("sim", 6).alias("sim"), "rank")


TOOL_SIMILAR = "select b.vec_id as gid, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim, row_number() over (order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id)::int as rank from embeddings a, embeddings b where a.vec_id = 1 and b.vec_id <> 1 order by rank limit 10"


def tool_verify_quote(spark, d):
    """The opening of every abstract verified as a quote of its paper, in one pass."""
    from papyrine.operators import verification as Ver

    s = store(spark, d)
    p = s.papers.where("abstract is not null").join(s.facts, "gid", "left")
    quote = F.substring_index("abstract", " ", 8)
    role = Ver.quote_role(quote, [("limitation", F.col("limitation")), ("claim", F.col("claim")), ("abstract", F.col("abstract"))])
    return p.select(role.alias("role")).groupBy("role").agg(F.count("*").alias("n"))


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TOOL_VERIFY_QUOTE = f"""with {_P}, {_F}, q as (select {_N.format("array_to_string(string_split(abstract, ' ')[1:8], ' ')")} as q, {_N.format('facts.limitation')} as l, {_N.format('facts.key_change')} as c, {_N.format('abstract')} as a from p left join f using (event_id) where abstract is not null)
select case when length(q) < 20 then null when contains(' ' || l || ' ', ' ' || q || ' ') then 'limitation' when contains(' ' || c || ' ', ' ' || q || ' ') then 'claim' when contains(' ' || a || ' ', ' ' || q || ' ') then 'abstract' end as role, count(*) as n from q group by 1"""


def export_bibtex(spark, d):
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")
    return files.bibtex(p).select("event_id", "cite_key", F.length("entry").alias("chars"))


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\textbackslash ')"
    for sign in "&%$#_{}":
        c = f"replace({c}, '{sign}', '\\{sign}')"
    return c


_LAST = "case when contains(authors[1], ',') then split_part(authors[1], ',', 1) else string_split_regex(trim(authors[1]), '\\s+')[-1] end"
_PLAINED = f"regexp_replace(translate(lower({_LAST}), '{X._ACCENTS[0]}', '{X._ACCENTS[1]}'), '[^a-z0-9]+', '', 'g')"
EXPORT_BIBTEX = f"""with {_P}, n as (select *, coalesce({_PLAINED}, 'anon') || year || coalesce(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3)[1], '') as nat from p where length(title) > 0),
k as (select *, nat || repeat('a', (row_number() over (partition by nat order by event_id) - 1)::int) as cite_key from n)
select event_id, cite_key, length('@inproceedings{{' || cite_key || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_escaped("trim(regexp_replace(title, '\\s+', ' ', 'g'))")} || '}}', '  author = {{' || array_to_string(list_transform(authors, lambda a: {_escaped('a')}), ' and ') || '}}', '  booktitle = {{' || venue || '}}', '  year = {{' || year || '}}', '  url = {{' || paper_url || '}}') || chr(10) || '}}') as chars from k"""


def export_csv(spark, d):
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at").select("event_id", "venue", "year", "title", "authors", "institutions")
    return files.flat_rows(p)


EXPORT_CSV = f"with {_P} select event_id, venue, year, title, array_to_string(authors, '; ') as authors, array_to_string(institutions, '; ') as institutions from p"


def table_status(spark, d):
    """Rows and newest arrival of the tables that are fed."""
    out = None
    for name, when in (("papers", "ingested_at"), ("documents", "ingested_at"), ("arxiv_index", "harvested_at"), ("facts_abstract", "extracted_at")):
        one = table(spark, d, name).agg(F.count("*").alias("n"), F.date_format(F.max(when), "yyyy-MM-dd").alias("newest")).select(F.lit(name).alias("name"), "n", "newest")
        out = one if out is None else out.unionByName(one)
    return out


TABLE_STATUS = " union all ".join(f"select '{n}' as name, count(*) as n, strftime(max({w}), '%Y-%m-%d') as newest from {n}" for n, w in (("papers", "ingested_at"), ("documents", "ingested_at"), ("arxiv_index", "harvested_at"), ("facts_abstract", "extracted_at")))

QUERIES = [
    ("tool_topics", tool_topics, TOOL_TOPICS),
    ("tool_topic_papers", tool_topic_papers, TOOL_TOPIC_PAPERS),
    ("tool_search", tool_search, TOOL_SEARCH),
    ("tool_search_index", tool_search_index, TOOL_SEARCH_INDEX),
    ("tool_get_paper", tool_get_paper, TOOL_GET_PAPER),
    ("tool_blue_ocean", tool_blue_ocean, TOOL_BLUE_OCEAN),
    ("tool_paper_resources", tool_paper_resources, TOOL_PAPER_RESOURCES),
    ("tool_gap_scan", tool_gap_scan, TOOL_GAP_SCAN),
    ("tool_field_trend", tool_field_trend, TOOL_FIELD_TREND),
    ("tool_field_cards", tool_field_cards, TOOL_FIELD_CARDS),
    ("tool_citations", tool_citations, TOOL_CITATIONS),
    ("tool_benchmark", tool_benchmark, TOOL_BENCHMARK),
    ("tool_paper_text", tool_paper_text, TOOL_PAPER_TEXT),
    ("tool_similar", tool_similar, TOOL_SIMILAR),
    ("tool_verify_quote", tool_verify_quote, TOOL_VERIFY_QUOTE),
    ("export_bibtex", export_bibtex, EXPORT_BIBTEX),
    ("export_csv", export_csv, EXPORT_CSV),
    ("table_status", table_status, TABLE_STATUS),
]
