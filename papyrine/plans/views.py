"""Views: facet filters, what changed, registries, citations, exports, conversations.

The tables hold no conversations, references, links or ledgers: those are laid out from the papers, one each, and read whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import records as Rec
from papyrine.operators import selection as S
from papyrine.operators import trends as T
from papyrine.operators import views as V
from papyrine.operators import vocabulary as Voc
from papyrine.session import cut, table

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers where event_id is not null) where rn = 1)"
_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"
_M = "m as (select distinct event_id as doc, lower(trim(name)) as name from (select event_id, unnest(facts.methods).name as name from f) where trim(name) <> '')"
_PAR = "par as (select a.name as label, arg_max(b.name, (length(b.name), b.name)) as parent from (select distinct name from m) a join (select distinct name from m) b on starts_with(a.name, b.name || ' ') or ends_with(a.name, ' ' || b.name) group by 1)"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def _facts(spark, d):
    return Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", "facts")


def _methods(spark, d):
    m = _facts(spark, d).select(F.col("event_id").alias("doc"), F.explode("facts.methods.name").alias("name"))
    return m.select("doc", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()


def _parents(methods):
    v = methods.select(F.col("name").alias("label")).distinct()
    return Voc.find_parents(v, v)


# --- facet filters ---------------------------------------------------------------------------


def filter_method(spark, d):
    """Documents of every method that has children, its direct children's included."""
    m = cut(_methods(spark, d))
    p = _parents(m)
    both = m.join(p.withColumnRenamed("label", "name"), "name").select("doc", F.col("parent").alias("method"))
    own = m.join(p.select(F.col("parent").alias("name")).distinct(), "name").select("doc", F.col("name").alias("method"))
    return both.union(own).distinct().groupBy("method").agg(F.count("*").alias("n"))


FILTER_METHOD = f"with {_F}, {_M}, {_PAR} select method, count(distinct doc) as n from (select doc, parent as method from m join par on par.label = m.name union all select doc, name from m where name in (select parent from par)) group by 1"


def filter_one_method(spark, d):
    """Documents that use one method, the most frequent with children, or a direct child of it."""
    m = cut(_methods(spark, d))
    p = _parents(m)
    first = p.groupBy("parent").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "parent").limit(1).collect()
    return V.with_children(m, p, first[0].parent if first else "")


FILTER_ONE_METHOD = f"with {_F}, {_M}, {_PAR}, o as (select parent from par group by 1 order by count(*) desc, parent limit 1) select distinct doc from m where name in (select parent from o) or name in (select label from par where parent in (select parent from o))"


def filter_failure(spark, d):
    """Documents one of whose failure terms contains 'nois'."""
    f = _facts(spark, d).where("facts.limitation is not null")
    return V.stating(f.select(F.col("event_id").alias("doc"), F.explode(X.failure_terms(F.col("facts.limitation"))).alias("term")), "nois")


_FSTOP = "[" + ", ".join(f"'{w}'" for w in X.FAILURE_STOP) + "]"
FILTER_FAILURE = f"""with {_F}, w as (select event_id as doc, list_filter(regexp_extract_all(lower(facts.limitation), '[a-z][a-z\\-]{{2,}}'), lambda t: not list_contains({_FSTOP}, t)) as w from f where facts.limitation is not null),
t as (select doc, unnest(list_concat(list_filter(w, lambda t: length(t) >= 5), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w) select distinct doc from t where contains(term, 'nois')"""


def filter_cites(spark, d):
    """Entries that list the entry listed most often."""
    e = _papers(spark, d).select(F.col("event_id").alias("citing"), F.explode("duplicate_event_ids").alias("cited")).where("citing <> cited")
    first = e.groupBy("cited").agg(F.count_distinct("citing").alias("n")).orderBy(F.col("n").desc(), "cited").limit(1).collect()
    return V.citing(e, first[0].cited if first else -1)


FILTER_CITES = f"with {_P}, e as (select event_id as citing, unnest(duplicate_event_ids) as cited from p), o as (select cited from e where citing <> cited group by 1 order by count(distinct citing) desc, cited limit 1) select distinct citing as doc from e where citing <> cited and cited in (select cited from o)"


def filter_word(spark, d):
    """Documents with an index word that begins with 'kern', or whose title, authors or area contain it."""
    p = _papers(spark, d)
    posts = S.term_index(p.where("abstract is not null").select("event_id", "abstract"), "event_id", "abstract").select("doc", "term")
    return V.with_word(posts, p.select(F.col("event_id").alias("doc"), F.concat_ws(" ", "title", F.array_join("authors", " "), "area").alias("text")), "kern")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.SEARCH_STOP) + "]"
FILTER_WORD = f"""with {_P}, a as (select event_id as doc, regexp_extract_all(lower(abstract), '[a-z][a-z0-9\\-]{{2,}}') as w from p where abstract is not null),
t as (select distinct doc, unnest(list_concat(list_filter(w, lambda x: not list_contains({_STOP}, x)), list_transform(list_filter(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]), lambda x: not list_has_any(x, {_STOP})), lambda x: x[1] || ' ' || x[2]))) as term from a),
k as (select term from t group by 1 having case when contains(term, ' ') then count(*) >= 5 else count(*) >= 2 end and count(*) < 0.15 * (select count(*) from a))
select doc from t join k using (term) where starts_with(term, 'kern') union select event_id from p where contains(lower(concat_ws(' ', title, array_to_string(authors, ' '), area)), 'kern')"""


def filter_datasets(spark, d):
    """Dataset mentions without those that the reference list has as methods."""
    m = _facts(spark, d).select("event_id", F.explode("facts.datasets.name").alias("name")).where("name is not null")
    denied = table(spark, d, "term_reference").where("kind = 'method'").select(X.dataset_key(F.col("name")).alias("key")).distinct()
    return V.without_denied(V.visible(m), "name", denied).groupBy("name").agg(F.count("*").alias("n"))


_DK = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '^(the|a)\\s+', ''), '\\s+(benchmark|dataset|corpus|suite)s?$', ''), '[^a-z0-9+]', '', 'g')"
FILTER_DATASETS = f"with {_F}, x as (select unnest(facts.datasets).name as name from f) select name, count(*) as n from x where name is not null and {_DK.format('name')} not in (select {_DK.format('name')} from term_reference where kind = 'method') group by 1"


# --- what changed ----------------------------------------------------------------------------


def _items(spark, d):
    """(venue, side, doc, axis, item, shown) of the editions 2025 and 2026."""
    p = cut(_papers(spark, d).where("year in (2025, 2026)").select("venue", (F.col("year") - 2025).cast("int").alias("side"), F.col("event_id").alias("doc"), F.lower("subarea").alias("topic")))
    f = _facts(spark, d).withColumnRenamed("event_id", "doc")
    topics = p.where("topic is not null").select("venue", "side", "doc", F.lit("topic").alias("axis"), F.col("topic").alias("item"), F.col("topic").alias("shown"))
    names = lambda c: f.select("doc", F.explode(f"facts.{c}.name").alias("shown")).where("trim(shown) <> ''")
    tasks = names("tasks").select("doc", F.lit("task").alias("axis"), F.lower(F.trim("shown")).alias("item"), "shown").join(topics.select("item").distinct(), "item", "left_anti")
    m = cut(_methods(spark, d))
    methods = V.rolled_up(m.withColumnRenamed("name", "item"), _parents(m)).select("doc", F.lit("method").alias("axis"), "item", F.col("item").alias("shown"))
    data = names("datasets").select("doc", F.lit("dataset").alias("axis"), F.regexp_replace(F.lower("shown"), "[^a-z0-9]", "").alias("item"), "shown").where("item <> ''")
    rest = tasks.select("doc", "axis", "item", "shown").union(methods).union(data).join(p.drop("topic"), "doc").select("venue", "side", "doc", "axis", "item", "shown")
    totals = p.groupBy("venue").agg(F.count(F.when(F.col("side") == 0, 1)).alias("t0"), F.count(F.when(F.col("side") == 1, 1)).alias("t1"))
    return topics.union(rest), totals


_ITEMS = f"""with {_P}, {_F}, {_M}, {_PAR}, e as (select venue, year - 2025 as side, event_id as doc, lower(subarea) as topic from p where year in (2025, 2026)),
tot as (select venue, count(*) filter (side = 0) as t0, count(*) filter (side = 1) as t1 from e group by 1),
ti as (select doc, 'topic' as axis, topic as item, topic as shown from e where topic is not null),
si as (select event_id as doc, 'task' as axis, lower(trim(name)) as item, name as shown from (select event_id, unnest(facts.tasks).name as name from f) where trim(name) <> '' and lower(trim(name)) not in (select item from ti)),
mi as (select doc, 'method' as axis, coalesce(parent, name) as item, coalesce(parent, name) as shown from m left join par on par.label = m.name),
di as (select event_id as doc, 'dataset' as axis, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as item, name as shown from (select event_id, unnest(facts.datasets).name as name from f) where trim(name) <> '' and regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> ''),
i as (select distinct venue, side, doc, axis, item, shown from (select * from ti union all select * from si union all select * from mi union all select * from di) join e using (doc)),
sh as (select venue, axis, item, arg_min(shown, (-c, shown)) as shown from (select venue, axis, item, shown, count(distinct doc) as c from i group by 1, 2, 3, 4) group by 1, 2, 3),
n as (select venue, axis, item, count(distinct doc) filter (side = 0) as n0, count(distinct doc) filter (side = 1) as n1 from i group by 1, 2, 3),
ch as (select venue, axis, item, shown, n0, n1, 1000.0 * n0 / greatest(t0, 1) as share0, 1000.0 * n1 / greatest(t1, 1) as share1 from n join tot using (venue) join sh using (venue, axis, item) where n0 + n1 >= case axis when 'topic' then 12 when 'task' then 8 when 'method' then 12 else 8 end)"""


def changed_rows(spark, d):
    """Topics, tasks, methods and datasets of 2025 beside 2026, per venue."""
    items, totals = _items(spark, d)
    return V.changed_rows(items, totals).withColumn("share0", F.round("share0", 6)).withColumn("share1", F.round("share1", 6))


CHANGED_ROWS = _ITEMS + " select venue, axis, item, shown, n0, n1, round(share0, 6) as share0, round(share1, 6) as share1 from ch"


def pooled_movers(spark, d):
    """Methods that moved over all venues taken together."""
    items, totals = _items(spark, d)
    m = V.pooled_movers(V.changed_rows(items, totals, dict.fromkeys(V.LEAST, 2)), totals, "method", bar=1.0)
    return m.select("rank", "item", "n0", "n1", *[F.round(c, 6).alias(c) for c in ("share0", "share1", "z")], "tag")


POOLED_MOVERS = _ITEMS + """, c2 as (select venue, item, n0, n1 from n where axis = 'method' and n0 + n1 >= 2), g as (select item, sum(n0)::bigint as n0, sum(n1)::bigint as n1 from c2 group by 1), tt as (select sum(t0) as t0, sum(t1) as t1 from tot),
z as (select item, n0, n1, 1000.0 * n0 / greatest(t0, 1) as share0, 1000.0 * n1 / greatest(t1, 1) as share1, (n0 + n1)::double / (t0 + t1) as q, t0, t1 from g, tt),
y as (select *, case when q * (1 - q) * (1.0 / t0 + 1.0 / t1) > 1e-12 then (n1::double / t1 - n0::double / t0) / sqrt(q * (1 - q) * (1.0 / t0 + 1.0 / t1)) else 0 end as z from z),
k as (select * from y where greatest(share0, share1) >= 3 and abs(z) >= 1 and abs(share1 - share0) >= 2 or (greatest(share0, share1) >= 3 and abs(z) >= 1 and (least(share0, share1) = 0 or greatest(share0, share1) >= 1.5 * least(share0, share1))))
select row_number() over (order by abs(z) desc, item)::int as rank, item, n0, n1, round(share0, 6) as share0, round(share1, 6) as share1, round(z, 6) as z, case when n0 <= 2 and n1 > 2 then 'new' when n1 <= 2 and n0 > 2 then 'gone' else '' end as tag from k order by abs(z) desc, item limit 8"""


def _areas(spark, d):
    """(topic, item, doc, side, oral, title): methods inside the areas of the two editions."""
    p = _papers(spark, d).where("year in (2025, 2026) and area is not null")
    p = p.select("event_id", F.col("area").alias("topic"), (F.col("year") - 2025).cast("int").alias("side"), F.coalesce("is_oral", F.lit(False)).alias("oral"), "title")
    return p, p.join(_methods(spark, d).withColumnRenamed("doc", "event_id"), "event_id").select("topic", F.col("name").alias("item"), F.col("event_id").alias("doc"), "side")


def shift_evidence(spark, d):
    """Papers of 2026 that carry the leading shift of methods inside each area."""
    p, i = _areas(spark, d)
    totals = p.groupBy("topic").agg(F.count(F.when(F.col("side") == 0, 1)).alias("t0"), F.count(F.when(F.col("side") == 1, 1)).alias("t1")).where("t0 >= 20 and t1 >= 20")
    n = i.groupBy("topic", "item").agg(F.count_distinct(F.when(F.col("side") == 0, F.col("doc"))).alias("n0"), F.count_distinct(F.when(F.col("side") == 1, F.col("doc"))).alias("n1")).join(totals, "topic")
    lead = T.inside_shifts(n, "topic", "item", 4, 10.0, 1.2, bar=1.0)
    return V.carriers(lead, i.where("side = 1"), p.select(F.col("event_id").alias("doc"), "oral", "title"), "topic", "item", "doc")


SHIFT_EVIDENCE = f"""with {_P}, {_F}, {_M}, e as (select event_id as doc, area as topic, year - 2025 as side, coalesce(is_oral, false) as oral, title from p where year in (2025, 2026) and area is not null),
tot as (select topic, count(*) filter (side = 0) as t0, count(*) filter (side = 1) as t1 from e group by 1 having count(*) filter (side = 0) >= 20 and count(*) filter (side = 1) >= 20),
n as (select topic, name as item, count(distinct doc) filter (side = 0) as n0, count(distinct doc) filter (side = 1) as n1 from e join m using (doc) group by 1, 2 having count(distinct doc) >= 4),
q as (select *, (n0 + n1)::double / (t0 + t1) as q from n join tot using (topic)), z as (select *, case when q * (1 - q) * (1.0 / t0 + 1.0 / t1) > 1e-12 then (n1::double / t1 - n0::double / t0) / sqrt(q * (1 - q) * (1.0 / t0 + 1.0 / t1)) else 0 end as z0, 1000.0 * n0 / t0 as s0, 1000.0 * n1 / t1 as s1 from q),
k as (select *, case when n0 <= 1 and n1 >= 8 then 3.0 when n1 <= 1 and n0 >= 8 then -3.0 when abs(z0) >= 1.0 and (abs(s1 - s0) >= 10 or (least(s0, s1) > 0 and greatest(s0, s1) >= 1.2 * least(s0, s1))) then z0 end as z from z),
l as (select topic, item from (select *, row_number() over (partition by topic order by abs(z) desc, item) as r from k where z is not null) where r = 1)
select topic, item, place::int as place, doc from (select l.topic, l.item, doc, row_number() over (partition by l.topic order by oral desc, title, doc) as place from l join e on e.topic = l.topic and side = 1 join m using (doc) where m.name = l.item) where place <= 4"""


def set_card_rolled(spark, d):
    """Leading methods, rolled up to their parents, and datasets of a selection."""
    p = _papers(spark, d)
    sel = p.where("area in ('Optimization', 'Theory')").select(F.col("event_id").alias("doc"), "venue", "year")
    m = cut(_methods(spark, d))
    uses = V.rolled_up(m.withColumnRenamed("name", "item"), _parents(m)).select("doc", F.lit("method").alias("axis"), "item")
    data = _facts(spark, d).select(F.col("event_id").alias("doc"), F.lit("dataset").alias("axis"), F.explode("facts.datasets.name").alias("item")).where("item is not null")
    return V.set_card(sel, p.groupBy("venue", "year").agg(F.count("*").alias("total")), uses.union(data))[1]


SET_CARD_ROLLED = f"""with {_P}, {_F}, {_M}, {_PAR}, s as (select event_id as doc from p where area in ('Optimization', 'Theory')),
u as (select doc, 'method' as axis, coalesce(parent, name) as item from m left join par on par.label = m.name union all select event_id, 'dataset', name from (select event_id, unnest(facts.datasets).name as name from f) where name is not null),
c as (select axis, item, count(distinct doc) as n from u where doc in (select doc from s) group by 1, 2 having count(distinct doc) >= 2)
select axis, rank::int as rank, item, n from (select *, row_number() over (partition by axis order by n desc, item) as rank from c) where rank <= 4"""


# --- registries ------------------------------------------------------------------------------

_HOSTS = "case event_id % 4 when 0 then 'gh' when 1 then 'hfd' when 2 then 'hfm' else 'page' end"
_KINDS = "case event_id % 4 when 0 then 'code' when 1 then 'data' when 2 then 'model' else 'page' end"


def _links(spark, d):
    """One link per paper with an address: own where there is a submission id."""
    return _papers(spark, d).where("event_id is not null and paper_url is not null").select(
        F.col("event_id").alias("doc"), F.expr(_HOSTS).alias("host"), F.expr(_KINDS).alias("kind"), F.concat(F.lit("lab/"), F.pmod("event_id", F.lit(50)).cast("string")).alias("repo"), F.col("openreview_id").isNotNull().alias("own"), F.col("paper_url").alias("url")
    )


def _metadata(spark, d):
    p = _papers(spark, d).where("event_id between 0 and 49")
    return p.select(F.lit("gh").alias("host"), F.concat(F.lit("lab/"), F.col("event_id").cast("string")).alias("repo"), F.col("n_authors").alias("stars"), F.col("decision").isNull().alias("gone"), F.lit("2026-09-01").alias("at"))


def resource_coverage(spark, d):
    read = table(spark, d, "documents").where("event_id is not null").select(F.col("event_id").alias("doc"))
    return V.resource_coverage(_papers(spark, d).select(F.col("event_id").alias("doc"), "venue", "year"), read, _links(spark, d))


_LINKS = f"l as (select event_id as doc, {_HOSTS} as host, {_KINDS} as kind, 'lab/' || (event_id % 50) as repo, openreview_id is not null as own, paper_url as url from p where paper_url is not null)"
RESOURCE_COVERAGE = f"""with {_P}, {_LINKS}, r as (select distinct event_id as doc from documents where event_id is not null), o as (select doc, bool_or(kind = 'code') as code, bool_or(kind = 'data') as data, bool_or(kind = 'model') as model, bool_or(kind = 'page') as page from l where own group by 1)
select venue, year, count(*) as papers, count(r.doc) as fulltext, count(*) filter (r.doc is not null and code) as code, count(*) filter (r.doc is not null and data) as data, count(*) filter (r.doc is not null and model) as model, count(*) filter (r.doc is not null and page) as page
from p left join r on r.doc = event_id left join o on o.doc = event_id group by 1, 2"""


def link_metadata(spark, d):
    """Links with the public fields of their repository."""
    m = V.link_metadata(_links(spark, d), V.public_fields(_metadata(spark, d)))
    return m.select("doc", "host", "repo", "status", "stars", "checked")


LINK_METADATA = f"with {_P}, {_LINKS}, m as (select 'gh' as host, 'lab/' || event_id as repo, n_authors as stars, decision is null as gone from p where event_id between 0 and 49) select doc, l.host, l.repo, case when gone then 'not found' end as status, case when not gone then stars end as stars, case when m.repo is not null then '2026-09-01' end as checked from l left join m using (host, repo)"


def link_worklist(spark, d):
    return V.worklist(_links(spark, d), _metadata(spark, d))


LINK_WORKLIST = f"with {_P}, {_LINKS} select distinct host, repo from l where host in ('gh', 'hfd', 'hfm') and not (host = 'gh' and repo in (select 'lab/' || event_id from p where event_id between 0 and 49))"


def external_ids(spark, d):
    """Ids of every resolved paper; every third has a DOI of its own."""
    r = table(spark, d, "resolved").where("event_id is not null").groupBy("event_id").agg(F.min("arxiv_base").alias("arxiv_base"))
    base = table(spark, d, "arxiv_index").select(F.col("arxiv_base").alias("id")).where("id is not null").distinct()
    found = base.where(F.col("id").rlike("[369]$")).select("id", F.concat(F.lit("10.1000/"), "id").alias("doi"), F.concat(F.lit("s"), "id").alias("s2"))
    return V.external_ids(r, "arxiv_base", found)


EXTERNAL_IDS = """with r as (select event_id, min(arxiv_base) as arxiv_base from resolved where event_id is not null group by 1), i as (select distinct arxiv_base as id from arxiv_index where regexp_matches(arxiv_base, '[369]$'))
select event_id, arxiv_base, coalesce('10.1000/' || id, '10.48550/arXiv.' || arxiv_base) as doi, 's' || id as s2 from r left join i on id = arxiv_base where arxiv_base is not null"""


def topic_methods(spark, d):
    """Tasks that are methods too, by their canonical key."""
    f = _facts(spark, d)
    t = f.select(F.explode("facts.tasks.name").alias("topic")).where("topic is not null").distinct()
    m = f.select(F.explode("facts.methods.name").alias("method")).where("method is not null").union(t.select(F.concat(F.col("topic"), F.lit(" task")))).distinct()
    return V.topics_named_as_methods(t, m)


_BASIC = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[\\s.,;:]+$', ''), '[\\s\\-_/]+', ' ', 'g'))"
_C1 = f"trim(regexp_replace(regexp_replace({_BASIC}, '\\b(tasks?|problems?|applications?)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_CANON = f"case when length({_C1}) > 3 and not regexp_matches({_C1}, '(ics|ss|us|is|as)$') then regexp_replace({_C1}, '([a-z])s$', '\\1') else {_C1} end"
TOPIC_METHODS = f"""with {_F}, t as (select distinct name as topic from (select unnest(facts.tasks).name as name from f) where name is not null), m as (select name as method from (select unnest(facts.methods).name as name from f) where name is not null union select topic || ' task' from t)
select topic, min(method) as method from (select topic, {_CANON.format('topic')} as k from t) join (select method, {_CANON.format('method')} as k from m) using (k) group by topic"""


# --- citations -------------------------------------------------------------------------------


def _references(spark, d):
    """A reference and a citing sentence for each paper: (doc, reference, sentence, cite)."""
    p = _papers(spark, d).where("event_id is not null and size(authors) > 0 and title is not null")
    name = F.concat(F.regexp_replace(F.element_at(F.split(F.element_at("authors", 1), r"[ ,]+"), 1), r"[^\p{L}]", ""), F.lit(" and Others"))
    year = F.col("year").cast("string")
    return p.where(F.length(name) > 13).select(
        F.col("event_id").alias("doc"), F.concat(name, F.lit(" ("), year, F.lit(") "), "title", F.lit(". arXiv:2401."), F.lpad(F.pmod("event_id", F.lit(100000)).cast("string"), 5, "0")).alias("reference"),
        F.concat(F.lit("As shown by "), F.replace(name, F.lit(" and "), F.lit("  & ")), F.lit(" ( "), year, F.lit("), the rate holds; see "), name, F.lit(", "), year, F.lit("b.")).alias("sentence"),
        F.concat(name, F.lit(" ("), year, F.lit(")")).alias("cite"), "title",
    )


def citation_marks(spark, d):
    """Sentences that hold the mark of a reference, blanks and 'and' written otherwise."""
    r = _references(spark, d)
    other = r.select("doc", F.replace("sentence", F.lit("As shown"), F.lit("Not shown")).alias("sentence")).withColumn("sentence", F.regexp_replace("sentence", r"\d{4}", "1999"))
    return V.cited_sentences(r.select("doc", "sentence").union(other), r.select("doc", "reference"), "doc", "sentence", "reference").select("doc", "sentence")


_NAME = "regexp_replace(string_split_regex(authors[1], '[ ,]+')[1], '[^\\p{L}]', '', 'g')"
_REF = f"rf as (select event_id as doc, {_NAME} || ' and Others' as name, year, title from p where len(authors) > 0 and title is not null)"
CITATION_MARKS = f"with {_P}, {_REF} select doc, 'As shown by ' || replace(name, ' and ', '  & ') || ' ( ' || year || '), the rate holds; see ' || name || ', ' || year || 'b.' as sentence from rf where length(name) > 13"


def governing_refs(spark, d):
    """What every 'Name and Others (year)' stands for, found by surname and year, then by title or preprint number."""
    r = cut(_references(spark, d))
    titles = r.where("doc % 2 = 0").groupBy("title").agg(F.min("doc").alias("target"))
    g = V.governing_reference(r.select("doc", "cite"), r.select("doc", "reference"), "doc", "cite", "reference", titles)
    return g.groupBy(F.col("target").rlike(r"^2401\.").alias("by_number")).agg(F.count("*").alias("n"), F.count("target").alias("found"))


_NR = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"
GOVERNING_REFS = f"""with {_P}, {_REF}, r as (select doc, title, name || ' (' || year || ') ' || title || '. arXiv:2401.' || lpad((doc % 100000)::varchar, 5, '0') as ref from rf where length(name) > 13), t as (select title, min(doc) as target from r where doc % 2 = 0 group by 1),
b as (select ref, arg_max(target, (length(t.title), target))::varchar as target from (select distinct ref from r) r join t on contains({_NR.format('ref')}, {_NR.format('t.title')}) where length({_NR.format('t.title')}) >= 27 group by 1),
g as (select coalesce(target, '2401.' || lpad((doc % 100000)::varchar, 5, '0')) as target from r left join b using (ref)) select regexp_matches(target, '^2401[.]') as by_number, count(*) as n, count(target) as found from g group by 1"""


# --- texts and facts -------------------------------------------------------------------------

#: Abbreviations and acronyms as a site would pass them.
_SHORT, _CASED = [("entity linking", "EL"), ("machine translation", "MT")], {"qa": "QA", "ocr": "OCR"}


def shown_labels(spark, d):
    """Tasks as they are displayed, and accents put behind their letters."""
    t = _facts(spark, d).select(F.explode("facts.tasks.name").alias("name")).where("name is not null").distinct()
    return t.select("name", V.display(F.col("name"), _SHORT, _CASED).alias("shown"), V.compose_accents(F.concat(F.lit("``"), "name", F.lit("'' ˆV"))).alias("composed"), V.title_head(F.concat(F.col("name"), F.lit(": more"))).alias("head"))


SHOWN_LABELS = f"""with {_F}, t as (select distinct name from (select unnest(facts.tasks).name as name from f) where name is not null), a as (select name, regexp_replace(regexp_replace(name, 'entity linking', 'EL', 'gi'), 'machine translation', 'MT', 'gi') as s from t),
b as (select name, array_to_string(list_transform(string_split(s, ' '), lambda w: case lower(w) when 'qa' then 'QA' when 'ocr' then 'OCR' else w end), ' ') as s from a)
select name, upper(s[1]) || s[2:] as shown, '“' || name || '” V̂' as composed, lower(trim(regexp_split_to_array(name || ': more', '[:：]')[1])) as head from b"""


def finalized_facts(spark, d):
    """Spans of every extraction checked against the abstract they come from."""
    f = _facts(spark, d).select("event_id", "facts.*").join(_papers(spark, d).where("abstract is not null").select("event_id", "abstract"), "event_id")
    v = V.finalize(f, "abstract")
    return v.select("event_id", "kept", "dropped", "inconsistent", F.size("novelty_spans").alias("spans"), "limitation", "key_change", "result_claim")




def _held(c: str) -> str:
    """SQL of whether the abstract holds a span."""
    joined = lambda x: f"regexp_replace({x}, '([A-Za-z0-9_])-\\s+([A-Za-z0-9_])', '\\1\\2', 'g')"
    plain = lambda x: f"lower(trim(regexp_replace({joined(x)}, '\\s+', ' ', 'g')))"
    bare = lambda x: f"lower(trim(regexp_replace(regexp_replace({joined(x)}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')))"
    return f"coalesce(length({plain(c)}) >= 25 and (contains({plain('abstract')}, {plain(c)}) or contains({bare('abstract')}, {bare(c)})), false)"


FINALIZED_FACTS = f"""with {_P}, {_F}, j as (select event_id, facts, abstract from f join p using (event_id) where abstract is not null),
u as (select event_id, unnest(facts.novelty_spans) as s, abstract from j), su as (select event_id, count(*) filter ({_held('s')}) as good, count(*) as n from u group by 1),
k as (select event_id, facts, coalesce(good, 0) as good, coalesce(n, 0) as n, {', '.join(f"trim(coalesce(facts.{c}, '')) <> '' as g_{c}, trim(coalesce(facts.{c}, '')) <> '' and {_held(f'facts.{c}')} as k_{c}" for c in ('limitation', 'key_change', 'result_claim'))} from j left join su using (event_id))
select event_id, (good + k_limitation::int + k_key_change::int + k_result_claim::int)::int as kept, (n - good + (g_limitation and not k_limitation)::int + (g_key_change and not k_key_change)::int + (g_result_claim and not k_result_claim)::int)::int as dropped,
coalesce(facts.contribution_type = 'unknown' and len(list_filter(facts.methods, lambda x: x.role = 'proposed')) > 0, false) as inconsistent, good::int as spans,
case when k_limitation then trim(facts.limitation) end as limitation, case when k_key_change then trim(facts.key_change) end as key_change, case when k_result_claim then trim(facts.result_claim) end as result_claim from k"""


def semantic_extras(spark, d):
    """Papers close in meaning to what the words 'graph' and 'noisy' find best."""
    p = _papers(spark, d).where("abstract is not null").select("event_id", "abstract")
    posts = S.term_index(p, "event_id", "abstract").where(F.startswith("term", F.lit("graph")) | F.startswith("term", F.lit("noisy")))
    n = p.agg(F.count("*").alias("n"))
    hits = posts.crossJoin(F.broadcast(n)).groupBy("doc").agg(F.round(F.sum(F.log(1 + F.col("n") / F.col("df"))), 9).alias("score"))
    return V.semantic_extras(hits, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding"), "doc", "embedding")


SEMANTIC_EXTRAS = FILTER_WORD.split("select doc from t join k")[0].replace("k as (select term from t", "k as (select term, count(*) as df from t") + """, h as (select doc, round(sum(ln(1 + (select count(*) from a)::double / df)), 9) as score from t join k using (term) where starts_with(term, 'graph') or starts_with(term, 'noisy') group by 1),
sd as (select doc from h join embeddings on vec_id = doc order by score desc, doc limit 40), c0 as (select i, sum(embedding[i]::double) as x from embeddings, range(1, 65) r(i) where vec_id in (select doc from sd) group by 1),
dt as (select vec_id as doc, round(sum(embedding[i]::double * x) / (select sqrt(sum(x * x)) from c0), 9) as sim from embeddings, c0 group by 1),
br as (select list(sim order by sim desc)[floor(count(*) * 0.6)::int + 1] as bar from dt where doc in (select doc from sd) having count(*) >= 3)
select doc, sim from dt, br where doc not in (select doc from h) and sim >= bar order by sim desc, doc limit 60"""


# --- exports, conversations, spending, grading -----------------------------------------------


def export_rows(spark, d):
    p = _papers(spark, d).select(F.col("event_id").alias("gid"), "venue", "year", "title", "authors", F.coalesce("virtual_url", "paper_url").alias("url"))
    f = _facts(spark, d)
    role = lambda r: F.transform(F.filter("facts.methods", lambda m: m["role"] == r), lambda m: m["name"])
    cards = f.select(
        F.col("event_id").alias("gid"), "facts.limitation", "facts.key_change", F.col("facts.novelty_spans").alias("novelty"), "facts.result_claim",
        role("proposed").alias("proposes"), role("building-block").alias("builds_on"), F.col("facts.tasks.name").alias("tasks"), F.col("facts.datasets.name").alias("data"),
    )
    ids = V.external_ids(table(spark, d, "resolved").where("event_id is not null").groupBy(F.col("event_id").alias("gid")).agg(F.min("arxiv_base").alias("arxiv_base")))
    data = f.select(F.col("event_id").alias("gid"), F.explode("facts.datasets.name").alias("name")).where("name is not null").withColumn("place", F.when(F.col("name").rlike("^[A-M]"), F.concat(F.lit("https://data.example/"), X.slug(F.col("name")))))
    return V.export_rows(p, cards, ids, _links(spark, d).withColumnRenamed("doc", "gid"), data)


_NL = "array_to_string(list_filter(list_transform({0}, lambda x: x.name), lambda x: x is not null), ', ')"
EXPORT_ROWS = f"""with {_P}, {_F}, {_LINKS}, i as (select event_id as gid, '10.48550/arXiv.' || min(arxiv_base) as doi from resolved where event_id is not null group by 1 having min(arxiv_base) is not null),
w as (select doc as gid, kind || ' ' || url as links from l where own), dd as (select distinct event_id as gid, name || ' https://data.example/' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as s from (select event_id, unnest(facts.datasets).name as name from f) where regexp_matches(name, '^[A-M]')), b as (select gid, string_agg(s, ', ' order by s) as benchmark_urls from dd group by 1)
select event_id as gid, venue, year, coalesce(title, '') as title, coalesce(array_to_string(list_filter(authors, lambda x: x is not null), ', '), '') as authors, coalesce(virtual_url, paper_url, '') as url, doi, coalesce(facts.limitation, '') as limitation, coalesce(facts.key_change, facts.novelty_spans[1], '') as key_change, coalesce(facts.result_claim, '') as result_claim,
coalesce({_NL.format("list_filter(facts.methods, lambda m: m.role = 'proposed')")}, '') as proposes, coalesce({_NL.format("list_filter(facts.methods, lambda m: m.role = 'building-block')")}, '') as builds_on, coalesce({_NL.format('facts.tasks')}, '') as tasks, coalesce({_NL.format('facts.datasets')}, '') as data, coalesce(links, '') as links, coalesce(benchmark_urls, '') as benchmark_urls
from p left join f using (event_id) left join i on i.gid = event_id left join w on w.gid = event_id left join b on b.gid = event_id"""


def corpus_stamp(spark, d):
    return V.corpus_stamp(_papers(spark, d))


CORPUS_STAMP = f"with {_P} select (select string_agg(e, ', ' order by e) from (select distinct lower(venue) || '-' || year as e from p)) as editions, count(*) as papers from p"


def _segments(spark, d):
    """A turn for each paper: prose that names it, its title cited, more prose, a sentence cited, a figure."""
    p = _papers(spark, d).where("event_id is not null and title is not null")
    seg = lambda pos, kind, text, title, ok: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), title.alias("title"), ok.alias("ok"))
    t, none, yes = F.col("title"), F.lit(None).cast("string"), F.lit(True)
    parts = F.array(
        seg(1, "p", F.concat(F.lit("First, "), F.replace(t, F.lit("."), F.lit("")), F.lit(" is named")), none, yes), seg(2, "c", t, t, F.coalesce("is_oral", F.lit(False))), seg(3, "p", F.lit(" and more! Nothing here. "), none, yes),
        seg(4, "c", F.lit("a sentence of it"), t, yes), seg(5, "n", F.col("year").cast("string"), none, F.coalesce("is_spotlight", F.lit(False))),
    )
    return p.select(F.concat_ws("-", "venue", "year").alias("conv"), F.col("event_id").alias("turn"), F.explode(parts).alias("s")).select("conv", "turn", "s.*")


_T = f"{_P}, tn as (select venue || '-' || year as conv, event_id as turn, year, title, coalesce(is_oral, false) as oral, coalesce(is_spotlight, false) as spot from p where title is not null)"


def conversation_turns(spark, d):
    return V.conversation_turns(_segments(spark, d))


CONVERSATION_TURNS = f"with {_T} select conv, turn, 'First, ' || replace(title, '.', '') || ' is named[' || title || '] and more! Nothing here. [' || title || ']' || year as answer, 2 as citations, 1 + oral::int as verified, 1 as figures, spot::int as placed from tn"


def rendered_answers(spark, d):
    return V.rendered(_segments(spark, d))


RENDERED_ANSWERS = f"""with {_T} select conv, turn, 'First, ' || replace(title, '.', '') || ' is named' || case when title <> '' then '**' || title || '**' else '\"\" — ' end || case when oral then '' else ' [UNVERIFIED]' end || ' and more! Nothing here. "a sentence of it" — ' || title || year as text from tn"""


def anchor_totals(spark, d):
    a = V.anchor_totals(_segments(spark, d))
    return a.groupBy("conv").agg(F.sum("named").alias("named"), F.sum("anchored").alias("anchored"))


ANCHOR_TOTALS = f"""with {_T}, h as (select *, lower(trim(regexp_split_to_array(title, '[:：]')[1])) as head, 'First, ' || replace(title, '.', '') || ' is named' as s from tn),
u as (select conv, turn, head, len(x) as n, unnest(x) as sentence, generate_subscripts(x, 1) as i from (select *, regexp_extract_all(s, '[^.!?\\n]+[.!?\\n]|[^.!?\\n]+$') as x from h))
select conv, sum(1)::bigint as named, sum((i = n)::int)::bigint as anchored from u where length(head) >= 13 and contains(lower(sentence), head) group by 1"""


def spending(spark, d):
    """The event stream as a ledger: the event type names the model."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model"), F.floor(F.coalesce(F.abs("value"), F.lit(0.0)) * 1000).alias("tokens_in"), F.lit(500).alias("tokens_out"))
    s = V.spending(e, [("click", 5.0, 25.0), ("view", 1.0, 5.0)], (10.0, 50.0), 50.0, 400.0)
    return s.select("day", "calls", *[F.round(c, 4).alias(c) for c in ("usd", "month_usd", "day_left", "month_left")])


SPENDING = """with e as (select strftime(ts, '%Y-%m-%d') as day, case when contains(lower(event_type), 'click') then floor(coalesce(abs(value), 0) * 1000) * 5 + 500 * 25 when contains(lower(event_type), 'view') then floor(coalesce(abs(value), 0) * 1000) * 1 + 500 * 5 else floor(coalesce(abs(value), 0) * 1000) * 10 + 500 * 50 end / 1e6 as usd from events),
g as (select day, count(*) as calls, sum(usd) as usd from e group by 1), m as (select *, sum(usd) over (partition by day[1:7] order by day) as month_usd from g)
select day, calls, round(usd, 4) as usd, round(month_usd, 4) as month_usd, round(greatest(0, 50 - usd), 4) as day_left, round(greatest(0, 400 - month_usd), 4) as month_left from m"""


def grade_summary(spark, d):
    """Matches of the earlier run graded per feed: means by kind of match, as a table of metrics."""
    r = table(spark, d, "resolved").where("event_id is not null").groupBy("event_id").agg(F.min("match").alias("type"), F.max("score").alias("score"))
    g = _papers(spark, d).join(r, "event_id").select(F.coalesce("feed", F.lit("none")).alias("system"), "type", "score", F.col("n_authors").cast("long").alias("quotes"))
    return V.metric_table(V.summary(g, "system", {"score": "score", "fuzzy_score": "fuzzy:score"}, ["quotes"]), "system")


GRADE_SUMMARY = f"""with {_P}, r as (select event_id, min(match) as type, max(score) as score from resolved where event_id is not null group by 1), g as (select coalesce(feed, 'none') as system, type, score, n_authors as quotes from p join r using (event_id)),
s as (select system, count(*)::double as n, sum(coalesce(quotes, 0))::double as quotes, round(avg(score), 3) as score, round(avg(case when type = 'fuzzy' then score end), 3) as fuzzy_score from g group by 1)
select 'n' as metric, system, n as value from s union all select 'quotes', system, quotes from s union all select 'score', system, score from s union all select 'fuzzy_score', system, fuzzy_score from s"""


def quotes_anywhere(spark, d):
    """The first document that holds the opening sentence of an abstract, whichever paper it is about."""
    q = _papers(spark, d).where("abstract is not null").select(F.col("event_id").alias("quote_id"), F.substring_index("abstract", ".", 1).alias("quote"))
    return V.quoted_anywhere(q, table(spark, d, "documents").select("doc_id", "text"), "quote", "quote_id", "doc_id", "text")


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
QUOTES_ANYWHERE = f"with {_P}, q as (select event_id as quote_id, ' ' || {_N.format("split_part(abstract, '.', 1)")} || ' ' as q from p where abstract is not null), t as (select doc_id, ' ' || {_N.format('text')} || ' ' as t from documents) select quote_id, min(doc_id) as doc_id from q join t on contains(t, q) where length(q) >= 22 group by 1"

def benchmark_places(spark, d):
    """Dataset mentions with their place in a registry made of the reference list."""
    r = table(spark, d, "term_reference").where("kind = 'dataset'").select(
        F.col("ref_id").alias("pos"), "name", F.array(F.coalesce("acronym", "name")).alias("aliases"), X.slug(F.col("name")).alias("hf"), F.concat(F.lit("lab/"), X.slug(F.col("name"))).alias("gh"),
        F.when(F.col("ref_id") % 5 != 0, F.concat(F.lit("https://x.example/"), F.col("ref_id").cast("string"))).alias("url"), (F.col("ref_id") % 3 == 0).alias("hf_ok"), (F.col("ref_id") % 2 == 0).alias("gh_ok"),
    )
    m = _facts(spark, d).select("event_id", F.explode("facts.datasets.name").alias("name")).where("name is not null")
    return V.benchmark_places(m, r)


BENCHMARK_PLACES = f"""with {_F}, r as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as s from term_reference where kind = 'dataset'), u as (select ref_id, name, s, unnest([name, coalesce(acronym, name)]) as surface from r),
k as (select {_DK.format('surface')} as k, min(ref_id) as ref_id from u where {_DK.format('surface')} <> '' group by 1), m as (select event_id, name from (select event_id, unnest(facts.datasets).name as name from f) where name is not null)
select event_id, m.name, r.name as listed, case when r.ref_id % 3 = 0 then 'https://huggingface.co/datasets/' || s when r.ref_id % 2 = 0 then 'https://github.com/lab/' || s when r.ref_id % 5 <> 0 then 'https://x.example/' || r.ref_id end as place,
case when r.ref_id % 3 = 0 then 'huggingface' when r.ref_id % 2 = 0 then 'github' when r.ref_id % 5 <> 0 then 'web' end as host from m left join k on k.k = {_DK.format('m.name')} left join r on r.ref_id = k.ref_id"""


def concept_labels(spark, d):
    """Areas labelled by their methods and tasks; areas with few names take frequent subareas."""
    p = _papers(spark, d).where("area is not null").select(F.col("event_id").alias("doc"), "area", "subarea")
    names = _facts(spark, d).select(F.col("event_id").alias("doc"), F.explode(F.concat(F.coalesce("facts.methods.name", F.array().cast("array<string>")), F.coalesce("facts.tasks.name", F.array().cast("array<string>")))).alias("term")).where("term is not null")
    sub = p.where("subarea is not null").groupBy("area", F.col("subarea").alias("term")).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    fall = sub.withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy(F.col("c").desc(), "term"))).where("rank <= 3").select("area", "rank", "term")
    return V.concept_labels(p.select("area", "doc").join(names.where("doc % 4 <> 1"), "doc"), fall, "area", "doc", "term")


CONCEPT_LABELS = f"""with {_P}, {_F}, t0 as (select event_id as doc, unnest(list_concat(coalesce(list_transform(facts.methods, lambda x: x.name), []), coalesce(list_transform(facts.tasks, lambda x: x.name), []))) as term from f),
t as (select distinct area, doc, term from t0 join (select event_id as doc, area from p where area is not null) using (doc) where term is not null and doc % 4 <> 1), c as (select area, term, count(*) as c from t group by 1, 2), tt as (select term, sum(c) as total from c group by 1), n as (select area, count(distinct doc) as n from t group by 1),
s as (select area, term, row_number() over (partition by area order by round(c::double / n * (c::double / greatest(total - c, 1)), 12) desc, c desc, term desc) as rank from c join tt using (term) join n using (area) where c >= 2),
o as (select * from s where rank <= 3), fw as (select area from n where (select count(*) from o where o.area = n.area) < 2),
fb as (select area, subarea as term, row_number() over (partition by area order by count(*) desc, subarea) + 100 as rank from p where area is not null and subarea is not null group by 1, 2),
e as (select area, term, rank from o union all select area, term, rank from fb where rank <= 103 and area in (select area from fw))
select area, rank::int as rank, term from (select area, term, row_number() over (partition by area order by rank) as rank from e) where rank <= 3"""


def group_labels(spark, d):
    """Venues as the groups of each area's selection, labelled by distinctive methods."""
    g = _papers(spark, d).where("area is not null").select("area", F.col("event_id").alias("doc"), "venue")
    return V.group_labels(g, _methods(spark, d), "area", "doc", "venue", "name").select("area", "venue", F.array_join("labels", "; ").alias("labels"))


GROUP_LABELS = f"""with recursive {_P}, {_F}, {_M}, g as (select area, event_id as doc, venue from p where area is not null), z as (select area, venue, count(distinct doc) as n from g group by 1, 2), al as (select area, sum(n) as a from z group by 1),
c as (select area, venue, name, count(distinct doc) as c from g join m using (doc) group by 1, 2, 3), tt as (select area, name, sum(c) as total from c group by 1, 2),
s as (select area, venue, name, round((c::double / n + 0.02) / ((total - c)::double / greatest(a - n, 1) + 0.02) * ln(1 + c), 9) as s from c join tt using (area, name) join z using (area, venue) join al using (area) where c >= 2),
o as (select *, row_number() over (partition by area, venue order by s desc, name) as i from s),
pick as (select distinct area, venue, 0::bigint as i, []::varchar[] as used from o union all select o.area, o.venue, o.i, case when len(used) < 3 and len(list_filter(used, lambda u: contains(u, name) or contains(name, u))) = 0 then list_append(used, name) else used end from pick join o on o.area = pick.area and o.venue = pick.venue and o.i = pick.i + 1)
select area, venue, array_to_string(arg_max(used, i), '; ') as labels from pick group by 1, 2"""


def title_grades(spark, d):
    """Answers that name a paper held and one that only looks like a title: how many of either."""
    p = _papers(spark, d).where("title is not null").select("event_id", F.regexp_replace(X.squeeze(F.col("title")), '[*"“”]', " ").alias("title"))
    a = p.select(F.col("event_id").alias("answer"), F.concat(F.lit("See **"), "title", F.lit("** and **An Invented Study About Many Absent Things "), F.col("event_id").cast("string"), F.lit("** and *only small words in italics here*")).alias("text"))
    return V.title_grades(a, p, "answer", "text", "event_id", "title").withColumn("phantom_rate", F.round("phantom_rate", 6))


TITLE_GRADES = f"with {_P} select event_id as answer, 1 as matched, 1 as phantom, 0.5 as phantom_rate from p where title is not null"


def rendering_details(spark, d):
    """Abstracts against a rendering that loses a figure, repeats the opening and adds another script."""
    from papyrine.operators.enrichment import rendering_details as details

    p = _papers(spark, d).where("abstract is not null")
    out = F.concat(F.substring("abstract", 1, 60), F.lit(" 한국어 번역"))
    s = details(F.col("abstract"), out)
    return p.select("event_id", s["numbers"].alias("numbers"), s["kept"].alias("kept"), s["script_share"].alias("script_share"), s["echo_chars"].alias("echo_chars"))


_FG = "list_transform(list_filter(regexp_extract_all(replace({0}, '−', '-'), '-?\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?'), lambda f: not regexp_matches(f, '^(19|20)\\d\\d$')), lambda f: replace(f, ',', ''))".replace("\\\\", "\\")
RENDERING_DETAILS = f"""with {_P}, o as (select event_id, abstract as a, abstract[1:60] || ' 한국어 번역' as o from p where abstract is not null), v as (select event_id, a, o, {_FG.format('a')} as x, {_FG.format('o')} as y, length(regexp_replace(o, '[^A-Za-z]', '', 'g')) as latin,
list_filter(regexp_extract_all(o, '[A-Za-z][A-Za-z ,.:%()\\-]{{39,}}'), lambda r: contains(a, trim(r)[1:40])) as runs from o)
select event_id, len(x)::int as numbers, len(list_distinct(list_filter(x, lambda f: list_contains(y, f))))::int as kept, round(5.0 / (5 + latin), 2) as script_share, coalesce(list_max(list_transform(runs, lambda r: length(r))), 0)::int as echo_chars from v"""

QUERIES = [
    ("filter_method", filter_method, FILTER_METHOD),
    ("filter_one_method", filter_one_method, FILTER_ONE_METHOD),
    ("filter_failure", filter_failure, FILTER_FAILURE),
    ("filter_cites", filter_cites, FILTER_CITES),
    ("filter_word", filter_word, FILTER_WORD),
    ("filter_datasets", filter_datasets, FILTER_DATASETS),
    ("changed_rows", changed_rows, CHANGED_ROWS),
    ("pooled_movers", pooled_movers, POOLED_MOVERS),
    ("shift_evidence", shift_evidence, SHIFT_EVIDENCE),
    ("set_card_rolled", set_card_rolled, SET_CARD_ROLLED),
    ("resource_coverage", resource_coverage, RESOURCE_COVERAGE),
    ("link_metadata", link_metadata, LINK_METADATA),
    ("link_worklist", link_worklist, LINK_WORKLIST),
    ("external_ids", external_ids, EXTERNAL_IDS),
    ("topic_methods", topic_methods, TOPIC_METHODS),
    ("citation_marks", citation_marks, CITATION_MARKS),
    ("governing_refs", governing_refs, GOVERNING_REFS),
    ("shown_labels", shown_labels, SHOWN_LABELS),
    ("finalized_facts", finalized_facts, FINALIZED_FACTS),
    ("semantic_extras", semantic_extras, SEMANTIC_EXTRAS),
    ("export_rows", export_rows, EXPORT_ROWS),
    ("corpus_stamp", corpus_stamp, CORPUS_STAMP),
    ("conversation_turns", conversation_turns, CONVERSATION_TURNS),
    ("rendered_answers", rendered_answers, RENDERED_ANSWERS),
    ("anchor_totals", anchor_totals, ANCHOR_TOTALS),
    ("spending", spending, SPENDING),
    ("grade_summary", grade_summary, GRADE_SUMMARY),
    ("quotes_anywhere", quotes_anywhere, QUOTES_ANYWHERE),
    ("benchmark_places", benchmark_places, BENCHMARK_PLACES),
    ("concept_labels", concept_labels, CONCEPT_LABELS),
    ("group_labels", group_labels, GROUP_LABELS),
    ("title_grades", title_grades, TITLE_GRADES),
    ("rendering_details", rendering_details, RENDERING_DETAILS),
]
