"""Search, facet and gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import records as Rec
from papyrine.operators import selection as S
from papyrine.session import table

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"
_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def _facts(spark, d):
    return Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", "facts")


def _abstracts(spark, d):
    return _papers(spark, d).where("abstract is not null").select("event_id", "abstract")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.SEARCH_STOP) + "]"
_INDEX = f"""with {_P}, a as (select event_id as doc, regexp_extract_all(lower(abstract), '[a-z][a-z0-9\\-]{{2,}}') as w from p where abstract is not null),
b as (select doc, w, list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) as pr from a),
t as (select distinct doc, unnest(list_concat(list_filter(w, lambda x: not list_contains({_STOP}, x)), list_transform(list_filter(pr, lambda x: not list_has_any(x, {_STOP})), lambda x: x[1] || ' ' || x[2]))) as term from b),
k as (select term, count(*) as df from t group by 1 having case when contains(term, ' ') then count(*) >= 5 else count(*) >= 2 end and count(*) < 0.15 * (select count(*) from a)),
x as (select term, doc, df from t join k using (term))"""


def term_index(spark, d):
    return S.term_index(_abstracts(spark, d), "event_id", "abstract").groupBy("term").agg(F.count("*").alias("df"), F.min("doc").alias("first_doc"), F.sum("doc").alias("checksum"))


TERM_INDEX = _INDEX + " select term, count(*) as df, min(doc) as first_doc, sum(doc)::bigint as checksum from x group by 1"


def search_and(spark, d):
    return S.search_all(S.term_index(_abstracts(spark, d), "event_id", "abstract"), ["graph", "noisy"])


SEARCH_AND = _INDEX + " select doc from x group by doc having bool_or(starts_with(term, 'graph')) and bool_or(starts_with(term, 'noisy'))"


def search_scan(spark, d):
    p = _papers(spark, d)
    return S.search_text(p, "event_id", F.concat_ws(" ", "title", "abstract"), ["policy", "limited"])


SEARCH_SCAN = f"with {_P} select event_id from p where contains(lower(concat_ws(' ', title, abstract)), 'policy') and contains(lower(concat_ws(' ', title, abstract)), 'limited')"


def search_rank(spark, d):
    a = _abstracts(spark, d)
    s = S.search_ranked(S.term_index(a, "event_id", "abstract"), a.agg(F.count("*").alias("n")), ["graph", "noisy", "sparse"], 50)
    return s.withColumn("score", F.round("score", 6))


SEARCH_RANK = _INDEX + " select doc, round(s, 6) as score from (select doc, sum(ln(1 + (select count(*) from a)::double / df)) as s from x where starts_with(term, 'graph') or starts_with(term, 'noisy') or starts_with(term, 'sparse') group by doc) order by s desc, doc limit 50"


def search_titles(spark, d):
    """The title of every paper whose id is divisible by 100 as a query, against all abstracts."""
    a = _abstracts(spark, d)
    q = _papers(spark, d).where("event_id % 100 = 0").select(F.col("event_id").alias("query"), X.title_tokens(F.col("title")).alias("words"))
    posts = S.term_index(a, "event_id", "abstract")
    return S.search_set(posts, a.agg(F.count("*").alias("n")), q, 10).withColumn("score", F.round("score", 6))


SEARCH_TITLES = _INDEX + """, q as (select event_id as query, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2 and x not in ('the','and','for','with','via','from','into','using','based')))) as w from p where event_id % 100 = 0),
qt as (select distinct query, term, df from q join k on starts_with(term, w)), s as (select query, doc, round(sum(ln(1 + (select count(*) from a)::double / qt.df)), 9) as s from qt join x using (term) where query <> doc group by 1, 2),
r as (select *, row_number() over (partition by query order by s desc, doc) as rank from s) select query, rank::int as rank, doc, round(s, 6) as score from r where rank <= 10"""


def search_suggest(spark, d):
    v = S.term_index(_abstracts(spark, d), "event_id", "abstract").groupBy("term").agg(F.count("*").alias("df"))
    return S.suggest(v.where(~F.contains("term", F.lit(" "))), "kernal")


SEARCH_SUGGEST = _INDEX + " select term, levenshtein(term, 'kernal')::int as edits from (select distinct term from x where not contains(term, ' ')) where levenshtein(term, 'kernal') <= 2"

_FACETS = {"venue": ["NeurIPS", "ICLR"], "year": [2025, 2026], "area": ["Optimization", "Theory", "Deep Learning"], "methods": ["Anchored Policy Rank Pruning", "Causal Manifold Group Normalization"]}


def _items(spark, d):
    p = _papers(spark, d).select("event_id", "venue", "year", "area")
    return p.join(_facts(spark, d).select("event_id", F.array_distinct("facts.methods.name").alias("methods")), "event_id", "left")


def facet_select(spark, d):
    return S.select_facets(_items(spark, d), {k: v for k, v in _FACETS.items() if k != "methods"}).select("event_id")


FACET_SELECT = f"with {_P} select event_id from p where venue in ('NeurIPS', 'ICLR') and year in (2025, 2026) and area in ('Optimization', 'Theory', 'Deep Learning')"


def chip_counts(spark, d):
    return S.chip_counts(_items(spark, d), {k: v for k, v in _FACETS.items() if k != "methods"} | {"methods": []}, "event_id")


CHIP_COUNTS = f"""with {_P}, {_F}, i as (select event_id, venue, year, area, list_distinct(list_transform(facts.methods, lambda x: x.name)) as methods from p left join f using (event_id))
select 'venue' as facet, venue as value, count(*) as n from i where year in (2025, 2026) and area in ('Optimization', 'Theory', 'Deep Learning') and venue is not null group by venue
union all select 'year', year::varchar, count(*) from i where venue in ('NeurIPS', 'ICLR') and area in ('Optimization', 'Theory', 'Deep Learning') and year is not null group by year
union all select 'area', area, count(*) from i where venue in ('NeurIPS', 'ICLR') and year in (2025, 2026) and area is not null group by area
union all select 'methods', m, count(*) from (select unnest(methods) as m from i where venue in ('NeurIPS', 'ICLR') and year in (2025, 2026) and area in ('Optimization', 'Theory', 'Deep Learning')) where m is not null group by m"""


def set_benchmarks(spark, d):
    """Datasets of a selection with their share, the 150 most used."""
    sel = S.select_facets(_papers(spark, d), {"area": ["Optimization", "Theory"]}).select("event_id")
    m = _facts(spark, d).join(sel, "event_id", "left_semi").select("event_id", F.explode("facts.datasets.name").alias("name")).where("name is not null")
    return S.top_values(m, "name", "event_id", 150, 1, sel.agg(F.count("*").alias("total"))).withColumn("share", F.round("share", 6))


SET_BENCHMARKS = f"""with {_P}, {_F}, s as (select event_id from p where area in ('Optimization', 'Theory')), m as (select event_id, unnest(facts.datasets).name as name from f where event_id in (select event_id from s))
select name, count(distinct event_id) as n, round(1000.0 * count(distinct event_id) / (select count(*) from s), 6) as share from m where name is not null group by 1 order by n desc, name limit 150"""


def set_card(spark, d):
    """Per edition of a selection: its size and share, and its leading methods."""
    p = _papers(spark, d)
    sel = S.select_facets(p, {"area": ["Optimization", "Theory"]})
    size = sel.groupBy("venue", "year").agg(F.count("*").alias("n"))
    total = p.groupBy("venue", "year").agg(F.count("*").alias("total"))
    m = _facts(spark, d).join(sel.select("event_id", "venue", "year"), "event_id").select("venue", "year", "event_id", F.explode("facts.methods.name").alias("name")).where("name is not null")
    from pyspark.sql import Window

    c = m.groupBy("venue", "year", "name").agg(F.count_distinct("event_id").alias("c"))
    w = Window.partitionBy("venue", "year").orderBy(F.col("c").desc(), "name")
    top = c.withColumn("r", F.row_number().over(w)).where("r <= 4").groupBy("venue", "year").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "; ").alias("methods"))
    return size.join(total, ["venue", "year"]).join(top, ["venue", "year"], "left").select("venue", "year", "n", F.round(1000.0 * F.col("n") / F.col("total"), 6).alias("share"), "methods")


SET_CARD = f"""with {_P}, {_F}, s as (select event_id, venue, year from p where area in ('Optimization', 'Theory')), z as (select venue, year, count(*) as n from s group by 1, 2), t as (select venue, year, count(*) as total from p group by 1, 2),
m as (select venue, year, event_id, unnest(facts.methods).name as name from f join s using (event_id)),
r as (select venue, year, name, row_number() over (partition by venue, year order by count(distinct event_id) desc, name) as r from m where name is not null group by 1, 2, 3),
g as (select venue, year, string_agg(name, '; ' order by r) as methods from r where r <= 4 group by 1, 2)
select venue, year, n, round(1000.0 * n / total, 6) as share, methods from z join t using (venue, year) left join g using (venue, year)"""


def stands_on(spark, d):
    """Parts that the customers of one segment buy most."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("citing"), F.col("l_partkey").alias("cited"))
    return S.stands_on(e, c, "citing", "cited", 3, 20)


STANDS_ON = """select l_partkey as cited, count(distinct o_custkey) as n from orders join lineitem on o_orderkey = l_orderkey where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
group by 1 having count(distinct o_custkey) >= 3 order by n desc, cited limit 20"""


def overlap_chips(spark, d):
    """Neighbouring entries compared: shared methods, Jaccard and overlap of their tokens."""
    a = _papers(spark, d).select("event_id", X.title_tokens(F.col("title")).alias("t"))
    b = a.select((F.col("event_id") + 1).alias("event_id"), F.col("t").alias("u"))
    j = a.join(b, "event_id")
    return j.select("event_id", F.array_join(F.array_sort(F.array_intersect("t", "u")), " ").alias("shared"), F.round(X.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"), F.round(X.overlap(F.col("t"), F.col("u")), 6).alias("overlap"))


_TK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2 and x not in ('the','and','for','with','via','from','into','using','based')))"
OVERLAP_CHIPS = f"""with {_P}, a as (select event_id, {_TK} as t from p), j as (select x.event_id, x.t, y.t as u from a x join a y on x.event_id = y.event_id + 1)
select event_id, array_to_string(list_sort(list_intersect(t, u)), ' ') as shared, round(case when len(list_distinct(list_concat(t, u))) > 0 then len(list_intersect(t, u))::double / len(list_distinct(list_concat(t, u))) else 0 end, 6) as jaccard,
round(case when least(len(t), len(u)) > 0 then len(list_intersect(t, u))::double / least(len(t), len(u)) else 0 end, 6) as overlap from j"""


def _members(spark, d):
    """(event_id, year, limitation, attack): attack is what a paper claims, proposes and works on."""
    f = _facts(spark, d)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), " ")
    proposed = F.filter("facts.methods", lambda m: m["role"] == "proposed")
    attack = F.concat_ws(" ", "facts.key_change", F.array_join("facts.novelty_spans", " "), names(proposed), names(F.col("facts.tasks")))
    return f.select("event_id", F.col("facts.limitation").alias("limitation"), attack.alias("attack")).join(_papers(spark, d).select("event_id", "year"), "event_id")


def gap_terms(spark, d):
    return S.gap_terms(_members(spark, d), "event_id", "limitation")


_FSTOP = "[" + ", ".join(f"'{w}'" for w in X.FAILURE_STOP) + "]"


def gap_sql(members: str, own: str = "[]::varchar[]") -> str:
    """Common tables of a gap scan: ``members`` has event_id, limitation, attack, year; ``own`` is the list of the topic's words."""
    return f"""l as (select * from ({members}) where length(coalesce(limitation, '')) > 0),
ow as (select {own} as own), w as (select event_id, list_filter(regexp_extract_all(lower(limitation), '[a-z][a-z\\-]{{2,}}'), lambda x: not list_contains({_FSTOP}, x) and not list_contains(own, x)) as w from l, ow),
t as (select distinct event_id, unnest(list_concat(list_filter(w, lambda x: length(x) >= 5), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w),
c as (select term, count(*) as df from t group by 1), b as (select * from c where df >= greatest(3, floor((select count(*) from l) / 60)) and df <= (select count(*) from l) / 2.0),
h as (select distinct x.term from b x join b y on not contains(x.term, ' ') and contains(y.term, ' ') and contains(y.term, x.term) and y.df >= 0.6 * x.df),
g as (select term, df from b where term not in (select term from h))"""


GAP_SCAN_TAIL = """, nm as (select g.term, any_value(df) as df, count(l.event_id) as named from g left join l on contains(lower(limitation), g.term) group by 1),
ord as (select *, row_number() over (order by df desc, term) as i from nm),
pick as (select 0::bigint as i, []::varchar[] as used union all select o.i, case when len(used) < 10 and named >= 3 and len(list_filter(used, lambda u: contains(u, term) or contains(term, u))) = 0 then list_append(used, term) else used end from pick join ord o on o.i = pick.i + 1),
final as (select unnest(used) as term from (select used from pick order by i desc limit 1)),
nl as (select term, l.* from final join l on contains(lower(limitation), term)),
y as (select term, string_agg(year || ':' || k, ' ' order by year) as years from (select term, year, count(*) as k from nl group by 1, 2) group by 1),
s as (select term, count(*) as named, count(*) filter (contains(lower(coalesce(attack, '')), term)) as attacked, arg_min(event_id, (length(limitation), event_id)) as event_id, arg_min(limitation, (length(limitation), event_id)) as sentence from nl group by 1)
select row_number() over (order by (attacked > 0)::int, named desc, term)::int as rank, term, named, attacked, named - attacked as motivation, years, event_id, sentence from s join y using (term)"""
MEMBERS = """select event_id, year, facts.limitation as limitation, concat_ws(' ', facts.key_change, array_to_string(facts.novelty_spans, ' '),
array_to_string(list_transform(list_filter(facts.methods, lambda m: m.role = 'proposed'), lambda m: m.name), ' '), array_to_string(list_transform(facts.tasks, lambda m: m.name), ' ')) as attack from f join p using (event_id)"""
_GAP = f"with recursive {_P}, {_F}, " + gap_sql(MEMBERS)
GAP_TERMS = _GAP + " select term, df from g"


def gap_scan(spark, d):
    """The ten leading failure terms that do not contain one another, with who names and who attacks them."""
    return S.gap_scan(_members(spark, d), "event_id", "limitation", "attack", "year")


GAP_SCAN = _GAP + GAP_SCAN_TAIL


def cluster_labels(spark, d):
    p = _papers(spark, d).where("abstract is not null and area is not null")
    t = p.select("area", "event_id", F.explode(F.array_distinct(F.filter(X.words(F.col("abstract")), lambda w: ~w.isin(*X.SEARCH_STOP)))).alias("term"))
    return S.cluster_labels(t, "area", "event_id", "term").withColumn("score", F.round("score", 6))


CLUSTER_LABELS = f"""with {_P}, t as (select distinct area, event_id, term from (select area, event_id, unnest(list_filter(regexp_extract_all(lower(abstract), '[a-z][a-z0-9\\-]{{2,}}'), lambda x: not list_contains({_STOP}, x))) as term from p where abstract is not null and area is not null)),
c as (select area, term, count(*) as c from t group by 1, 2), n as (select area, count(distinct event_id) as n from t group by 1), g as (select *, sum(c) over (partition by term) as total from c),
s as (select area, term, c, c::double / n * (c::double / greatest(total - c, 1)) as score from g join n using (area) where c >= greatest(3, 0.05 * n)),
r as (select *, row_number() over (partition by area order by score desc, term) as rank from s) select area, rank::int as rank, term, c, round(score, 6) as score from r where rank <= 4"""


def highlights(spark, d):
    """Spotlights where an edition declares any, else its orals."""
    p = _papers(spark, d)
    declared = p.groupBy("venue", "year").agg(F.bool_or("is_spotlight").alias("any"))
    flag = F.when(F.col("any"), F.col("is_spotlight")).otherwise(F.col("is_oral"))
    return p.join(declared, ["venue", "year"]).where(flag).groupBy("venue", "year").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


HIGHLIGHTS = f"with {_P}, h as (select venue, year, event_id, case when bool_or(is_spotlight) over (partition by venue, year) then is_spotlight else is_oral end as h from p) select venue, year, count(*) as n, min(event_id) as first from h where h group by 1, 2"

QUERIES = [
    ("term_index", term_index, TERM_INDEX),
    ("search_and", search_and, SEARCH_AND),
    ("search_scan", search_scan, SEARCH_SCAN),
    ("search_rank", search_rank, SEARCH_RANK),
    ("search_titles", search_titles, SEARCH_TITLES),
    ("search_suggest", search_suggest, SEARCH_SUGGEST),
    ("facet_select", facet_select, FACET_SELECT),
    ("chip_counts", chip_counts, CHIP_COUNTS),
    ("set_benchmarks", set_benchmarks, SET_BENCHMARKS),
    ("set_card", set_card, SET_CARD),
    ("stands_on", stands_on, STANDS_ON),
    ("overlap_chips", overlap_chips, OVERLAP_CHIPS),
    ("gap_terms", gap_terms, GAP_TERMS),
    ("gap_scan", gap_scan, GAP_SCAN),
    ("cluster_labels", cluster_labels, CLUSTER_LABELS),
    ("highlights", highlights, HIGHLIGHTS),
]
