"""Vocabulary queries over extraction results."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import records as Rec
from papyrine.operators import vocabulary as V
from papyrine.session import cut, table


def _facts(spark, d):
    return Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", "facts")


_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"


def _names(spark, d, field):
    return _facts(spark, d).select("event_id", F.explode(f"facts.{field}.name").alias("name")).where("name is not null")


def _n(field):
    return f"n as (select event_id, name from (select event_id, unnest(facts.{field}).name as name from f) where name is not null)"


def term_counts(spark, d):
    parts = None
    for k in ("methods", "tasks", "datasets"):
        part = _names(spark, d, k).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("docs")).withColumn("kind", F.lit(k))
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("kind", "name", "n", "docs")


TERM_COUNTS = f"with {_F}, n as (" + " union all ".join(f"select '{k}' as kind, event_id, unnest(facts.{k}).name as name from f" for k in ("methods", "tasks", "datasets")) + ") select kind, name, count(*) as n, count(distinct event_id) as docs from n where name is not null group by 1, 2"


def alias_learning(spark, d):
    counts = _names(spark, d, "methods").groupBy("name").agg(F.count("*").alias("n"))
    return V.learn_aliases(counts)


_B = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[\s.,;:]+$', ''), '[\s\-_/]+', ' ', 'g'))"
_PAREN = r"'^(.+?)\s*\(\s*([^)]{2,40})\s*\)\s*$'"
_ALIASES = (
    "with " + _F + ", " + _n("methods") + ", c as (select name, count(*) as n from n group by 1), b0 as (select name, n, " + _B.format("name") + " as b from c), "
    "b as (select *, " + _B.format(f"regexp_extract(b, {_PAREN}, 1)") + " as long, " + _B.format(f"regexp_extract(b, {_PAREN}, 2)") + " as short, regexp_extract(b, " + _PAREN + ", 1) <> '' as paren from b0), "
    """a as (select short, long from (select short, long, row_number() over (partition by short order by sum(n) desc, long) as r from b where long <> '' and short <> '' and long <> short group by short, long) where r = 1),
s as (select t, sum(n) as n from (select unnest(case when long <> '' and short <> '' and long <> short then [long, short] else [b] end) as t, n from b) group by 1),
c1 as (select t, coalesce(a.long, t) as c from s left join a on t = short),
c2 as (select t, coalesce(x.t2, y.t2, z.t2, c) as c from c1
  left join (select t as t2 from s where n > 0) x on c like '%ies' and length(c) > 5 and x.t2 = left(c, length(c) - 3) || 'y'
  left join (select t as t2 from s where n > 0) y on c like '%ses' and length(c) > 5 and y.t2 = left(c, length(c) - 3) || 's'
  left join (select t as t2 from s where n > 0) z on c like '%s' and length(c) > 3 and z.t2 = left(c, length(c) - 1)),
c3 as (select t, coalesce(a.long, c) as canonical from c2 left join a on c = short),
m as (select name, n, coalesce(canonical, k) as canonical from (select *, case when paren then long else b end as k from b) left join c3 on t = k)"""
)
ALIAS_LEARNING = _ALIASES + " select name, n, canonical from m"


def alias_stats(spark, d):
    m = alias_learning(spark, d)
    g = m.groupBy("canonical").agg(F.sum("n").alias("n"))
    a = m.agg(F.count_distinct("name").alias("raw"), F.sum("n").alias("mentions"))
    b = g.agg(F.count("*").alias("canonical"), F.count(F.when(F.col("n") >= 3, 1)).alias("at_least_3"), F.max("n").alias("largest"))
    return a.crossJoin(F.broadcast(b))


ALIAS_STATS = _ALIASES + ", g as (select canonical, sum(n) as n from m group by 1) select (select count(distinct name) from m) as raw, (select sum(n)::bigint from m) as mentions, count(*) as canonical, count(*) filter (n >= 3) as at_least_3, max(n)::bigint as largest from g"

_DS = r"regexp_replace(regexp_replace(regexp_replace(lower(name), '^(the|a)\s+', ''), '\s+(benchmark|dataset|corpus|suite)s?$', ''), '[^a-z0-9+]', '', 'g')"


def dataset_fold(spark, d):
    counts = _names(spark, d, "datasets").groupBy("name").agg(F.count_distinct("event_id").alias("n"))
    return V.fold_surfaces(counts, X.dataset_key(F.col("name")))


DATASET_FOLD = f"""with {_F}, {_n('datasets')}, c as (select name, count(distinct event_id) as n from n group by 1),
k as (select *, {_DS} as key from c)
select key, sum(n)::bigint as n, count(*) as surfaces, arg_min(name, struct_pack(a := -n, b := name)) as surface from k where key <> '' group by key"""


def dataset_entries(spark, d):
    """Datasets of three or more papers that are no placeholder, the 400 most used."""
    n = _names(spark, d, "datasets").where(~X.is_placeholder(F.col("name"))).withColumn("key", X.dataset_key(F.col("name"))).where("key <> ''")
    g = n.groupBy("key").agg(F.count_distinct("event_id").alias("n")).where("n >= 3")
    return g.orderBy(F.col("n").desc(), "key").limit(400)


_PH = "(regexp_matches({0}, '" + X.PLACEHOLDER + "') or regexp_matches({0}, '" + X.PLACEHOLDER_TAIL + "'))"
DATASET_ENTRIES = f"""with {_F}, {_n('datasets')}, k as (select event_id, {_DS} as key from n where not {_PH.format(_B.format('name'))})
select key, count(distinct event_id) as n from k where key <> '' group by 1 having count(distinct event_id) >= 3 order by n desc, key limit 400"""


def placeholder_filter(spark, d):
    n = _names(spark, d, "datasets").select("name").distinct()
    b = X.basic(F.col("name"))
    return n.select("name", X.is_placeholder(F.col("name")).alias("placeholder"), X.is_label(b).alias("label"))


PLACEHOLDER_FILTER = f"""with {_F}, {_n('datasets')}, b as (select distinct name, {_B.format('name')} as b from n)
select name, {_PH.format('b')} as placeholder, length(b) >= 4 and b not in ({', '.join(repr(x) for x in X.GENERIC_LABELS)}) and b not in ({', '.join(repr(x) for x in X.NULL_LITERALS)}) as label from b"""


def building_blocks(spark, d):
    return V.building_blocks(_names(spark, d, "methods"), "event_id", "name", 2)


_SING = "case when length({0}) > 3 and not regexp_matches({0}, '(ics|ss|us|sis|is|as)$') then regexp_replace({0}, '([a-z])s$', '\\1') else {0} end"
_METHOD_KEYS = f"""with {_F}, {_n('methods')},
n1 as (select event_id, name, trim(regexp_replace(name, '[‐-―−]|--+', '-', 'g')) as s from n),
n2 as (select *, regexp_extract(s, '\\(([A-Za-z][A-Za-z0-9\\-/]{{1,17}})\\)', 1) as gloss, trim(regexp_replace(regexp_replace(s, '\\s*\\([A-Za-z][A-Za-z0-9\\-/]{{1,17}}\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g')) as rest from n1),
n3 as (select *, case when gloss = '' then s when rest = '' then gloss else rest end as nm from n2),
n4 as (select *, {_B.format('s')} as bs, {_B.format('nm')} as bn, {_B.format('gloss')} as bg from n3),
n5 as (select *, case when {_PH.format('bs')} then '' else {_SING.format('bn')} end as key from n4),
k as (select event_id, name, key, case when gloss <> '' and rest <> '' and key <> '' then {_SING.format('bg')} end as acronym from n5)"""


def method_keys(spark, d):
    k = X.method_key(F.col("name"))
    return _names(spark, d, "methods").select("name").distinct().select("name", k["key"].alias("key"), k["acronym"].alias("acronym"))


METHOD_KEYS = _METHOD_KEYS + " select distinct name, key, acronym from k"
BUILDING_BLOCKS = _METHOD_KEYS + """,
m as (select * from k where key <> ''),
u as (select acronym, key as full from (select acronym, key, row_number() over (partition by acronym order by count(distinct event_id) desc, key) as r from m where acronym is not null and acronym <> key group by 1, 2) where r = 1),
g as (select event_id, name, coalesce(u.full, key) as key from m left join u on u.acronym = m.key),
c as (select key, count(distinct event_id) as n from g group by 1 having count(distinct event_id) >= 2),
s as (select key, name as surface from (select key, name, row_number() over (partition by key order by count(*) desc, name) as r from g group by 1, 2) where r = 1)
select key, n, surface from c join s using (key)"""


def _declared(spark, d):
    """(doc, label): the domain and the tasks of every paper, as canonical labels."""
    f = _facts(spark, d)
    raw = f.select("event_id", F.explode(F.array_union(F.array("facts.domain"), F.coalesce("facts.tasks.name", F.array().cast("array<string>")))).alias("raw"))
    return raw.select(F.col("event_id").alias("doc"), X.canon(F.col("raw")).alias("label")).where(X.is_label(F.col("label"))).distinct()


_CANON0 = "trim(regexp_replace(regexp_replace(" + _B + ", '\\b(tasks?|problems?|applications?)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_DECLARED = f"""with {_F}, r as (select event_id, facts.domain as raw from f union all select event_id, unnest(facts.tasks).name from f),
q as (select event_id as doc, {_CANON0.format('raw')} as c0 from r where raw is not null),
m as (select distinct doc, {_SING.format('c0')} as label from q),
d as (select * from m where length(label) >= 4 and label not in ({', '.join(repr(x) for x in X.GENERIC_LABELS)}) and label not in ({', '.join(repr(x) for x in X.NULL_LITERALS)}))"""


def declared_labels(spark, d):
    return _declared(spark, d).groupBy("label").agg(F.count("*").alias("n"))


DECLARED_LABELS = _DECLARED + " select label, count(*) as n from d group by 1"


def _editions(spark, d):
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at").select(F.col("event_id").alias("doc"), F.concat_ws("-", F.lower("venue"), "year").alias("edition"))
    return p, p.groupBy("edition").agg(F.count("*").alias("total"))


_EDITIONS = ", p as (select event_id as doc, lower(venue) || '-' || year as edition from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1), t as (select edition, count(*) as total from p group by 1)"


def topics_discovered(spark, d):
    p, totals = _editions(spark, d)
    t = V.discover_topics(_declared(spark, d).join(p, "doc"), "doc", "label", "edition", totals, 20.0, 3)
    return t.select("label", F.round("max_share", 6).alias("max_share"), "max_n", "n")


_TOPICS = _DECLARED + _EDITIONS + """, e as (select label, edition, count(distinct doc) as n, any_value(total) as total from d join p using (doc) join t using (edition) group by 1, 2),
v as (select label, max(1000.0 * n / greatest(total, 1)) as max_share, max(n) as max_n, sum(n)::bigint as n from e group by 1 having max(1000.0 * n / greatest(total, 1)) >= 20.0 and max(n) >= 3)"""
TOPICS_DISCOVERED = _TOPICS + " select label, round(max_share, 6) as max_share, max_n, n from v"


def _titles(spark, d):
    """(doc, label): title pieces of two to four neighbouring words, a stand-in for a long tail of labels."""
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")
    w = F.split(X.norm(F.col("title")), " ")
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(3)), " "))
    return p.select(F.col("event_id").alias("doc"), F.explode(F.array_distinct(runs)).alias("label"))


_TITLES = """, w as (select event_id as doc, string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') as w from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1),
x as (select distinct doc, array_to_string(w[i:i+2], ' ') as label from (select doc, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w))"""


def parent_rollup(spark, d):
    """Title phrases under the topic that begins or ends them."""
    p, totals = _editions(spark, d)
    v = V.discover_topics(_declared(spark, d).join(p, "doc"), "doc", "label", "edition", totals, 20.0, 3)
    labels = _titles(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return V.find_parents(labels, v).join(labels, "label").select("label", "parent", "n")


PARENT_ROLLUP = _TOPICS + _TITLES + """, l as (select label, count(*) as n from x group by 1)
select l.label, arg_max(v.label, struct_pack(a := length(v.label), b := v.label)) as parent, any_value(l.n) as n from l join v on l.label <> v.label and (starts_with(l.label, v.label || ' ') or ends_with(l.label, ' ' || v.label)) group by 1"""


def label_fold(spark, d):
    p, totals = _editions(spark, d)
    v = V.discover_topics(_declared(spark, d).join(p, "doc"), "doc", "label", "edition", totals, 20.0, 3)
    return V.fold_labels(_titles(spark, d).select("label").distinct(), v)


LABEL_FOLD = _TOPICS + _TITLES + """, l as (select distinct label from x)
select l.label, v.label as topic from l join v on l.label <> v.label and length(v.label) >= 8 and contains(' ' || l.label || ' ', ' ' || v.label || ' ')"""


def topic_membership(spark, d):
    p, totals = _editions(spark, d)
    # used by three joins each: read and planned once
    declared = cut(_declared(spark, d))
    members = declared.unionByName(cut(_titles(spark, d)))
    v = cut(V.discover_topics(declared.join(p, "doc"), "doc", "label", "edition", totals, 20.0, 3).select("label"))
    labels = members.select("label").distinct()
    m = V.topic_membership(members, v, V.find_parents(labels, v), V.fold_labels(labels, v))
    return m.groupBy("topic").agg(F.count(F.when(F.col("kind") == 1, 1)).alias("direct"), F.count(F.when(F.col("kind") == 2, 1)).alias("via"))


TOPIC_MEMBERSHIP = _TOPICS + _TITLES + """, a as (select doc, label from d union select doc, label from x),
h as (select v.label as topic, doc, 1 as kind from a join v using (label)
  union all select v.label, doc, 2 from a join v on a.label <> v.label and length(v.label) >= 8 and contains(' ' || a.label || ' ', ' ' || v.label || ' ')
  union all select parent, doc, 2 from a join (select l.label, arg_max(v.label, struct_pack(a := length(v.label), b := v.label)) as parent from (select distinct label from a) l join v on l.label <> v.label and (starts_with(l.label, v.label || ' ') or ends_with(l.label, ' ' || v.label)) group by 1) z on z.label = a.label),
g as (select topic, doc, min(kind) as kind from h group by 1, 2)
select topic, count(*) filter (kind = 1) as direct, count(*) filter (kind = 2) as via from g group by 1"""

QUERIES = [
    ("term_counts", term_counts, TERM_COUNTS),
    ("alias_learning", alias_learning, ALIAS_LEARNING),
    ("alias_stats", alias_stats, ALIAS_STATS),
    ("dataset_fold", dataset_fold, DATASET_FOLD),
    ("dataset_entries", dataset_entries, DATASET_ENTRIES),
    ("placeholder_filter", placeholder_filter, PLACEHOLDER_FILTER),
    ("method_keys", method_keys, METHOD_KEYS),
    ("building_blocks", building_blocks, BUILDING_BLOCKS),
    ("declared_labels", declared_labels, DECLARED_LABELS),
    ("topics_discovered", topics_discovered, TOPICS_DISCOVERED),
    ("parent_rollup", parent_rollup, PARENT_ROLLUP),
    ("label_fold", label_fold, LABEL_FOLD),
    ("topic_membership", topic_membership, TOPIC_MEMBERSHIP),
]
