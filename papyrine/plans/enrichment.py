"""Enrichment queries over extraction results, matches and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import rules as R
from papyrine.functions import text as X
from papyrine.operators import enrichment as En
from papyrine.operators import records as Rec
from papyrine.operators import selection as S
from papyrine.operators import trends as T
from papyrine.session import cut, table

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"
_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def _facts(spark, d):
    return Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", "facts")


def _case(col, rules):
    q = lambda s: s.replace("'", "''")
    return "case " + " ".join(f"when regexp_matches({col}, '{q(p)}') then '{q(n)}'" for p, n in rules) + " else 'Other' end"


_B = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[\s.,;:]+$', ''), '[\s\-_/]+', ' ', 'g'))"


def task_families(spark, d):
    n = _facts(spark, d).select(F.explode("facts.tasks.name").alias("name")).where("name is not null")
    return n.groupBy(X.classify(X.basic(F.col("name")), R.TASK_FAMILIES, "Other").alias("family")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("labels"))


TASK_FAMILIES = f"with {_F}, n as (select unnest(facts.tasks).name as name from f) select {_case(_B.format('name'), R.TASK_FAMILIES)} as family, count(*) as n, count(distinct name) as labels from n where name is not null group by 1"


def method_families(spark, d):
    n = _facts(spark, d).select(F.explode("facts.methods.name").alias("name")).where("name is not null and name <> ''")
    tag = F.when(F.col("name").rlike(R.NOT_A_TECHNIQUE), "product").when(F.col("name").rlike(R.MODEL_NAME), "model").otherwise("technique")
    return n.groupBy(X.classify(F.col("name"), R.METHOD_FAMILIES, "Other").alias("family"), tag.alias("tag")).agg(F.count("*").alias("n"))


METHOD_FAMILIES = f"""with {_F}, n as (select unnest(facts.methods).name as name from f) select {_case('name', R.METHOD_FAMILIES)} as family,
case when regexp_matches(name, '{R.NOT_A_TECHNIQUE}') then 'product' when regexp_matches(name, '{R.MODEL_NAME}') then 'model' else 'technique' end as tag, count(*) as n from n where name is not null and name <> '' group by 1, 2"""


def fact_cards(spark, d):
    c = En.cards(_facts(spark, d), "event_id")
    return c.select("event_id", F.array_join("methods", "; ").alias("methods"), F.array_join("datasets", "; ").alias("datasets"), "claim", "result", "limitation")


def _names_sql(field, cap):
    return f"array_to_string((select list(name order by i) from (select name, min(i) as i from (select unnest(list_transform(facts.{field}, lambda x: x.name)) as name, generate_subscripts(facts.{field}, 1) as i) where name is not null and name <> '' and not regexp_matches(name, '{R.CJK}') group by name order by i limit {cap})), '; ')"


FACT_CARDS = f"""with {_F} select event_id, coalesce({_names_sql('methods', 6)}, case when facts.methods is not null then '' end) as methods, coalesce({_names_sql('datasets', 4)}, case when facts.datasets is not null then '' end) as datasets,
coalesce(nullif(facts.key_change, ''), facts.novelty_spans[1]) as claim,
coalesce(nullif(facts.result_claim, ''), list_filter(case when facts.key_change is null then facts.novelty_spans[2:] else facts.novelty_spans end, lambda s: regexp_matches(s, '{R.RESULT}'))[1]) as result, facts.limitation as limitation from f"""


def domains(spark, d):
    x = En.domain_of(F.col("facts.domain"))
    return _facts(spark, d).select(x["domain"].alias("domain"), x["family"].alias("family")).groupBy("domain", "family").agg(F.count("*").alias("n"))


_CANON0 = "trim(regexp_replace(regexp_replace(" + _B + ", '\\b(tasks?|problems?|applications?)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
DOMAINS = f"""with {_F}, a as (select {_CANON0.format('facts.domain')} as c0 from f),
b as (select case when length(c0) > 3 and not regexp_matches(c0, '(ics|ss|us|sis|is|as)$') then regexp_replace(c0, '([a-z])s$', '\\1') else c0 end as c from a),
e as (select case c {' '.join(f"when '{k}' then '{v}'" for k, v in R.DOMAIN_ALIASES)} else c end as x from b),
g as (select case when x in {_IN(R.NOT_A_DOMAIN)} or x in {_IN(R.JUNK_LABELS)} or length(x) < 4 or x in {_IN(X.GENERIC_LABELS)} or x in {_IN(X.NULL_LITERALS)} then null else x end as domain from e)
select domain, case {' '.join(f"when domain in {_IN(ls)} then '{n}'" for n, ls in R.DOMAIN_FAMILIES)} end as family, count(*) as n from g group by 1, 2"""


def coverage_block(spark, d):
    """Totals of a build: papers, with abstract, with facts, spans, names, areas reached."""
    p, f = _papers(spark, d), _facts(spark, d)
    a = p.agg(F.count("*").alias("papers"), F.count("abstract").alias("abstracts"), F.count_distinct("subarea").alias("topics"))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    b = f.agg(F.count("*").alias("facts"), F.sum(size("facts.novelty_spans")).alias("spans"), F.sum(size("facts.methods")).alias("methods"), F.sum(size("facts.datasets")).alias("datasets"), F.count("facts.domain").alias("with_domain"))
    return a.crossJoin(F.broadcast(b))


COVERAGE_BLOCK = f"""with {_P}, {_F}, a as (select count(*) as papers, count(abstract) as abstracts, count(distinct subarea) as topics from p),
b as (select count(*) as facts, sum(coalesce(len(facts.novelty_spans), 0))::bigint as spans, sum(coalesce(len(facts.methods), 0))::bigint as methods, sum(coalesce(len(facts.datasets), 0))::bigint as datasets, count(facts.domain) as with_domain from f) select * from a, b"""


def pair_relations(spark, d):
    """Listed duplicates as links: how each pair of neighbours stands to one another."""
    e = _papers(spark, d).select(F.col("event_id").alias("citing"), F.explode("duplicate_event_ids").alias("cited")).where("citing <> cited")
    pairs = e.select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b")).distinct()
    return En.relation(pairs, e, "a", "b")


PAIR_RELATIONS = f"""with {_P}, e as (select distinct citing, cited from (select event_id as citing, unnest(duplicate_event_ids) as cited from p) where citing <> cited), q as (select distinct least(citing, cited) as a, greatest(citing, cited) as b from e)
select a, b, case when x and y then 'both' when x then 'cites' when y then 'cited by' else 'none' end as relation from (select a, b, (a, b) in (select citing, cited from e) as x, (b, a) in (select citing, cited from e) as y from q)"""


def match_quality(spark, d):
    """What an earlier run resolved against exact titles and authors of the index: recall and precision by venue."""
    from papyrine.operators.matching import exact_match

    p = _papers(spark, d).select("event_id", "venue", "title")
    truth = exact_match(p, table(spark, d, "arxiv_index").select("arxiv_base", "title"), X.norm(F.col("title")), "arxiv_base", "event_id").join(p.select("event_id", "venue"), "event_id")
    found = table(spark, d, "resolved").where("arxiv_base is not null").select("event_id", "arxiv_base").join(p.select("event_id", "venue"), "event_id")
    item = F.concat_ws("|", F.col("event_id").cast("string"), "arxiv_base")
    m = En.set_metrics(found.select("venue", item.alias("item")), truth.select("venue", item.alias("item")), "venue", "item")
    return m.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
MATCH_QUALITY = f"""with {_P}, r as (select {_N.format('title')} as k, min(arxiv_base) as b from arxiv_index group by 1), t as (select distinct venue, event_id || '|' || b as item from p join r on {_N.format('title')} = k where k <> ''),
g as (select distinct venue, p.event_id || '|' || arxiv_base as item from resolved join p using (event_id) where arxiv_base is not null)
select coalesce(t.venue, g.venue) as venue, count(g.item) as found, count(t.item) as wanted, count(*) filter (g.item is not null and t.item is not null) as hit, round(count(*) filter (g.item is not null and t.item is not null)::double / nullif(count(t.item), 0), 6) as recall,
round(count(*) filter (g.item is not null and t.item is not null)::double / nullif(count(g.item), 0), 6) as precision from t full join g on t.venue = g.venue and t.item = g.item group by 1"""


def rising_limits(spark, d):
    """Words of stated limitations that rise between 2024 and later years, strongest first, none inside another."""
    years = _papers(spark, d).select("event_id", "year")
    f = _facts(spark, d).select("event_id", F.col("facts.limitation").alias("s")).where("s is not null").join(years, "event_id")
    side = F.when(F.col("year") <= 2024, 0).otherwise(1)
    totals = f.agg(F.count(F.when(side == 0, 1)).alias("t0"), F.count(F.when(side == 1, 1)).alias("t1"))
    t = f.select("event_id", side.alias("side"), F.explode(F.array_distinct(F.filter(X.words(F.col("s")), lambda w: ~w.isin(*X.SEARCH_STOP)))).alias("term")).groupBy("term", "side").agg(F.count("*").alias("n"))
    r = En.rising_terms(T.paired(t, ["term"], F.col("side"), totals), "term", least=3, most_share=0.2, bar=1.0)
    r = cut(r)
    picked: list[str] = []
    for x in r.orderBy(F.round("z", 9).desc(), "term").select("term").toLocalIterator():  # in order, until five hold
        picked = S.pick_disjoint([*picked, x.term], 5)
        if len(picked) == 5:
            break
    return r.where(F.col("term").isin(picked) if picked else F.lit(False)).select("term", "n0", "n1", F.round("z", 6).alias("z"))


_LSTOP = "[" + ", ".join(f"'{w}'" for w in X.SEARCH_STOP) + "]"
RISING_LIMITS = f"""with recursive {_P}, {_F}, l as (select event_id, facts.limitation as s, (year > 2024)::int as side from f join p using (event_id) where facts.limitation is not null),
t as (select distinct event_id, side, term from (select event_id, side, unnest(regexp_extract_all(lower(s), '[a-z][a-z0-9\\-]{{2,}}')) as term from l) where not list_contains({_LSTOP}, term)),
n as (select term, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1, (select count(*) filter (side = 0) from l) as t0, (select count(*) filter (side = 1) from l) as t1 from t group by 1),
q as (select *, (n0 + n1)::double / (t0 + t1) as p from n where n0 + n1 >= 3 and n0 <= 0.2 * t0 and n1 <= 0.2 * t1),
z as (select *, case when p * (1 - p) * (1.0 / t0 + 1.0 / t1) > 1e-12 then (n1::double / t1 - n0::double / t0) / sqrt(p * (1 - p) * (1.0 / t0 + 1.0 / t1)) else 0 end as z from q),
o as (select *, row_number() over (order by round(z, 9) desc, term) as i from z where z >= 1),
pick as (select 0::bigint as i, []::varchar[] as used union all select o.i, case when len(used) < 5 and len(list_filter(used, lambda u: contains(u, term) or contains(term, u))) = 0 then list_append(used, term) else used end from pick join o on o.i = pick.i + 1)
select term, n0, n1, round(z, 6) as z from o where term in (select unnest(used) from (select used from pick order by i desc limit 1))"""


def renderings(spark, d):
    """Abstracts against themselves with one figure changed: figures that no longer survive are seen."""
    p = _papers(spark, d).where("abstract is not null")
    changed = F.regexp_replace("abstract", r"^(\D*)\d+(?!\d)", "$1987654")
    s, t = En.rendering_score(F.col("abstract"), F.col("abstract")), En.rendering_score(F.col("abstract"), changed)
    return p.agg(F.count("*").alias("n"), F.count(F.when(s["numbers_kept"], 1)).alias("kept"), F.count(F.when(s["echo"], 1)).alias("echo"), F.count(F.when(~t["numbers_kept"], 1)).alias("caught"))


_FIGS = "list_transform(list_filter(regexp_extract_all(replace({0}, '−', '-'), '-?\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?'), lambda f: not regexp_matches(f, '^(19|20)\\d\\d$')), lambda f: replace(f, ',', '')::double)"
_KILO = "list_transform(regexp_extract_all(abstract, '(\\d+(?:\\.\\d+)?)\\s*[kK]\\b', 1), lambda f: f::double)"
RENDERINGS = f"""with {_P}, c as (select abstract, regexp_replace(abstract, '^([^0-9]*)[0-9]+', '\\1987654') as other from p where abstract is not null), v as (select {_FIGS.format('abstract')} as a, {_FIGS.format('other')} as b, {_KILO} as k from c)
select count(*) as n, count(*) as kept, count(*) as echo, count(*) filter (len(list_filter(a, lambda x: not (list_contains(b, x) or (list_contains(k, x) and list_contains(b, x * 1000))))) > 0) as caught from v"""


def role_ranges(spark, d):
    """Evidence spans marked in the abstract, longest first, none overlapping."""
    f = _facts(spark, d).select("event_id", F.transform("facts.methods", lambda m: F.struct(F.lit("method").alias("role"), m["name"].alias("phrase"), F.lit(1).alias("priority"))).alias("a"), F.transform("facts.tasks", lambda m: F.struct(F.lit("task").alias("role"), m["name"].alias("phrase"), F.lit(2).alias("priority"))).alias("b"))
    r = _papers(spark, d).select("event_id", "abstract").join(f, "event_id").select("event_id", "abstract", F.concat(F.coalesce("a", F.array()), F.coalesce("b", F.array())).alias("phrases"))
    return En.annotate(r, "event_id", "abstract", "phrases").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("papers"))


def area_summary(spark, d):
    """Regions of the embedding layout: size, centre and leading labels."""
    from papyrine.operators import vectors as V

    e = table(spark, d, "embeddings")
    r = V.regions(e, "vec_id", "embedding", 8).join(V.layout(e, "vec_id", "embedding"), "vec_id").join(e.select("vec_id", F.col("label").cast("string").alias("label")), "vec_id")
    return En.group_summary(r, "region", ["x", "y"], "label")


def preprint_cites(spark, d):
    """Preprints that two or more texts name; the texts are built from the resolved table."""
    t = table(spark, d, "resolved").where("arxiv_base is not null").select(F.explode(F.array(F.col("event_id"), F.col("event_id") + F.lit(10**9))).alias("doc"), F.concat(F.lit("see arXiv:"), "arxiv_base", F.lit(" and arXiv 9999.99999")).alias("text"))
    return En.external_cites(t, "doc", "text", table(spark, d, "arxiv_index"), "arxiv_base")


PREPRINT_CITES = "with r as (select distinct event_id, arxiv_base from resolved where arxiv_base is not null) select arxiv_base, 2 * count(*) as n from r where arxiv_base in (select arxiv_base from arxiv_index) group by 1"


def corpus_texts(spark, d):
    """One text per paper for an external reader, with its size and digest."""
    p = _papers(spark, d)
    text = F.concat_ws("\n\n", "title", F.array_join("authors", ", "), "abstract")
    return p.select("event_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


CORPUS_TEXTS = f"with {_P}, t as (select event_id, concat_ws(chr(10) || chr(10), title, array_to_string(authors, ', '), abstract) as t from p) select event_id, length(t) as chars, md5(t) as digest from t"


def term_list(spark, d):
    """Distinct names of 4 to 39 characters, longest first, the first 4,000."""
    f = _facts(spark, d)
    n = f.select(F.explode(F.concat(F.coalesce("facts.methods.name", F.array().cast("array<string>")), F.coalesce("facts.datasets.name", F.array().cast("array<string>")))).alias("name")).where("name is not null and length(name) between 4 and 39").distinct()
    return n.orderBy(F.length("name").desc(), "name").limit(4000)


TERM_LIST = f"with {_F} select name from (select distinct name from (select unnest(facts.methods).name as name from f union all select unnest(facts.datasets).name from f) where name is not null and length(name) between 4 and 39) order by length(name) desc, name limit 4000"

QUERIES = [
    ("task_families", task_families, TASK_FAMILIES),
    ("method_families", method_families, METHOD_FAMILIES),
    ("fact_cards", fact_cards, FACT_CARDS),
    ("domains", domains, DOMAINS),
    ("coverage_block", coverage_block, COVERAGE_BLOCK),
    ("pair_relations", pair_relations, PAIR_RELATIONS),
    ("match_quality", match_quality, MATCH_QUALITY),
    ("rising_limits", rising_limits, RISING_LIMITS),
    ("renderings", renderings, RENDERINGS),
    ("role_ranges", role_ranges, None),
    ("area_summary", area_summary, None),
    ("preprint_cites", preprint_cites, PREPRINT_CITES),
    ("corpus_texts", corpus_texts, CORPUS_TEXTS),
    ("term_list", term_list, TERM_LIST),
]
