"""Link prediction queries: areas against methods, editions up to 2025 against 2026; customers' nations against brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import prediction as P
from papyrine.operators import records as Rec
from papyrine.session import cut, table


def _base(spark, d):
    """(doc, field, year, names, limitation, claim), read once: field is the subarea or null, claim what is changed and what results."""
    p = Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at").select("event_id", "year", F.col("subarea").alias("field"))
    f = Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model")
    claim = F.nullif(F.concat_ws(" ", "facts.key_change", "facts.result_claim"), F.lit(""))
    f = f.select("event_id", F.col("facts.methods.name").alias("names"), F.nullif("facts.limitation", F.lit("")).alias("limitation"), claim.alias("claim"))
    return cut(p.join(f, "event_id").withColumnRenamed("event_id", "doc"))


def _rows(base):
    """(field, technique, doc, year): method keys."""
    k = X.method_key(F.col("name"))["key"]
    return base.select("field", "doc", "year", F.explode("names").alias("name")).select("field", k.alias("technique"), "doc", "year").where("technique <> ''").distinct()


_B = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[\s.,;:]+$', ''), '[\s\-_/]+', ' ', 'g'))"
_PH = "(regexp_matches({0}, '" + X.PLACEHOLDER + "') or regexp_matches({0}, '" + X.PLACEHOLDER_TAIL + "'))"
_ROWS = f"""with p as (select event_id, year, subarea from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1),
f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1),
n0 as (select event_id, unnest(facts.methods).name as name from f), n1 as (select event_id, trim(regexp_replace(name, '[‐-―−]|--+', '-', 'g')) as s from n0 where name is not null),
n2 as (select *, regexp_extract(s, '\\(([A-Za-z][A-Za-z0-9\\-/]{{1,17}})\\)', 1) as gloss, trim(regexp_replace(regexp_replace(s, '\\s*\\([A-Za-z][A-Za-z0-9\\-/]{{1,17}}\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g')) as rest from n1),
n3 as (select event_id, {_B.format('s')} as bs, {_B.format("case when gloss = '' then s when rest = '' then gloss else rest end")} as bn from n2),
n4 as (select event_id, case when {_PH.format('bs')} then '' when length(bn) > 3 and not regexp_matches(bn, '(ics|ss|us|sis|is|as)$') then regexp_replace(bn, '([a-z])s$', '\\1') else bn end as technique from n3),
w as (select distinct subarea as field, technique, event_id as doc, year from n4 join p using (event_id) where technique <> '')"""

#: Papers of a field and of a technique, and the greatest share of texts that a term may be in.
LEAST_F, LEAST_T, MOST_SHARE = 5, 3, 0.2
_CELLS = _ROWS + f""", past as (select * from w where year <= 2025), fut as (select distinct field, technique from w where year = 2026 and field is not null),
fs as (select field, count(distinct doc) as nf from past where field is not null group by 1 having count(distinct doc) >= {LEAST_F}), ts as (select technique, count(distinct doc) as nt from past group by 1 having count(distinct doc) >= {LEAST_T}),
o as (select field, technique, count(distinct doc) as n from past where field in (select field from fs) and technique in (select technique from ts) group by 1, 2),
e as (select field, nf, technique, nt from fs, ts where (field, technique) not in (select field, technique from o))"""


def _world(spark, d):
    base = _base(spark, d)
    rows = cut(_rows(base))
    o, f, t = P.cells(rows.where("year <= 2025"), "field", "technique", "doc", LEAST_F, LEAST_T)
    return base, rows, cut(o), f, t


def link_cells(spark, d):
    _, _, o, f, t = _world(spark, d)
    e = P.empty_cells(o, f, t, "field", "technique").groupBy("field").agg(F.count("*").alias("empty"))
    return f.join(o.groupBy("field").agg(F.count("*").alias("filled"), F.sum("n").alias("docs")), "field", "left").join(e, "field", "left").select("field", "nf", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("empty", F.lit(0)).alias("empty"))


LINK_CELLS = _CELLS + """, a as (select field, count(*) as filled, sum(n)::bigint as docs from o group by 1), b as (select field, count(*) as empty from e group by 1)
select field, nf, coalesce(filled, 0) as filled, coalesce(docs, 0) as docs, coalesce(empty, 0) as empty from fs left join a using (field) left join b using (field)"""


def _profiles(base, rows):
    """Failure profiles of the fields and claim profiles of the techniques, up to 2025."""
    texts = base.where("field is not null and year <= 2025")
    n = texts.agg(F.count_distinct("doc").alias("n"))
    lim = texts.where("limitation is not null").select("field", "doc", F.explode(X.failure_terms(F.col("limitation"))).alias("term"))
    claim = texts.where("claim is not null").select("doc", F.explode(X.failure_terms(F.col("claim"))).alias("term"))
    idf = P.banded_idf(lim.select("doc", "term").union(claim), "doc", "term", n, 3, MOST_SHARE)
    used = claim.join(rows.where("year <= 2025").select("doc", "technique"), "doc")
    return texts, P.profiles(lim, "field", "doc", "term", idf), P.profiles(used, "technique", "doc", "term", idf)


def _scored(spark, d):
    base, rows, o, f, t = _world(spark, d)
    e = P.empty_cells(o, f, t, "field", "technique")
    future = rows.where("year = 2026 and field is not null").select("field", "technique").distinct().withColumn("hit", F.lit(True))
    cf = P.overlap_scores(o, "field", "technique")
    texts, vf, vt = _profiles(base, rows)
    lim = P.profile_cosine(vf, vt, "field", "technique")
    spread = o.groupBy("technique").agg(F.count("*").alias("n_fields"))
    c = e.join(cf, ["field", "technique"], "left").join(lim, ["field", "technique"], "left").join(future, ["field", "technique"], "left").join(spread, "technique", "left")
    zero = F.lit(0.0)
    c = c.select("field", "technique", "nf", "nt", F.coalesce("cf", zero).alias("cf"), F.coalesce("cosine", zero).alias("lim"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return rows, texts, vf, vt, P.scores(cut(c))


def link_scores(spark, d):
    s = _scored(spark, d)[-1]
    return s.select("field", "technique", "hit", F.col("pa").cast("long").alias("pa"), *[F.round(c, 6).alias(c) for c in ("cf", "lim", "lim_cf", "lim_spec")])


_FSTOP = "[" + ", ".join(f"'{w}'" for w in X.FAILURE_STOP) + "]"
_W = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z][a-z\\-]{{{{2,}}}}'), lambda t: not list_contains({_FSTOP}, t))"
_TERMS = f"list_concat(list_filter({_W}, lambda t: length(t) >= 5), list_transform(range(1, len({_W})), lambda i: ({_W})[i] || ' ' || ({_W})[i + 1]))"
_SCORED = _CELLS + f""", sf as (select field, count(*) as s from o group by 1), st as (select technique, count(*) as s from o group by 1),
jf as (select x.field as x, y.field as y, count(*)::double / (any_value(a.s) + any_value(b.s) - count(*)) as j from o x join o y on x.technique = y.technique and x.field <> y.field join sf a on a.field = x.field join sf b on b.field = y.field group by 1, 2),
jt as (select x.technique as x, y.technique as y, count(*)::double / (any_value(a.s) + any_value(b.s) - count(*)) as j from o x join o y on x.field = y.field and x.technique <> y.technique join st a on a.technique = x.technique join st b on b.technique = y.technique group by 1, 2),
c1 as (select x as field, technique, sum(j) as a from jf join o on o.field = y group by 1, 2), c2 as (select field, x as technique, sum(j) as b from jt join o on o.technique = y group by 1, 2),
x as (select event_id as doc, subarea as field, nullif(facts.limitation, '') as limitation, nullif(concat_ws(' ', facts.key_change, facts.result_claim), '') as claim from f join p using (event_id) where subarea is not null and year <= 2025),
xl as (select distinct field, doc, term from (select field, doc, unnest({_TERMS.format('limitation')}) as term from x where limitation is not null)),
xc as (select distinct doc, term from (select doc, unnest({_TERMS.format('claim')}) as term from x where claim is not null)),
di as (select term, ln((select count(*) from x)::double / count(distinct doc)) as idf from (select doc, term from xl union select doc, term from xc) group by 1 having count(distinct doc) >= 3 and count(distinct doc) <= {MOST_SHARE} * (select count(*) from x)),
pf as (select field, term, w / sqrt(sum(w * w) over (partition by field)) as w from (select field, term, count(distinct doc) * any_value(idf) as w from xl join di using (term) group by 1, 2)),
pt as (select technique, term, w / sqrt(sum(w * w) over (partition by technique)) as w from (select technique, term, count(distinct doc) * any_value(idf) as w from xc join past using (doc) join di using (term) group by 1, 2)),
lm as (select pf.field, pt.technique, sum(pf.w * pt.w) as lim from pf join pt using (term) group by 1, 2),
y as (select field, technique, nf * nt as pa, coalesce(a, 0) + coalesce(b, 0) as cf, coalesce(lim, 0) as lim, coalesce(st.s, 0) as k, (field, technique) in (select field, technique from fut) as hit
from e left join c1 using (field, technique) left join c2 using (field, technique) left join lm using (field, technique) left join st using (technique)),
z as (select *, case when max(lim) over () > min(lim) over () then (lim - min(lim) over ()) / (max(lim) over () - min(lim) over ()) else 0 end * case when max(cf) over () > min(cf) over () then (cf - min(cf) over ()) / (max(cf) over () - min(cf) over ()) else 0 end as lim_cf, lim / ln(2.0 + k) as lim_spec from y)"""
LINK_SCORES = _SCORED + " select field, technique, pa, round(cf, 6) as cf, round(lim, 6) as lim, round(lim_cf, 6) as lim_cf, round(lim_spec, 6) as lim_spec, hit from z"


def _rounded(s):
    """Scores to nine digits, so that sums in another order rank alike."""
    return s.select("field", "technique", "hit", "random", "pa", *[F.round(c, 9).alias(c) for c in ("cf", "lim", "lim_cf", "lim_spec")])


def link_eval(spark, d):
    """Precision at k and average precision of the six scorers on the cells filled in 2026."""
    out = P.evaluate(_rounded(_scored(spark, d)[-1]), P.SCORERS, "hit", "field", "technique")
    # the order of the random scorer is a seeded hash, which no other engine has
    return out.where("scorer <> 'random'").select("scorer", "candidates", "hits", *[F.round(c, 6).alias(c) for c in ("base_rate", "p_10", "p_25", "p_50", "p_100", "average_precision")])


def _eval_sql(name):
    return f"""select '{name}' as scorer, count(*) as candidates, sum(hit::int)::bigint as hits, round(avg(hit::int), 6) as base_rate, {', '.join(f"round(count(*) filter (hit and r <= {k}) / {k}.0, 6) as p_{k}" for k in (10, 25, 50, 100))},
round(coalesce(sum(case when hit then h::double / r end) / nullif(sum(hit::int), 0), 0), 6) as average_precision from (select *, sum(hit::int) over (order by r) as h from (select *, row_number() over (order by round({name}, 9) desc, field, technique) as r from z))"""


LINK_EVAL = _SCORED + " " + " union all ".join(map(_eval_sql, P.SCORERS[1:]))


def link_evidence(spark, d):
    """The hundred leading cells of lim_cf with their matched terms and the shortest sentences that state the failure or the claim."""
    rows, texts, vf, vt, s = _scored(spark, d)
    top = cut(_rounded(s).orderBy(F.col("lim_cf").desc(), "field", "technique").limit(100).where("lim > 0").select("field", "technique"))
    m = cut(P.matched_terms(vf, vt, top, "field", "technique"))
    cell = ["field", "technique"]
    states = P.evidence(m, texts, cell, "field", "doc", "limitation").withColumn("side", F.lit("states"))
    users = rows.where("year <= 2025").select("technique", "doc").join(texts.select("doc", "claim"), "doc")
    claims = P.evidence(m, users, cell, "technique", "doc", "claim").withColumn("side", F.lit("claims"))
    return states.unionByName(claims).select("field", "technique", "side", "place", "doc", "sentence", F.array_join("terms", "; ").alias("terms"))


LINK_EVIDENCE = _SCORED + """, top as (select field, technique from (select * from z order by round(lim_cf, 9) desc, field, technique limit 100) where lim > 0),
mt as (select field, technique, term, row_number() over (partition by field, technique order by round(pf.w * pt.w, 12) desc, term) as r from top join pf using (field) join pt using (technique, term)),
m6 as (select field, technique, list(term order by r) as terms from mt where r <= 6 group by 1, 2),
ev as (select field, technique, 'states' as side, doc, limitation as sentence, list_filter(terms, lambda t: contains(lower(limitation), t)) as terms from m6 join x using (field) where limitation is not null
union all select m6.field, technique, 'claims', doc, claim, list_filter(terms, lambda t: contains(lower(claim), t)) from m6 join (select distinct technique, doc from past) using (technique) join (select doc, claim from x) using (doc) where claim is not null)
select field, technique, side, place::int as place, doc, sentence, array_to_string(terms, '; ') as terms from (select *, row_number() over (partition by field, technique, side order by length(sentence), doc) as place from ev where len(terms) > 0) where place <= 2"""


QUERIES = [
    ("link_cells", link_cells, LINK_CELLS),
    ("link_scores", link_scores, LINK_SCORES),
    ("link_eval", link_eval, LINK_EVAL),
    ("link_evidence", link_evidence, LINK_EVIDENCE),
]
