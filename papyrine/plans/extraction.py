"""Extraction queries.  The tables hold no addresses or links, so lines that hold some are built from papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import extraction as E
from papyrine.operators import records as Rec
from papyrine.operators import verification as Ver
from papyrine.session import table

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def text_sections(spark, d):
    s = E.text_sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def html_sections(spark, d):
    """Pages built from the documents: a heading, paragraphs, a note that is skipped, an open tag."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<html><h1>Abstract</h1><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>")), F.lit("<aside>note</aside><h2>2 Results</h2><p>"), "text", F.lit("</html>")).alias("html"))
    s = E.html_sections(docs, "doc_id", "html")
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


def contact_lines(spark, d):
    p = _papers(spark, d).where("size(authors) > 0")
    one = F.element_at("authors", 1)
    mail = F.concat(X.slug(one), F.lit("@example.org"))
    line = F.concat(F.lit("Intro. Correspondence to: "), F.regexp_replace(one, ",", ""), F.lit(" <"), mail, F.lit(">, someone <"), mail, F.lit(">. Preprint. other@x.org"))
    return p.select("event_id", F.explode(E.contacts(line)).alias("c")).select("event_id", "c.name", "c.email")


CONTACT_LINES = f"""with {_P}, a as (select event_id, authors[1] as a from p where len(authors) > 0), m as (select event_id, regexp_replace(a, ',', '', 'g') as n, lower(trim(regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g'), '-')) || '@example.org' as m from a)
select event_id, nullif(regexp_extract(n, '([A-Z][\\w.''\\-]*(?:\\s+[A-Z][\\w.''\\-]*){{0,3}})$', 1), '') as name, m as email from m"""


def repo_links(spark, d):
    p = _papers(spark, d).where("event_id is not null")
    name = X.slug(F.substring_index("title", ":", 1))
    line = F.concat(
        F.lit("We study a problem. Our code is available at https://github. com/lab-"), F.col("year").cast("string"), F.lit("/"), name, F.lit(".git. We use the data from https://huggingface.co/datasets/other/set. "),
        F.lit("See https://github.com/topics/x and https://lab.github.io/"), name, F.lit("). Weights: https://zenodo.org/record/"), (F.col("event_id") + 100000).cast("string"), F.lit("."),
    )
    return E.links(p.select("event_id", line.alias("text")), "event_id", "text").select("event_id", "own", "kind", "host", "repo", "evidence", "rank")


_SLUG = "trim(regexp_replace(lower(split_part(title, ':', 1)), '[^a-z0-9]+', '-', 'g'), '-')"
REPO_LINKS = f"""with {_P} select event_id, true as own, 'code' as kind, 'gh' as host, 'lab-' || year || '/' || {_SLUG} as repo, 'ao' as evidence, 1 as rank from p
union all select event_id, false, 'data', 'hfd', 'other/set', '', 1 from p union all select event_id, false, 'page', 'page', 'lab.github.io/' || {_SLUG}, '', 2 from p
union all select event_id, false, 'data', 'zenodo', (event_id + 100000)::varchar, '', 3 from p"""


def url_kinds(spark, d):
    """Paper addresses put on several hosts, read by host and path."""
    p = _papers(spark, d)
    hosts = ["https://github.com/a{}/b.git", "https://www.gitlab.com/A{}/B", "https://hf.co/models/a{}/m,", "https://huggingface.co/spaces/a{}/s", "https://osf.io/{}x", "https://example.org/{}"]
    urls = F.array(*[F.concat(F.lit(h.split("{}")[0]), F.col("event_id").cast("string"), F.lit(h.split("{}")[1])) for h in hosts])
    c = E.classify_url(F.col("url"))
    return p.select(F.explode(urls).alias("url")).select("url", c["kind"].alias("kind"), c["repo"].alias("repo"))


URL_KINDS = f"""with {_P} select 'https://github.com/a' || event_id || '/b.git' as url, 'gh' as kind, 'a' || event_id || '/b' as repo from p
union all select 'https://www.gitlab.com/A' || event_id || '/B', 'gl', 'a' || event_id || '/b' from p union all select 'https://hf.co/models/a' || event_id || '/m,', 'hfm', 'a' || event_id || '/m' from p
union all select 'https://huggingface.co/spaces/a' || event_id || '/s', 'hfs', 'a' || event_id || '/s' from p union all select 'https://osf.io/' || event_id || 'x', 'osf', event_id || 'x' from p
union all select 'https://example.org/' || event_id, null, null from p"""


def text_repairs(spark, d):
    """Extraction artefacts put right in every abstract: hyphens at breaks, citations, TeX, frames."""
    a = F.col("abstract")
    p = _papers(spark, d).where("abstract is not null")
    broken = F.concat(F.lit("In this paper, we propose "), a, F.lit(" condition- ing token- level $\\alpha$ [3, 12] (Lee et al., 2024) \\textbf{end}"))
    fixed = E.elide(E.detex(E.strip_citations(E.dehyphen(broken))))
    return p.select("event_id", fixed.alias("fixed"), E.standalone(a).alias("standalone"))


def title_pieces(spark, d):
    """Titles found again in answers written as lists, bold and quoted text."""
    p = _papers(spark, d).select("event_id", X.squeeze(F.col("title")).alias("title")).where("title is not null")
    plain = F.regexp_replace("title", '[*"“”]', " ")
    text = F.concat(F.lit("See **"), plain, F.lit("** and\n- "), plain, F.lit(" – good\n"))
    f = p.select("event_id", F.explode(E.markdown_titles(text)).alias("piece"), X.norm(F.col("title")).alias("key"), E.titleish(F.col("title")).alias("titleish"))
    return f.groupBy("event_id").agg(F.bool_or(F.col("piece") == F.col("key")).alias("found"), F.first("titleish").alias("titleish"))


_SQ = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
_TW = f"regexp_extract_all({_SQ}, '[\\p{{L}}][\\p{{L}}\\-]{{2,}}')"
TITLE_PIECES = f"""with {_P}, t as (select event_id, regexp_replace({_SQ}, '[*"“”]', ' ', 'g') as s, {_TW} as w, trim(regexp_replace(lower({_SQ}), '[^a-z0-9]+', ' ', 'g')) as key from p where title is not null)
select event_id, true as found, len(w) >= 5 and len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.6 * len(w) as titleish from t where length(s) between 8 and 200 and length(key) >= 8"""


def figure_scan(spark, d):
    """Figures of every abstract: how many, their sum, and how many are whole numbers."""
    p = _papers(spark, d).where("abstract is not null").select("event_id", F.explode(Ver.figures(F.col("abstract"))).alias("f"))
    return p.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("f").cast("double")), 6).alias("total"), F.count(F.when(Ver.decimals(F.col("f")) == 0, 1)).alias("whole"))


FIGURE_SCAN = f"""with {_P}, x as (select event_id, unnest(regexp_extract_all(replace(abstract, '−', '-'), '-?\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?')) as f from p where abstract is not null)
select event_id, count(*) as n, round(sum(replace(f, ',', '')::double), 6) as total, count(*) filter (not contains(f, '.')) as whole from x where not regexp_matches(f, '^(19|20)\\d\\d$') group by 1"""


def figure_checks(spark, d):
    """Figures of an abstract against the pool of its extraction result: ok, derived or no."""
    f = Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", Ver.figure_pool(F.to_json("facts")).alias("pool"))
    a = _papers(spark, d).where("abstract is not null").select("event_id", "abstract")
    return Ver.check_figures(a.join(f, "event_id"), "abstract", "pool").groupBy("verdict").agg(F.count("*").alias("n"))


def figure_pool(spark, d):
    """Figures of the events' JSON payloads."""
    e = table(spark, d, "events").select("event_id", F.explode(Ver.figure_pool("props")).alias("value"))
    return e.groupBy(F.pmod("event_id", F.lit(10)).alias("digit")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


FIGURE_POOL = "select event_id % 10 as digit, count(*) as n, sum((props->>'k')::double) as total from events group by 1"


def answer_segments(spark, d):
    """Answers with a quote and a figure anchor, one per paper, cut into segments."""
    p = _papers(spark, d).where("event_id is not null")
    text = F.concat(F.lit("As ⟦"), F.col("event_id").cast("string"), F.lit("|"), F.regexp_replace("title", r"[⟦⟧|]", ""), F.lit("⟧ shows, "), F.lit("⟦field_trend:graphs|"), F.col("year").cast("string"), F.lit("⟧ of them grew."))
    s = Ver.answer_segments(p.select("event_id", text.alias("text")), "event_id", "text")
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("refs"))


ANSWER_SEGMENTS = f"with {_P} select 'prose' as kind, 3 * count(*) as n, 0 as refs from p union all select 'quote', count(*), count(distinct event_id) from p union all select 'figure', count(*), 1 from p"


def license_lines(spark, d):
    """Documents that hold a phrase, in any case (exhaustive scan)."""
    t = table(spark, d, "documents")
    return t.where(F.contains(F.lower("text"), F.lit("released")) | F.contains(F.lower("text"), F.lit("release a"))).select("doc_id")


LICENSE_LINES = "select doc_id from documents where contains(lower(text), 'released') or contains(lower(text), 'release a')"

QUERIES = [
    ("text_sections", text_sections, None),
    ("html_sections", html_sections, None),
    ("contact_lines", contact_lines, CONTACT_LINES),
    ("repo_links", repo_links, REPO_LINKS),
    ("url_kinds", url_kinds, URL_KINDS),
    ("text_repairs", text_repairs, None),
    ("title_pieces", title_pieces, TITLE_PIECES),
    ("figure_scan", figure_scan, FIGURE_SCAN),
    ("figure_checks", figure_checks, None),
    ("figure_pool", figure_pool, FIGURE_POOL),
    ("answer_segments", answer_segments, ANSWER_SEGMENTS),
    ("license_lines", license_lines, LICENSE_LINES),
]
