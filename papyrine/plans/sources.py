"""Sources and sinks read back, and column functions over whole tables, each beside its SQL.

Files are written under the shared checkpoint folder and read again by the readers under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import stats
from papyrine.functions import text as X
from papyrine.operators import enrichment as En
from papyrine.operators import extraction as E
from papyrine.operators import records as Rec
from papyrine.operators import tools as Tool
from papyrine.operators import vectors as Vec
from papyrine.operators import vocabulary as Voc
from papyrine.plans.streams import _work
from papyrine.session import table
from papyrine.sources import files
from papyrine.streaming import ingest

_P = "p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers where event_id is not null) where rn = 1)"
_F = "f as (select event_id, facts from (select *, row_number() over (partition by event_id order by extracted_at desc, source, model) as rn from facts_abstract where ok) where rn = 1)"


def _papers(spark, d):
    return Rec.latest(table(spark, d, "papers"), "event_id", "ingested_at")


def _facts(spark, d):
    return Rec.latest(table(spark, d, "facts_abstract").where("ok"), "event_id", "extracted_at", "source", "model").select("event_id", "facts")


# --- files -----------------------------------------------------------------------------------


def source_jsonl(spark, d):
    """Papers written as JSON lines and read back, and a file that is not there."""
    at = _work(spark)
    p = _papers(spark, d).select("event_id", "title", "authors", "year")
    files.write_jsonl(p, f"{at}/papers")
    schema = "event_id long, title string, authors array<string>, year int"
    r = files.read_jsonl(spark, f"{at}/papers", schema).unionByName(files.read_jsonl(spark, f"{at}/none", schema))
    return r.select("event_id", "title", F.array_join("authors", "; ").alias("authors"), "year")


SOURCE_JSONL = f"with {_P} select event_id, title, array_to_string(authors, '; ') as authors, year from p"


def source_json(spark, d):
    """One document that holds a whole table, read as such."""
    at = _work(spark)
    doc = table(spark, d, "nation").agg(F.to_json(F.struct(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))).alias("value"))
    doc.coalesce(1).write.text(f"{at}/doc")
    r = files.read_json(spark, f"{at}/doc")
    return r.select("n", F.explode("rows").alias("r")).select("n", "r.n_nationkey", "r.n_name")


SOURCE_JSON = "select (select count(*) from nation) as n, n_nationkey::bigint as n_nationkey, n_name from nation"


def source_snapshots(spark, d):
    """Feeds added under their dates: an empty feed and a date that is there change nothing; the newest is read."""
    root = f"{_work(spark)}/feed"
    p = _papers(spark, d).select("event_id", F.coalesce("abstract", F.lit("")).alias("body"))
    added = [files.add_snapshot(p.where("event_id % 3 = 0"), root, "2026-01-01", "body"), files.add_snapshot(p.where("event_id % 3 = 1"), root, "2026-02-01", "body")]
    added += [files.add_snapshot(p, root, "2026-02-01", "body"), files.add_snapshot(p.limit(0), root, "2026-03-01", "body")]
    return files.latest_snapshot(spark, root).select("event_id", "digest", F.lit(sum(added)).alias("added"))


SOURCE_SNAPSHOTS = f"with {_P} select event_id, sha256(coalesce(abstract, ''))[1:16] as digest, 2 as added from p where event_id % 3 = 1"


def source_remaining(spark, d):
    """Papers that have no extraction yet."""
    return files.remaining(_papers(spark, d).select("event_id", "venue"), table(spark, d, "facts_abstract").select("event_id").distinct(), "event_id")


SOURCE_REMAINING = f"with {_P} select event_id, venue from p where event_id not in (select event_id from facts_abstract)"


def source_listing(spark, d):
    """A proceedings page per venue and year, split into its entries."""
    t = F.regexp_replace(F.coalesce("title", F.lit("")), "[<>]", "")
    entry = F.concat(F.lit('<div class="paper"><p class="title">\n '), t, F.lit(' </p><a href="v1/'), F.col("event_id").cast("string"), F.lit('.pdf">x</a><a href="v1/'), F.col("event_id").cast("string"), F.lit('.html">y</a></div>'))
    pages = _papers(spark, d).groupBy("venue", "year").agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list(entry), ""), F.lit("</html>")).alias("html"))
    return files.split_listing(pages, "html", ["venue", "year"])


SOURCE_LISTING = f"with {_P} select venue, year, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[<>]', '', 'g'), '\\s+', ' ', 'g')) as title, 'v1/' || event_id || '.pdf' as pdf, 'v1/' || event_id || '.html' as url from p"


def source_harvest(spark, d):
    """Harvested pages of a hundred records each; deleted ones are left out."""
    r = table(spark, d, "arxiv_index").where("arxiv_base is not null").select("arxiv_base", F.regexp_replace(F.coalesce("title", F.lit("")), "[<>]", "").alias("title"), "date")
    deleted = F.when(F.col("arxiv_base").endswith("7"), F.lit(' status="deleted"')).otherwise(F.lit(""))
    record = F.concat(F.lit("<record><header"), deleted, F.lit("/><id>"), "arxiv_base", F.lit("</id><title>\n  "), "title", F.lit(" </title><created>"), F.coalesce("date", F.lit("")), F.lit("</created></record>"))
    pages = r.groupBy(F.pmod(F.xxhash64("arxiv_base", "title", "date"), F.lit(50)).alias("page")).agg(F.concat_ws("\n", F.collect_list(record)).alias("xml"))
    return files.harvest_records(pages, "xml")


SOURCE_HARVEST = "select arxiv_base, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[<>]', '', 'g'), '\\s+', ' ', 'g')) as title, nullif(trim(coalesce(date, '')), '') as date from arxiv_index where arxiv_base is not null and not ends_with(arxiv_base, '7')"


def source_term_tables(spark, d):
    """The tables of a search service written and read back: postings and rounded vectors."""
    at = _work(spark)
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    files.term_tables(posts, vectors, at)
    p = spark.read.parquet(f"{at}/postings").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("doc").alias("docs"))
    v = spark.read.parquet(f"{at}/vectors").agg(F.count("*").alias("vectors"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))), 2).alias("total"))
    return p.crossJoin(v)


SOURCE_TERM_TABLES = """with t as (select distinct doc_id as doc, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}')) as term from documents)
select count(*) as postings, count(distinct term) as terms, sum(doc)::bigint as docs, (select count(*) from embeddings) as vectors, (select round(sum(list_sum(list_transform(embedding, lambda x: round(x::double, 4)))), 2) from embeddings) as total from t"""


def stateful_counts(spark, d):
    """Events of each user counted in state over micro-batches; the last count of each is its number."""
    at = _work(spark)
    src = table(spark, d, "events").select("user_id", "event_id")
    src.repartition(4).write.parquet(f"{at}/in")
    seen = ingest.running_counts(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "user_id")

    def keep(batch, number: int) -> None:
        batch.write.mode("append").parquet(f"{at}/out")

    q = seen.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max("n").alias("n"))


STATEFUL_COUNTS = "select user_id, count(*) as n from events where user_id is not null group by 1"

# --- column functions ------------------------------------------------------------------------


def text_keys(spark, d):
    """Dashes folded, submission ids read, slugs, subsequences, terms as whole words."""
    p = _papers(spark, d).where("title is not null")
    first = F.substring_index("title", " ", 2)
    return p.select(
        "event_id", X.fold_dashes(F.concat(F.col("title"), F.lit(" – a—b--c"))).alias("dashes"), X.submission_id(F.col("paper_url")).alias("submission"), X.slug(F.col("title")).alias("slug"),
        E.is_subsequence(F.regexp_replace("title", "[aeiou]", ""), F.col("title")).alias("subsequence"), X.contains_term(F.col("title"), first).alias("opening"), X.contains_term(F.col("title"), F.lit("policy")).alias("policy"),
    )


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TEXT_KEYS = f"""with {_P}, t as (select *, array_to_string(string_split(title, ' ')[1:2], ' ') as first from p where title is not null)
select event_id, regexp_replace(title || ' – a—b--c', '[‐-―−]|--+', '-', 'g') as dashes, nullif(regexp_extract(paper_url, '[?&]id=([A-Za-z0-9_-]+)', 1), '') as submission, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') as slug, true as subsequence,
contains(' ' || {_N.format('title')} || ' ', ' ' || {_N.format('first')} || ' ') as opening, contains(' ' || {_N.format('title')} || ' ', ' policy ') as policy from t"""


def page_abstracts(spark, d):
    """Abstracts of pages built from the papers, tags and entities taken out."""
    p = _papers(spark, d).where("abstract is not null and not contains(abstract, '<') and not contains(abstract, '&')")
    page = F.concat(F.lit("<html><h3> Abstract </h3><p>"), F.replace("abstract", F.lit(" the "), F.lit(" <b>the</b> ")), F.lit(" a &lt; b &amp; c</p><h3>Next</h3>text"))
    return p.select("event_id", E.page_abstract(page).alias("abstract"))


PAGE_ABSTRACTS = f"""with {_P}, a as (select event_id, trim(regexp_replace(replace(abstract, ' the ', '  the  ') || ' a < b & c', '\\s+', ' ', 'g')) as a from p where abstract is not null and not contains(abstract, '<') and not contains(abstract, '&'))
select event_id, case when length(a) >= 40 and not contains(a[1:80], '{{') then a end as abstract from a"""


def masked_texts(spark, d):
    """Code, figures and names hidden before a rewrite and put back: every title survives."""
    kind = "event_id long, back boolean, held int"

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, E.unmask(*m) == t, len(m[1])) for i, t in zip(b["event_id"], b["title"]) for m in [E.mask(t)]]
            yield pd.DataFrame(rows, columns=["event_id", "back", "held"])

    p = _papers(spark, d).select("event_id", F.regexp_replace(F.coalesce("title", F.lit("")), "[&⟨⟩`]", "").alias("title"))
    return p.mapInPandas(run, kind).groupBy("back").agg(F.count("*").alias("n"))


MASKED_TEXTS = f"with {_P} select true as back, count(*) as n from p"


def axis_places(spark, d):
    """Prices on a logarithmic axis from 100."""
    return table(spark, d, "orders").select("o_orderkey", F.round(stats.log_axis(F.col("o_totalprice"), 100.0, 600_000.0), 6).alias("place"))


AXIS_PLACES = "select o_orderkey, round(case when o_totalprice <= 100 then 0 else ln(o_totalprice / 100) / ln(6000.0) * 100 end, 6) as place from orders"


def registry_states(spark, d):
    """Resources looked up: what became of each; of several answers the last counts."""
    p = _papers(spark, d).where("openreview_id is not null")
    reg = p.select(F.concat(F.lit("r"), F.pmod("event_id", F.lit(40)).cast("string")).alias("key")).distinct()
    answers = p.select(F.concat(F.lit("r"), F.pmod("event_id", F.lit(40)).cast("string")).alias("key"), F.col("event_id").alias("seq"), (F.col("n_authors") > 1).alias("found"), F.col("decision").isNull().alias("gone"), F.pmod("event_id", F.lit(7)).eqNullSafe(0).alias("error"))
    cache = En.last_write(answers.where("substring(key, -1) <> '3'"), "key", "seq").withColumn("name", F.when(F.col("seq") % 2 == 0, F.upper("key")).otherwise(F.concat("key", F.lit("-new"))))
    return En.registry_status(reg, cache, "key").groupBy("status").agg(F.count("*").alias("n"))


REGISTRY_STATES = f"""with {_P}, a as (select 'r' || (event_id % 40) as key, event_id as seq, n_authors > 1 as found, decision is null as gone, event_id % 7 = 0 as error from p where openreview_id is not null),
c as (select * from (select *, row_number() over (partition by key order by seq desc) as r from a where not ends_with(key, '3')) where r = 1)
select case when found is null then 'unknown' when error then 'error' when gone or not found then 'gone' when seq % 2 = 1 then 'renamed' else 'ok' end as status, count(*) as n from (select distinct key from a) left join c using (key) group by 1"""


def near_badges(spark, d):
    """Areas that reach a paper through its subarea only."""
    p = _papers(spark, d)
    own = p.where("area is not null and event_id % 2 = 0").select(F.col("area").alias("topic"), F.col("event_id").alias("doc"), F.lit(1).alias("kind"))
    via = p.where("area is not null and subarea is not null").select(F.col("area").alias("topic"), F.col("event_id").alias("doc"), F.lit(2).alias("kind"))
    return En.near_badge(own.union(via), "topic", "doc").groupBy("topic").agg(F.count("*").alias("n"), F.count(F.when(F.col("near"), 1)).alias("near"))


NEAR_BADGES = f"with {_P}, m as (select area, event_id, event_id % 2 = 0 as own from p where area is not null and (event_id % 2 = 0 or subarea is not null)) select area as topic, count(*) as n, count(*) filter (not own) as near from m group by 1"


def sized_parents(spark, d):
    """Method names under the name that begins or ends them, if that is as frequent."""
    m = _facts(spark, d).select("event_id", F.explode("facts.methods.name").alias("name")).where("name is not null")
    n = m.groupBy(F.lower(F.trim("name")).alias("label")).agg(F.count_distinct("event_id").alias("n"))
    return Voc.find_parents(n, n, size="n")


SIZED_PARENTS = f"with {_F}, n as (select lower(trim(name)) as label, count(distinct event_id) as n from (select event_id, unnest(facts.methods).name as name from f) where name is not null group by 1) select a.label, arg_max(b.label, (length(b.label), b.label)) as parent from n a join n b on (starts_with(a.label, b.label || ' ') or ends_with(a.label, ' ' || b.label)) and b.n >= a.n group by 1"


def renamed_terms(spark, d):
    """Affiliations through the known aliases, twice, and a correction by hand."""
    a = table(spark, d, "institution_aliases").where("alias is not null").groupBy(X.basic(F.col("alias")).alias("term")).agg(F.min(X.basic(F.col("canonical"))).alias("canonical"))
    t = _papers(spark, d).where("institution is not null").select("institution").distinct()
    fix = t.sparkSession.createDataFrame([("voluluvo ai lab", "voluluvo")], "term string, canonical string")
    return En.rename_terms(t, "institution", a, fix).groupBy("canonical").agg(F.count("*").alias("n"))


_B = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[\\s.,;:]+$', ''), '[\\s\\-_/]+', ' ', 'g'))"
RENAMED_TERMS = f"""with {_P}, a as (select {_B.format('alias')} as term, min({_B.format('canonical')}) as c from institution_aliases where alias is not null group by 1), t as (select distinct institution, {_B.format('institution')} as k from p where institution is not null),
one as (select coalesce(c, k) as k from t left join a on a.term = k), two as (select coalesce(c, k) as k from one left join a on a.term = k) select case when k = 'voluluvo ai lab' then 'voluluvo' else k end as canonical, count(*) as n from two group by 1"""


def decoded_vectors(spark, d):
    """Compact codes expanded again: they point the way of the components they came from."""
    c = Vec.compact_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 16)
    back = Vec.expand_codes(c, "vec_id")
    code = F.transform("code", lambda x: x.cast("double"))
    return back.join(c, "vec_id").select("vec_id", (Vec.dot(Vec.normalise(code), F.col("vec")) > 0.999999).alias("same")).groupBy("same").agg(F.count("*").alias("n"))


DECODED_VECTORS = "select true as same, count(*) as n from embeddings"


def recomputed_figures(spark, d):
    """Claims run again: one that holds, one that does not, one that cannot be run."""
    from papyrine.plans.tools import store

    s = store(spark, d)
    n = s.topics.groupBy("topic").agg(F.count_distinct("gid").alias("n")).agg(F.max("n")).first()[0]
    states = [Tool.recompute(spark, s, "list_topics", float(n), "total"), Tool.recompute(spark, s, "list_topics", -5.0, "total"), Tool.recompute(spark, s, "search_papers", 1.0, "score", query="x"), Tool.recompute(spark, s, "field_trend", 1.0, "nothing", topic="x")]
    return spark.createDataFrame([(i, x) for i, x in enumerate(states)], "claim int, state string")


RECOMPUTED_FIGURES = "select 0 as claim, 'ok' as state union all select 1, 'no' union all select 2, 'na' union all select 3, 'na'"

QUERIES = [
    ("source_jsonl", source_jsonl, SOURCE_JSONL),
    ("source_json", source_json, SOURCE_JSON),
    ("source_snapshots", source_snapshots, SOURCE_SNAPSHOTS),
    ("source_remaining", source_remaining, SOURCE_REMAINING),
    ("source_listing", source_listing, SOURCE_LISTING),
    ("source_harvest", source_harvest, SOURCE_HARVEST),
    ("source_term_tables", source_term_tables, SOURCE_TERM_TABLES),
    ("stateful_counts", stateful_counts, STATEFUL_COUNTS),
    ("text_keys", text_keys, TEXT_KEYS),
    ("page_abstracts", page_abstracts, PAGE_ABSTRACTS),
    ("masked_texts", masked_texts, MASKED_TEXTS),
    ("axis_places", axis_places, AXIS_PLACES),
    ("registry_states", registry_states, REGISTRY_STATES),
    ("near_badges", near_badges, NEAR_BADGES),
    ("sized_parents", sized_parents, SIZED_PARENTS),
    ("renamed_terms", renamed_terms, RENAMED_TERMS),
    ("decoded_vectors", decoded_vectors, DECODED_VECTORS),
    ("recomputed_figures", recomputed_figures, RECOMPUTED_FIGURES),
]
