"""Trend queries.  Topic, edition and venue stand-ins: see README."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import trends as T
from papyrine.session import table

R = 6  # digits of every rounded figure


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, R))
    return df


# field_trend: event types over weeks
def field_trend(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("edition"), F.col("event_type").alias("topic"))
    totals = e.groupBy("edition").agg(F.count("*").alias("total"))
    counts = e.groupBy("edition", "topic").agg(F.count("*").alias("n")).join(F.broadcast(totals), "edition")
    return _rounded(T.share_trend(counts, "topic", "edition"), "per_1k", "change", "z")


_Z = """case when t0 is null then null when p * (1 - p) * (1.0 / t0 + 1.0 / total) > 1e-12
   then (n::double / total - n0::double / t0) / sqrt(p * (1 - p) * (1.0 / t0 + 1.0 / total)) else 0 end"""
FIELD_TREND = f"""
with e as (select date_trunc('week', ts)::date as edition, event_type as topic from events),
t as (select edition, count(*) as total from e group by 1),
c as (select edition, topic, count(*) as n, any_value(total) as total from e join t using (edition) group by 1, 2),
l as (select *, lag(n) over w as n0, lag(total) over w as t0 from c window w as (partition by topic order by edition)),
s as (select *, (n + n0)::double / (total + t0) as p from l)
select edition, topic, n, total, round(1000.0 * n / total, 6) as per_1k,
  case when t0 is not null then round(1000.0 * n / total - 1000.0 * n0 / t0, 6) end as change,
  round({_Z}, 6) as z, abs({_Z}) >= 2.576 as significant_99
from s"""


# field_trend_venues: order priorities per region and year
def _orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    place = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(place.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("venue"), "n_name", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("doc")
    )


_ORDERS = """with o as (select r_name as venue, n_name, year(o_orderdate)::int as year, o_orderpriority as topic, o_orderkey as doc
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _order_counts(o):
    totals = o.groupBy("venue", "year").agg(F.count("*").alias("total"))
    return o.groupBy("venue", "year", "topic").agg(F.count("*").alias("n")).join(totals, ["venue", "year"])


def field_trend_venues(spark, d):
    c = T.last_editions(_order_counts(_orders(spark, d)), "venue", "year", 3)
    return _rounded(T.share_trend(c, "topic", "year", ["venue"]), "per_1k", "change", "z")


FIELD_TREND_VENUES = f"""
{_ORDERS},
t as (select venue, year, count(*) as total, row_number() over (partition by venue order by year desc) - 1 as age from o group by 1, 2),
c as (select venue, year, topic, count(*) as n, any_value(total) as total, any_value(age) as age from o join t using (venue, year) where age < 3 group by 1, 2, 3),
l as (select *, lag(n) over w as n0, lag(total) over w as t0 from c window w as (partition by venue, topic order by year)),
s as (select *, (n + n0)::double / (total + t0) as p from l)
select venue, year, topic, n, total, age::int as age, round(1000.0 * n / total, 6) as per_1k,
  case when t0 is not null then round(1000.0 * n / total - 1000.0 * n0 / t0, 6) end as change,
  round({_Z}, 6) as z, abs({_Z}) >= 2.576 as significant_99
from s"""


# movers: paper areas and subareas, last two editions of each venue
def _topics(spark, d):
    """(venue, year, event_id, area, subarea) of the latest delivery of every entry."""
    from papyrine.operators.records import latest

    p = latest(table(spark, d, "papers"), "event_id", "ingested_at").select("venue", "year", "event_id", "area", "subarea")
    return p


_LATEST = """with p as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingested_at desc, title) as rn from papers) where rn = 1)"""


def _lanes(spark, d):
    p = T.last_editions(_topics(spark, d), "venue", "year", 2)
    side = 1 - F.col("age")
    totals = p.groupBy("venue").agg(F.count(F.when(side == 0, 1)).alias("t0"), F.count(F.when(side == 1, 1)).alias("t1"))
    counts = p.where("subarea is not null").groupBy("venue", "subarea", "age").agg(F.count("*").alias("n"))
    return T.movers(T.paired(counts, ["venue", "subarea"], side, totals, ["venue"]).where("n0 + n1 >= 4"), delta=2.0, ratio=1.5, bar=1.0)


def mover_lanes(spark, d):
    return _rounded(_lanes(spark, d), "share0", "share1", "z")


_LANES = f"""{_LATEST},
v as (select venue, year, row_number() over (partition by venue order by year desc) - 1 as age from (select distinct venue, year from p)),
q as (select p.*, age from p join v using (venue, year) where age < 2),
t as (select venue, count(*) filter (age = 1) as t0, count(*) filter (age = 0) as t1 from q group by 1),
n as (select venue, subarea, count(*) filter (age = 1) as n0, count(*) filter (age = 0) as n1 from q where subarea is not null group by 1, 2),
b as (select *, (n0 + n1)::double / (t0 + t1) as p, 1000.0 * n0 / greatest(t0, 1) as share0, 1000.0 * n1 / greatest(t1, 1) as share1 from n join t using (venue) where n0 + n1 >= 4),
z as (select *, case when p * (1 - p) * (1.0 / t0 + 1.0 / t1) > 1e-12 then (n1::double / t1 - n0::double / t0) / sqrt(p * (1 - p) * (1.0 / t0 + 1.0 / t1)) else 0 end as z from b),
m as (select *, case when not (abs(z) >= 1.0 and (abs(share0 - share1) >= 2 or (least(share0, share1) > 0 and greatest(share0, share1) >= 1.5 * least(share0, share1)))) then 'steady'
  when n0 = 0 and n1 > 0 then 'new' when z > 0 then 'rising' else 'falling' end as direction from z)"""
MOVER_LANES = _LANES + " select venue, subarea, n0, n1, t0, t1, round(share0, 6) as share0, round(share1, 6) as share1, round(z, 6) as z, direction from m"


def movers_sections(spark, d):
    return _rounded(T.mover_sections(_lanes(spark, d), "subarea", "venue"), "max_z", "share")


MOVERS_SECTIONS = _LANES + """,
i as (select subarea, count(*) filter (direction in ('rising', 'new')) as up, count(*) filter (direction = 'falling') as down,
  min(direction) filter (direction in ('rising', 'new')) as kind, max(abs(z)) as max_z, sum(n1) as n1, sum(t1) as t1 from m where direction <> 'steady' group by 1),
s as (select *, case when down > 0 then 'falling' else kind end as section, up + down as venues, 1000.0 * n1 / greatest(t1, 1) as share from i where up = 0 or down = 0),
r as (select *, row_number() over (partition by section order by case when section = 'rising' then venues else 0 end desc, case when section = 'new' then share else max_z end desc, subarea) as rank from s)
select section, rank::int as rank, subarea, venues, round(max_z, 6) as max_z, round(share, 6) as share from r where rank <= 5"""


# inside_mix: brands inside part types, by year sides
def _mix_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate")
    pt = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    j = li.join(pt, F.col("l_partkey") == F.col("p_partkey"))
    side = F.when(F.year("l_shipdate") < 1998, 0).otherwise(1)
    c = j.groupBy("p_type", "p_brand", side.alias("side")).agg(F.count("*").alias("n"))
    totals = c.groupBy("p_type").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("t0"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("t1"))
    return T.paired(c, ["p_type", "p_brand"], F.col("side"), totals, ["p_type"])


def inside_mix(spark, d):
    return _rounded(T.inside_shifts(_mix_pairs(spark, d), "p_type", "p_brand", least=6, delta=1.0, ratio=1.05, top=4, bar=1.5), "z")


INSIDE_MIX = """
with j as (select p_type, p_brand, case when year(l_shipdate) < 1998 then 0 else 1 end as side from lineitem join part on l_partkey = p_partkey),
t as (select p_type, count(*) filter (side = 0) as t0, count(*) filter (side = 1) as t1 from j group by 1),
n as (select p_type, p_brand, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from j group by 1, 2 having count(*) >= 6),
b as (select *, (n0 + n1)::double / (t0 + t1) as p, 1000.0 * n0 / greatest(t0, 1) as a, 1000.0 * n1 / greatest(t1, 1) as c from n join t using (p_type)),
z as (select *, case when p * (1 - p) * (1.0 / t0 + 1.0 / t1) > 1e-12 then (n1::double / t1 - n0::double / t0) / sqrt(p * (1 - p) * (1.0 / t0 + 1.0 / t1)) else 0 end as z0 from b),
k as (select *, case when n0 <= 1 and n1 >= 8 then 'appeared' when n1 <= 1 and n0 >= 8 then 'vanished'
  when abs(z0) >= 1.5 and (abs(a - c) >= 1.0 or (least(a, c) > 0 and greatest(a, c) >= 1.05 * least(a, c))) then 'moved' end as kind from z),
f as (select *, case kind when 'appeared' then 3.0 when 'vanished' then -3.0 else z0 end as z from k where kind is not null),
r as (select *, row_number() over (partition by p_type order by abs(z) desc, p_brand) as rank from f)
select p_type, rank::int as rank, p_brand, kind, n0, n1, round(z, 6) as z from r where rank <= 4"""


# fresh_items: datasets named in extraction results, by year of extraction
def fresh_items(spark, d):
    f = table(spark, d, "facts_abstract").where("ok")
    names = f.select("event_id", F.year("extracted_at").alias("year"), F.explode("facts.datasets.name").alias("name")).where("name is not null")
    side = F.when(F.col("year") < 2025, 0).otherwise(1)
    c = names.groupBy("name", side.alias("side")).agg(F.count_distinct("event_id").alias("n"))
    return T.fresh_items(T.paired(c, ["name"], F.col("side")), 2).select("name", F.col("n1").alias("n"))


FRESH_ITEMS = """
with n as (select event_id, year(extracted_at) as y, unnest(facts.datasets).name as name from facts_abstract where ok),
c as (select name, count(distinct event_id) filter (y < 2025) as n0, count(distinct event_id) filter (y >= 2025) as n1 from n where name is not null group by 1)
select name, n1 as n from c where n0 = 0 and n1 >= 2"""


# rollup_totals: orders over region, nation, year
def rollup_totals(spark, d):
    o = _orders(spark, d)
    g = o.rollup("venue", "n_name", "year").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"), F.grouping_id().alias("level"))
    return g.select("venue", "n_name", "year", "n", "topics", F.col("level").cast("long").alias("level"))


ROLLUP_TOTALS = f"""{_ORDERS} select venue, n_name, year, count(*) as n, count(distinct topic) as topics, grouping_id(venue, n_name, year)::bigint as level
from o group by rollup (venue, n_name, year)"""


# topic_totals: papers per area, a column for each edition
def topic_totals(spark, d):
    p = _topics(spark, d).where("area is not null")
    years = [2024, 2025, 2026]
    g = p.groupBy("area").pivot("year", years).agg(F.count("event_id"))
    total = p.groupBy("area").agg(F.count("*").alias("total"))
    return g.join(total, "area").select("area", "total", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


TOPIC_TOTALS = f"""{_LATEST} select area, count(*) as total, count(*) filter (year = 2024) as y2024, count(*) filter (year = 2025) as y2025, count(*) filter (year = 2026) as y2026
from p where area is not null group by 1"""


def shift_tests(spark, d):
    """Every brand's shift with its z; p-values adjusted for the number of tests (no SQL: erfc)."""
    from papyrine.functions.stats import two_sided_p

    m = T.movers(_mix_pairs(spark, d), delta=1.0, ratio=1.05).withColumn("p", two_sided_p(F.col("z")))
    return T.adjusted_p(m, "p", ["p_type"], "p_brand").select("p_type", "p_brand", "n0", "n1", "z", "p", "p_adjusted")


QUERIES = [
    ("field_trend", field_trend, FIELD_TREND),
    ("field_trend_venues", field_trend_venues, FIELD_TREND_VENUES),
    ("mover_lanes", mover_lanes, MOVER_LANES),
    ("movers_sections", movers_sections, MOVERS_SECTIONS),
    ("inside_mix", inside_mix, INSIDE_MIX),
    ("fresh_items", fresh_items, FRESH_ITEMS),
    ("rollup_totals", rollup_totals, ROLLUP_TOTALS),
    ("topic_totals", topic_totals, TOPIC_TOTALS),
    ("shift_tests", shift_tests, None),
]
