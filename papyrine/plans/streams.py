"""Stream queries: run to the end of the files and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from papyrine.session import checkpoint_dir, table
from papyrine.streaming import ingest


def _work(spark) -> str:
    """A folder of our own under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"streams-{uuid.uuid4().hex}")


def stream_ingest(spark, d):
    """Papers streamed in and delivered once each: ids per venue and year."""
    src = table(spark, d, "papers").select("event_id", "venue", "year", "ingested_at")
    at = _work(spark)
    src.write.parquet(f"{at}/in")
    s = ingest.once(ingest.file_stream(spark, f"{at}/in", src.schema), "event_id", "ingested_at", "3650 days")
    q = ingest.append(s, f"{at}/out", f"{at}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("venue", "year").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


STREAM_INGEST = "select venue, year, count(*) as n, count(*) as ids from (select distinct event_id, venue, year from papers) group by 1, 2"


def event_sessions(spark, d):
    s = ingest.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


EVENT_SESSIONS = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g), c as (select user_id, k, count(*) as n from s group by 1, 2)
select user_id, count(*) as sessions, sum(n)::bigint as events, max(n) as longest from c group by 1"""


def daily_counts(spark, d):
    c = ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")
    return c.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


DAILY_COUNTS = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2"

QUERIES = [
    ("stream_ingest", stream_ingest, STREAM_INGEST),
    ("event_sessions", event_sessions, EVENT_SESSIONS),
    ("daily_counts", daily_counts, DAILY_COUNTS),
]
