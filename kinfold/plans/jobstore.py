"""The store of jobs over events: a job is a user's, an event of the first type takes it away, others save it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.plans.registry import query
from kinfold.streaming import jobstore as J

#: Seconds that a job lives here.
TTL = 6 * 3600.0


def job_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = e.agg(F.min("event_type")).first()[0]
    kind = F.when(F.col("event_type") == first, "remove").otherwise("save")
    ttl = F.when(F.col("event_id") % 7 == 0, F.lit(1800.0))
    return e.select(F.col("user_id").cast("string").alias("job"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("order"), ttl.alias("ttl"))


# With one owner a job, what becomes of it follows from an event and the next.
@query(f"""with e as (select user_id::varchar job, 'u' || (user_id % 5) owner_, event_type = (select min(event_type) from events) gone, ts, event_id, case when event_id % 7 = 0 then 1800 else {TTL} end ttl from events),
n as (select *, lead(ts) over w nxt, lag(ts) over w before_ts, lag(ttl) over w before_ttl, lag(gone) over w before_gone, (select max(ts) from events) last_ from e window w as (partition by job order by ts, event_id)),
p as (select *, not coalesce(before_gone, true) and epoch_us(before_ts) + before_ttl * 1000000 > epoch_us(ts) held from n)
select job, owner_ as owner, case when not gone then 'saved' when held then 'removed' else 'refused' end what, strftime(ts, '%Y-%m-%d %H:%M:%S') on_time from p
union all select job, owner_, 'expired', strftime(ts + to_microseconds((ttl * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') from p where not gone and epoch_us(ts) + ttl * 1000000 <= epoch_us(coalesce(nxt, last_))""")
def job_store_log(spark, sf_dir):
    return J.job_log(job_events(spark, sf_dir), TTL).select("job", "owner", "what", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("on_time"))


@query(f"""with e as (select user_id::varchar job, 'u' || (user_id % 5) "user", event_type = (select min(event_type) from events) gone, epoch_us(ts) / 1000000.0::double + case when event_id % 7 = 0 then 1800 else {TTL} end until, row_number() over (partition by user_id order by ts desc, event_id desc) r from events)
select job, "user", strftime(make_timestamp((until * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') until from e where r = 1 and not gone and until > (select max(epoch_us(ts)) / 1000000.0::double from events)""")
def job_store_live(spark, sf_dir):
    events = job_events(spark, sf_dir)
    now = events.agg(F.max("at").cast("double")).first()[0]
    return J.live_jobs(events, TTL, now).select("job", "user", F.date_format(F.timestamp_micros(F.round(F.col("until") * 1000000).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("until"))
