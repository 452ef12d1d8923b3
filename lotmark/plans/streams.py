"""Streams over the events, each with the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotmark.operators import records
from lotmark.plans.base import query
from lotmark.streaming import jobs, keyed


def _events(m):
    events = jobs.stream(m.spark, f"{m.folder}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st05_latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, epoch_us(arg_max(ts, event_id)) AS at_us FROM events GROUP BY user_id")
def latest_state(m):
    events = _events(m).select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at_us"))
    return jobs.latest_state(events, jobs.shared_folder(m.spark), ["user_id"], "event_id")


@query("st01_ingested_once", "SELECT event_id, user_id, event_type FROM events")
def ingested_once(m):
    twice = _events(m).select("event_id", "user_id", "event_type").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("_copy")
    return jobs.ingest_once(twice, jobs.shared_folder(m.spark), "event_id")


@query(
    "x01_tumbling_windows",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM events GROUP BY ALL",
)
def tumbling(m):
    aggs = [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total")]
    out = jobs.windowed(_events(m), jobs.shared_folder(m.spark), "ts", "1 hour", None, "1 day", [F.col("event_type")], aggs)
    return out.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


@query(
    "x02_sliding_windows",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, user_id FROM events) SELECT epoch_us(s) AS start_us, count(*) AS n FROM w GROUP BY 1""",
)
def sliding(m):
    out = jobs.windowed(_events(m), jobs.shared_folder(m.spark), "ts", "1 hour", "30 minutes", "1 day", [], [F.count("*").alias("n")])
    return out.select(F.unix_micros("window.start").alias("start_us"), "n")


@query(
    "x03_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""",
)
def sessions(m):
    """The sessions that are over by the watermark, a day before the last event."""
    out = jobs.sessions(_events(m), jobs.shared_folder(m.spark), "ts", "30 minutes", "1 day", "user_id", [F.count("*").alias("n")])
    return out.select("user_id", F.unix_micros("session.start").alias("start_us"), "n")


@query(
    "st04_checked",
    "SELECT CASE WHEN value >= 0 AND event_type <> 'error' THEN 'accepted' WHEN event_type = 'error' THEN 'retry' ELSE 'dead' END AS outcome, count(*) AS n FROM events GROUP BY 1",
)
def checked(m):
    folder = jobs.shared_folder(m.spark)
    problem = F.when(F.col("event_type") == "error", "unavailable").when(F.col("value") < 0, "invalid")
    jobs.ingest_checked(_events(m).select("event_id", "event_type", "value"), folder, problem, F.col("problem") == "unavailable")
    return jobs.batches(m.spark, folder, "checked").groupBy("outcome").agg(F.count("*").alias("n"))


@query("st06_suppressed", "SELECT DISTINCT user_id, event_type FROM events")
def suppressed(m):
    return jobs.ingest_once(_events(m).select("user_id", "event_type"), jobs.shared_folder(m.spark), "user_id", "event_type")


@query(
    "st03_job_states",
    """WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id AS job_id, CASE user_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'paused' WHEN 2 THEN 'stopped' WHEN 3 THEN 'running' ELSE 'created' END AS state,
  CASE user_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS n_refused, CASE user_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 2 WHEN 0 THEN 2 ELSE 1 END AS attempts FROM e""",
)
def job_states(m):
    """A log for each user: five courses, two of them with an action that their state refuses."""
    courses = ("start pause resume finish", "start pause", "start fail stop resume", "start lose resume", "finish")
    log = F.create_map(*[x for k, c in enumerate(courses) for x in (F.lit(k), F.split(F.lit(c), " "))])
    jobs_ = m.table("events").select(F.col("user_id").alias("job_id")).distinct()
    events = jobs_.select("job_id", F.posexplode(log[(F.col("job_id") % 5).cast("int")]).alias("seq", "action"))
    return jobs.job_states(events)


@query(
    "a35_job_snapshot",
    """WITH p AS (SELECT user_id, event_id, event_type, event_id % 4 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events)
SELECT event_type, count(*) AS total, count(*) FILTER (k = 0) AS completed, count(*) FILTER (k = 1) AS failed, count(*) FILTER (k = 2) AS running, count(*) FILTER (k = 3) AS pending, max(attempt) AS most_attempts FROM p GROUP BY event_type""",
)
def job_snapshot(m):
    """Attempts are numbered within a user, as within a notice."""
    e = m.table("events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "failed", "running", "pending")]), (F.col("event_id") % 4 + 1).cast("int"))
    return jobs.snapshot(records.attempts(e.withColumn("status", status), ["user_id"], "event_id"), ["event_type"])


@query(
    "st07_stale_sources",
    """WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'gone' WHEN b.h IS NULL THEN 'new' ELSE 'changed' END AS state FROM b FULL JOIN a USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""",
)
def stale_sources(m):
    """Two listings of all documents: some are only in one of them, and every third has other content."""
    text = F.coalesce("text", F.lit(""))
    before = m.table("documents").where("doc_id % 7 <> 0").select("doc_id", F.sha2(text, 256).alias("sha256"))
    after = m.table("documents").where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("sha256"))
    return jobs.stale(before, after, "doc_id")


HOUR = 3_600_000


@query(
    "st05_keyed_state",
    f"""WITH last AS (SELECT user_id, event_type, max(event_id) AS event_id, epoch_us(max(ts)) // 1000 AS at_ms FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id, at_ms FROM last WHERE at_ms + {HOUR} > (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
)
def keyed_state(m):
    """The latest event of each user and type, read from the stream's state; those with none in the last hour have left it."""
    folder = jobs.shared_folder(m.spark)
    keyed.advance(_events(m).select("user_id", "event_type", "event_id", "ts"), folder, ["user_id", "event_type"], ["event_id"], "ts", silent_ms=HOUR)
    return keyed.current(m.spark, folder).select("user_id", "event_type", "event_id", F.col("_at").alias("at_ms"))
