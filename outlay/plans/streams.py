"""Queries over keyed state: the events read as a register log, stretched over half a year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.plans.registry import register
from outlay.sources.scratch import scratch
from outlay.streaming import verdicts

#: What the log says of an event type: (event, kind).
EVENTS = {"purchase": ("fetched", None), "error": ("absent", None), "view": ("verdict", "confirmed"), "click": ("verdict", "refuted"), "signup": ("verdict", "unknown")}
#: 2024-01-01 in milliseconds, and how many times slower the log's time goes.
START_MS, STRETCH = 1_704_067_200_000, 6
LATENESS_MS = 3 * 86_400_000
KEEP_MS, KEEP_VERDICT_MS = (int(d.total_seconds() * 1000) for d in (verdicts.RETENTION, verdicts.VERDICT_RETENTION))


def _log(events: DataFrame) -> DataFrame:
    def said(i: int) -> F.Column:
        out = F.lit(None).cast("string")
        for name, what in EVENTS.items():
            out = F.when(F.col("event_type") == name, what[i]).otherwise(out)
        return out

    verdict = F.col("event") == "verdict"
    rows = events.withColumn("event", said(0))
    ms = F.expr(f"{START_MS} + timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) * {STRETCH} div 1000")
    return rows.select(
        F.col("user_id").cast("string").alias("company"), F.when(verdict, F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"))).otherwise("").alias("link"),
        "event", said(1).alias("kind"), (F.col("event_type") == "view").alias("publishable"), F.when(verdict, F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string"))).alias("rules"),
        F.when(verdict, (F.col("event_id") % 5).cast("string")).alias("inputs"), F.timestamp_millis(ms).alias("at"),
    )


_MS = f"CAST({START_MS} + date_diff('microsecond', TIMESTAMP '2024-01-01', ts) * {STRETCH} // 1000 AS BIGINT)"
_CASE = lambda i: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in EVENTS.items() if v[i]) + " END"
_STATE_SQL = f"""WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS company, {_CASE(0)} AS event, {_CASE(1)} AS kind, event_type = 'view' AS publishable, event_id, {_MS} AS t FROM events
), now AS (SELECT max(t) - {LATENESS_MS} AS ms FROM log),
v AS (SELECT company, company || ':' || (event_id % 3) AS link, t, kind, publishable, 'v' || (event_id % 2) AS rules, CAST(event_id % 5 AS VARCHAR) AS inputs FROM log WHERE event = 'verdict'),
lastv AS (SELECT company, link, arg_max(struct_pack(t := t, kind := kind, publishable := publishable, rules := rules, inputs := inputs), struct_pack(t := t, kind := kind, inputs := inputs)) AS c FROM v GROUP BY ALL),
ab AS (SELECT company, t, row_number() OVER (PARTITION BY company ORDER BY t DESC) AS k FROM (SELECT DISTINCT company, t FROM log WHERE event = 'absent')),
o AS (SELECT company, coalesce(max(t) FILTER (event = 'fetched'), 0) AS fetched FROM log WHERE event IN ('fetched', 'absent') GROUP BY company),
s AS (SELECT o.company, fetched, coalesce(max(ab.t) FILTER (k = 1), 0) AS late, coalesce(max(ab.t) FILTER (k = 2), 0) AS earlier FROM o LEFT JOIN ab ON ab.company = o.company GROUP BY ALL),
state AS (
  SELECT company, '' AS link, greatest(fetched, late) AS at_ms, CASE WHEN fetched >= late THEN 'fetched' WHEN earlier > greatest(fetched, late - {KEEP_MS}) THEN 'outside' ELSE 'pending' END AS kind, CAST(NULL AS BOOLEAN) AS publishable, CAST(NULL AS VARCHAR) AS rules, CAST(NULL AS VARCHAR) AS inputs
  FROM s, now WHERE greatest(fetched, late) + {KEEP_MS} > now.ms
  UNION ALL SELECT company, link, c.t, c.kind, c.publishable, c.rules, c.inputs FROM lastv, now WHERE c.t + {KEEP_VERDICT_MS} > now.ms)"""


def _table(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern: a plain path to one file is taken for a folder
    return verdicts.latest(verdicts.run_log(_log(events), scratch(spark, "register"), lateness=f"{LATENESS_MS} milliseconds"))


@register(_STATE_SQL + " SELECT * FROM state")
def register_state(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf).select("company", "link", F.unix_millis("at").alias("at_ms"), "kind", "publishable", "rules", "inputs")


#: Links that somebody wants decided: every pair of user and remainder, with the inputs that the rules see today.
_LINKS_SQL = "links AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS company, user_id || ':' || r AS link, CAST((user_id + r) % 5 AS VARCHAR) AS inputs FROM events, (SELECT unnest([0, 1, 2, 3]) AS r))"
_STALE_SQL = f""", {_LINKS_SQL}, stale AS (SELECT l.*, z.at_ms FROM links l LEFT JOIN state z ON z.link = l.link AND z.link <> ''
  WHERE NOT coalesce(z.rules = 'v1' AND z.inputs = l.inputs AND z.at_ms >= (SELECT ms FROM now) - {30 * 86_400_000}, false))"""


def _stale(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf}/events.parquet")
    r = F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("r")
    links = events.select("user_id").distinct().select("user_id", r).select(F.col("user_id").cast("string").alias("company"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("r").cast("string")).alias("link"), ((F.col("user_id") + F.col("r")) % 5).cast("string").alias("inputs"))
    last = _log(events).agg(F.max("at")).first()[0]
    now = (last or dt.datetime(2024, 1, 1)) - dt.timedelta(milliseconds=LATENESS_MS)
    return links, verdicts.stale(links, _table(spark, sf), "v1", now, dt.timedelta(days=30))


@register(_STATE_SQL + _STALE_SQL + " SELECT company, link, at_ms FROM stale")
def stale_links(spark: SparkSession, sf: str) -> DataFrame:
    return _stale(spark, sf)[1].select("company", "link", F.unix_millis("decided_at").alias("at_ms"))


@register(_STATE_SQL + _STALE_SQL + """ SELECT row_number() OVER (ORDER BY undecided DESC, at_ms, company) AS rank, company, links, CASE WHEN undecided THEN NULL ELSE at_ms END AS at_ms
  FROM (SELECT company, count(*) AS links, bool_or(at_ms IS NULL) AS undecided, CASE WHEN bool_or(at_ms IS NULL) THEN 0 ELSE min(at_ms) END AS at_ms FROM stale GROUP BY company) ORDER BY undecided DESC, at_ms, company LIMIT 25""")
def next_companies(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.next_companies(_stale(spark, sf)[1], 25).select("rank", "company", "links", F.unix_millis("waiting_since").alias("at_ms"))


@register(_STATE_SQL + _STALE_SQL + " SELECT w AS wanted, w - m AS current, m AS missing, CASE WHEN w = 0 THEN 1 ELSE CAST(w - m AS DOUBLE) / w END AS ratio FROM (SELECT count(*) AS w FROM links), (SELECT count(*) AS m FROM stale)")
def verdict_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.coverage(*_stale(spark, sf))
