"""Operational statistics and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schemas
from lumenframe.functions import text as T
from lumenframe.operators import health, stats
from lumenframe.streaming import stateful, windows

from .registry import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_NOW = "(SELECT max(ts) FROM events)"


def _now(events: DataFrame):
    """The newest timestamp, as a literal."""
    return F.lit(events.agg(F.max("ts")).first()[0])


@query(
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), "
    "a AS (SELECT event_type AS operation, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(value) FILTER (WHERE rn <= 50), 4) AS recent_avg FROM w WHERE rn <= 1000 GROUP BY 1), "
    "s AS (SELECT event_type AS operation, count(*) FILTER (WHERE value > 100) AS slow_count FROM events GROUP BY 1) SELECT * FROM a JOIN s USING (operation)"
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_stats(schemas.performance(spark, sf_dir), slow=100.0)


@query(f"SELECT count(*) AS slow_count, round(avg(value), 4) AS slow_avg, round(max(value), 4) AS slow_max, count(*) FILTER (WHERE ts > {_NOW} - INTERVAL 1 HOUR) AS last_hour FROM events WHERE value > 100")
def slow_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    return stats.slow_rollup(e, 100.0, _now(e))


_CLIENT = "WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), k AS (SELECT * FROM w WHERE rn <= 500), t AS (SELECT user_id AS client, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 4) AS avg, count(DISTINCT event_type) AS operations FROM k GROUP BY 1)"


@query(
    _CLIENT + ", c AS (SELECT user_id AS client, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS n FROM k GROUP BY 1, 2) SELECT t.*, c.event_type AS most_common FROM t JOIN c USING (client) WHERE n = 1"
)
def agent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.client_stats(schemas.performance(spark, sf_dir))


@query(
    "WITH w AS (SELECT *, user_id % 10 AS team, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
    "SELECT team, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS avg, count(DISTINCT event_type) AS operations, count(DISTINCT user_id) AS members FROM w WHERE rn <= 200 GROUP BY 1"
)
def team_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.team_stats(schemas.performance(spark, sf_dir).withColumn("team", F.col("client") % 10))


@query(
    f"WITH c AS (SELECT count(*) FILTER (WHERE value > 100) AS slow, count(*) FILTER (WHERE value > 400) AS errors, count(*) FILTER (WHERE value > 100 AND ts > {_NOW} - INTERVAL 1 HOUR) AS recent_slow, count(*) FILTER (WHERE event_id % 97 = 0) AS timers FROM events) "
    "SELECT *, concat_ws(',', CASE WHEN slow > 10 THEN 'slow_operations' END, CASE WHEN errors > 50 THEN 'errors' END, CASE WHEN recent_slow > 5 THEN 'recent_slow' END, CASE WHEN timers > 100 THEN 'open_timers' END) AS alarms FROM c"
)
def monitor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    return stats.monitor_health(e.withColumn("error", F.col("duration") > 400).withColumn("open", F.col("event_id") % 97 == 0), _now(e), 100.0)


@query("SELECT event_type || ':' || user_id AS error, count(*) AS count FROM events GROUP BY 1")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.error_counts(schemas.performance(spark, sf_dir), "operation", "client")


@query(
    f"WITH a AS (SELECT count(*) AS events, count(DISTINCT event_type) AS operations, count(*) FILTER (WHERE value > 100) AS slow, count(*) FILTER (WHERE value > 100 AND ts > {_NOW} - INTERVAL 1 HOUR) AS recent_slow, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600, 4) AS uptime_hours FROM events) SELECT *, slow <= 10 AND recent_slow <= 5 AS healthy FROM a"
)
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    return stats.global_rollup(e, 100.0, _now(e))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.performance(spark, sf_dir).withColumn("t", F.unix_micros("ts") / 1e6)


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id AS client, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "r AS (SELECT client, n, event_id, TRUE AS accepted, [t] AS log FROM e WHERE n = 1 UNION ALL "
    "SELECT e.client, e.n, e.event_id, len(list_filter(r.log, lambda x: x >= e.t - 43200)) < 2, CASE WHEN len(list_filter(r.log, lambda x: x >= e.t - 43200)) < 2 THEN list_append(list_filter(r.log, lambda x: x >= e.t - 43200), e.t) ELSE list_filter(r.log, lambda x: x >= e.t - 43200) END FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1) "
    "SELECT client, event_id, accepted FROM r"
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate_limit(_timed(spark, sf_dir), 2, 43_200.0)


_CACHE = (
    "WITH RECURSIVE e AS (SELECT event_id, event_type AS shard, user_id AS k, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), "
    "r AS (SELECT shard, n, event_id, FALSE AS hit, [{'k': k, 't': t}] AS log FROM e WHERE n = 1 UNION ALL "
    "SELECT shard, n, event_id, hit, l[greatest(len(l) - 49, 1) : len(l)] AS log FROM ("
    "SELECT e.shard, e.n, e.event_id, len(list_filter(r.log, lambda x: x.k = e.k AND e.t - x.t < 86400)) > 0 AS hit, "
    "list_append(list_filter(r.log, lambda x: x.k <> e.k), {'k': e.k, 't': coalesce(list_filter(r.log, lambda x: x.k = e.k AND e.t - x.t < 86400)[1].t, e.t)}) AS l "
    "FROM r JOIN e ON e.shard = r.shard AND e.n = r.n + 1)) "
)


@query(_CACHE + "SELECT shard, event_id, hit FROM r")
def cache_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(spark, sf_dir).select(F.col("operation").alias("shard"), F.col("client").alias("key"), "event_id", "t")
    return stateful.cache_simulation(e, 86_400.0, 50)


@query(
    f"WITH a AS (SELECT user_id AS node_id, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS status, count(*) AS announcements FROM events GROUP BY 1) SELECT node_id, epoch_us(last_seen) AS last_seen_us, status, announcements, last_seen >= {_NOW} - INTERVAL 2 DAY AS online FROM a"
)
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    a = e.select(F.col("client").alias("node_id"), F.col("ts").alias("last_seen"), F.col("event_id").alias("seq"), F.col("operation").alias("status"))
    r = health.registry(a, _now(e), "2 days")
    return r.select("node_id", F.unix_micros("last_seen").alias("last_seen_us"), "status", "announcements", "online")


@query(
    "WITH g AS (SELECT user_id AS client, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(c) OVER (PARTITION BY client ORDER BY ts) AS k FROM g) "
    "SELECT client, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY client, k"
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(schemas.performance(spark, sf_dir), "6 hours")
    return s.select("client", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.latency_windows(schemas.performance(spark, sf_dir), "1 day")
    return w.select(F.unix_micros("start").alias("start_us"), "operation", "n", "total", "most")


@query(
    "WITH x AS (SELECT date_trunc('day', ts) - to_days(i::INT) AS s, event_type, value FROM events, range(0, 2) t(i)) SELECT epoch_us(s) AS start_us, event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM x GROUP BY 1, 2"
)
def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.latency_windows(schemas.performance(spark, sf_dir), "2 days", "1 day")
    return w.select(F.unix_micros("start").alias("start_us"), "operation", "n", "total", "most")


@query(
    "WITH s AS (SELECT event_id AS timer_id, ts FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id - 1 AS timer_id, ts FROM events WHERE event_id % 2 = 1) SELECT timer_id, epoch_us(e.ts) - epoch_us(s.ts) AS duration_us FROM s JOIN e USING (timer_id) WHERE e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR"
)
def timer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    starts = e.where("event_id % 2 = 0").select(F.col("event_id").alias("timer_id"), "ts")
    stops = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("timer_id"), "ts")
    return windows.pair_timers(starts, stops).select("timer_id", F.round(F.col("duration") * 1e6).cast("long").alias("duration_us"))


@query(_CACHE + "SELECT count(*) AS requests, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 3) AS hit_rate, count(*) > 100 AND count(*) FILTER (WHERE hit) / count(*) < 0.1 AS low_hit_rate FROM r")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the simulated cache."""
    return stats.cache_stats(cache_simulation(spark, sf_dir))


@query(
    f"WITH a AS (SELECT user_id AS node_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT node_id, round((epoch_us({_NOW}) - epoch_us(last_seen)) / 1e6, 3) AS silent_seconds, last_seen < {_NOW} - INTERVAL 1 DAY AND node_id <> 7 AS expired FROM a"
)
def session_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    nodes = e.groupBy(F.col("client").alias("node_id")).agg(F.max("ts").alias("last_seen"))
    return health.sweep(nodes, _now(e), "1 day", 7).select("node_id", "silent_seconds", "expired")


@query(
    "WITH f AS (SELECT CASE user_id % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'temp' WHEN 2 THEN 'log' ELSE 'other' END AS kind, event_id AS bytes, ts AS mtime FROM events), "
    f"g AS (SELECT *, coalesce((epoch_us({_NOW}) - epoch_us(mtime)) / 3.6e9 > CASE kind WHEN 'cache' THEN 168 WHEN 'temp' THEN 24 WHEN 'log' THEN 480 END, FALSE) AS gone FROM f) "
    "SELECT kind, count(*) AS files, count(*) FILTER (WHERE gone) AS expired, CAST(coalesce(sum(bytes) FILTER (WHERE gone), 0) AS BIGINT) AS bytes FROM g GROUP BY 1"
)
def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    k = F.col("client") % 4
    kind = F.when(k == 0, "cache").when(k == 1, "temp").when(k == 2, "log").otherwise("other")
    return health.maintenance(e.select(kind.alias("kind"), F.col("event_id").alias("bytes"), F.col("ts").alias("mtime")), _now(e), {"cache": 168, "temp": 24, "log": 480})


@query(
    "WITH c AS (SELECT 'client' || user_id AS component, count(DISTINCT event_type) FILTER (WHERE value < 300) AS handlers, count(*) FILTER (WHERE value > 300) AS errors FROM events GROUP BY 1) "
    "SELECT component, 'handlers' AS \"check\", handlers > 0 AS ok, 'missing handlers' AS issue FROM c UNION ALL SELECT component, 'errors', errors = 0, errors || ' errors at start' FROM c"
)
def component_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    c = e.groupBy(F.concat(F.lit("client"), "client").alias("component")).agg(F.countDistinct(F.when(F.col("duration") < 300, F.col("operation"))).alias("handlers"), F.count_if(F.col("duration") > 300).alias("errors"))
    return health.component_health(c)


@query("SELECT event_id, md5(event_type || ' | client=' || user_id || ' id=' || event_id) AS line FROM events")
def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = schemas.performance(spark, sf_dir)
    return e.select("event_id", F.md5(T.log_message(F.col("operation"), client=F.col("client"), id=F.col("event_id"))).alias("line"))


@query("SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS actual, round(greatest(1.0, count(*) * 57248 / sum(n_chars)), 4)::DOUBLE AS ratio FROM documents")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compression_ratio(schemas.table(spark, sf_dir, "documents").select(F.col("n_chars").alias("bytes")))
