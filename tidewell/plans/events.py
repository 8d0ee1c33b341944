"""Histories, windows and scores over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import events as E
from tidewell.operators.rules import spaced_chains
from tidewell.operators.scores import evidence_scores
from tidewell.plans.registry import query
from tidewell.plans.tables import d4
from tidewell.session import load


@query(
    """SELECT event_id, user_id, event_type, CASE WHEN rn = 1 THEN 'first' ELSE 'changed' END AS state, CASE WHEN rn = 1 THEN NULL ELSE prev END AS prev_event_type FROM
    (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR prev IS DISTINCT FROM event_type"""
)
def history_events(spark, sf_dir):
    """Append-only history: the rows at which a user's state changes."""
    out = E.change_history(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_type"])
    return out.select("event_id", "user_id", "event_type", "state", "prev_event_type")


@query(
    """SELECT user_id, count(*) FILTER (WHERE before = 'view' AND event_type = 'click' AND ts <= gone + INTERVAL 1 DAY) AS cycles,
    count(*) FILTER (WHERE before = 'view' AND event_type = 'click' AND ts <= gone + INTERVAL 1 DAY) >= 3 AS flagged
    FROM (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS gone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id"""
)
def repost_cycles(spark, sf_dir):
    """Times a state came back within a day, flagged from three on."""
    return E.cycles(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "view", "click", 1)


@query(
    """SELECT user_id, count(*) FILTER (WHERE changed AND ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE changed) AS month, count(DISTINCT event_type) AS names
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type AS changed FROM events WHERE ts <= TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) GROUP BY user_id"""
)
def identity_churn(spark, sf_dir):
    """Changes of a user's shown value in the last week and month."""
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    rows = load(spark, sf_dir, "events").where((F.col("ts") <= now) & (F.col("ts") > now - F.expr("interval 30 days")))
    changed = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) != F.col("event_type")
    rows = rows.withColumn("changed", changed)
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("changed") & (F.col("ts") > now - F.expr("interval 7 days"))).alias("week"),
        F.count_if("changed").alias("month"),
        F.countDistinct("event_type").alias("names"),
    )


@query(
    """WITH p AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY ALL)
    SELECT user_id, count(*) AS properties, count(*) FILTER (WHERE hits * 10 >= n * 6) AS failing, count(*) >= 3 AND count(*) FILTER (WHERE hits * 10 >= n * 6) * 2 >= count(*) AS risky FROM p GROUP BY user_id"""
)
def availability_summary(spark, sf_dir):
    """Two-level aggregate: rates of each property, then of each actor."""
    p = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    failing = F.count_if(F.col("hits") * 10 >= F.col("n") * 6)
    out = p.groupBy("user_id").agg(F.count("*").alias("properties"), failing.alias("failing"))
    return out.withColumn("risky", (F.col("properties") >= 3) & (F.col("failing") * 2 >= F.col("properties")))


_R3 = "CAST(round(CAST({0} AS DECIMAL(24,12)), 3) AS DOUBLE)"


@query(
    f"""WITH e AS (SELECT user_id, event_type AS reason, CASE WHEN event_type IN ('view', 'click') THEN 'risk' ELSE 'trust' END AS polarity,
      CAST(CAST(max(value) AS DECIMAL(10,2)) AS DOUBLE) / 100 AS weight, count(*) AS independent, max(ts) < TIMESTAMP '2024-01-25' AS stale, CASE WHEN user_id % 3 = 0 THEN 'confirmed' WHEN user_id % 3 = 1 THEN 'open' ELSE 'dismissed' END AS review FROM events GROUP BY ALL),
    v AS (SELECT *, {_R3.format("weight * (1 - pow(0.5, independent)) * CASE review WHEN 'confirmed' THEN 1.5::DOUBLE WHEN 'dismissed' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN stale THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END")} AS worth FROM e),
    t AS (SELECT user_id, polarity, CAST({_R3.format("worth * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY user_id, polarity ORDER BY worth DESC, reason) - 1)")} AS DECIMAL(20,3)) AS term FROM v),
    m AS (SELECT user_id, CAST(COALESCE(sum(term) FILTER (WHERE polarity = 'risk'), 0) AS DOUBLE) AS risk, CAST(COALESCE(sum(term) FILTER (WHERE polarity = 'trust'), 0) AS DOUBLE) AS trust FROM t GROUP BY user_id)
    SELECT user_id, CAST(CAST(risk AS DECIMAL(20,4)) AS DOUBLE) AS risk, CAST(CAST(trust AS DECIMAL(20,4)) AS DOUBLE) AS trust, CAST(CAST(1 - exp(-greatest(0, risk - 0.6::DOUBLE * trust)) AS DECIMAL(20,4)) AS DOUBLE) AS score FROM m"""
)
def integrity_scores(spark, sf_dir):
    """Evidence mass with terms rounded one by one, and its score."""
    events = load(spark, sf_dir, "events")
    polarity = F.when(F.col("event_type").isin("view", "click"), "risk").otherwise("trust")
    review = F.when(F.col("user_id") % 3 == 0, "confirmed").when(F.col("user_id") % 3 == 1, "open").otherwise("dismissed")
    e = events.groupBy("user_id", F.col("event_type").alias("reason"), polarity.alias("polarity"), review.alias("review")).agg(
        (F.max("value").cast("decimal(10,2)").cast("double") / 100).alias("weight"),
        F.count("*").alias("independent"),
        (F.max("ts") < F.lit("2024-01-25").cast("timestamp_ntz")).alias("stale"),
    )
    out = evidence_scores(e, ["user_id"])
    return out.select("user_id", d4("risk"), d4("trust"), d4("score"))


@query(
    """SELECT user_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31') AS last_7d, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-31') AS last_30d FROM events GROUP BY user_id"""
)
def rolling_7d_30d(spark, sf_dir):
    """Counts of the last 7 and 30 days."""
    return E.counts_until(load(spark, sf_dir, "events"), "user_id", "ts", "2024-01-31", [7, 30])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_1h(spark, sf_dir):
    """Hourly windows."""
    w = F.window("ts", "1 hour")
    return load(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def sliding_2h(spark, sf_dir):
    """Two-hour windows, every hour."""
    w = F.window("ts", "2 hours", "1 hour")
    return load(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """SELECT user_id, session, count(*) AS n, min(ts) AS begun, max(ts) AS ended FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM
    (SELECT *, CASE WHEN ts - INTERVAL 30 MINUTE > lag(ts) OVER w OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL"""
)
def session_30m(spark, sf_dir):
    """Sessions with gaps of over half an hour between them."""
    s = E.sessions(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 minutes")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begun"), F.max("ts").alias("ended"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-05')")
def new_since_scan(spark, sf_dir):
    """Keys after a cut that weren't seen in the prime scan."""
    events = load(spark, sf_dir, "events")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    seen = events.where(F.col("ts") < at("2024-01-05")).select("user_id", "event_type")
    return events.where(F.col("ts") >= at("2024-01-20")).select("user_id", "event_type").distinct().join(seen, ["user_id", "event_type"], "left_anti")


@query(
    """WITH d AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE value > 80) AS observed, count(*) AS known FROM events GROUP BY ALL)
    SELECT source, day, CASE WHEN observed = 0 THEN 'suspect_empty' WHEN known < 3 THEN 'partial' WHEN known > 0 AND 1 - observed / known::DOUBLE > 0.9 THEN 'blocked' ELSE 'apply' END AS verdict FROM d"""
)
def scan_reconciliation(spark, sf_dir):
    """What each crawl's counts allow."""
    d = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("value") > 80).alias("observed"), F.count("*").alias("known")
    )
    verdict = E.crawl_state(F.col("observed"), F.col("known"), F.lit(0), F.col("known") >= 3)
    return d.select("source", "day", verdict.alias("verdict"))


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
    w AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 6 HOUR PRECEDING) AS before FROM t), nxt AS (SELECT * FROM w WHERE before IS NOT NULL),
    c AS (SELECT user_id, max(ts) AS ts, 1::BIGINT AS n FROM t GROUP BY user_id UNION ALL SELECT c.user_id, nxt.before, c.n + 1 FROM c JOIN nxt ON c.user_id = nxt.user_id AND c.ts = nxt.ts)
    SELECT user_id, max(n) AS streak FROM c GROUP BY user_id"""
)
def spaced_streaks(spark, sf_dir):
    """Greedy chain of a user's times at least six hours apart, newest first, over all days."""
    return spaced_chains(load(spark, sf_dir, "events"), "user_id", "ts", 6)


_SCANS = """scans AS (SELECT event_type AS source, CAST(min(event_id) AS BIGINT) AS scan, date_trunc('hour', ts) AS tm, count(*) FILTER (WHERE value > 70) AS observed, count(*) - count(*) FILTER (WHERE value < 0.5) AS known,
    min(event_id) % 9 <> 1 AS terminal, min(event_id) % 13 = 2 AS limited, min(event_id) % 11 = 3 AS errored FROM events GROUP BY ALL)"""


def scans(spark, sf_dir):
    """Hours of each event type as scans of a source; see _SCANS for the same in SQL."""
    first = F.min("event_id")
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("at")).agg(
        first.alias("scan"), F.count_if(F.col("value") > 70).alias("observed"), (F.count("*") - F.count_if(F.col("value") < 0.5)).alias("known"),
        (first % 9 != 1).alias("terminal"), (first % 13 == 2).alias("limited"), (first % 11 == 3).alias("errored"),
    )


_STATES = f"""WITH RECURSIVE {_SCANS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tm, scan) AS i,
    CASE WHEN errored THEN 'failed' WHEN limited OR NOT terminal THEN 'partial' WHEN observed > 0 OR known = 0 THEN 'complete' ELSE 'empty' END AS kind FROM scans),
  w(source, i, scan, tm, state, streak, times) AS (
    SELECT DISTINCT source, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::VARCHAR, 0, CAST([] AS TIMESTAMP[]) FROM n
    UNION ALL
    SELECT source, i, scan, tm, CASE WHEN kind <> 'empty' THEN kind WHEN steps >= 3 THEN 'confirmed-empty' ELSE 'suspect-empty' END, CASE WHEN kind = 'empty' THEN steps ELSE 0 END,
      CASE WHEN kind IN ('failed', 'partial') THEN times WHEN kind = 'complete' OR steps >= 3 THEN CAST([] AS TIMESTAMP[]) ELSE list_append(times, tm) END
    FROM (SELECT n.source, n.i, n.scan, n.tm, n.kind, w.times,
        CAST(len(list_reduce(list_prepend([n.tm], list_transform(list_reverse(w.times), lambda x: [x])), lambda acc, x: CASE WHEN acc[-1] - x[1] >= INTERVAL 6 HOUR THEN list_concat(acc, x) ELSE acc END)) AS INTEGER) AS steps
      FROM w JOIN n ON n.source = w.source AND n.i = w.i + 1))
"""


@query(_STATES + "SELECT source, scan, state, streak FROM w WHERE i > 0")
def scan_outcomes(spark, sf_dir):
    """What every scan of a source may conclude: emptiness counts only after three scans six hours apart."""
    from tidewell.operators.crawls import outcomes

    return outcomes(scans(spark, sf_dir)).select("source", "scan", "state", "streak")


@query(
    _STATES
    + """, c AS (SELECT DISTINCT source, tm FROM w WHERE state IN ('complete', 'confirmed-empty')), s AS (SELECT event_type AS source, user_id AS id, max(ts) AS tm FROM events GROUP BY ALL)
    SELECT s.source, s.id, least(3, count(c.tm)) AS missed, count(c.tm) < 3 AS active FROM s LEFT JOIN c ON c.source = s.source AND c.tm > s.tm GROUP BY s.source, s.id"""
)
def missed_crawls(spark, sf_dir):
    """Users of each source by how many of its complete scans missed them; three make them inactive."""
    from tidewell.operators.crawls import missed_runs, outcomes

    complete = outcomes(scans(spark, sf_dir)).where("may_remove").select("source", "at")
    seen = load(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return missed_runs(seen, complete)


@query(
    """WITH h AS (SELECT o_orderkey AS id, o_totalprice AS new, lag(o_totalprice) OVER w AS old, CASE WHEN o_orderkey % 9 = 0 THEN 'EUR' ELSE 'USD' END AS nc, lag(CASE WHEN o_orderkey % 9 = 0 THEN 'EUR' ELSE 'USD' END) OVER w AS oc FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT id, floor((new - old) * 100 + 0.5) / 100 AS amount, CAST(round(CAST((new - old) / old AS DECIMAL(20,8)), 4) AS DOUBLE) AS ratio, CASE WHEN new > old THEN 'up' WHEN new < old THEN 'down' ELSE 'same' END AS direction FROM h WHERE old > 0 AND nc = oc"""
)
def price_changes(spark, sf_dir):
    """Every change of a contact's price against the one before, in the same currency: amount, ratio and direction."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    currency = F.when(F.col("o_orderkey") % 9 == 0, "EUR").otherwise("USD")
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("new"), F.lag("o_totalprice").over(w).alias("old"), currency.alias("nc"), F.lag(currency).over(w).alias("oc")
    )
    told = rows.select("id", E.price_delta(F.col("old"), F.col("new"), F.col("oc"), F.col("nc")).alias("d")).where("d IS NOT NULL")
    return told.select("id", (F.floor(F.col("d.amount") * 100 + 0.5) / 100).alias("amount"), "d.ratio", "d.direction")
