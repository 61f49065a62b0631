"""Ordered-series logic: running best, patience, plateaus, trends, versions, islands, schedules."""

from millrace.plans.registry import Group

GROUP = Group()
DAYS = """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)),
e AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS epoch FROM d),
b AS (SELECT *, min(v) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e),
i AS (SELECT *, CASE WHEN best_before IS NULL OR v < best_before THEN 1 ELSE 0 END AS improved FROM b),
g AS (SELECT *, sum(improved) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS grp FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY epoch) - 1 AS stale FROM g)
"""
GROUP.add("running_best", DAYS + "SELECT epoch, v, least(v, coalesce(best_before, v)) AS best, improved FROM i")
GROUP.add("early_stop_epoch", DAYS + "SELECT min(CASE WHEN stale >= 5 THEN epoch END) AS stop_epoch, max(stale) AS longest FROM p")
GROUP.add("plateau_flags", DAYS + """SELECT epoch, CASE WHEN count(*) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) > 10
  AND max(v) OVER (ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - min(v) OVER (ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) < CAST(2.5 AS DOUBLE) THEN true ELSE false END AS plateau FROM e""")
GROUP.add("history_summary", DAYS + """, l AS (SELECT *, lag(v) OVER (ORDER BY epoch) AS before, row_number() OVER (ORDER BY epoch DESC) AS back FROM e)
SELECT (SELECT min(v) FROM l) AS lowest, (SELECT max(v) FROM l) AS highest, v AS latest, CASE WHEN v < before THEN 'improving' ELSE 'stable' END AS trend FROM l WHERE back = 1""")
GROUP.add("best_epoch", DAYS + ", r AS (SELECT epoch, v, row_number() OVER (ORDER BY v, epoch) AS k FROM e) SELECT epoch, v FROM r WHERE k = 1")
GROUP.add("risk_warnings", DAYS + """, t AS (SELECT epoch, v, lag(v) OVER (ORDER BY epoch) AS w FROM e)
SELECT epoch, CASE WHEN w - v < CAST(-0.1 AS DOUBLE) THEN 'overfitting' END AS overfit, CASE WHEN abs(v - w) > CAST(0.15 AS DOUBLE) THEN 'gap' END AS gap FROM t""")
GROUP.add("freeze_schedule", DAYS + "SELECT epoch, epoch < 5 AS frozen FROM e")
GROUP.add("annotation_versions", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS current_value FROM events")
GROUP.add("crawl_pacing",
          "SELECT event_id, greatest(CAST(0 AS DOUBLE), CAST(2 AS DOUBLE) - (unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / CAST(1000000 AS DOUBLE)) AS pause FROM events",
          "SELECT event_id, CASE WHEN lag(ts) OVER w IS NULL THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 2::DOUBLE - (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000::DOUBLE) END AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
GROUP.add("consecutive_miss_cutoff", """WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS probe FROM events),
  g AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY probe ROWS UNBOUNDED PRECEDING) AS grp FROM p),
  m AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id, grp ORDER BY probe ROWS UNBOUNDED PRECEDING) AS misses FROM g),
  c AS (SELECT user_id, min(CASE WHEN misses >= 10 THEN probe END) AS stop_at, max(probe) AS n FROM m GROUP BY user_id)
  SELECT user_id, stop_at, coalesce(stop_at, n) AS n_probed FROM c""")
GROUP.add("curriculum_asof", DAYS + """, s AS (SELECT * FROM (VALUES (0, 0.8, 'easy'), (10, 0.5, 'medium'), (20, 0.3, 'hard'), (35, 0.1, 'hard')) AS t(start_epoch, ratio, difficulty)),
  k AS (SELECT e.epoch, max(s.start_epoch) AS start_epoch FROM e JOIN s ON s.start_epoch <= e.epoch GROUP BY e.epoch)
  SELECT k.epoch, CAST(s.ratio AS DOUBLE) AS ratio, s.difficulty FROM k JOIN s ON k.start_epoch = s.start_epoch""")
GROUP.add("ctc_collapse", """WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT user_id, event_id, event_type FROM s WHERE event_type <> 'view' AND (before IS NULL OR before <> event_type)""")
GROUP.add("shard_ranges", """WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS t(k))
  SELECT k, k * CAST(floor(n / 7) AS BIGINT) + least(k, n % 7) AS range_start, (k + 1) * CAST(floor(n / 7) AS BIGINT) + least(k + 1, n % 7) AS range_end FROM k CROSS JOIN n""")
GROUP.add("round_robin", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM orders")
GROUP.add("checkpoint_retention", DAYS + "SELECT epoch, row_number() OVER (ORDER BY epoch DESC) > 3 AS deleted FROM e")
