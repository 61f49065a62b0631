"""Choosing one reading of several, and the summaries of shards and modes."""

from millrace.plans.registry import Group

GROUP = Group()
READINGS = """WITH r AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderpriority AS source, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('t', o_orderkey) END AS reading FROM orders)"""
GROUP.add("best_reading", READINGS + """, b AS (SELECT k, reading, row_number() OVER (PARTITION BY k ORDER BY CASE coalesce(substring(source, 1, 1), '3') WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END DESC, pos) AS rn FROM r),
  c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS consensus FROM customer)
  SELECT c.k, coalesce(nullif(c.consensus, ''), b.reading) AS best FROM c LEFT JOIN (SELECT k, reading FROM b WHERE rn = 1) b ON c.k = b.k""")
GROUP.add("source_consensus", READINGS + """, p AS (SELECT *, CASE WHEN lower(source) LIKE '%urgent%' THEN 1 WHEN lower(source) LIKE '%high%' THEN 2 WHEN lower(source) LIKE '%low%' THEN 3 END AS pri FROM r),
  f AS (SELECT *, row_number() OVER (PARTITION BY k, pri ORDER BY pos) AS rn FROM p WHERE pri IS NOT NULL),
  b AS (SELECT k, reading, row_number() OVER (PARTITION BY k ORDER BY pri) AS rn FROM f WHERE rn = 1 AND reading <> ''),
  a AS (SELECT k, reading, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM r)
  SELECT a.k, coalesce(b.reading, a.reading) AS consensus FROM a LEFT JOIN (SELECT k, reading FROM b WHERE rn = 1) b ON a.k = b.k WHERE a.rn = 1""")
GROUP.add("type_consensus", READINGS + """, t AS (SELECT k, reading, row_number() OVER (PARTITION BY k ORDER BY CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, pos) AS rn FROM r WHERE status IN ('F', 'O', 'P'))
  SELECT k, reading FROM t WHERE rn = 1""")
GROUP.add("char_counts",
          "WITH n AS (SELECT r_name AS t FROM region UNION ALL SELECT n_name FROM nation), c AS (SELECT explode(regexp_extract_all(upper(t), '([A-Z])', 1)) AS ch FROM n) SELECT ch, count(*) AS n FROM c GROUP BY ch",
          "WITH n AS (SELECT r_name AS t FROM region UNION ALL SELECT n_name FROM nation), c AS (SELECT unnest(regexp_extract_all(upper(t), '([A-Z])', 1)) AS ch FROM n) SELECT ch, count(*) AS n FROM c GROUP BY ch")
GROUP.add("shard_summary", """WITH s AS (SELECT o_orderkey % 7 AS shard, o_orderkey, length(o_orderpriority) AS n, o_orderpriority AS p FROM orders)
  SELECT shard, CAST(grouping(shard) AS INT) AS is_total, count(*) AS total, count(CASE WHEN p LIKE '1%' THEN 1 END) AS easy, count(CASE WHEN p LIKE '2%' OR p LIKE '3%' THEN 1 END) AS medium, count(CASE WHEN p LIKE '4%' OR p LIKE '5%' THEN 1 END) AS hard,
  CAST(sum(n) AS DOUBLE) / count(*) AS avg_text_length, min(o_orderkey) AS first_index, max(o_orderkey) AS last_index FROM s GROUP BY GROUPING SETS ((shard), ())""")
GROUP.add("mode_lift", """WITH m AS (SELECT o_orderpriority AS mode, CAST(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS DOUBLE) / count(*) AS pre, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS DOUBLE) / count(*) AS post FROM orders GROUP BY o_orderpriority)
  SELECT mode, pre, post, 100 * (pre - post) AS lift_pp FROM m""")
GROUP.add("comparison_report", """WITH m AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b FROM orders)
  SELECT abs(a - b) > CAST(1 AS DOUBLE) AS differs, CASE WHEN a < b THEN 'F' ELSE 'O' END AS winner, abs(a - b) / greatest(a, b) < CAST(0.5 AS DOUBLE) AS close_call FROM m""")
GROUP.add("curriculum_snapshot", """WITH c AS (SELECT count(CASE WHEN quality = 1 THEN 1 END) AS n_real, count(CASE WHEN quality = 0 THEN 1 END) AS n_synthetic, count(*) AS total FROM labels)
  SELECT s.epoch, CAST(s.ratio AS DOUBLE) AS ratio, c.n_real, c.n_synthetic, c.total FROM (VALUES (0, 1.0), (10, 0.5), (20, 0.3), (35, 0.1)) AS s(epoch, ratio) CROSS JOIN c""")
