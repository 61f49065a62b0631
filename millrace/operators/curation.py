"""Joins and counters of the curation store: precedence, overrides, upserts, funnels, progress."""

from millrace.plans.registry import Group

GROUP = Group()
GROUP.add("source_precedence_join", """WITH s AS (SELECT doc_id, 1 AS priority, 'curated' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2, 'cropped' FROM labels UNION ALL SELECT doc_id, 3, 'raw' FROM documents),
  m AS (SELECT doc_id, min(priority) AS priority FROM s GROUP BY doc_id) SELECT DISTINCT s.doc_id, s.kind FROM s JOIN m ON s.doc_id = m.doc_id AND s.priority = m.priority""")
GROUP.add("stem_join_override", """SELECT d.doc_id, coalesce(c.note, d.lang) AS value FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'rejected' END AS note FROM labels) c ON d.doc_id = c.doc_id WHERE coalesce(c.note, '') <> 'drop'""")
GROUP.add("candidate_key_join", """WITH k AS (SELECT o_orderkey, o_custkey AS cand, 1 AS pos FROM orders UNION ALL SELECT o_orderkey, o_custkey % 100 + 1, 2 FROM orders),
  j AS (SELECT k.o_orderkey, c.c_name, row_number() OVER (PARTITION BY k.o_orderkey ORDER BY pos) AS rn FROM k JOIN customer c ON k.cand = c.c_custkey AND c.c_acctbal > 0) SELECT o_orderkey, c_name FROM j WHERE rn = 1""")
# A processed file's stem starts with its raw file's; the stone equals, so the prefix test runs within one stone's files.
GROUP.add("prefix_join_first", """WITH raw AS (SELECT p_brand AS stone, substring(p_name, 1, 3 + CAST(p_size % 3 AS INT)) AS stem FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), made AS (SELECT p_brand AS stone, p_name AS stem FROM part)
  SELECT raw.stone, raw.stem, min(made.stem) AS first_match FROM raw JOIN made ON raw.stone = made.stone AND startswith(made.stem, raw.stem) GROUP BY raw.stone, raw.stem""",
          """WITH raw AS (SELECT DISTINCT p_brand AS stone, substring(p_name, 1, 3 + CAST(p_size % 3 AS INT)) AS stem FROM part WHERE p_partkey % 2 = 0)
  SELECT stone, stem, (SELECT p_name FROM part WHERE p_brand = raw.stone AND starts_with(p_name, raw.stem) ORDER BY p_name LIMIT 1) AS first_match FROM raw""")
GROUP.add("anti_missing", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
GROUP.add("semi_present", "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment")
GROUP.add("licence_dimension_join", """WITH l AS (SELECT * FROM (VALUES (0, 'CC0', 'true', false), (1, 'CC-BY', 'true', true), (2, 'CC-BY-SA', 'share-alike', true), (3, 'CC-BY-NC', 'true', true)) AS t(k, licence, derivatives, attribution))
  SELECT l.licence, l.derivatives, l.attribution, count(*) AS n FROM documents d JOIN l ON d.doc_id % 4 = l.k GROUP BY l.licence, l.derivatives, l.attribution""")
GROUP.add("funnel_counters", """SELECT count(*) AS total, count(CASE WHEN length(text) >= 2 THEN 1 END) AS with_text, count(l.doc_id) AS labelled, count(CASE WHEN l.quality = 1 THEN 1 END) AS kept, count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
GROUP.add("progress_stats", """WITH t AS (SELECT count(*) AS total FROM documents), a AS (SELECT count(*) AS annotated FROM labels) SELECT total, annotated, total - annotated AS remaining, CASE WHEN total > 0 THEN CAST(100 AS DOUBLE) * annotated / total ELSE CAST(0 AS DOUBLE) END AS percent_done FROM t CROSS JOIN a""")
GROUP.add("curation_counts", "SELECT count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS keep, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS enhance, count(CASE WHEN quality = 0 THEN 1 END) AS dropped, count(CASE WHEN quality IS NULL THEN 1 END) AS pending FROM labels")
GROUP.add("latest_per_key", "SELECT conv_id, x.turn, x.role FROM (SELECT conv_id, min(struct(-turn AS back, role, turn)) AS x FROM conversations GROUP BY conv_id)", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rn FROM conversations) x WHERE rn = 1")
GROUP.add("upsert_merge", """WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer), n AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders GROUP BY o_custkey) SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL OUTER JOIN n ON o.k = n.k""")
GROUP.add("scrape_totals", "SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN event_type <> 'error' THEN 1 END) AS ok, CAST(grouping(user_id) AS INT) AS is_total FROM events GROUP BY GROUPING SETS ((user_id), ())")
GROUP.add("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
GROUP.add("confidence_filter", "SELECT doc_id FROM labels WHERE coalesce(CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 0 THEN 'probable' END, 'uncertain') IN ('verified', 'probable')")
