"""Lines and boxes on a picture: projecting on a stem, scoring stems, suggesting crops, widths."""

from millrace.plans.registry import Group

GROUP = Group()
LINES = """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x1, CAST(l_linenumber AS BIGINT) AS y1, CAST(l_quantity AS BIGINT) + l_suppkey % 7 AS x2, l_linenumber + (l_partkey % 5) * 8 AS y2,
  l_partkey % 60 AS px, l_suppkey % 40 AS py, 80 AS w, 120 AS h FROM lineitem)"""
GROUP.add("stem_projection", LINES + """, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM l),
  t AS (SELECT *, CASE WHEN l2 >= 1 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST((px - x1) * dx + (py - y1) * dy AS DOUBLE) / l2)) END AS t FROM d)
  SELECT l_orderkey, l_linenumber, t, x1 + dx * coalesce(t, CAST(0 AS DOUBLE)) AS x, y1 + dy * coalesce(t, CAST(0 AS DOUBLE)) AS y FROM t""")
GROUP.add("best_stem", LINES + """, c AS (SELECT l_orderkey, l_linenumber, w, h, CAST(x1 + x2 AS DOUBLE) / 2 AS mid, degrees(atan(CAST(abs(x2 - x1) AS DOUBLE) / abs(y2 - y1))) AS angle, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len FROM l WHERE y2 <> y1),
  s AS (SELECT l_orderkey, l_linenumber, round(CAST(0.4 AS DOUBLE) * len / h + CAST(0.3 AS DOUBLE) * abs(mid - CAST(w AS DOUBLE) / 2) / (CAST(w AS DOUBLE) / 2) + CAST(0.3 AS DOUBLE) * (1 - angle / 30), 9) AS score FROM c WHERE angle <= 30),
  b AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rn FROM s) SELECT l_orderkey, l_linenumber FROM b WHERE rn = 1""")
GROUP.add("crop_suggestion", LINES + """SELECT l_orderkey, l_linenumber, CASE WHEN y2 <> y1 THEN greatest(0, CAST(floor(CAST(x1 + x2 AS DOUBLE) / 2) AS BIGINT) - CAST(floor(w * CAST(0.25 AS DOUBLE)) AS BIGINT)) ELSE CAST(floor(w * CAST(0.1 AS DOUBLE)) AS BIGINT) END AS cx1,
  CASE WHEN y2 <> y1 THEN least(w, CAST(floor(CAST(x1 + x2 AS DOUBLE) / 2) AS BIGINT) + CAST(floor(w * CAST(0.25 AS DOUBLE)) AS BIGINT)) ELSE w - CAST(floor(w * CAST(0.1 AS DOUBLE)) AS BIGINT) END AS cx2, 0 AS cy1, h AS cy2 FROM l""")
GROUP.add("auto_width", "SELECT p_partkey, greatest(134, least(1200, CAST(floor(64 * (CAST(p_size AS DOUBLE) / 4) * CAST(1.2 AS DOUBLE)) AS BIGINT))) AS width FROM part")
