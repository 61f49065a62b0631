"""Field extraction and geometry as scalar expressions."""

from millrace.plans.registry import Group

GROUP = Group()
GROUP.add("html_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
GROUP.add("image_id_md5", "SELECT doc_id, substring(md5(concat(CAST(doc_id AS STRING), '_', source, '_0')), 1, 12) AS image_id FROM documents", "SELECT doc_id, substring(md5(concat(CAST(doc_id AS VARCHAR), '_', source, '_0')), 1, 12) AS image_id FROM documents")
GROUP.add("bbox_rotate_clamp", """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS x1, CAST(l_quantity AS INT) * 2 AS y1, CAST(l_quantity AS INT) + 40 AS x2, CAST(l_quantity AS INT) * 3 AS y2, 80 AS w, 120 AS h FROM lineitem)
  SELECT l_orderkey, l_linenumber, h - y2 AS cw_x1, x1 AS cw_y1, h - y1 AS cw_x2, x2 AS cw_y2, greatest(0, least(x1, w)) AS cx1, greatest(0, least(y1, h)) AS cy1, greatest(0, least(x2, w)) AS cx2, greatest(0, least(y2, h)) AS cy2 FROM b""")
GROUP.add("resize_plan", """WITH s AS (SELECT p_partkey, p_size * 20 + 50 AS h, p_size * 37 + 20 AS w FROM part), r AS (SELECT *, CAST(floor(w * (CAST(384 AS DOUBLE) / h)) AS BIGINT) AS scaled FROM s), c AS (SELECT *, greatest(128, least(2048, scaled)) AS clamped FROM r)
  SELECT p_partkey, scaled, clamped, clamped + (16 - clamped % 16) % 16 AS padded, CAST(h AS DOUBLE) / w > CAST(1.2 AS DOUBLE) AS rotate FROM c""")
GROUP.add("clip_limit", """SELECT o_orderkey, CASE s WHEN 'minimal' THEN CAST(1.5 AS DOUBLE) WHEN 'moderate' THEN CAST(2.5 AS DOUBLE) WHEN 'severe' THEN CAST(3.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS clip, CASE WHEN s IN ('minimal', 'moderate', 'severe') THEN concat('adaptive_', s) ELSE 'config_default' END AS chosen
  FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'minimal' WHEN 'F' THEN 'moderate' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'severe' END END AS s FROM orders) x""",
          """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.5::DOUBLE WHEN o_orderstatus = 'F' THEN 2.5::DOUBLE WHEN o_orderkey % 2 = 0 THEN 3.5::DOUBLE ELSE 2.0::DOUBLE END AS clip,
  CASE WHEN o_orderstatus = 'O' THEN 'adaptive_minimal' WHEN o_orderstatus = 'F' THEN 'adaptive_moderate' WHEN o_orderkey % 2 = 0 THEN 'adaptive_severe' ELSE 'config_default' END AS chosen FROM orders""")
