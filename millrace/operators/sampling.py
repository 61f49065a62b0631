"""Splits, weights and selections. Orders that the original draws at random are hash orders here."""

from millrace.plans.registry import Group

GROUP = Group()
# A row's rank in its stratum is what lies in lower buckets of the hash and its rank in its own bucket: no
# stratum is sorted as a whole. The other engine ranks whole strata.
HASHED = """r AS (SELECT {id} AS id, {k} AS stratum, md5(concat('42-', CAST({id} AS STRING))) AS hash FROM {t}),
b AS (SELECT stratum, substring(hash, 1, 4) AS bucket, count(*) AS c FROM r GROUP BY stratum, substring(hash, 1, 4)),
f AS (SELECT stratum, bucket, sum(c) OVER (PARTITION BY stratum ORDER BY bucket) - c AS before, sum(c) OVER (PARTITION BY stratum) AS n FROM b),
h AS (SELECT r.id, r.stratum, f.before + row_number() OVER (PARTITION BY r.stratum, f.bucket ORDER BY r.hash, r.id) AS rn, f.n FROM r JOIN f ON r.stratum <=> f.stratum AND substring(r.hash, 1, 4) = f.bucket) """
RANKED = "h AS (SELECT {id} AS id, {k} AS stratum, row_number() OVER (PARTITION BY {k} ORDER BY md5(concat('42-', CAST({id} AS VARCHAR))), {id}) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {t}) "
ASSIGN = "CASE WHEN n < 3 THEN 'train' WHEN rn <= greatest(1, floor(n * CAST(0.7 AS DOUBLE))) THEN 'train' WHEN rn <= greatest(1, floor(n * CAST(0.7 AS DOUBLE))) + greatest(1, floor(n * CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END"


def hashed(name: str, body: str, **at: str) -> None:
    GROUP.add(name, "WITH " + HASHED.format(**at) + body, "WITH " + RANKED.format(**at) + body)


hashed("stratified_split_assign", f"SELECT id, stratum, {ASSIGN} AS split FROM h", id="c_custkey", k="c_mktsegment", t="customer")
hashed("stratified_split_counts", f"SELECT stratum, {ASSIGN} AS split, count(*) AS cnt FROM h GROUP BY stratum, {ASSIGN}", id="doc_id", k="coalesce(lang, 'unknown')", t="documents")
hashed("train_val_split", "SELECT id, CASE WHEN rn <= greatest(1, floor(n * CAST(0.1 AS DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM h", id="o_custkey * 100000000 + o_orderkey", k="o_orderpriority", t="orders")
hashed("split_80_10_10_v1", "SELECT id, CASE WHEN rn <= greatest(1, floor(n / 10)) THEN 'val' WHEN rn <= 2 * greatest(1, floor(n / 10)) THEN 'test' ELSE 'train' END AS split FROM h", id="o_orderkey", k="o_orderstatus", t="orders")
hashed("split_80_10_10_v2", "SELECT id, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM h", id="o_orderkey", k="o_orderstatus", t="orders")
GROUP.add("fewshot_shortest3", "SELECT item_id, length(text) AS n FROM benchmark ORDER BY n, item_id LIMIT 3")
GROUP.add("length_range", "SELECT item_id FROM benchmark WHERE length(text) BETWEEN 5 AND 300")
GROUP.add("source_ratio_weights", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
  SELECT doc_id, CASE WHEN l.toxic = 1 THEN CAST(0.3 AS DOUBLE) / n ELSE (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE)) / n END AS weight FROM labels l JOIN c ON l.toxic <=> c.toxic""",
  """WITH c AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
  SELECT doc_id, CASE WHEN toxic = 1 THEN CAST(0.3 AS DOUBLE) / n ELSE (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE)) / n END AS weight FROM c""")
GROUP.add("confidence_weights", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN CAST(1 AS DOUBLE) WHEN quality = 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS weight FROM labels")
GROUP.add("first_category_region", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey, n_name FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) x WHERE rn = 1")
GROUP.add("routed_union", "SELECT CAST(s_suppkey AS BIGINT) AS idx, 'real' AS kind FROM supplier UNION ALL SELECT c_custkey + (SELECT max(s_suppkey) FROM supplier) AS idx, 'synthetic' AS kind FROM customer")
GROUP.add("id_union", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey AS id FROM supplier")
GROUP.add("id_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey AS id FROM orders")
