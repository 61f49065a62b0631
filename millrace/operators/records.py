"""Records of the catalogue and of evaluation: coercion, projection, filters, joins by id and by ordinal, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sampling import HASHED, RANKED
from millrace.plans.registry import Group

# Annotation confidences, from the surest on.
CONFIDENCES = ("verified", "probable", "uncertain")
# Locations of a record, in the order in which they are tried.
LOCATIONS = ("last_recorded", "repository", "present", "current")


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value, the default where it is missing; an error where it is none of those allowed."""
    told = F.coalesce(value, F.lit(default))
    return F.when(told.isin(*allowed), told).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), told)))


def sure_enough(confidence: Column, least: str) -> Column:
    """Whether a confidence is at least as sure as the one named; an unknown one is an error, a missing one uncertain."""
    order = F.array(*map(F.lit, CONFIDENCES))
    return F.array_position(order, coerced(confidence, CONFIDENCES, "uncertain")) <= CONFIDENCES.index(least) + 1


def requested(rows: DataFrame, key: str, ids: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the ids, then the first by key; an empty list, 0 and None switch either off."""
    if ids:
        rows = rows.filter(F.col(key).isin(*ids))
    return rows.orderBy(key).limit(limit) if limit else rows


def by_ordinal(predictions: DataFrame, references: DataFrame, strict: bool = True) -> DataFrame:
    """predictions (idx, prediction) with references (idx, reference). Strict: a row without its other is an error; else it goes."""
    if not strict:
        return predictions.join(references, "idx")
    both = predictions.withColumn("__p", F.lit(1)).join(references.withColumn("__r", F.lit(1)), "idx", "full")
    gap = F.col("__p").isNull() | F.col("__r").isNull()
    checked = F.when(gap, F.raise_error(F.lit("predictions and references differ in length"))).otherwise(F.col("idx"))
    return both.select(checked.alias("idx"), "prediction", "reference")


def check_ratios(*ratios: float) -> None:
    """Shares of a split must sum to 1, within a thousandth."""
    if abs(sum(ratios) - 1.0) >= 0.001:
        raise AssertionError(f"ratios sum to {sum(ratios)}")


def ratios_hold(*ratios: Column) -> Column:
    """The same of columns: whether the shares of each row sum to 1; a missing share counts as none."""
    total = sum((F.coalesce(r, F.lit(0.0)) for r in ratios[1:]), F.coalesce(ratios[0], F.lit(0.0)))
    return F.abs(total - 1.0) < 0.001


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def on_first(rows: list[dict]) -> dict[str, list]:
    """Metadata of a batch by column; only the columns that the first element has."""
    return {k: [r.get(k) for r in rows] for k in rows[0]} if rows else {}


def collated(rows: DataFrame, batch: str, place: str, metadata: str) -> DataFrame:
    """batch, key and values: the metadata (a map of strings) of each batch by key, in the order of the places; only the keys that the batch's first row has, null where another row lacks one.

    A batch is as large as whoever numbers the rows makes it, and one task's work.
    """
    # maps can't be compared, so they are sorted as lists of their entries
    told = rows.groupBy(batch).agg(F.min_by(metadata, place).alias("first"), F.collect_list(F.struct(F.col(place).alias("place"), F.map_entries(metadata).alias("told"))).alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    keyed = told.select(batch, F.explode(F.map_keys("first")).alias("key"), ordered.alias("rows"))
    return keyed.select(batch, "key", F.transform("rows", lambda r: F.try_element_at(F.map_from_entries(r["told"]), F.col("key"))).alias("values"))


GROUP = Group()


def _of(*names: str):
    return lambda s, d: [s.read.parquet(f"{d}/{n}.parquet") for n in names]


def _one(name: str, run, oracle: str, *tables: str) -> None:
    GROUP.frame(name, lambda s, d: run(*_of(*tables)(s, d)), oracle)


_one("enum_coercion", lambda o: o.select("o_orderkey", coerced(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), ("O", "F", "P", "missing"), "missing").alias("status")),
     "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE 'missing' END AS status FROM orders", "orders")
def record_json(rows: DataFrame, key: str, **fields: Column) -> DataFrame:
    """key and row: the record as JSON, all fields in their order, missing ones as null, enumerations by their value, lists and nested records whole."""
    return rows.select(key, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias("row"))


_one(
    "record_projection",
    lambda o, c: record_json(
        o.join(c, o["o_custkey"] == c["c_custkey"], "left"), "o_orderkey", id=F.col("o_orderkey"), status=coerced(F.col("o_orderstatus"), ("O", "F", "P"), "O"), priority=F.lower("o_orderpriority"),
        date=F.date_format("o_orderdate", "yyyy-MM-dd"), cents=F.round(F.col("o_totalprice") * 100).cast("long"), severity=F.when(F.col("c_acctbal") < 0, "severe"),
        place=F.struct(F.col("c_custkey").alias("customer"), F.when(F.col("o_orderkey") % 3 > 0, F.col("c_mktsegment")).alias("segment")), keys=F.array(F.col("o_orderkey"), F.col("o_custkey")),
    ),
    """SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || lower(o_orderpriority) || '","date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","cents":' || round(o_totalprice * 100)::BIGINT
    || ',"severity":' || CASE WHEN c_acctbal < 0 THEN '"severe"' ELSE 'null' END || ',"place":{"customer":' || c_custkey || ',"segment":' || CASE WHEN o_orderkey % 3 > 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '},"keys":[' || o_orderkey || ',' || o_custkey || ']}' AS row
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "orders", "customer",
)
_one("text_present", lambda d: d.filter(F.coalesce("text", F.lit("")) != "").select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0", "documents")


def _level() -> Column:
    return F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "verified").otherwise("probable"))


_one("least_confidence", lambda x: x.filter(sure_enough(_level(), "probable")).select("doc_id"), "SELECT doc_id FROM labels WHERE quality = 1", "labels")


def _status() -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, ("MACHINERY", "drop", "BUILDING", "keep"))), F.col("c_mktsegment"))


_one("drop_status", lambda c: c.withColumn("s", _status()).filter(F.coalesce("s", F.lit("")) != "drop").select("c_custkey", "s"),
     "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'keep' END AS s FROM customer WHERE c_mktsegment <> 'MACHINERY'", "customer")
_one("status_default", lambda c: c.withColumn("s", _status()).filter(F.coalesce("s", F.lit("pending")) == "pending").select("c_custkey"),
     "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING')", "customer")
_one("requested_rows", lambda s: requested(s, "s_suppkey", [9, 2, 5, 7], 3).select("s_suppkey").unionAll(requested(s, "s_suppkey", [], 0).select("s_suppkey")),
     "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (2, 5, 7) UNION ALL SELECT s_suppkey FROM supplier", "supplier")
_one("region_predicate", lambda n, r: n.join(F.broadcast(r.filter("r_name = 'EUROPE'")), n["n_regionkey"] == r["r_regionkey"], "left_semi").select("n_name"),
     "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'EUROPE'", "nation", "region")
_one("split_annotations", lambda c, o: c.filter("c_custkey % 10 < 7").select(F.col("c_custkey").alias("id")).distinct().join(o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")), "id"),
     "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_custkey % 10 < 7 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey", "customer", "orders")
_one("weathering_lookup", lambda o, c: o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "severe").when(F.col("c_acctbal") < 5000, "moderate").alias("severity")), "o_custkey", "left").select("o_orderkey", "severity"),
     "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'severe' WHEN c_acctbal < 5000 THEN 'moderate' END AS severity FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "orders", "customer")
_one("location_chain", lambda p: p.select("p_partkey", first_present(F.when(F.col("p_size") > 40, F.col("p_brand")), F.when(F.col("p_size") > 20, F.lit("")), F.when(F.col("p_size") > 10, F.col("p_type")), F.lit("unplaced")).alias("location")),
     "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand WHEN p_size > 10 THEN p_type ELSE 'unplaced' END AS location FROM part", "part")
_one("ordinal_join", lambda o: by_ordinal(o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("prediction")), o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("reference"))).groupBy("prediction", "reference").agg(F.count("*").alias("n")),
     "SELECT o_orderpriority AS prediction, o_orderstatus AS reference, count(*) AS n FROM orders GROUP BY ALL", "orders")
_one("ordinal_join_truncating", lambda o: by_ordinal(o.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("prediction")), o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("reference")), strict=False).groupBy("reference").agg(F.count("*").alias("n")),
     "SELECT o_orderstatus AS reference, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_orderstatus", "orders")
_one("step_statistics", lambda p: p.select(F.posexplode(F.split("p_type", " ")).alias("place", "step"), "p_size").groupBy("step").agg(F.count("*").alias("n"), F.count(F.when(F.col("place") == 0, 1)).alias("n_first"), F.count(F.when(F.col("p_size") > 25, 1)).alias("n_large")),
     "SELECT step, count(*) AS n, count(CASE WHEN place = 0 THEN 1 END) AS n_first, count(CASE WHEN p_size > 25 THEN 1 END) AS n_large FROM (SELECT unnest(string_split(p_type, ' ')) AS step, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS place, p_size FROM part) GROUP BY step", "part")
_one("distinct_ids", lambda x: x.agg(F.countDistinct("l_suppkey").alias("n")), "SELECT count(*) AS n FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey)", "lineitem")
_one("distinct_list", lambda x: x.select(F.col("l_returnflag").alias("kind")).distinct(), "SELECT l_returnflag AS kind FROM lineitem GROUP BY l_returnflag", "lineitem")
_one("mean_loss", lambda e: e.groupBy("event_type").agg((F.sum("value") / F.nullif(F.count("value"), F.lit(0))).alias("loss"), F.count("value").alias("batches")), "SELECT event_type, avg(value) AS loss, count(value) AS batches FROM events GROUP BY event_type", "events")
_one("top_rows", lambda o: o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "orders")
_CUT = "CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split"
for _name, _id, _t in (("random_split", "c_custkey", "customer"), ("string_id_split", "concat('SYNTH-FF-', lpad(CAST(s_suppkey AS STRING), 4, '0'))", "supplier")):
    GROUP.add(_name, "WITH " + HASHED.format(id=_id, k="1", t=_t) + f"SELECT id, {_CUT} FROM h", "WITH " + RANKED.format(id=_id.replace("STRING", "VARCHAR"), k="1", t=_t) + f"SELECT id, {_CUT} FROM h")
GROUP.add("epoch_record", """WITH s AS (SELECT turn, text AS r, concat(coalesce(text, ''), CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE '' END) AS p, CAST(conv_id % 11 AS DOUBLE) / 10 AS loss FROM conversations)
  SELECT turn AS epoch, avg(loss) AS loss, avg(CASE WHEN trim(p) = trim(coalesce(r, '')) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS exact, CAST(sum(levenshtein(p, coalesce(r, ''))) AS DOUBLE) / sum(greatest(length(coalesce(r, '')), 1)) AS cer FROM s GROUP BY turn""",
          # what the prediction has beyond the reference is one blank, so its count is the distance
          """SELECT turn AS epoch, sum((conv_id % 11) / 10.0::DOUBLE) / count(*) AS loss, 1.0::DOUBLE AS exact, sum(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(greatest(length(coalesce(text, '')), 1)) AS cer FROM conversations GROUP BY turn""")
GROUP.add("status_report", """SELECT event_type, CASE WHEN count(*) % 2 = 0 THEN 'API error' ELSE concat(CAST(CAST(floor(100 * avg(value)) AS BIGINT) AS STRING), ' %') END AS shown, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type""",
          """SELECT event_type, CASE WHEN count(*) % 2 = 0 THEN 'API error' ELSE CAST(floor(100 * (sum(value) / count(value)))::BIGINT AS VARCHAR) || ' %' END AS shown, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type""")
GROUP.add("orientation_modes", """WITH s AS (SELECT p_partkey, p_size * 20 + 50 AS h, p_partkey % 900 + 60 AS w FROM part)
  SELECT p_partkey, CAST(h AS DOUBLE) / w > CAST(1.2 AS DOUBLE) AS pipeline_rotates, CASE WHEN h > w * CAST(1.5 AS DOUBLE) THEN 'rotate_90_cw' WHEN w > h * CAST(1.5 AS DOUBLE) THEN 'keep_vertical' ELSE 'rotate_90_cw' END AS mode FROM s""",
          """SELECT p_partkey, (p_size * 20 + 50)::DOUBLE / (p_partkey % 900 + 60) > 1.2::DOUBLE AS pipeline_rotates, CASE WHEN 2 * (p_partkey % 900 + 60) > 3 * (p_size * 20 + 50) THEN 'keep_vertical' ELSE 'rotate_90_cw' END AS mode FROM part""")
GROUP.add("orientation_handler", """SELECT p_partkey, CASE m WHEN 0 THEN 'left_to_right' WHEN 1 THEN 'right_to_left' ELSE coalesce(d, 'bottom_to_top') END AS direction, CASE WHEN m < 2 THEN w ELSE h END AS new_h, CASE WHEN m < 2 THEN h ELSE w END AS new_w
  FROM (SELECT p_partkey, p_partkey % 3 AS m, CASE WHEN p_size > 25 THEN p_brand END AS d, p_size AS h, p_partkey % 90 AS w FROM part) x""",
          """SELECT p_partkey, ['left_to_right', 'right_to_left', CASE WHEN p_size > 25 THEN p_brand ELSE 'bottom_to_top' END][p_partkey % 3 + 1] AS direction, [p_partkey % 90, p_partkey % 90, p_size][p_partkey % 3 + 1] AS new_h, [p_size, p_size, p_partkey % 90][p_partkey % 3 + 1] AS new_w FROM part""")
GROUP.add("crop_dispatch", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'automatic' ELSE 'metadata' END AS method, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS x1 FROM part",
          "SELECT p_partkey, CASE WHEN box IS NULL THEN 'automatic' ELSE 'metadata' END AS method, coalesce(box, 0) AS x1 FROM (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS box FROM part)")
GROUP.add("file_names", "SELECT s_suppkey, format_string('%03d', s_suppkey) AS image, format_string('%06d', s_suppkey) AS sample, format_string('%04d', s_suppkey) AS shard FROM supplier",
          "SELECT s_suppkey, printf('%03d', s_suppkey) AS image, printf('%06d', s_suppkey) AS sample, printf('%04d', s_suppkey) AS shard FROM supplier")
GROUP.add("timestamps", "SELECT event_id, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS naive, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ssXXX\") = concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') AS utc FROM events",
          "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS naive, true AS utc FROM events")
GROUP.add("normalised_pixels", """SELECT p_partkey, array_join(transform(array(p_size, p_partkey % 256, 255), (x, i) -> CAST(CAST(round((x / CAST(255 AS DOUBLE) - array(0.485D, 0.456D, 0.406D)[i]) / array(0.229D, 0.224D, 0.225D)[i] * 10000) AS BIGINT) AS STRING)), ',') AS v FROM part""",
          """SELECT p_partkey, concat_ws(',', CAST(round((p_size / 255::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE * 10000)::BIGINT AS VARCHAR), CAST(round(((p_partkey % 256) / 255::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE * 10000)::BIGINT AS VARCHAR), CAST(round((1::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE * 10000)::BIGINT AS VARCHAR)) AS v FROM part""")
GROUP.add("config_record", """SELECT p_partkey, to_json(named_struct('height', p_size, 'padding', p_size % 16, 'brand', p_brand)) AS config FROM part""",
          """SELECT p_partkey, '{"height":' || p_size || ',"padding":' || p_size % 16 || ',"brand":"' || p_brand || '"}' AS config FROM part""")
GROUP.add("stroke_segments", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_linenumber AS DOUBLE) AS y1, CAST(l_partkey % 5 + 1 AS INT) AS n, substring('bhma', CAST(l_suppkey % 4 AS INT) + 1, 1) AS side FROM lineitem),
  s AS (SELECT *, explode(sequence(0, n - 1)) AS i FROM c), o AS (SELECT *, x1 + 50 + (i - (n - 1) / CAST(2 AS DOUBLE)) * 8 AS sx, y1 AS sy FROM s)
  SELECT l_orderkey, l_linenumber, i, CASE side WHEN 'm' THEN sx - 14 ELSE sx END AS ax, CASE side WHEN 'm' THEN sy + 14 WHEN 'a' THEN sy - 6 ELSE sy END AS ay, CASE side WHEN 'm' THEN sx + 14 ELSE sx END AS bx, CASE side WHEN 'b' THEN sy + 28 WHEN 'h' THEN sy - 28 WHEN 'm' THEN sy - 14 ELSE sy + 6 END AS byy FROM o""",
          """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE + 50 AS x, l_linenumber::DOUBLE AS y, (l_partkey % 5 + 1)::INT AS n, (l_suppkey % 4)::INT AS side, unnest(range(0, (l_partkey % 5 + 1)::INT))::INT AS i FROM lineitem),
  d AS (SELECT *, x + 8 * i - 4 * (n - 1) AS sx FROM c)
  SELECT l_orderkey, l_linenumber, i, sx + [0, 0, -14, 0][side + 1] AS ax, y + [0, 0, 14, -6][side + 1] AS ay, sx + [0, 0, 14, 0][side + 1] AS bx, y + [28, -28, -14, 6][side + 1] AS byy FROM d""")
GROUP.add("text_dimensions", """WITH c AS (SELECT p_partkey, filter(split(p_name, ''), x -> x <> '') AS l FROM part) SELECT p_partkey, aggregate(l, 0, (a, x) -> a + 10 + ascii(x) % 7 + 4) - CASE WHEN size(l) > 0 THEN 4 ELSE 0 END AS width FROM c""",
          """SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda x: 14 + ascii(x) % 7)) - 4 AS INT) AS width FROM part""")
_one("ratio_assertion", lambda p: p.select("p_partkey", ratios_hold(F.col("p_size") / 100, 0.7 - F.col("p_size") / 100, F.when(F.col("p_partkey") % 3 > 0, 0.3 + F.col("p_partkey") % 5 / 1500)).alias("holds")),
     "SELECT p_partkey, p_partkey % 3 > 0 AND p_partkey % 5 < 2 AS holds FROM part", "part")
_one("collated_metadata", lambda p: collated(p.select((F.floor(F.col("p_partkey") / 8)).alias("batch"), "p_partkey", F.map_filter(F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("string"))), lambda k, v: v.isNotNull()).alias("told")), "batch", "p_partkey", "told").select("batch", "key", F.array_join("values", ",", "-").alias("values")),
     """WITH b AS (SELECT p_partkey // 8 AS batch, p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_size::VARCHAR END AS size, min(p_partkey) OVER (PARTITION BY p_partkey // 8) AS first FROM part)
     SELECT batch, 'name' AS key, string_agg(p_name, ',' ORDER BY p_partkey) AS values FROM b GROUP BY batch UNION ALL
     SELECT batch, 'size', string_agg(coalesce(size, '-'), ',' ORDER BY p_partkey) FROM b GROUP BY batch, first HAVING first % 3 > 0""", "part")
