"""Alignment of prediction and reference: word error rate, positional differences, label encoding."""

from millrace.operators.metrics import DUCK, SPARK, scored_plan
from millrace.plans.registry import Group

GROUP = Group()
CODED = """, c AS (SELECT role, split(p, ' ', -1) AS a, split(r, ' ', -1) AS b FROM pairs), s AS (SELECT role, size(b) AS n, word_distance(a, b) AS edits FROM c)
SELECT role, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(edits) AS DOUBLE) / sum(n) AS wer FROM s GROUP BY role"""
# The other engine counts bytes, so there the distance is a table of rows, one step a reference word.
TABLE = """, s AS (SELECT role, string_split(p, ' ') AS a, string_split(r, ' ') AS b FROM pairs),
dp AS (SELECT role, a, b, 0::BIGINT AS i, range(0, len(a) + 1) AS d FROM s UNION ALL
  SELECT role, a, b, i + 1, list_transform(range(1, len(a) + 2), lambda j: j + list_min(list_slice(c, 1, j))) FROM (
    SELECT *, list_transform(range(1, len(a) + 2), lambda j: CASE WHEN j = 1 THEN d[1] + 1 ELSE least(d[j] + 1, d[j - 1] + CASE WHEN a[j - 1] = b[i + 1] THEN 0 ELSE 1 END) END - j) AS c FROM dp WHERE i < len(b)))
SELECT role, sum(d[len(a) + 1])::BIGINT AS edits, sum(len(b))::BIGINT AS n_words, sum(d[len(a) + 1])::DOUBLE / sum(len(b)) AS wer FROM dp WHERE i = len(b) GROUP BY role"""
GROUP.frame("wer_by_role", scored_plan(SPARK + CODED), DUCK.replace("WITH ", "WITH RECURSIVE ", 1) + TABLE)

DIFF = "SELECT conv_id, turn, n, hits, CASE WHEN n > 0 THEN CAST(hits AS DOUBLE) / n ELSE CAST(1 AS DOUBLE) END AS char_accuracy FROM x"
GROUP.add("positional_diff",
          SPARK + """, x AS (SELECT conv_id, turn, CAST(greatest(length(p), length(r)) AS BIGINT) AS n, CAST(size(filter(zip_with(filter(split(p, ''), c -> c <> ''), filter(split(r, ''), c -> c <> ''), (a, b) -> coalesce(a = b, false)), h -> h)) AS BIGINT) AS hits FROM pairs) """ + DIFF,
          DUCK + """, x AS (SELECT conv_id, turn, greatest(length(p), length(r))::BIGINT AS n, len(list_filter(range(1, least(length(p), length(r)) + 1), lambda j: p[j] = r[j]))::BIGINT AS hits FROM pairs) """ + DIFF)

CHARS, LONGEST = "abcdefghijklmnopqrstuvwxyz ", 64
ENCODE = f"""WITH c AS (SELECT item_id, filter(transform(split(lower(coalesce(text, '')), ''), x -> CASE WHEN x = '' THEN 0 ELSE instr('{CHARS}', x) END), i -> i > 0) AS l FROM benchmark),
e AS (SELECT item_id, least(size(l), {LONGEST}) AS n, concat(slice(l, 1, {LONGEST}), array_repeat(0, {LONGEST} - least(size(l), {LONGEST}))) AS ids FROM c) """
ENCODE_DUCK = f"""WITH c AS (SELECT item_id, list_filter(list_transform(string_split(lower(coalesce(text, '')), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE instr('{CHARS}', x) END), lambda i: i > 0) AS l FROM benchmark),
e AS (SELECT item_id, least(len(l), {LONGEST})::INT AS n, list_concat(l[1:{LONGEST}], list_transform(range({LONGEST} - least(len(l), {LONGEST})), lambda i: 0)) AS ids FROM c) """
GROUP.add("vocabulary_encode", ENCODE + "SELECT item_id, n, array_join(transform(ids, x -> CAST(x AS STRING)), ',') AS ids FROM e", ENCODE_DUCK + "SELECT item_id, n, array_to_string(ids, ',') AS ids FROM e")
GROUP.add("label_mask", ENCODE + "SELECT item_id, array_join(transform(ids, x -> CASE WHEN x = 0 THEN '-100' ELSE CAST(x AS STRING) END), ',') AS labels FROM e", ENCODE_DUCK + "SELECT item_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels FROM e")
