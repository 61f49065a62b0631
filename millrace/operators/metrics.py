"""Recognition-quality metrics: error rates and their variants, exact match, error analysis, strata.

Texts count whole, in whatever script: the pairs are conversation turns, every other one of
them in script letters, with predictions that replace and lose letters. The edit distance
counts code points and is bit-parallel (functions/distance.py). The other engine's counts bytes,
so there the characters of a pair become single bytes first.
"""

from millrace.functions import distance
from millrace.plans.registry import Group, dealt_out, plan

GROUP = Group()
# Letters that have one of their own in the script block, and those letters.
LATIN, LETTERS = "BLFSNHDTCQMGZRAOUEI ", "ᚁᚂᚃᚄᚅᚆᚇᚈᚉᚊᚋᚌᚎᚏᚐᚑᚒᚓᚔ "
PAIRS = f"""pairs AS (SELECT conv_id, turn, role, r, translate(r, 'aeoᚐᚓᚑ', 'oiᚒᚔ') AS p
  FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN translate(coalesce(text, ''), '{LATIN}', '{LETTERS}') ELSE coalesce(text, '') END AS r FROM conversations) x)"""
# al: the pair's characters; co: as many single bytes
CODED = """pairs AS (SELECT *, array_to_string(list_transform(range(1, length(al) + 1), lambda i: chr(i::INT)), '') AS co FROM (
  SELECT *, array_to_string(list_distinct(string_split(p || r || ' ', '')), '') AS al FROM plain) y)"""
SPARK, DUCK = "WITH " + PAIRS, "WITH " + PAIRS.replace("pairs", "plain", 1) + ", " + CODED


def coded(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, al, co), translate({b}, al, co))"


def scored_plan(sql: str):
    """A query whose text uses the distances."""
    run = plan(sql, dealt_out)

    def registered(spark, sf_dir):
        distance.register(spark)
        return run(spark, sf_dir)

    return registered


def both(name: str, body: str, oracle: str | None = None) -> None:
    """LEV{a, b} in the body is the edit distance of a and b."""

    def told(text: str, distance) -> str:
        parts = text.split("LEV{")
        return parts[0] + "".join(distance(*args.split("; ")) + rest for args, rest in (p.split("}", 1) for p in parts[1:]))

    GROUP.frame(name, scored_plan(SPARK + told(body, "edit_distance({}, {})".format)), DUCK + told(oracle or body, coded))


# One distance a pair, below whatever groups it.
SCORED = ", scored AS (SELECT conv_id, turn, role, p, r, length(r) AS n, LEV{p; r} AS edits FROM pairs)"
ONE, NONE = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"
SAMPLE_CER = f"CASE WHEN n = 0 THEN CASE WHEN length(p) > 0 THEN {ONE} ELSE {NONE} END ELSE CAST(edits AS DOUBLE) / n END"
both("cer_by_role", SCORED + f""" SELECT role, count(*) AS n_samples, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS n_chars,
  CASE WHEN sum(n) > 0 THEN CAST(sum(edits) AS DOUBLE) / sum(n) ELSE {NONE} END AS cer,
  avg(CASE WHEN p = r THEN {ONE} ELSE {NONE} END) AS exact_match FROM scored GROUP BY role""")
both("cer_floor1_by_role", SCORED + " SELECT role, CAST(sum(edits) AS DOUBLE) / sum(greatest(n, 1)) AS cer FROM scored GROUP BY role")
both("cer_trimmed_by_role", f""", scored AS (SELECT role, length(trim(r)) AS n, LEV{{trim(p); trim(r)}} AS edits FROM pairs)
  SELECT role, CASE WHEN sum(n) > 0 THEN CAST(sum(edits) AS DOUBLE) / sum(n) ELSE {ONE} END AS cer FROM scored GROUP BY role""")
both("cer_despaced", """, scored AS (SELECT turn, length(replace(r, ' ', '')) AS n, LEV{replace(p, ' ', ''); replace(r, ' ', '')} AS edits FROM pairs)
  SELECT turn, 100 * CAST(sum(edits) AS DOUBLE) / sum(greatest(n, 1)) AS cer_percent FROM scored GROUP BY turn""")
both("cer_macro", SCORED + f""", told AS (SELECT turn, CASE WHEN r NOT LIKE '%.' THEN 'truncated' END AS error, {SAMPLE_CER} AS cer FROM scored)
  SELECT turn, avg(CASE WHEN error IS NULL THEN cer END) AS mean_cer, count(CASE WHEN error IS NULL THEN 1 END) AS n_ok, count(error) AS n_errors FROM told GROUP BY turn""")
both("exact_match_by_turn", f""" SELECT turn, avg(CASE WHEN p = r THEN {ONE} ELSE {NONE} END) AS exact_match, avg(CASE WHEN replace(p, ' ', '') = replace(r, ' ', '') THEN {ONE} ELSE {NONE} END) AS exact_despaced FROM pairs GROUP BY turn""")
both("metric_bundle", SCORED + f""" SELECT CAST(sum(edits) AS DOUBLE) / greatest(sum(n), 1) AS cer, avg(CASE WHEN p = r THEN {ONE} ELSE {NONE} END) AS exact_match, count(*) AS n_samples FROM scored""")
both("per_sample_cer", SCORED + f" SELECT conv_id, turn, {SAMPLE_CER} AS cer FROM scored")
both("worst_k_samples", SCORED + " SELECT conv_id, turn, edits FROM scored ORDER BY edits DESC, conv_id, turn LIMIT 10")
both("char_deletions_topk",
     """, c AS (SELECT p, explode(split(r, '')) AS ch FROM pairs) SELECT ch, count(*) AS n FROM c WHERE ch <> '' AND instr(p, ch) = 0 GROUP BY ch ORDER BY n DESC, ch LIMIT 10""",
     """, c AS (SELECT p, unnest(string_split(r, '')) AS ch FROM pairs) SELECT ch, count(*) AS n FROM c WHERE ch <> '' AND instr(p, ch) = 0 GROUP BY ch ORDER BY n DESC, ch LIMIT 10""")
both("char_insertions_topk",
     """, c AS (SELECT r, explode(split(p, '')) AS ch FROM pairs) SELECT ch, count(*) AS n FROM c WHERE ch <> '' AND instr(r, ch) = 0 GROUP BY ch ORDER BY n DESC, ch LIMIT 10""",
     """, c AS (SELECT r, unnest(string_split(p, '')) AS ch FROM pairs) SELECT ch, count(*) AS n FROM c WHERE ch <> '' AND instr(r, ch) = 0 GROUP BY ch ORDER BY n DESC, ch LIMIT 10""")
both("stratified_length_turn", SCORED + """, s AS (SELECT *, CASE WHEN n < 6 THEN 'short' WHEN n < 15 THEN 'medium' WHEN n < 100 THEN 'long' END AS len_bucket FROM scored),
  fine AS (SELECT len_bucket, turn, role, sum(edits) AS edits, sum(n) AS n_chars, count(*) AS n FROM s GROUP BY len_bucket, turn, role)
  SELECT len_bucket, turn, role, CAST(grouping(len_bucket) AS INT) AS g_len, CAST(grouping(turn) AS INT) AS g_turn, CAST(grouping(role) AS INT) AS g_role, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n) AS BIGINT) AS n
  FROM fine GROUP BY GROUPING SETS ((), (len_bucket), (turn), (role))""")
GROUP.add("length_histogram_zero_filled",
          """WITH l AS (SELECT length(text) AS n FROM benchmark WHERE text IS NOT NULL), b AS (SELECT explode(sequence(5, 400)) AS n),
  c AS (SELECT n, count(*) AS cnt FROM l GROUP BY n)
  SELECT b.n, coalesce(cnt, 0) AS cnt, CAST(coalesce(cnt, 0) AS DOUBLE) / (SELECT sum(cnt) FROM c) AS share FROM b LEFT JOIN c ON b.n = c.n""",
          """WITH l AS (SELECT length(text) AS n FROM benchmark WHERE text IS NOT NULL), b AS (SELECT unnest(range(5, 401))::INT AS n)
  SELECT b.n, count(l.n) AS cnt, CAST(count(l.n) AS DOUBLE) / (SELECT count(*) FROM l) AS share FROM b LEFT JOIN l ON b.n = l.n GROUP BY b.n""")
GROUP.add("domain_gap", """WITH s AS (SELECT avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END) AS syn, avg(CASE WHEN toxic = 1 THEN CAST(quality AS DOUBLE) END) AS rl FROM labels)
  SELECT syn, rl, rl - syn AS gap, CASE WHEN syn > 0 THEN rl / syn ELSE CAST('Infinity' AS DOUBLE) END AS ratio, abs(rl - syn) > CAST(0.15 AS DOUBLE) AS flagged FROM s""")
GROUP.add("model_strategy_pivot", """SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS click, avg(CASE WHEN event_type = 'view' THEN value END) AS view_value, avg(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, count(*) AS n FROM events GROUP BY user_id""")
GROUP.add("mode_winner", """WITH m AS (SELECT o_orderpriority AS mode, avg(o_totalprice) AS cer FROM orders GROUP BY o_orderpriority) SELECT mode, cer FROM m ORDER BY cer, mode LIMIT 1""")
GROUP.add("display_capped", """SELECT event_type, max(value) AS true_value, least(max(value), CAST(110 AS DOUBLE)) AS shown FROM events GROUP BY event_type""")
