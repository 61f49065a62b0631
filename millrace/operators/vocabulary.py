"""Reports on a public tokenizer and the script's letters: what is one token, what comes back, and first vectors for new tokens.

The tokenizer's file is a parameter. Texts are coded in Arrow batches by the tokenizer itself, with the
new tokens added to it in the worker; the vocabulary is a relation of some tens of thousands of rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.script import DIGRAPHS, FEATHERS, LATIN, LETTERS, latin_to_script
from millrace.plans.registry import Group

# The Latin letters that a new letter's vector starts from; marks of editors that are tokens as well.
SEEDS = dict(zip(LETTERS, LATIN)) | {"ᚚ": "P", FEATHERS[0]: "(", FEATHERS[1]: ")"}
_loaded: dict = {}


def public(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str, added: tuple[str, ...] = ()):
    """The tokenizer with the new tokens, once in a process."""
    if (path, added) not in _loaded:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.add_tokens([AddedToken(t, normalized=False) for t in added])
        _loaded[path, added] = made
    return _loaded[path, added]


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id and token (as it is written in the file) of all tokens."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    rows = {**told["model"]["vocab"], **{a["content"]: a["id"] for a in told.get("added_tokens") or []}}
    return spark.createDataFrame(list(rows.items()), "token string, id int")


def missing(path: str, tokens: tuple[str, ...] = tuple(SEEDS)) -> tuple[str, ...]:
    """Those of the tokens that the tokenizer doesn't give as one token that comes back; they are what has to be added."""
    tokenizer = loaded(path)
    coded = [(t, tokenizer.encode(t, add_special_tokens=False).ids) for t in tokens]
    return tuple(t for t, ids in coded if len(ids) != 1 or tokenizer.decode(ids) != t)


def reports(texts: DataFrame, column: str, path: str, added: tuple[str, ...] = ()) -> DataFrame:
    """texts with token_ids, decoded, single_token and round_trip (but for blanks at the ends) of a column. A null text has no tokens and comes back as null."""
    names = texts.columns

    def run(batches):
        import pyarrow as pa

        tokenizer = loaded(path, added)
        for b in batches:
            told = b.column(column).to_pylist()
            ids = [None if t is None else tokenizer.encode(t, add_special_tokens=False).ids for t in told]
            back = [None if i is None else tokenizer.decode(i, skip_special_tokens=False) for i in ids]
            flags = [None if t is None else x.strip() == t.strip() for t, x in zip(told, back)]
            arrays = [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string()), pa.array([None if i is None else len(i) == 1 for i in ids], pa.bool_()), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*names, "token_ids", "decoded", "single_token", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kinds}, token_ids array<int>, decoded string, single_token boolean, round_trip boolean")


def first_vectors(embeddings: DataFrame, ordinal: str, vector: str, path: str, strategy: str = "latin", seeds: dict[str, str] | None = None) -> DataFrame:
    """letter, parts (how many vectors count) and vector of each new token: the mean of its Latin letters' vectors, by the first token of each letter, or zeros.

    embeddings: the row of a token by its id. Letters none of whose vectors is there are left out; letters that are single tokens already aren't new.
    """
    if strategy not in ("latin", "zero"):
        raise ValueError(f"unknown strategy: {strategy}")
    spark, seeds = embeddings.sparkSession, SEEDS if seeds is None else seeds
    new, tokenizer = missing(path, tuple(seeds)), loaded(path)
    parts = [(t, i, tokenizer.encode(c, add_special_tokens=False).ids[:1]) for t in new for i, c in enumerate(seeds[t])]
    rows = F.broadcast(spark.createDataFrame([(t, i, ids[0]) for t, i, ids in parts if ids], "letter string, place int, id int"))  # two for each letter of the script
    met = embeddings.select(F.col(ordinal).alias("id"), F.col(vector).cast("array<double>").alias("v")).join(rows, "id")
    value = F.avg("x") if strategy == "latin" else F.lit(0.0)
    means = met.select("letter", "place", F.posexplode("v").alias("k", "x")).groupBy("letter", "k").agg(value.alias("x"), F.count("*").alias("parts"))
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])
    return means.groupBy("letter").agg(F.max("parts").alias("parts"), vectors.alias("vector"))


GROUP = Group()


def _both(s, d: str) -> DataFrame:
    """Single characters of the parts' names, in Latin and in script, before and after the script's letters are added."""
    part = s.read.parquet(f"{d}/part.parquet")
    of = lambda text, kind: part.select(F.explode(F.split(text, "")).alias("c")).filter("c <> ''").distinct().withColumn("kind", F.lit(kind))
    # the script's blank is a blank to tokenizers
    chars = of(F.col("p_name"), "latin").unionAll(of(F.translate(latin_to_script(F.col("p_name")), " ", " "), "script").filter("c <> ' '"))
    path = public()
    told = [reports(chars, "c", path, missing(path) if extended else ()).withColumn("extended", F.lit(extended)) for extended in (False, True)]
    count = lambda flag: F.count_if(flag).alias(f"n_{flag}")
    return told[0].unionAll(told[1]).groupBy("kind", "extended").agg(F.count("*").alias("n"), count("single_token"), count("round_trip"))


def _script_of(column: str) -> str:
    from millrace.functions.script import _SCRIPT

    return _SCRIPT.replace("p_name", column)


GROUP.frame(
    "round_trip_report", _both,
    f"""WITH l AS (SELECT DISTINCT unnest(string_split(p_name, '')) AS c FROM part), s AS (SELECT DISTINCT unnest(string_split({_script_of('p_name')}, '')) AS c FROM part),
    n AS (SELECT 'latin' AS kind, count(*) AS n FROM l WHERE c <> '' UNION ALL SELECT 'script', count(*) FROM s WHERE c <> '' AND unicode(c) > 5760)
    SELECT kind, extended, n, CASE WHEN kind = 'latin' OR extended THEN n ELSE 0 END AS n_single_token, n AS n_round_trip FROM n, (SELECT unnest([false, true]) AS extended)""",
)


def _lengths(s, d: str) -> DataFrame:
    path = public()
    text = F.translate(latin_to_script(F.col("p_name")), " ", " ")
    told = reports(s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.alias("label")), "label", path, missing(path))
    return told.select("p_partkey", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


# every letter is one token, and so is a blank between letters
GROUP.frame("extended_labels", _lengths, f"SELECT p_partkey, length({_script_of('p_name')}) AS n_tokens, true AS round_trip FROM part")
_DIGITS = 6
GROUP.frame(
    "embedding_mean",
    lambda s, d: first_vectors(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", public()).select("letter", "parts", F.posexplode("vector").alias("k", "x")).select("letter", "parts", "k", F.round("x", _DIGITS).alias("x")),
    # in this vocabulary the printable characters come first, from the exclamation mark on
    f"""WITH s(letter, latin) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SEEDS.items())}), c AS (SELECT letter, unnest(string_split(latin, '')) AS c FROM s),
    e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT letter, count(*) AS parts, k::INT AS k, round(avg(x), {_DIGITS}) AS x FROM c JOIN e ON vec_id = ascii(c) - 33 GROUP BY letter, k""",
)
