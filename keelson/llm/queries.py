"""Queries that apply the operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import langid, lm, mixing, neardup, packing, quality, rules, secrets, telephony, tokencount
from keelson.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> tuple:
    """Where the public vocabulary files are; the same on all machines."""
    import public_tokenizers

    return tokencount.tokenizer_paths(public_tokenizers.path(json_name), public_tokenizers.path(ranks_name), public_tokenizers.PATTERN)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store(table(spark, sf_dir, "documents"))
    return telephony.features(stored, keep=("n_bytes",)).drop("error")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = documents.withColumn("held_out", held_out("doc_id", 4))
    return langid.predict(rows, langid.fit(documents), keep=("held_out",))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_paths())
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_paths()))


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents.withColumn("held_out", held_out("doc_id", 4)), model, keep=("held_out",))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size / weight AS full_at FROM s),
q AS (
  SELECT *, coalesce(sum(2 * source_size) OVER e, 0) AS spent,
         sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS rest,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM f WINDOW e AS (ORDER BY full_at, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((budget - spent)::DOUBLE / rest, full_at) AS t FROM q WHERE (budget - spent)::DOUBLE / rest <= full_at),
g AS (SELECT source, source_size, weight, least(2 * source_size::DOUBLE, coalesce(weight * t, 2 * source_size::DOUBLE)) AS target FROM q, v),
l AS (
  SELECT d.doc_id, d.size, d.source, d.h, g.source_size, g.weight, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (upto + pass * source_size)::DOUBLE / weight AS finish FROM l, (VALUES (0), (1)) AS x(pass) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, h, doc_id, pass ROWS UNBOUNDED PRECEDING) AS given FROM p),
k AS (SELECT doc_id, count(*) AS passes FROM o WHERE given <= floor(1.5 * (SELECT sum(size) FROM d)) GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, (l.size * coalesce(k.passes, 0))::BIGINT AS taken
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 2], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, u.b FROM r JOIN u ON r.reached = u.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_telephony, op2_langid, op3_secrets, op4_interpolation, op5_perplexity_bands, op6_token_counts, op7_bin_completion, op8_fair_queueing, op9_quality, op10_near_duplicates)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_fair_queueing": OP8_SQL, "op10_near_duplicates": OP10_SQL}
