"""The operators as driver queries, op<N>_<name>, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import mixed_sizes

    return mixed_sizes(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_hash", "root")


def op3_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.metric_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), copies=True)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.repeated_passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("mate_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality_rules import quality_cascade

    return quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality_model import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.piece_codec import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.personal_data import personal_digest

    return personal_digest(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR {rules}) AS kept
FROM b
"""


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k, row_number() OVER () AS r
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM s0),
s2 AS (SELECT *, (no - 1) % 3 + 1 AS w, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s1),
s3 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap * (6 // w), no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
         sum(w) OVER (ORDER BY cap * (6 // w), no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s2),
s4 AS (SELECT *, (total - lower) * 6 >= cap * (6 // w) * rest AS capped FROM s3),
s5 AS (
  SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS lft,
         (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS opn FROM s4),
s AS (
  SELECT source, source_size, target, least(floor(target)::BIGINT, cap) AS quota
  FROM (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (w * lft)::DOUBLE / opn::DOUBLE END AS target FROM s5)),
p AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, r ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE
         size * (quota // source_size) + greatest(0, least(size, quota % source_size - start)) END)::BIGINT AS taken
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
"""


OP3_SQL = r"""
WITH e AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
smallest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (
  SELECT r, doc_id, i - 1 AS pos, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
shared AS (SELECT h FROM p GROUP BY h HAVING min(r) <> max(r)),
hit AS (SELECT r, doc_id, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS prior FROM p WHERE h IN (FROM shared)),
part AS (
  SELECT *, sum(CASE WHEN prior IS NULL OR pos > prior + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS k
  FROM hit)
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + 50)::BIGINT AS end_word FROM part GROUP BY r, doc_id, k
"""


def oracle_sql() -> dict[str, str]:
    from barloom.llm.quality_rules import RULES

    return {
        "op1_source_mix": OP1_SQL,
        "op2_near_duplicates": OP2_SQL,
        "op3_metric_tree": OP3_SQL,
        "op4_repeated_passages": OP4_SQL,
        "op5_quality_rules": OP5_SQL.replace("{rules}", " OR ".join(f"({r.sql})" for r in RULES)),
    }
