"""The thin queries of this subpackage: each applies an operator to its whole table.

``queries()`` and ``oracle_sql()`` are added to the repository's own by ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, ngram_lm, quality, substring_dedup, url_filter

#: The rules of the url query.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
LM_ORDER = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(modulus: int):
    """crc32 of doc_id's text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def vocabulary() -> str:
    """The public byte-level vocabulary; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), RULES, default="allow")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.filter(part_of(5) != 1), LM_ORDER)
    return model.score_frame(docs).select("doc_id", (part_of(5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=10).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(part_of(3) != 1))
    return model.predict_frame(docs).select("doc_id", (part_of(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary(), keep=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(part_of(3) != 1))
    return model.score_frame(docs).select("doc_id", (part_of(3) == 1).alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_ngram_lm, op3_line_dedup, op4_language_id, op5_bpe, op6_quality, op7_exact_dedup, op8_substring_dedup, op9_jaccard_join, op10_decontaminate)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM split JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, first IS NOT NULL AND first <> doc_id AS dropped FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gs FROM w
), g AS (
  SELECT doc_id, unnest(gs) AS gram FROM grams
), links AS (
  SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) o
  JOIN grams m ON m.doc_id = o.a JOIN grams n ON n.doc_id = o.b WHERE 100 * o.n >= 75 * (len(m.gs) + len(n.gs) - o.n)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, component_id FROM grams JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: learnt models, a vocabulary file, rolling hashes. Their tests hold them
    against plain versions."""
    return {"op1_url_filter": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL}
