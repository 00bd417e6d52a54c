"""The query of each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import chat, cotraining, cross_polytope, language_id, line_dedup, ngram_jaccard, packing, quality_rules, suffix_dedup, tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer splits than there are cores, so a small one, is dealt to all cores before texts are worked on."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_groups(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).drop("n_ids")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(documents(spark, sf_dir))


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = cotraining.quality_views(documents(spark, sf_dir))
    return cotraining.score_quality(views, cotraining.fit_quality(views, table(spark, sf_dir, "labels")))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip_digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed_lines", "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    return language_id.predict_languages(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model, keep_text=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(documents(spark, sf_dir))


def op9_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return out.withColumn("spans", spans)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_best_fit_packing, op3_suffix_array_dedup, op4_cotraining_quality, op5_bpe_round_trip, op6_line_dedup,
        op7_language_id, op8_quality_rules, op9_cross_polytope_ann, op10_perspective_rotation, pipeline,
    )
}

#: Same rows as op6: a line's key is the line without blanks at its ends; sites are counted exactly.
OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line, trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) AS u
), bad AS (
  SELECT k, min(doc_id * 1000000 + pos) AS first FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AND l.doc_id * 1000000 + l.pos <> b.first AS gone
  FROM lines l LEFT JOIN bad b ON l.k = b.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed_lines,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), seats AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), seen AS (
  SELECT s.*, p.speaker, s.role = p.speaker AS target,
         '<|im_start|>' || CASE WHEN s.role = p.speaker THEN 'assistant' WHEN s.role = 'system' THEN s.role ELSE 'user name=' || s.role END || chr(10) AS head
  FROM said s JOIN seats p ON s.conv_id = p.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM seen
)
SELECT conv_id, speaker, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
       CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (target) AS BIGINT) AS n_target_turns,
       CAST(sum(length(head) + length(text) + 11) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(text)) FILTER (target), 0) AS BIGINT) AS target_chars,
       coalesce(string_agg(CAST(begins + length(head) AS VARCHAR) || '+' || CAST(length(text) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (target), '') AS spans
FROM placed GROUP BY conv_id, speaker
"""

ORACLES: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op10_perspective_rotation": OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
