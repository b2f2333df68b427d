"""One query per training-data operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import encode_decode
from tidewatch.llm.chat import format_chats
from tidewatch.llm.common import table
from tidewatch.llm.embed_dedup import near_vectors
from tidewatch.llm.language import predict_language
from tidewatch.llm.mixing import mixed
from tidewatch.llm.periodic import collapse_runs, plant_runs
from tidewatch.llm.pii import KINDS, personal_data
from tidewatch.llm.quality_llr import judge
from tidewatch.llm.simhash_ball import near_copies
from tidewatch.llm.substring import remove_repeats
from tidewatch.llm.token_align import align_tokens
from tidewatch.llm.toxicity import score_toxicity
from tidewatch.llm.urls import judge_urls


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file: of the installed package, else in TOKENIZERS_DIR (default /opt/tokenizers)."""
    if importlib.util.find_spec("public_tokenizers") is not None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def op1_embed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS c FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(c) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""


def op2_quality_llr(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op3_simhash_ball(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumnRenamed("id", "doc_id")


def _of(kind: str):
    return lambda s: s.kind == kind


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s.kind != "term")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    found = format_chats(table(spark, folder, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "part", "n_turns", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(coalesce(length(role)::VARCHAR, '-') || ':' || coalesce(length(text)::VARCHAR, '-') || ':' || coalesce(role, '') || coalesce(text, ''), '|') OVER w AS so_far,
    '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
),
whole AS (SELECT conv_id, n_turns, so_far FROM r WHERE pos = n_turns),
kept AS (
  SELECT w.conv_id FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos = w.n_turns AND r.so_far = w.so_far AND (r.n_turns > w.n_turns OR (r.n_turns = w.n_turns AND r.conv_id < w.conv_id)))
),
x AS (
  SELECT r.conv_id, ((pos - 1) // 1000)::INTEGER AS part, any_value(n_turns)::BIGINT AS n_turns, string_agg(line, '' ORDER BY pos) AS text
  FROM r JOIN kept USING (conv_id) GROUP BY 1, 2
)
SELECT conv_id, part, n_turns, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha256, text FROM x
"""


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixed(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_decode(table(spark, folder, "documents"), vocabulary())
    return found.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = collapse_runs(table(spark, folder, "documents"), prepare=plant_runs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    return predict_language(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op13_align(spark: SparkSession, folder: str) -> DataFrame:
    found = align_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("groups", "groups_sha256")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embed_dedup": op1_embed_dedup,
        "op2_quality_llr": op2_quality_llr,
        "op3_simhash_ball": op3_simhash_ball,
        "op4_toxicity": op4_toxicity,
        "op5_pii": op5_pii,
        "op6_urls": op6_urls,
        "op7_chat": op7_chat,
        "op8_substring": op8_substring,
        "op9_mixing": op9_mixing,
        "op10_bpe": op10_bpe,
        "op11_periodic": op11_periodic,
        "op12_language": op12_language,
        "op13_align": op13_align,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op1_embed_dedup": OP1_SQL,
        "op7_chat": OP7_SQL,
    }
