"""The queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, lm_score, near_dedup, ngram_join, pii, token_files, toxicity, vector_codes, warc, whitening
from .common import LOWER, UPPER, table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file, which every worker has under the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(control)
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    return chat.read(chat.write(turns, tokenizer), tokenizer).drop("n_tokens")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url", "html")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), ids=False)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(table(spark, sf_dir, "documents"))
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("all").alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("sanitised_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_within(table(spark, sf_dir, "documents"), width=3, radius=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_lm_score": op1_attention_lm_score,
    "op2_repair_token_files": op2_repair_token_files,
    "op3_chat_prefix_tree": op3_chat_prefix_tree,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_pii_disclosure": op7_pii_disclosure,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_ngram_join": op12_ngram_join,
    "op13_whitening": op13_whitening,
}


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every round in full: all parts against all entries, then floored means."""
    sql = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        q AS (SELECT *, row_number() OVER (ORDER BY vec_id, x) AS r FROM k), p AS MATERIALIZED (SELECT r, vec_id, label, part, x[len(x) // {parts} * part + 1 : len(x) // {parts} * (part + 1)] AS v FROM q, range({parts}) AS t(part)),
        b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY r) - 1 AS e, v AS c FROM p QUALIFY e < {entries})"""
    for i in range(rounds + 1):
        sql += f""", a{i} AS MATERIALIZED (SELECT r, vec_id, label, p.part, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} USING (part) QUALIFY row_number() OVER (PARTITION BY r, p.part ORDER BY d, e) = 1)"""
        if i < rounds:
            sql += f""", u{i} AS (SELECT part, e, unnest(v) AS s, generate_subscripts(v, 1) AS j FROM a{i}), m{i} AS (SELECT part, e, j, CAST(sum(s) AS BIGINT) AS s, count(*) AS n FROM u{i} GROUP BY ALL),
            f{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{i} GROUP BY part, e), b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(f.c, b.c) AS c FROM b{i} b LEFT JOIN f{i} f USING (part, e))"""
    return sql + f""", g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
        o AS (SELECT r, vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, g"""


_ESCAPE = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\#'), '</turn>', '\\</turn>')"

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE),
    "op3_chat_prefix_tree": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || replace({_ESCAPE.format("role")}, ':', '\\:') || ': ' || {_ESCAPE.format("text")} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
