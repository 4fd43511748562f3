"""Registered queries of this package: one for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import alignment, chat, clustering, decontaminate, fingerprint, language_id, line_dedup, packing, sharding, simhash, suffix_tree, toxicity, warc
from starloom.llm.common import fold, table

SHARDS = 16


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# A user and an assistant who both say the strings of a common template.
STAGED = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    staged = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(STAGED).alias("text"))
    out = chat.format_chats(turns.unionByName(staged))
    back = out.withColumn("turns", chat.read_turns("formatted")).withColumn("trained", chat.trained_text())
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), near AS (
    SELECT *, row_number() OVER o AS r, lag(role) OVER o AS before FROM turns
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), held AS (
    SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|\+>|INST\b|/INST\b)', '\1\\\2\3', 'g') AS safe,
        replace(replace(regexp_replace(role, '([<\[])(\\*)(s>|/s>|\+>|INST\b|/INST\b)', '\1\\\2\3', 'g'), '%', '%25'), ']', '%5D') AS safe_role
    FROM near
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(safe) + CASE WHEN before = role THEN 3 ELSE 10 + length(safe_role) + 5 END) AS BIGINT) AS formatted_chars
FROM held GROUP BY conv_id
"""


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.read_pieces(packing.standing(packing.bins(docs, tokenizer())), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
lowest AS (SELECT payload_digest, min(page_id) AS lowest FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM coalesce(lowest, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM coalesce(lowest, page_id) THEN lowest END AS refers_to
FROM rows LEFT JOIN lowest USING (payload_digest)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shards.select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.with_language(docs.select("doc_id", "text"), model, "found")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.clean(line_dedup.build_index(docs), docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents),
lines AS (
    SELECT r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, doc_id, unnest(held) AS line, generate_subscripts(held, 1) AS pos FROM rows)
), shared AS (SELECT key, min(doc_id) AS lo FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, coalesce(l.doc_id <> s.lo, false) AS gone FROM lines l LEFT JOIN shared s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.summaries(alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), paths))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.centroid_clusters(table(spark, sf_dir, "embeddings"))


def _op13_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Rounds as sub-queries: components as rows, distances and floors of means by groups."""
    parts = ["""kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) AS r, vec_id, q FROM (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
        WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64))""",
             "parts AS MATERIALIZED (SELECT r, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM kept)",
             f"c0 AS MATERIALIZED (SELECT r - 1 AS cluster, i, v FROM parts WHERE r <= {clusters})"]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
    SELECT r, min((d, cluster)) AS m FROM (
        SELECT r, cluster, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS d FROM parts p JOIN c{k} c USING (i) GROUP BY r, cluster) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT c.cluster, c.i, coalesce(f.v, c.v) AS v FROM c{k} c LEFT JOIN (
        SELECT m[2] AS cluster, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
        FROM parts JOIN a{k} USING (r) GROUP BY m[2], i) f USING (cluster, i))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
    CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r)
JOIN (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY cluster) x ON x.cluster = m[2]
"""


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_chat_formatting, op3_suffix_tree, op4_fingerprints, op5_packing, op6_simhash, op7_decontamination, op8_warc, op9_sharding, op10_language_id,
    op11_line_dedup, op12_alignment, op13_centroids)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL = {"op2_chat_formatting": OP2_SQL, "op8_warc": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_centroids": _op13_sql()}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
