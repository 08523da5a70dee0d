"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresift.llm import bpe, exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dedup, nearest, quotes, repair, sharding, token_alignment
from foresift.llm.common import table

SHARD_NAMES = [f"shard-{k:02d}" for k in range(sharding.SHARDS)]


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_NAMES).select(F.col("id").alias("doc_id"), F.col("slot").cast("long"), "shard")


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_quotes(spark, sf_dir):
    linked = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select(F.col("conv").alias("conv_id"), "turn", "role", "text", F.col("n_quotes").cast("long"), "reply_to", "thread", F.col("depth").cast("long"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs), carry=["doc_id"])
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_fingerprints(spark, sf_dir):
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_exact_dedup(spark, sf_dir):
    decided = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return decided.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chunks", "n_removed", "removed_chars", F.sha2("text", 256).alias("text_sha256"))


def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, with_groups=False)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    return repair.audit(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_sharding": op2_sharding, "op3_near_dedup": op3_near_dedup, "op4_quotes": op4_quotes, "op5_language_id": op5_language_id, "op6_bpe": op6_bpe, "op7_mixing": op7_mixing, "op8_fingerprints": op8_fingerprints, "op9_exact_dedup": op9_exact_dedup, "op10_line_dedup": op10_line_dedup, "op11_token_alignment": op11_token_alignment, "op12_nearest": op12_nearest, "op13_conversation_repair": op13_conversation_repair}

_HASH60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"

ORACLES = {
    "op2_sharding": f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({sharding.SHARDS}) r(i)
), lists AS (
  SELECT list({_HASH60.format("name || '/offset'")} % {sharding.SLOTS} ORDER BY i) AS offs,
         list({_HASH60.format("name || '/step'")} % {sharding.SLOTS - 1} + 1 ORDER BY i) AS steps,
         list(name ORDER BY i) AS names
  FROM shards
), turns AS (
  SELECT 0 AS turn, list_transform(range({sharding.SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, k: CASE WHEN k - 1 = slot THEN turn % {sharding.SHARDS} ELSE x END)
  FROM (
    SELECT turn, owner, list_filter(
      list_transform(range({sharding.SLOTS}), lambda j: (offs[turn % {sharding.SHARDS} + 1] + j * steps[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS}),
      lambda s: owner[s + 1] = -1)[1] AS slot
    FROM turns, lists WHERE turn < {sharding.SLOTS}
  )
), placed AS (
  SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(list_transform(owner, lambda x: names[x + 1])) AS shard
  FROM turns, lists WHERE turn = {sharding.SLOTS}
)
SELECT doc_id, d.slot, shard
FROM (SELECT doc_id, {_HASH60.format("coalesce(doc_id::VARCHAR, '')")} % {sharding.SLOTS} AS slot FROM documents) d JOIN placed USING (slot)""",
    "op7_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {_HASH60.format("coalesce(doc_id::VARCHAR, '')")} AS h
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM sizes WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(level) OVER ()) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest
  FROM goals
), runs AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h
), chosen AS (
  SELECT r.source, h, rest > 0 AND (upto <= rest OR (upto - words < rest AND upto - rest < rest - (upto - words))) AS more
  FROM runs r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h""",
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
