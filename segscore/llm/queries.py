"""One query per operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, infill, lines, neardup, packing, pii, repair, repeats, rules, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_windows(rows, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.HashTree(2, 3, 4), sharding.HashTree(2, 3, 4).grow())


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.arrange(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"), harm=True)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.found_spans(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op5_warc": OP5, "op11_fill_in_middle": OP11}


OP2 = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), b AS (
  SELECT trim(line) AS t, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^ \t\x0B\f\r]')
  GROUP BY 1 HAVING count(DISTINCT site) >= CASE WHEN length(trim(line)) < 20 THEN 15 ELSE 10 END
), k AS (
  SELECT l.*, b.first IS NOT NULL AND l.doc_id <> b.first AS gone FROM l LEFT JOIN b ON trim(l.line) = b.t
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM k GROUP BY doc_id
"""

OP5 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS digest_ok
FROM f
"""

OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT *, ('0x' || substring(h, 1, 8))::BIGINT % (n + 1) AS k1, ('0x' || substring(h, 9, 8))::BIGINT % (n + 1) AS k2,
         ('0x' || substring(h, 17, 8))::BIGINT % 100 AS k3, ('0x' || substring(h, 25, 8))::BIGINT % 100 AS k4
  FROM d
), f AS (
  SELECT *, least(k1, k2) AS a, greatest(k1, k2) AS b,
         CASE WHEN n = 0 OR k3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, '<P>' || substring(t, 1, a) AS pre, '<S>' || substring(t, b + 1, n - b) AS suf,
         '<M>' || substring(t, a + 1, b - a) AS mid
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
