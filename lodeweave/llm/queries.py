"""The queries of the training-data operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import alignment, byte_bpe, chat, fill_middle, html_text, language_id, mixing, near_dup, quality, search, sharding, token_counts, vector_dup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.link_classes(_table(spark, sf_dir, "embeddings"))


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


#: The same rows by nested arrays of turns instead of hashes.
_CHAT_SQL = """
WITH clean AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM clean),
rolled AS (
  SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY position) AS so_far
  FROM placed),
ends AS (SELECT so_far, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE position = n_turns GROUP BY so_far, n_turns),
kept AS (
  SELECT * FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.position < r.n_turns AND r.position = e.n_turns AND r.so_far = e.so_far))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.position) AS text
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""

#: Whole token lists instead of chunks and ranks.
_FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda p: ('0x' || substr(h, p, 8))::BIGINT) AS draws FROM d),
placed AS (
  SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 50 THEN 'plain'
              WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:], ''), '') AS s
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def _crc_table() -> list[int]:
    """The CRC-32 of each byte, from the polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: Walks as a recursion over integers of 128 bits, slots by one window a shard, checksums byte by byte.
_SHARD_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT DISTINCT text FROM d),
sums AS (
  SELECT text, strlen(text) + 16 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT),
             lambda c, x: xor(c >> 8, list_extract({_crc_table()}, ((xor(c, x) & 255) + 1)::BIGINT)::UBIGINT), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM texts),
walks(r, k, b, j) AS (
  SELECT r, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT r, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
         floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM walks WHERE j < 40),
ended AS (SELECT r, b AS shard, CASE WHEN j = 40 THEN 40 ELSE b END AS grown_shard FROM walks WHERE j >= 40),
placed AS (
  SELECT doc_id, size, text_crc32, shard::INT AS shard, grown_shard::INT AS grown_shard,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), text_crc32, size)), 1, 15))::BIGINT AS place
  FROM d JOIN sums USING (text) JOIN ended USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_vector_near_dup, op3_chat_snapshots, op4_token_counts, op5_near_dup, op6_language_id, op7_bm25_top_k, op8_html_text, op9_byte_bpe, op10_mixing, op11_fill_middle, op12_jump_shards, op13_token_alignment)}


def oracle_sql() -> dict:
    return {"op3_chat_snapshots": _CHAT_SQL, "op11_fill_middle": _FIM_SQL, "op12_jump_shards": _SHARD_SQL}
