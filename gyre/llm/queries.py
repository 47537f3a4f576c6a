"""The registered queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm import merkle
from gyre.llm.bpe import bpe_round_trip
from gyre.llm.exact_dedup import exact_dedup
from gyre.llm.language_crf import language_id
from gyre.llm.license_scan import license_labels
from gyre.llm.line_dedup import SITES, line_dedup
from gyre.llm.near_dedup import near_duplicates
from gyre.llm.packing import pack
from gyre.llm.sharding import SHARD_BYTES, extendible_shards
from gyre.llm.substring_dedup import WINDOW, substring_dedup
from gyre.llm.syncmers import edited_likeness
from gyre.llm.token_alignment import token_alignment
from gyre.llm.warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(_documents(spark, sf_dir), limit=SHARD_BYTES)


OP1_SQL = f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS bits,
         coalesce(strlen(text), 0) AS n_bytes
  FROM documents),
x AS (SELECT r.*, d, bits >> (60 - d) AS p FROM r, (SELECT unnest(range(0, 61))::INTEGER AS d)),
b AS (SELECT d, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM x GROUP BY d, p),
l AS (SELECT d, p, shard_bytes, shard_rows FROM b WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 OR d = 60)
SELECT x.doc_id, x.n_bytes, x.d AS depth, CASE WHEN x.d = 0 THEN '' ELSE lpad(bin(x.p), x.d, '0') END AS shard_id,
       l.shard_bytes, l.shard_rows, l.shard_bytes > {SHARD_BYTES} AS oversized
FROM x JOIN l ON x.d = l.d AND x.p = l.p
QUALIFY row_number() OVER (PARTITION BY x.doc_id ORDER BY x.d) = 1
"""


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=3, percent=85)


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS keep,
         list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(payload), CAST(1 + 5 * i AS INTEGER), 5))::BIGINT) AS v
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((v[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d
"""


def op4_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), window=WINDOW)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op7_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
t AS (SELECT doc_id, source, i, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max(CAST(source IS NULL AS INTEGER)) >= {SITES}),
m AS (SELECT t.*, t.line IN (SELECT line FROM b) AS cut FROM t)
SELECT d.doc_id, count(m.i) AS n_lines, count(m.i) FILTER (m.cut) AS n_removed,
       sha256(coalesce(string_agg(m.raw, chr(10) ORDER BY m.i) FILTER (NOT m.cut), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_documents(spark, sf_dir))


def op10_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("token_ids")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by its checksum has been tampered with: its text is in lower case."""
    docs = _documents(spark, sf_dir)
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = merkle.leaf([small if f == "text" else F.col(f) for f in merkle.FIELDS])
    return merkle.merkle_manifest(docs, changed=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, now))


def _field_sql(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All levels of the trees over ``leaves`` (g, i, h, n): the nodes, and what stands left and right of each in its run."""
    return f"""{name}_all(l, g, i, h, n) AS (
  SELECT 0, g, i, h, n FROM {leaves} UNION ALL
  SELECT l + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM {name}_all WHERE n > 1 GROUP BY l, g, i // 8, n),
{name}_path AS (
  SELECT l, g, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM {name}_all WHERE n > 1 WINDOW w AS (PARTITION BY l, g, i // 8 ORDER BY i))"""


#: CRC-32 bit by bit: -1 stands for a shift.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_concat([unicode(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"""
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS g, {_field_sql(*merkle.FIELDS)} AS leaf, {_CRC_SQL} % 3 = 0 AS bent,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM documents),
q AS (SELECT g, doc_id, leaf AS h, CASE WHEN bent THEN {_field_sql(*(f if f != "text" else "small" for f in merkle.FIELDS))} ELSE leaf END AS now,
        row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql("low", "q")},
s AS (SELECT g AS grp, h, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low_all WHERE n = 1),
{_tree_sql("top", "s")},
m AS (
  SELECT q.g, q.i, 0 AS part, p.l, p.a, p.b FROM q JOIN low_path p ON p.g = q.g AND p.i = q.i // CAST(pow(8, p.l) AS BIGINT) UNION ALL
  SELECT q.g, q.i, 1, p.l, p.a, p.b FROM q JOIN s ON s.grp = q.g JOIN top_path p ON p.i = s.i // CAST(pow(8, p.l) AS BIGINT)),
f AS (SELECT g, i, string_agg(a || b, '' ORDER BY part, l) AS proof, list(a || '|' || b ORDER BY part, l) AS steps FROM m GROUP BY g, i),
o AS (
  SELECT q.doc_id, q.h AS leaf, s.h AS subroot, (SELECT h FROM top_all WHERE n = 1) AS root, sha256(coalesce(f.proof, '')) AS proof_sha256,
         list_reduce(list_concat([q.now], coalesce(f.steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM q JOIN s ON s.grp = q.g LEFT JOIN f ON f.g = q.g AND f.i = q.i)
SELECT *, folded_root = root AS verified FROM o
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(_documents(spark, sf_dir))


QUERIES = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_warc_chain": op3_warc_chain,
    "op4_substring_automata": op4_substring_automata,
    "op5_bpe_transducer": op5_bpe_transducer,
    "op6_crf_language": op6_crf_language,
    "op7_streaming_dedup": op7_streaming_dedup,
    "op8_line_spread": op8_line_spread,
    "op9_syncmers": op9_syncmers,
    "op10_dp_packing": op10_dp_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_license_rules": op13_license_rules,
}
ORACLE = {
    "op1_extendible_sharding": OP1_SQL,
    "op3_warc_chain": OP3_SQL,
    "op7_streaming_dedup": OP7_SQL,
    "op8_line_spread": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
