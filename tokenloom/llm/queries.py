"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_blocks, line_dedup, ngram_join, packing, quality, sharding, token_binary, token_counts, warc
from .common import documents, stored, table, work_dir

SHARDS = 16
TOKEN_LIMIT = 1024
END_ID = 1


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.stratified_shards(rows, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(documents(spark, sf_dir, "doc_id", "text"), vocabulary("word_bpe_49k.json"), end_id=END_ID)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the prefix table of every text and answers from it."""
    counts = stored(token_counts.prefix_token_counts(documents(spark, sf_dir, "doc_id", "text"), vocabulary("byte_bpe_50k.json")), work_dir(spark) + "/prefixes")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(documents(spark, sf_dir, "doc_id", "lang", "text"), keep_text=False)
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept", F.round("log2_perplexity", 6).alias("log2_perplexity"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.warc_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return archives.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_decontamination, op3_token_binary, op4_html_text, op5_token_counts, op6_packing, op7_line_dedup, op8_jaccard_join, op9_quality, op10_warc)
    return {f.__name__: f for f in own}


#: DuckDB has no CRC-32, so this one goes byte by byte over a table from the polynomial.
OP1_SQL = f"""
WITH RECURSIVE steps(n, i, c) AS (
  SELECT r.n, 0, r.n FROM range(256) r(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, CASE WHEN source IS NULL THEN '' ELSE '=' || source END, h) AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, (({SHARDS} * pos - 1) // total) AS shard FROM p)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'rows' AS law, shard::INTEGER AS shard, (pos - 1 - (shard * total) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM s, crc
"""

OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, i, line, hot.k IS NOT NULL AND l.doc_id <> last AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM f
"""

#: Shingles are compared as text; components by reachability over the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, g, len(g)::BIGINT AS n FROM g),
e AS (SELECT doc_id, n, unnest(g) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, coalesce(least, n.doc_id)) AS component_id, CASE WHEN n > 0 THEN min(n.doc_id) OVER (PARTITION BY g) ELSE n.doc_id END AS class_id
FROM n LEFT JOIN c ON n.doc_id = c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op7_line_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op10_warc": OP10_SQL}
