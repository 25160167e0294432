"""The thin queries over the test tables: each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read
from .config_packing import pack_documents
from .debruijn import strip_repeats
from .jaccard_join import similar_classes
from .lsa_vote import fit, score
from .mcd_rules import judge
from .reply_trees import conversation_nodes, digest, format_trees
from .secret_links import scan_documents
from .shard_tree import shard_documents
from .string_tiling import contaminated
from .token_grammar import read_shards, write_shards


def op1_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("distance")


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_trees(conversation_nodes(rows.unionByName(own))))


def op3_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    write_shards(read(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))


def op7_lsa_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op8_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mcd_rules": op1_mcd_rules,
    "op2_reply_trees": op2_reply_trees,
    "op3_token_grammar": op3_token_grammar,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_hash_tree": op5_hash_tree,
    "op6_secret_links": op6_secret_links,
    "op7_lsa_vote": op7_lsa_vote,
    "op8_config_packing": op8_config_packing,
    "op9_debruijn": op9_debruijn,
    "op10_string_tiling": op10_string_tiling,
}

SQL: dict[str, str] = {
    "op2_reply_trees": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g') AS body,
    replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(body) + 10 + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op5_hash_tree": r"""
WITH RECURSIVE crc_table(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8
), docs AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents
), nodes(level, parent, child, w, grown_w) AS (
  SELECT 'region', -1, r, CASE WHEN r < 2 THEN 8 ELSE 0 END, CASE WHEN r < 2 THEN 8 ELSE 1 END FROM range(3) t(r)
  UNION ALL SELECT 'rack', CAST(k // 2 AS BIGINT), k, 4, 4 FROM range(4) t(k)
  UNION ALL SELECT 'shard', CAST(s // 4 AS BIGINT), s, 1, 1 FROM range(16) t(s)
), draws AS (
  SELECT key, level, parent, child, w, grown_w, -ln((CAST('0x' || substr(md5(key || '/' || level || '/' || child), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS d
  FROM (SELECT DISTINCT key FROM docs), nodes
), plain AS (SELECT key, level, parent, arg_min(child, struct_pack(d := d / w, c := child)) AS child FROM draws WHERE w > 0 GROUP BY ALL
), grown AS (SELECT key, arg_min(child, struct_pack(d := d / grown_w, c := child)) AS region FROM draws WHERE level = 'region' GROUP BY ALL
), put AS (
  SELECT a.key, c.child AS shard, CASE WHEN g.region = 2 THEN 16 ELSE gc.child END AS grown_shard
  FROM plain a JOIN plain b ON b.key = a.key AND b.level = 'rack' AND b.parent = a.child
  JOIN plain c ON c.key = a.key AND c.level = 'shard' AND c.parent = b.child
  JOIN grown g ON g.key = a.key
  LEFT JOIN plain gb ON gb.key = a.key AND gb.level = 'rack' AND gb.parent = g.region
  LEFT JOIN plain gc ON gc.key = a.key AND gc.level = 'shard' AND gc.parent = gb.child
  WHERE a.level = 'region'
)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM docs JOIN put USING (key), crc
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
