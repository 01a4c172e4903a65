"""Queries of the training-data operators: each applies its operator to a whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir), ``ORACLES`` to DuckDB SQL where
SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, html_extract, line_dedup, packing, quality, secrets, simhash, substring
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
judged AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS goes FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(read(spark, sf_dir, "conversations"))


#: The messages of these tables carry no tools, so all are plain; ``chat_links`` gives them tools.
OP5_SQL = """
SELECT conv_id, turn, role, turn AS order_turn, 0::INTEGER AS order_level, 'plain' AS status, 0::BIGINT AS n_calls, 0::BIGINT AS n_invalid,
  '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR END
      || CASE WHEN text IS NULL OR role IS NULL THEN '' ELSE ',' END
      || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role)::VARCHAR END || '}' AS json
FROM conversations
"""


#: Of the derived tools: arguments of a message.
NOTE = '{"tools":[{"name":"note","parameters":{"type":"object","properties":{"about":{"type":"object","properties":{"length":{"type":"integer","maximum":150}},"required":["length"]},"turn":{"type":["integer","null"]}},"required":["about"],"additionalProperties":false}}]}'


def with_tools(conversations: DataFrame) -> DataFrame:
    """The conversations with tools, by a rule: assistants' messages call a tool by the name of their turn, users' messages answer the call of the turn before, if there is one."""
    told = conversations.select("conv_id", "turn", "role", "text")
    about = F.struct(F.struct(F.char_length("text").alias("length")).alias("about"), "turn")
    call = F.struct(F.concat(F.lit("c"), F.col("turn")).alias("id"), F.lit("note").alias("name"), F.to_json(about).alias("arguments"))
    calls = F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    told = told.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "assistant", calls).when(F.col("role") == "user", result).otherwise(F.col("text")).alias("text"),
    )
    heads = conversations.where("conv_id is not null").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(NOTE).alias("text"))
    return told.unionByName(heads)


def chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over conversations with derived tools: calls, results and orphans."""
    return chat.format_messages(with_tools(read(spark, sf_dir, "conversations")))


CHAT_LINKS_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT DISTINCT conv_id, -1, 'head', '{NOTE}' FROM conversations WHERE conv_id IS NOT NULL),
calls AS (SELECT DISTINCT conv_id, turn FROM told WHERE role = 'assistant'),
linked AS (
  SELECT t.*, c.turn AS placed, CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text)::VARCHAR || ',' END AS content, length(text) AS n
  FROM told t LEFT JOIN calls c ON t.role = 'user' AND t.conv_id = c.conv_id AND c.turn = t.turn - 1)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' WHEN 'head' THEN 'system' ELSE role END AS role, coalesce(placed, turn) AS order_turn,
  CASE WHEN placed IS NULL THEN 0 ELSE 1 END::INTEGER AS order_level,
  CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND placed IS NULL THEN 'orphan' WHEN role = 'user' THEN 'result' ELSE 'plain' END AS status,
  CASE WHEN role = 'assistant' THEN 1 ELSE 0 END::BIGINT AS n_calls, CASE WHEN role = 'assistant' AND NOT coalesce(n <= 150, false) THEN 1 ELSE 0 END::BIGINT AS n_invalid,
  CASE WHEN role = 'assistant' THEN '{{' || content || '"role":"assistant","tool_calls":[{{"arguments":"{{\\"about\\":{{' || CASE WHEN n IS NULL THEN '' ELSE '\\"length\\":' || n END || '}},\\"turn\\":' || turn
         || '}}","id":"c' || turn || '","name":"note","valid":' || CASE WHEN coalesce(n <= 150, false) THEN 'true' ELSE 'false' END || '}}]}}'
       WHEN role = 'user' THEN '{{' || content || '"role":"tool","tool_call_id":"c' || (turn - 1) || '"}}'
       ELSE '{{' || content || '"role":"' || CASE role WHEN 'head' THEN 'system' ELSE role END || '"}}' END AS json
FROM linked
"""


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


#: All pairs, which the graph search finds at the size where this runs; sums go from the first component to the last.
OP6_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda s, x: s + x) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secrets.train(secrets.labelled_samples(spark))
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), ratios))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, tau=2, similarity=None)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "chat_links": chat_links,
    "op6_nearest": op6_nearest,
    "op7_decontaminate": op7_decontaminate,
    "op8_secret_scan": op8_secret_scan,
    "op9_simhash": op9_simhash,
    "op10_passages": op10_passages,
}

ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op5_chat": OP5_SQL,
    "chat_links": CHAT_LINKS_SQL,
    "op6_nearest": OP6_SQL,
}
