"""The jobs as queries: each runs twice into one new folder and gives what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import SECTIONS, hash_sql, walk_sql

from .answer_questions import PLACES, answer_questions, hits
from .refresh_chunks import current, refresh_chunks


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share; under the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_refresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        refresh_chunks(spark, f"{sf_dir}/documents.parquet*", f"{at}/out", f"{at}/checkpoint")
    dims = F.size(F.filter("embedding", lambda x: x != 0))
    return current(spark, f"{at}/out").select(
        "id", "file_path", "module", "language", "chunk_type", "symbol_name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"), dims.alias("n_dims"))


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        answer_questions(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    return hits(spark, at, "latest").select("item_id", "rank", "file_path", "module", "start_line", "end_line", "score", F.md5(F.col("content").cast("binary")).alias("content_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_refresh_chunks": job1_refresh_chunks, "job2_answer_questions": job2_answer_questions}

_NAMED = """files AS (
  SELECT doc_id, coalesce(nullif(source, '') || '/', '') || doc_id || '{0}' AS file_path, coalesce(nullif(source, ''), 'root') AS module, text AS content
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""
_PARTS = "md AS (" + SECTIONS.split("md AS (", 1)[1].replace("replace(content, chr(10) || 'An', chr(10) || '## An') AS content", "content")

ORACLES = {
    "job1_refresh_chunks": f"""WITH RECURSIVE {_NAMED.format('.md')}, {_PARTS}, {walk_sql('kept', 'doc_id, title, start_line', 'body', 'part')},
bare AS (SELECT * FROM md WHERE doc_id NOT IN (SELECT doc_id FROM kept)), {walk_sql('bare', 'doc_id', 'content', 'whole')},
chunks AS (
  SELECT doc_id, 'section' AS chunk_type, title AS symbol_name, start_line + s AS start_line, start_line + e - 1 AS end_line, body FROM part
  UNION ALL SELECT doc_id, 'block', '', s + 1, e, body FROM whole),
keyed AS (SELECT *, file_path || ':' || start_line AS key FROM chunks JOIN (SELECT doc_id, file_path, module FROM files) USING (doc_id)),
ids AS (SELECT *, list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM keyed),
texts AS (SELECT key, 'search_document: ' || substr(body, 1, 3500) AS text FROM keyed), {hash_sql('texts', 'key', 'text')},
dims AS (SELECT key, count(*) AS n_dims FROM hashed GROUP BY key)
SELECT lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36, 8)) AS id, file_path, module, 'markdown' AS language, chunk_type, symbol_name,
       start_line::INT AS start_line, end_line::INT AS end_line, md5(body) AS content_md5, coalesce(n_dims, 0)::INT AS n_dims
FROM ids LEFT JOIN dims USING (key)""",
    "job2_answer_questions": f"""WITH RECURSIVE {_NAMED.format('.txt')}, {walk_sql('files', 'doc_id, file_path, module', 'content')},
named AS (SELECT file_path || ':' || lpad((s + 1)::VARCHAR, 9, '0') AS key, file_path, module, s + 1 AS start_line, e AS end_line, body, 'search_document: ' || substr(body, 1, 3500) AS text FROM walk),
{hash_sql('named', 'key', 'text', 'passage')},
asked AS (SELECT item_id AS key, 'search_query: ' || text AS text FROM benchmark WHERE text IS NOT NULL), {hash_sql('asked', 'key', 'text', 'probe')},
scored AS (SELECT q.key AS item_id, p.key, round(sum(p.v * q.v), {PLACES}) AS score FROM passage p JOIN probe q ON p.k = q.k GROUP BY ALL),
every AS (SELECT a.key AS item_id, n.key, coalesce(score, 0.0) AS score FROM asked a CROSS JOIN named n LEFT JOIN scored s ON s.item_id = a.key AND s.key = n.key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS rank FROM every),
top AS (SELECT *, greatest(max(score) OVER (PARTITION BY item_id), 0) - 0.1 AS threshold FROM ranked WHERE rank <= 10)
SELECT item_id, rank::INT AS rank, file_path, module, start_line::INT AS start_line, end_line::INT AS end_line, score, md5(body) AS content_md5
FROM top JOIN named USING (key) WHERE score >= greatest(threshold, 0)""",
}
