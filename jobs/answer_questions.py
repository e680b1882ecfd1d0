"""Search reports: the best passages of a document table for each question of a list.

Documents are chunked and embedded, all questions are searched in one pass over the passages,
and hits within ``min_score_diff`` of a question's best are kept.  The report is a folder of its
own, replaced whole by a rerun:

    OUT/report=NAME/hits/module=M   hits: question, rank, file, lines, score, content
    OUT/report=NAME/questions       each question with the number of its hits and its best score (JSON)

    python -m jobs.answer_questions --documents IN --questions IN --out OUT --report NAME
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.chunk import chunk_files
from corvane.operators.search import cut_min_score_diff, top_k_batch
from corvane.sources.embedders import QUERY, HashingEmbedder, embed_column, passage

from .common import as_files, main

log = logging.getLogger("answer_questions")

#: Decimal places to which scores are compared and told.
PLACES = 6
HITS = "item_id long, rank int, file_path string, start_line int, end_line int, score double, content string, module string"


def hits(spark: SparkSession, out: str, report: str) -> DataFrame:
    """The hits of a report as written."""
    return spark.read.schema(HITS).parquet(f"{out}/report={report}/hits")


def answer_questions(spark: SparkSession, documents: str, questions: str, out: str, *, report: str = "latest", extension: str = ".txt", dimensions: int = 64,
                     max_tokens: int = 800, overlap: int = 5, top_k: int = 10, min_score_diff: float = 0.1) -> dict[str, Any]:
    """Write the report; the numbers of questions and hits.

    A question is a row (item_id, text); one without words finds nothing.  Equal scores go by
    file and line.  Documents without an id or a text are left out.
    """
    asked = spark.read.parquet(questions).select("item_id", "text")
    files = as_files(spark.read.parquet(documents), extension).withColumns({"language": F.lit("text"), "last_modified": F.col("digest")})
    chunks = chunk_files(files, max_tokens, overlap).withColumn("place", F.concat_ws(":", "file_path", F.lpad(F.col("start_line").cast("string"), 9, "0")))
    rows = embed_column(chunks, passage(F.col("content")), lambda: HashingEmbedder(dimensions), double=True)
    queries = embed_column(asked.filter(F.col("text").isNotNull()).select(F.col("item_id").alias("query_id"), "text"), F.concat(F.lit(QUERY), "text"), lambda: HashingEmbedder(dimensions), double=True)
    found = cut_min_score_diff(top_k_batch(rows, queries, top_k, key="place", places=PLACES), min_score_diff, by="query_id")
    base = f"{out}/report={report}"
    told = found.select(F.col("query_id").alias("item_id"), "rank", "file_path", "start_line", "end_line", "score", "content", "module")
    told.hint("rebalance", "module").write.mode("overwrite").partitionBy("module").parquet(f"{base}/hits")
    written = hits(spark, out, report)
    counts = written.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best_score"))
    summary = asked.join(counts, "item_id", "left").select("item_id", "text", F.coalesce("hits", F.lit(0)).alias("hits"), "best_score")
    summary.write.mode("overwrite").json(f"{base}/questions")
    n = {"questions": asked.count(), "hits": written.count()}
    log.info("read %s and %s; wrote %s: %s", documents, questions, base, n)
    return n


if __name__ == "__main__":
    main(None, "answer_questions.json", __doc__, answer_questions)
