"""The queries over the engine's own operators, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import detect_language, detect_module, hash_id, is_text_file, tokens
from .operators import chunk, clips, diff, ivf, render, search, slices
from .operators.bursts import bursts
from .operators.sections import section_rows
from .sources.embedders import HashingEmbedder, embed_column, embed_query, passage
from .sources.ignore import ignored, watched
from .sources.store import delete_paths, latest_rows, upsert
from .streaming.watch import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Patterns and the directories of the ignore queries.
PATTERNS = ["src7/", "*.json", "!src/src3/*.json", "/src/src1/**", "src/**/*9.py", "# note", "", "src/src2?/"]
WATCHED_DIRS = ("src/src0", "src/src3", "src/src7")
DIM, PROBE = 64, "the nation and the other thing"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


# -- fixtures, the same in both engines ---------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".ts", ".md", ".py", ".txt", ".json", ".html"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    stamp = F.concat(F.lit("2024-01-01T00:00:00."), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", path.alias("file_path"), stamp.alias("last_modified"), F.col("text").alias("content"), "lang")


FILES = """files AS (
  SELECT doc_id, 'src/' || source || '/' || doc_id || (['.ts', '.md', '.py', '.txt', '.json', '.html'])[doc_id % 6 + 1] AS file_path,
         '2024-01-01T00:00:00.' || lpad((n_chars % 1000)::VARCHAR, 3, '0') || 'Z' AS last_modified, text AS content, lang
  FROM documents)"""


def _markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\nAn"), F.lit("\n## An")))


MARKDOWN = FILES + """,
md AS (SELECT doc_id, file_path, replace(content, chr(10) || 'An', chr(10) || '## An') AS content FROM files)"""


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the text of the document of their number."""
    files = _files(spark, sf_dir).select("doc_id", "file_path", "content", "lang")
    rows = _table(spark, sf_dir, "embeddings").join(files, F.col("vec_id") == F.col("doc_id"))
    return rows.select(
        F.col("vec_id").alias("id"), "embedding", "label", "file_path", detect_language(F.col("file_path")).alias("language"), detect_module(F.col("file_path")).alias("module"),
        F.lit("block").alias("chunk_type"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("symbol_name"),
        F.lit(1).alias("start_line"), (F.col("label") + 1).alias("end_line"), "content")


LANGUAGE = """CASE regexp_extract(file_path, '(\\.[a-z]+)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.py' THEN 'python'
       WHEN '.json' THEN 'json' WHEN '.html' THEN 'html' ELSE 'text' END"""
COLLECTION = FILES + f""",
coll AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, file_path, {LANGUAGE} AS language, split_part(file_path, '/', 1) AS module, 'block' AS chunk_type,
         CASE WHEN lang = 'en' THEN '' ELSE lang END AS symbol_name, 1 AS start_line, label + 1 AS end_line, content
  FROM embeddings JOIN files ON vec_id = doc_id)"""


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0, sign: float = 1.0) -> list[float]:
    row = _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [sign * float(x) for x in row[0]]


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _top_sql(k: int, where: str = "", sign: str = "", vec_id: int = 0, source: str = "embeddings") -> str:
    return f"""top AS (
  SELECT vec_id AS id, label, {sign}list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})) AS score
  FROM {source} {where} ORDER BY score DESC, id LIMIT {k})"""


# -- scans and derived columns ------------------------------------------------------------


@query(f"WITH {FILES} SELECT file_path, {LANGUAGE} AS language FROM files")
def q_detect_language(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", detect_language(F.col("file_path")).alias("language"))


@query(f"WITH {FILES} SELECT file_path, split_part(file_path, '/', 1) AS module FROM files")
def q_detect_module(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", detect_module(F.col("file_path")).alias("module"))


@query(f"""WITH {FILES}, judged AS (
  SELECT file_path, CASE
    WHEN regexp_matches(file_path, '(^|/)src2[^/]/') AND file_path LIKE 'src/src2_/%' THEN true
    WHEN regexp_matches(file_path, '^src/(.*/)?[^/]*9\\.py$') THEN true
    WHEN file_path LIKE 'src/src1/%' THEN true
    WHEN regexp_matches(file_path, '^src/src3/[^/]*\\.json$') THEN false
    WHEN file_path LIKE '%.json' THEN true
    WHEN file_path LIKE '%/src7/%' THEN true ELSE false END AS ignored
  FROM files)
SELECT file_path, ignored, NOT ignored AS indexed, NOT ignored AND regexp_matches(file_path, '^src/src[037]/') AS watched FROM judged""")
def q_ignore_filter(spark, sf_dir):
    path = F.col("file_path")
    hidden = ignored(path, PATTERNS)
    return _files(spark, sf_dir).select("file_path", hidden.alias("ignored"), (~hidden & is_text_file(path)).alias("indexed"), watched(path, WATCHED_DIRS, PATTERNS).alias("watched"))


_SNAPSHOTS = FILES + """,
was AS (SELECT file_path, last_modified FROM files JOIN labels USING (doc_id)),
now AS (SELECT file_path, CASE WHEN quality = 0 THEN 'later' ELSE last_modified END AS last_modified
        FROM files LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0),
diffed AS (SELECT coalesce(n.file_path, w.file_path) AS file_path,
                  CASE WHEN w.file_path IS NULL THEN 'add' WHEN n.file_path IS NULL THEN 'delete' WHEN n.last_modified <> w.last_modified THEN 'change' ELSE 'same' END AS op
           FROM now n FULL JOIN was w ON n.file_path = w.file_path)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, labels = _files(spark, sf_dir), _table(spark, sf_dir, "labels")
    now = files.join(labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    now = now.withColumn("last_modified", F.when(F.col("quality") == 0, "later").otherwise(F.col("last_modified")))
    return diff.changes(now, files.join(labels, "doc_id").select("file_path", "last_modified"))


@query(f"WITH {_SNAPSHOTS} SELECT file_path, op FROM diffed")
def q_change_detection(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"WITH {_SNAPSHOTS} SELECT op, count(*) AS n FROM diffed GROUP BY op")
def q_change_summary(spark, sf_dir):
    return diff.summary(_changes(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS} SELECT file_path FROM diffed WHERE op IN ('add', 'change')")
def q_to_index(spark, sf_dir):
    return diff.to_index(_changes(spark, sf_dir))


# -- chunks -----------------------------------------------------------------------------------


def walk_sql(source: str, keys: str, text: str, name: str = "walk") -> str:
    """Windows of lines of each text of ``source``: keys, s (lines before), e (end) and body."""
    return f"""{name}_lines AS (SELECT {keys}, string_split({text}, chr(10)) AS ls FROM {source}),
{name}_sums AS (
  SELECT {keys}, ls, list_transform(range(0, len(ls) + 1), lambda k: k + coalesce(list_sum(list_transform(ls[1:k], lambda x: length(x))), 0)) AS ends FROM {name}_lines),
{name}_steps AS (
  SELECT {keys}, ls, ends, 0::BIGINT AS s, greatest(1, len(list_filter(ends, lambda x: x <= 3200)) - 1) AS e FROM {name}_sums
  UNION ALL
  SELECT {keys}, ls, ends, s2, greatest(s2 + 1, len(list_filter(ends, lambda x: x <= ends[s2 + 1] + 3200)) - 1)
  FROM (SELECT *, greatest(s + 1, e - 5) AS s2 FROM {name}_steps WHERE e < len(ls))),
{name} AS (SELECT {keys}, s, e, regexp_replace(array_to_string(ls[s + 1:e], chr(10)), '\\s+$', '') AS body FROM {name}_steps
           WHERE regexp_matches(array_to_string(ls[s + 1:e], chr(10)), '\\S'))"""


_CHUNKS = f"WITH RECURSIVE {walk_sql('documents', 'doc_id', 'text')}"


def _chunked(spark: SparkSession, sf_dir: str, files: DataFrame, language: str) -> DataFrame:
    named = files.select(F.col("doc_id").cast("string").alias("file_path"), F.lit(language).alias("language"), F.lit("src").alias("module"), "last_modified", "content")
    return chunk.chunk_files(named).withColumn("doc_id", F.col("file_path").cast("long"))


@query(f"{_CHUNKS} SELECT doc_id, s + 1 AS start_line, e AS end_line, length(body) AS n_chars, md5(body) AS digest FROM walk")
def q_chunk_lines(spark, sf_dir):
    out = _chunked(spark, sf_dir, _files(spark, sf_dir), "text")
    return out.select("doc_id", "start_line", "end_line", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""WITH {FILES}, keyed AS (SELECT file_path, content, file_path || ':' || (doc_id + 1) AS k FROM files),
hashed AS (SELECT file_path, content, list_reduce(list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM keyed)
SELECT file_path, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36, 8)) AS id, ceil(length(content) / 4.0)::INT AS n_tokens FROM hashed""")
def q_chunk_ids(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", hash_id(F.col("file_path"), F.col("doc_id") + 1).alias("id"), tokens(F.col("content")).alias("n_tokens"))


SECTIONS = MARKDOWN + """,
rows AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS nr FROM md),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3}\\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY nr) AS section FROM rows),
found AS (SELECT doc_id, section, arg_min(line, nr) AS head, min(nr) AS start_line, max(nr) AS end_line, string_agg(line, chr(10) ORDER BY nr) AS text FROM marked GROUP BY ALL),
sect AS (
  SELECT doc_id, section, CASE WHEN section = 0 THEN 'intro' ELSE regexp_extract(head, '^#{1,3}\\s+(.+)', 1) END AS title, start_line, end_line,
         regexp_replace(regexp_replace(text, '\\s+$', ''), '^\\s+', '') AS body FROM found),
kept AS (SELECT *, ceil(length(body) / 4.0)::INT AS n_tokens FROM sect WHERE ceil(length(body) / 4.0) > 30)"""


@query(f"WITH {SECTIONS} SELECT doc_id, section::BIGINT AS section, title, start_line, end_line, n_tokens, md5(body) AS digest FROM kept")
def q_markdown_sections(spark, sf_dir):
    out = section_rows(_markdown_files(spark, sf_dir), "doc_id")
    return out.select("doc_id", "section", "title", "start_line", "end_line", "n_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {SECTIONS}, {walk_sql('kept', 'doc_id, title, start_line', 'body', 'part')},
bare AS (SELECT * FROM md WHERE doc_id NOT IN (SELECT doc_id FROM kept)), {walk_sql('bare', 'doc_id', 'content', 'whole')}
SELECT doc_id, 'section' AS chunk_type, title AS symbol_name, start_line + s AS start_line, start_line + e - 1 AS end_line, md5(body) AS digest FROM part
UNION ALL SELECT doc_id, 'block', '', s + 1, e, md5(body) FROM whole""")
def q_chunk_markdown(spark, sf_dir):
    out = _chunked(spark, sf_dir, _markdown_files(spark, sf_dir), "markdown")
    return out.select("doc_id", "chunk_type", "symbol_name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {SECTIONS}, {walk_sql('kept', 'doc_id, title, start_line', 'body', 'part')},
bare AS (SELECT * FROM md WHERE doc_id NOT IN (SELECT doc_id FROM kept)), {walk_sql('bare', 'doc_id', 'content', 'whole')},
plain AS (SELECT * FROM md WHERE file_path NOT LIKE '%.md'), {walk_sql('plain', 'doc_id', 'content', 'rest')},
chunks AS (
  SELECT doc_id, 'section' AS chunk_type, title AS symbol_name, start_line + s AS start_line, start_line + e - 1 AS end_line, body FROM part WHERE doc_id NOT IN (SELECT doc_id FROM plain)
  UNION ALL SELECT doc_id, 'block', '', s + 1, e, body FROM whole WHERE doc_id NOT IN (SELECT doc_id FROM plain)
  UNION ALL SELECT doc_id, 'block', '', s + 1, e, body FROM rest),
keyed AS (SELECT *, file_path || ':' || start_line AS k FROM chunks JOIN (SELECT doc_id, file_path, last_modified FROM files) USING (doc_id)),
hashed AS (SELECT *, list_reduce(list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM keyed)
SELECT lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36, 8)) AS id, body AS content, file_path, {LANGUAGE} AS language, split_part(file_path, '/', 1) AS module,
       chunk_type, symbol_name, start_line::INT AS start_line, end_line::INT AS end_line, last_modified FROM hashed""")
def q_chunk_files(spark, sf_dir):
    """Every file by the chunker of its language (none of these texts holds a declaration, so code is split by lines)."""
    files = _markdown_files(spark, sf_dir)
    return chunk.chunk_files(files.withColumns({"language": detect_language(F.col("file_path")), "module": detect_module(F.col("file_path"))}))


@query(f"""WITH RECURSIVE code AS (
  SELECT doc_id, 'export function f' || doc_id || '() {{' || chr(10) || '// ' || replace(text, chr(10), chr(10) || '// ') || chr(10) || '}}' AS body FROM documents),
large AS (SELECT * FROM code WHERE length(body) > 3200), {walk_sql('large', 'doc_id', 'body', 'part')},
chunks AS (
  SELECT doc_id, 'function' AS chunk_type, 'f' || doc_id AS symbol_name, 3 + s AS start_line, 2 + e AS end_line, body FROM part
  UNION ALL SELECT doc_id, 'function', 'f' || doc_id, 3, 2 + len(string_split(body, chr(10))), body FROM code WHERE length(body) <= 3200
  UNION ALL SELECT doc_id, 'variable', 'v' || doc_id, 4 + len(string_split(body, chr(10))), 4 + len(string_split(body, chr(10))), 'export const v' || doc_id || ' = 1;' FROM code)
SELECT doc_id, chunk_type, symbol_name, start_line::INT AS start_line, end_line::INT AS end_line, md5(body) AS digest FROM chunks""")
def q_chunk_code(spark, sf_dir):
    """Every document as a source file: an import, a function whose body comments its text, and an exported constant."""
    name = F.col("doc_id").cast("string")
    body = F.concat(F.lit("import x from 'y';\n\nexport function f"), name, F.lit("() {\n// "), F.replace("content", F.lit("\n"), F.lit("\n// ")), F.lit("\n}\n\nexport const v"), name, F.lit(" = 1;\n"))
    out = _chunked(spark, sf_dir, _files(spark, sf_dir).withColumn("content", body), "typescript")
    return out.select("doc_id", "chunk_type", "symbol_name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"{_CHUNKS} SELECT count(*) AS count FROM walk")
def q_collection_stats(spark, sf_dir):
    return _chunked(spark, sf_dir, _files(spark, sf_dir), "text").agg(F.count(F.lit(1)).alias("count"))


# -- embeddings and search ----------------------------------------------------------------


def hash_sql(source: str, key: str, text: str, name: str = "hashed") -> str:
    """key and v, the DIM values of each text's hashed embedding before it is normalised."""
    return f"""{name}_tokens AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS t FROM {source}),
{name}_places AS (SELECT {key}, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS k, CASE WHEN ('0x' || substr(md5(t), 8, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS g FROM {name}_tokens),
{name}_sums AS (SELECT {key}, k, sum(g) AS g FROM {name}_places GROUP BY ALL),
{name} AS (SELECT {key}, k, g / sqrt(sum(g * g) OVER (PARTITION BY {key})) AS v FROM {name}_sums WHERE g <> 0)"""


@query(f"""WITH cut AS (SELECT doc_id, 'search_document: ' || substr(text, 1, 3500) AS text FROM documents), {hash_sql('cut', 'doc_id', 'text')}
SELECT doc_id, k::INT AS k, round(v, 4) AS v FROM hashed""")
def q_embed_hash(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embed_column(docs, passage(F.col("text")), lambda: HashingEmbedder(DIM)).select("doc_id", F.posexplode("embedding").alias("k", "v"))
    return out.filter(F.col("v") != 0).select("doc_id", "k", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(f"WITH {_top_sql(5)} SELECT id, label, round(score, 4) AS score FROM top")
def q_vector_topk(spark, sf_dir):
    out = search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir), 5)
    return out.select("id", "label", F.round("score", 4).alias("score"))


@query(f"WITH {_top_sql(50)} SELECT id, round(score, 4) AS score FROM top")
def q_vector_topk_fast(spark, sf_dir):
    """The same search with one matrix product for each Arrow batch."""
    out = search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir), 50, fast=True)
    return out.select("id", F.round("score", 4).alias("score"))


@query(f"WITH {_top_sql(20)} SELECT id, round(score, 4) AS score FROM top")
def q_vector_topk_cells(spark, sf_dir):
    """The search over a cell index; with every cell visited it is exact."""
    rows = _embeddings(spark, sf_dir)
    index, asked = ivf.fit_cells(rows, 32), _vector(spark, sf_dir)
    return ivf.search_cells(ivf.with_cells(rows, index), index, asked, 20, probes=32).select("id", F.round("score", 4).alias("score"))


_BATCH = """WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
SELECT query_id, id, rank::INT AS rank, round(score, 4) AS score FROM ranked WHERE rank <= 5"""


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")


@query()
def q_vector_topk_probes(spark, sf_dir):
    """The search as an index does it: every twentieth vector asks, and visits as many cells as the index was tuned to; with the recall of all and the measured share of rows read."""
    rows = _embeddings(spark, sf_dir)
    index = ivf.fit_index(rows)
    found = ivf.search_cells_batch(ivf.with_cells(rows, index), index, _asked(rows), 20).select("query_id", "id", "rank", F.round("score", 4).alias("score"))
    true = search.top_k_batch(rows, _asked(rows), 20).select("query_id", "id", F.lit(1).alias("_true"))
    share = true.join(found, ["query_id", "id"], "left").agg((F.count("rank") / F.count("_true")).alias("recall"))
    return found.crossJoin(F.broadcast(share)).withColumn("share_read", F.round(F.lit(index.share), 4))  # one row on the right


@query(_BATCH)
def q_vector_topk_cells_batch(spark, sf_dir):
    """The batched search over cells; with every cell visited it is exact."""
    rows = _embeddings(spark, sf_dir)
    index = ivf.fit_cells(rows, 32)
    return ivf.search_cells_batch(ivf.with_cells(rows, index), index, _asked(rows), 5, probes=32).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {_top_sql(10, 'WHERE label = 3')} SELECT id, label, round(score, 4) AS score FROM top")
def q_vector_topk_filtered(spark, sf_dir):
    kept = search.pre_filter(_embeddings(spark, sf_dir), {"label": 3, "module": ""})
    return search.top_k(kept, _vector(spark, sf_dir), 10).select("id", "label", F.round("score", 4).alias("score"))


@query(_BATCH)
def q_vector_topk_batch(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.top_k_batch(rows, _asked(rows), 5).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {_top_sql(100)} SELECT id, round(score, 4) AS score, (SELECT count(*) FROM top) AS candidates FROM top WHERE score >= 0.2""")
def q_min_score(spark, sf_dir):
    from pyspark.sql import Window

    found = search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir), 100)
    counted = found.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return search.cut_min_score(counted, 0.2).select("id", F.round("score", 4).alias("score"), "candidates")


def _diff_sql(sign: str = "") -> str:
    return f"""WITH {_top_sql(100, sign=sign)}, cut AS (SELECT *, greatest(greatest(max(score) OVER (), 0) - 0.7, 0) AS threshold FROM top)
SELECT id, round(score, 4) AS score, round(threshold, 4) AS threshold FROM cut WHERE score >= threshold"""


@query(_diff_sql())
def q_min_score_diff(spark, sf_dir):
    found = search.cut_min_score_diff(search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir), 100), 0.7)
    return found.select("id", F.round("score", 4).alias("score"), F.round("applied_threshold", 4).alias("threshold"))


@query(_diff_sql("-"))
def q_min_score_diff_negative(spark, sf_dir):
    """The opposite vector: the threshold stays at 0."""
    found = search.cut_min_score_diff(search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir, sign=-1.0), 100), 0.7)
    return found.select("id", F.round("score", 4).alias("score"), F.round("applied_threshold", 4).alias("threshold"))


_HITS = COLLECTION + """,
hits AS (SELECT *, list_cosine_similarity(e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM coll ORDER BY score DESC, id LIMIT 20)"""


def _hits(spark: SparkSession, sf_dir: str, k: int = 20, vec_id: int = 0) -> DataFrame:
    return search.top_k(_collection(spark, sf_dir), _vector(spark, sf_dir, vec_id), k)


@query(f"""WITH {_HITS} SELECT file_path, language, module, chunk_type, symbol_name, start_line, end_line, content, round(score, 4) AS score FROM hits""")
def q_hit_projection(spark, sf_dir):
    return search.project_hits(_hits(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(f"""WITH {_HITS} SELECT id, file_path AS "filePath", nullif(symbol_name, '') AS "symbolName", round(score, 4) AS score, start_line AS "startLine",
  end_line AS "endLine", content, chunk_type AS "chunkType", language FROM hits""")
def q_include_projection(spark, sf_dir):
    return search.lean(_hits(spark, sf_dir), ("chunkType", "language"))


@query(f"""WITH {_HITS}, blocks AS (
  SELECT '---' || chr(10) || chr(10) || '```' || language || chr(10) || regexp_replace(content, chr(10) || '+$', '') || chr(10) || '```' || chr(10) || chr(10)
         || file_path || ':' || start_line || '-' || end_line || CASE WHEN symbol_name = '' THEN '' ELSE ' • ' || symbol_name END
         || ' • score: ' || regexp_replace(regexp_replace(printf('%.4f', round(score, 4)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ' • module: ' || module || ' • id: ' || id AS b,
         score, id FROM hits)
SELECT '# Search: "nearest"' || chr(10) || chr(10) || count(*) || ' results • top_k: 20 • min_score: 0 • included: module • clip store: 20' || chr(10) || chr(10)
       || string_agg(b, chr(10) || chr(10) ORDER BY score DESC, id) AS markdown FROM blocks""")
def q_render_markdown(spark, sf_dir):
    from pyspark.sql import Window

    hits = _hits(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))
    return render.markdown(hits, "nearest", 20, 20, include=("module",), min_score=0.0)


@query(f"""WITH {_HITS} SELECT id, to_json(struct_pack(id := id, "filePath" := file_path, "symbolName" := nullif(symbol_name, ''), score := round(score, 4), "startLine" := start_line,
  "endLine" := end_line, content := content, "chunkType" := chunk_type, module := module, language := language))::VARCHAR AS json FROM hits""")
def q_json_payload(spark, sf_dir):
    return render.json_results(search.lean(_hits(spark, sf_dir), ("chunkType", "module", "language")))


@query(f"""WITH RECURSIVE {walk_sql('documents', 'doc_id', 'text')},
named AS (SELECT doc_id || ':' || (s + 1) AS key, doc_id, s + 1 AS start_line, e AS end_line, 'search_document: ' || substr(body, 1, 3500) AS text FROM walk),
{hash_sql('named', 'key', 'text', 'passage')},
asked AS (SELECT 'q' AS key, 'search_query: {PROBE}' AS text), {hash_sql('asked', 'key', 'text', 'probe')},
scored AS (SELECT p.key, sum(p.v * q.v) AS score FROM passage p JOIN probe q ON p.k = q.k GROUP BY p.key),
top AS (SELECT doc_id, start_line, end_line, coalesce(score, 0) AS score FROM named LEFT JOIN scored USING (key) ORDER BY round(coalesce(score, 0), 5) DESC, key LIMIT 100)
SELECT doc_id, start_line, end_line, round(score, 4) AS score FROM top WHERE score >= greatest((SELECT max(score) FROM top) - 0.1, 0)""")
def q_semantic_search_e2e(spark, sf_dir):
    """Documents to chunks to embeddings to the best hundred, cut at 0.1 below the best."""
    chunks = _chunked(spark, sf_dir, _files(spark, sf_dir), "text").withColumn("key", F.concat_ws(":", "doc_id", "start_line"))
    rows = embed_column(chunks, passage(F.col("content")), lambda: HashingEmbedder(DIM), keep=("key", "doc_id", "start_line", "end_line"))
    scored = search.scored(rows, embed_query(HashingEmbedder(DIM), PROBE), fast=True)
    top = scored.orderBy(F.desc(F.round("score", 5)), "key").limit(100)  # single-precision vectors tie at five places
    return search.cut_min_score_diff(top, 0.1).select("doc_id", "start_line", "end_line", F.round("score", 4).alias("score"))


# -- writes ---------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    old = files.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("file_path", F.lit(1).alias("start_line"), F.length("content").alias("n"))
    new = files.filter(F.col("lang") != "en").select("file_path", F.lit(1).alias("start_line"), F.lit(-1).alias("n"))
    return old, new


_VERSIONS = FILES + """,
old AS (SELECT file_path, 1 AS start_line, length(content) AS n FROM files JOIN labels USING (doc_id)),
new AS (SELECT file_path, 1 AS start_line, -1 AS n FROM files WHERE lang <> 'en')"""


@query(f"WITH {_VERSIONS} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT * FROM new")
def q_upsert(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    keys = ["file_path", "start_line"]
    return upsert(old, latest_rows(new, keys, "n"), keys)


@query(f"WITH {_VERSIONS} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM new)")
def q_delete_paths(spark, sf_dir):
    return delete_paths(*_versions(spark, sf_dir)).select("file_path", "start_line", "n")


# -- slices and clips -------------------------------------------------------------------------


@query(f"""WITH {FILES}, asked AS (SELECT doc_id AS pos, file_path, string_split(content, chr(10)) AS ls, n_chars FROM files JOIN documents USING (doc_id)),
cut AS (SELECT pos, file_path, ls, least(1 + n_chars % 3, len(ls)) AS a, least(1 + n_chars % 3 + n_chars % 40, len(ls)) AS b FROM asked)
SELECT pos, file_path, a::INT AS start_line, b::INT AS end_line, len(ls)::INT AS total_lines, array_to_string(ls[a:b], chr(10)) AS content FROM cut""")
def q_read_slice(spark, sf_dir):
    files = _files(spark, sf_dir)
    size = F.size(F.split("content", "\n", -1))
    n = F.length("content")
    first = F.least(n % 3 + 1, size)
    asked = files.select(F.col("doc_id").alias("pos"), "file_path", first.cast("double").alias("start_line"), F.greatest(n % 3 + 1 + n % 40, first).cast("double").alias("end_line"))
    return slices.read_slices(asked, files).select("pos", "file_path", "start_line", "end_line", "total_lines", "content")


_BAD = """requests AS (
  SELECT doc_id AS pos, ls, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '../x' WHEN 2 THEN 'none' ELSE file_path END AS file_path,
         CASE doc_id % 9 WHEN 3 THEN 0.0 WHEN 4 THEN 9.0 WHEN 5 THEN 1000000.0 WHEN 6 THEN NULL ELSE 1.0 END::DOUBLE AS s,
         CASE doc_id % 9 WHEN 4 THEN 8.0 WHEN 5 THEN 1000001.0 ELSE 7.9 END::DOUBLE AS e
  FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files))"""


@query(f"""WITH {FILES}, {_BAD}
SELECT pos, file_path, CASE WHEN s IS NULL OR e IS NULL THEN 400 WHEN s < 1 OR e < 1 THEN 400 WHEN e < s THEN 400 WHEN file_path = '' THEN 400 WHEN file_path LIKE '../%' THEN 403
            WHEN file_path = 'none' THEN 404 WHEN least(floor(e), len(ls)) < floor(s) THEN 400 ELSE 200 END AS status,
       CASE WHEN s >= 1 AND e >= s AND file_path LIKE 'src/%' AND least(floor(e), len(ls)) >= floor(s) THEN least(floor(e), len(ls))::INT ELSE -1 END AS end_line
FROM requests""")
def q_read_slice_errors(spark, sf_dir):
    files, kind = _files(spark, sf_dir), F.col("doc_id") % 9
    path = F.when(kind == 0, "").when(kind == 1, "../x").when(kind == 2, "none").otherwise(F.col("file_path"))
    start = F.when(kind == 3, 0.0).when(kind == 4, 9.0).when(kind == 5, 1e6).when(kind == 6, F.lit(None)).otherwise(1.0)
    end = F.when(kind == 4, 8.0).when(kind == 5, 1e6 + 1).otherwise(7.9)
    asked = files.select(F.col("doc_id").alias("pos"), path.alias("file_path"), start.cast("double").alias("start_line"), end.cast("double").alias("end_line"))
    return slices.read_slices(asked, files).select("pos", "file_path", "status", F.coalesce("end_line", F.lit(-1)).alias("end_line"))


@query(f"""WITH {_top_sql(30)}, {_top_sql(30, vec_id=20).replace('top AS', 'other AS')},
puts AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS nr, id, label FROM top
         UNION ALL SELECT 1000 + row_number() OVER (ORDER BY score DESC, id), id, label FROM other),
firsts AS (SELECT 'v' || id AS file_path, 1 AS start_line, label + 1 AS end_line, min(nr) AS nr FROM puts GROUP BY ALL)
SELECT row_number() OVER (ORDER BY nr) AS id, file_path, start_line, end_line FROM firsts""")
def q_clip_assign(spark, sf_dir):
    from pyspark.sql import Window

    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")
    found = [search.top_k(_embeddings(spark, sf_dir), _vector(spark, sf_dir, v), 30).withColumn("at", F.row_number().over(ranked) + after) for v, after in ((0, 0), (20, 1000))]
    puts = found[0].unionByName(found[1]).select("at", F.concat(F.lit("v"), "id").alias("file_path"), F.lit(1).alias("start_line"), (F.col("label") + 1).alias("end_line"))
    return clips.assign(puts, ["at"])


@query("""WITH numbered AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_orderkey || '/' || l_partkey || '/' || l_suppkey AS file_path,
         l_linenumber AS start_line, l_linenumber AS end_line FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem))
SELECT * FROM numbered WHERE id > (SELECT max(id) FROM numbered) - 10000""")
def q_clip_fifo(spark, sf_dir):
    """Every line item puts a clip; the store keeps the youngest ten thousand."""
    path = F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey")
    puts = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", path.alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    return clips.fifo(puts, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("""WITH numbered AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS nr, count(*) OVER () AS every, l_orderkey || '/' || l_partkey || '/' || l_suppkey AS file_path,
         l_linenumber AS start_line, l_linenumber AS end_line FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem))
SELECT CASE WHEN every > 10000 THEN nr + every ELSE nr END AS id, file_path, start_line, end_line FROM numbered WHERE nr > every - 10000""")
def q_clip_fifo_again(spark, sf_dir):
    """Every line item puts a clip, and then every one again: where there are more than the store holds, each was evicted meanwhile and gets a new id."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    puts = _table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("round"), *keys, F.concat_ws("/", *keys[:3]).alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    return clips.fifo(puts, ["round", *keys])


_CLIPS = FILES + """,
held AS (SELECT doc_id * 2 AS id, file_path, 1 AS start_line, 3 AS end_line, string_split(content, chr(10)) AS ls FROM files),
asked AS (SELECT doc_id AS pos, doc_id AS id FROM documents),
told AS (
  SELECT pos, a.id, h.id IS NOT NULL AS success, CASE WHEN h.id IS NULL THEN 'Clip not found: ' || a.id END AS error, file_path,
         CASE WHEN h.id IS NULL THEN -1 ELSE 1 END AS start_line, CASE WHEN h.id IS NULL THEN -1 ELSE least(3, len(ls)) END::INT AS end_line, coalesce(len(ls), -1)::INT AS total_lines, array_to_string(ls[1:3], chr(10)) AS content
  FROM asked a LEFT JOIN held h ON a.id = h.id)"""


def _clip_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    held = files.select((F.col("doc_id") * 2).alias("id"), "file_path", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    out = slices.read_clips(files.select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id")), held, files)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start_line", "end_line", "total_lines")})


@query(f"WITH {_CLIPS} SELECT * FROM told")
def q_clip_batch(spark, sf_dir):
    return _clip_batch(spark, sf_dir)


@query(f"WITH {_CLIPS} SELECT count(*) AS requested, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM told")
def q_clip_tally(spark, sf_dir):
    return slices.tally(_clip_batch(spark, sf_dir))


@query("""WITH asked AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS ids FROM asked""")
def q_clip_ids_distinct(spark, sf_dir):
    """Ids of one request at their first places: text lengths of a conversation's turns stand for ids."""
    asked = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("turns"))
    return asked.select("conv_id", F.array_join(clips.distinct_ids(F.transform("turns", lambda t: t["n"])), ",").alias("ids"))


# -- bursts of events ---------------------------------------------------------------------------


def _sessions_sql(keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    names = f"{keys}, " if keys else ""
    return f"""WITH gaps AS (SELECT {names}ts, CASE WHEN ts - lag(ts) OVER ({part} ORDER BY ts) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM events),
numbered AS (SELECT *, sum(new) OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT {names}count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY {names}s"""


@query(_sessions_sql())
def q_debounce_sessions(spark, sf_dir):
    return bursts(_table(spark, sf_dir, "events"), 600)


@query(_sessions_sql("user_id"))
def q_debounce_sessions_by_user(spark, sf_dir):
    """A burst for each workspace (user), dealt by it."""
    return sessions(_table(spark, sf_dir, "events"), "10 minutes", keys=("user_id",))
