"""Stored schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Language of a file by its lower-cased last extension; others are ``text``.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".md": "markdown", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".css": "css", ".scss": "scss", ".html": "html", ".sh": "shell", ".sql": "sql",
    ".tf": "terraform", ".py": "python",
}
#: Names that count as text although their extension is unknown.
TEXT_ENDINGS = (".txt", ".md", ".env", ".gitignore", ".dockerignore", ".editorconfig", ".prettierrc")
CHUNK_TYPES = ("function", "class", "interface", "type", "variable", "imports", "section", "block")
INCLUDE_FIELDS = ("chunkType", "module", "language")
CODE_LANGUAGES = ("typescript", "tsx", "javascript", "jsx")

#: Characters of content that the collection keeps, and that an embedder sees.
STORED_CHARS, EMBEDDED_CHARS = 16_000, 3_500

FILES = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("module", T.StringType()),
    T.StructField("last_modified", T.StringType()), T.StructField("content", T.StringType()),
])
CHUNKS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("module", T.StringType()), T.StructField("chunk_type", T.StringType()),
    T.StructField("symbol_name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("last_modified", T.StringType()),
])
COLLECTION = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
LEDGER = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("last_modified", T.StringType())])
CLIPS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
])
#: Columns of a hit besides its score.
HIT_COLUMNS = ("file_path", "language", "module", "chunk_type", "symbol_name", "start_line", "end_line", "content")
