"""Line ranges of files, and why a range can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

MAX_RANGE, MAX_BYTES = 500, 25 * 1024 * 1024
#: Status and text of each failure, part of the interface.
FAILURES = {
    "numbers": (400, "startLine and endLine are required and must be finite numbers"),
    "positive": (400, "startLine and endLine must be >= 1"),
    "order": (400, "endLine must be >= startLine"),
    "path": (400, "filePath is required"),
    "outside": (403, "filePath must be inside the workspace root"),
    "missing": (404, "File not found"),
    "directory": (400, "Not a regular file"),
    "large": (413, "File too large"),
    "unreadable": (500, "File can't be read"),
    "clamped": (400, "endLine must be >= startLine (after clamping to file bounds)"),
    "range": (400, "Line range too large"),
}


def safe_path(path: Column) -> Column:
    """True for a relative path that doesn't leave its root: no prefix of it has more ``..`` than names."""
    step = lambda depth, part: F.when(depth < 0, depth).when(part.isin("", "."), depth).when(part == "..", depth - 1).otherwise(depth + 1)
    return ~F.startswith(path, F.lit("/")) & (F.aggregate(F.split(path, "/", -1), F.lit(0), step) >= 0)


def read_slices(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each request (pos, file_path, start_line, end_line as double); ``files`` has file_path, content and maybe problem (a key of FAILURES).

    Returns pos, file_path, success, status, error, start_line, end_line, total_lines and
    content; checks run in a fixed order and the first that fails is told.  The end is
    clamped to the file; contents over MAX_BYTES aren't split.
    """
    problem = (F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")).alias("_problem")
    found = requests.join(files.select("file_path", F.col("content").alias("_text"), problem), "file_path", "left")
    s, e = F.col("start_line"), F.col("end_line")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    size = F.octet_length("_text")
    rows = F.when(size <= MAX_BYTES, lines(F.col("_text")))
    staged = found.withColumn("_lines", rows).withColumn("total_lines", F.when(F.col("_lines").isNotNull(), F.size("_lines")))
    ok = finite(s) & finite(e)
    first = F.when(ok, F.greatest(F.floor(s), F.lit(1))).cast("long")
    last = F.when(ok, F.least(F.floor(e), F.col("total_lines").cast("double"))).cast("long")
    staged = staged.withColumns({"_first": first, "_last": last})
    span = F.col("_last") - F.col("_first") + 1
    told = lambda name: F.col("_problem") == name
    failure = (
        F.when(~ok, _fail("numbers"))
        .when((s < 1) | (e < 1), _fail("positive"))
        .when(e < s, _fail("order"))
        .when(F.coalesce("file_path", F.lit("")) == "", _fail("path"))
        .when(~safe_path(F.col("file_path")) | told("outside"), _fail("outside")))
    for name in ("directory", "large", "unreadable"):
        failure = failure.when(told(name), _fail(name))
    failure = (
        failure.when(F.col("_text").isNull(), _fail("missing"))
        .when(size > MAX_BYTES, _fail("large"))
        .when(F.col("_last") < F.col("_first"), _fail("clamped"))
        .when(span > MAX_RANGE, _fail("range")))
    judged = staged.withColumn("_fail", failure)
    good = F.col("_fail").isNull()
    taken = F.when(good, F.array_join(F.slice("_lines", F.col("_first").cast("int"), F.greatest(span, F.lit(0)).cast("int")), "\n"))
    return judged.select(
        "pos", "file_path", good.alias("success"), F.when(good, 200).otherwise(F.col("_fail.status")).alias("status"), F.col("_fail.message").alias("error"),
        F.when(good, F.col("_first")).cast("int").alias("start_line"), F.when(good, F.col("_last")).cast("int").alias("end_line"),
        F.when(good, F.col("total_lines")).alias("total_lines"), taken.alias("content"))


def _fail(name: str) -> Column:
    status, message = FAILURES[name]
    return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))


def read_clips(ids: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each requested id (pos, id), with its slice or its error; errors stop nothing."""
    from .clips import resolve

    wanted = resolve(ids, clips).withColumns({c: F.col(c).cast("double") for c in ("start_line", "end_line")})
    read = read_slices(wanted.filter(F.col("file_path").isNotNull()).select("pos", "file_path", "start_line", "end_line"), files)
    read = read.withColumnRenamed("file_path", "_path").withColumnsRenamed({"start_line": "_start", "end_line": "_end", "error": "_error"})
    joined = wanted.select("pos", "id", "file_path").join(read, "pos", "left")
    missing = F.col("file_path").isNull()
    return joined.select(
        "pos", "id", F.coalesce("success", F.lit(False)).alias("success"), F.when(missing, F.concat(F.lit("Clip not found: "), F.col("id").cast("string"))).otherwise(F.col("_error")).alias("error"),
        "file_path", F.col("_start").alias("start_line"), F.col("_end").alias("end_line"), "total_lines", "content")


def tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("requested"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
