"""URL filters as a sort-merge range join, in DataFrame operations only.

A url is keyed by its host's labels reversed, then its path.  For one host level a rule is
the interval of keys that begin with the rule's key, and such intervals nest.  Rules and
urls are sorted together; each url takes the stack of nested rules that was open at the
last rule before it, and keeps the innermost one that still covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows that the rules may become when they are copied to each part.
COPIES = 20_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(_host(url), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    tail = F.substr(_rest(url), F.length(_host(url)) + 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(tail, "^[^?#]*", 0)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def _host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def _reversed_key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def _stacked(rules: DataFrame) -> DataFrame:
    """Each rule with the stack of rules of its own host that enclose it, outermost first."""
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().collect()]  # at most the longest rule path
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("r_path"))
    prefixes = rules.select("r_host", "r_path", F.explode(sizes).alias("_n")).select(
        "r_host", F.col("r_path").alias("at_path"), F.expr("left(r_path, _n)").alias("r_path"))
    found = prefixes.join(rules, ["r_host", "r_path"])
    layer = F.struct(F.length("r_path").alias("n"), F.col("r_path").alias("path"), F.col("verdict").alias("verdict"))
    return found.groupBy("r_host", "at_path").agg(F.sort_array(F.collect_list(layer)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains where the
    url's path starts with its path; the longest rule (host and path together, then host)
    wins, and of equal rules with different verdicts ``block``.  Without a fitting rule the
    verdict is ``default``.  A null url, or one without ``://``, has empty host and path.
    Rows and ids repeat as they come; urls of any length are judged whole; without pages the
    result is empty, and without rules every verdict is ``default``; other columns of
    ``pages`` are ignored, whatever their names.

    Distinct urls are dealt over ``salts`` parts (the session's shuffle partitions by default,
    fewer where the copies of the rules would exceed COPIES) by a hash of host and path, and
    the rules are copied to each part, so no host is a hot key.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
             .groupBy(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"))
             .agg(F.max("verdict").alias("verdict")))
    deepest, count = rules.agg(F.max(F.size(F.split("r_host", "\\."))), F.count(F.lit(1))).first()
    salts, deepest = max(1, min(salts, COPIES // max(count, 1))), deepest or 0

    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    keys = judged.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    depth = F.least(F.size(labels), F.lit(max(deepest, 1)))
    levels = keys.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(labels, -n, n), "."))).alias("level"))
    none = F.lit(None)
    left = levels.select(
        F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), _reversed_key(F.col("level")).alias("rev"),
        "path", F.lit(1).alias("kind"), "host", "level", none.cast("array<struct<n:int,path:string,verdict:string>>").alias("stack"))
    right = _stacked(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), _reversed_key(F.col("r_host")).alias("rev"),
        F.col("at_path").alias("path"), F.lit(0).alias("kind"), none.cast("string").alias("host"), F.col("r_host").alias("level"), "stack")
    sweep = Window.partitionBy("salt").orderBy("rev", "path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == 0, F.struct("level", "stack")), ignorenulls=True).over(sweep)
    swept = left.unionByName(right).withColumn("open", opened).filter((F.col("kind") == 1) & (F.col("open.level") == F.col("level")))
    covering = F.filter(F.col("open.stack"), lambda layer: F.startswith(F.col("path"), layer["path"]))
    inner = swept.select("host", "path", "level", F.try_element_at(covering, F.lit(-1)).alias("layer")).filter(F.col("layer").isNotNull())
    best = inner.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("level") + F.col("layer.n")).alias("n"), F.length("level").alias("h"),
        F.concat("level", "layer.path").alias("rule"), F.col("layer.verdict").alias("verdict"))).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
