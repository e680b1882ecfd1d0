"""Results as markdown or JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fence_language, short_number
from .search import INCLUDE_COLUMNS

DOT = " • "


def short(x: float) -> str:
    """A number without a needless fraction."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def summary_line(count: int, top_k: float, clip_store: int, min_score: float | None = None, min_score_diff: float | None = None, include: tuple[str, ...] = ()) -> str:
    parts = [f"{count} {'result' if count == 1 else 'results'}", f"top_k: {short(top_k)}"]
    parts += [f"{name}: {short(v)}" for name, v in (("min_score", min_score), ("min_score_diff", min_score_diff)) if v is not None]
    parts += [f"included: {', '.join(include)}"] if include else []
    return DOT.join([*parts, f"clip store: {clip_store}"])


def hit_block(include: tuple[str, ...] = ()) -> Column:
    """The text of one hit: rule, fenced content and caption."""
    caption = [F.format_string("%s:%d-%d", "file_path", "start_line", "end_line"), F.nullif(F.col("symbol_name"), F.lit("")),
               F.concat(F.lit("score: "), short_number(F.col("score")))]
    for name in ("chunkType", "module"):
        if name in include:
            value = F.nullif(F.col(INCLUDE_COLUMNS[name]), F.lit(""))
            caption.append(F.concat(F.lit(f"{name}: "), value))
    caption.append(F.concat(F.lit("id: "), F.col("id").cast("string")))
    return F.concat(F.lit("---\n\n```"), fence_language(F.col("language")), F.lit("\n"), F.regexp_replace("content", "\n+\\z", ""), F.lit("\n```\n\n"), F.concat_ws(DOT, *caption))


def markdown(hits: DataFrame, query: str, top_k: float, clip_store: int, *, order: str = "rank", include: tuple[str, ...] = (), **cuts: float | None) -> DataFrame:
    """One row, ``markdown``: the whole answer; hits (at most 100) come in ``order``."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), hit_block(include).alias("text"))))
    got = hits.agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n"))
    head, tail = (f"# Search: \"{query}\"\n\n", summary_line(0, top_k, clip_store, cuts.get("min_score"), cuts.get("min_score_diff"), include).split(" ", 2)[2])
    noun = F.when(F.col("n") == 1, " result ").otherwise(" results ")
    body = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    text = F.concat(F.lit(head), F.col("n").cast("string"), noun, F.lit(tail), F.lit("\n"), F.when(F.col("n") > 0, F.concat(F.lit("\n"), body)).otherwise(""))
    return got.select(text.alias("markdown"))


def json_results(lean: DataFrame) -> DataFrame:
    """One row for each lean hit, ``json``; an absent symbol is told as null."""
    return lean.select("id", F.to_json(F.struct(*lean.columns), {"ignoreNullFields": "false"}).alias("json"))
