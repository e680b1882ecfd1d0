"""What the jobs' command lines share: config files, options, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def settings(argv: list[str] | None, config: str, about: str) -> dict[str, Any]:
    """The options of a config file, changed by those on the command line (``--name value``)."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(Path(__file__).with_name(config)))
    known, rest = first.parse_known_args(argv)
    with open(known.config) as f:
        given = json.load(f)
    parser = argparse.ArgumentParser(description=about, parents=[first])
    for name, value in given.items():
        parser.add_argument(f"--{name.replace('_', '-')}", default=value, type=type(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str)
    return {k: v for k, v in vars(parser.parse_args(rest)).items() if k != "config"}


def main(argv: list[str] | None, config: str, about: str, job: Callable[..., dict[str, Any]]) -> None:
    """Run ``job`` with its settings in a session of its own; the session ends with it."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    given = settings(argv, config, about)
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
    spark = SparkSession.builder.appName(config.removesuffix(".json")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(job(spark, **given)))
    finally:
        spark.stop()


def as_files(documents: DataFrame, extension: str) -> DataFrame:
    """Documents (doc_id, source, text) as files: file_path, module, content and a digest of the content.

    The module is the source; a document without one (null or empty) lies at the root, one without an id or a
    text is no file.
    """
    named = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    source = F.nullif(F.col("source"), F.lit(""))
    path = F.concat_ws("/", source, F.concat(F.col("doc_id").cast("string"), F.lit(extension)))
    return named.select(path.alias("file_path"), F.coalesce(source, F.lit("root")).alias("module"), F.col("text").alias("content"), F.sha2("text", 256).alias("digest"))
