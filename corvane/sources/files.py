"""Files of a workspace as a DataFrame."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config
from ..functions.text import detect_language, detect_module, is_text_file
from .ignore import ignored

#: Largest file of which lines are read.
MAX_BYTES = 25 * 1024 * 1024
#: Folders from which a listing is dealt, and the most levels that the driver goes down to find them.
PARTS, LEVELS = 64, 4


def _stamp(ns: int) -> str:
    """A time in nanoseconds as ISO text in UTC, to the millisecond."""
    at = datetime.fromtimestamp(ns // 1_000_000 / 1000, timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _look(root: str) -> Callable[[str], tuple[list[str], list[tuple[str, str]]]]:
    """A function of a folder (relative to ``root``): its visible subfolders, and its visible plain files with their mtimes; nothing for a missing one."""
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))

        def far(folder: str) -> tuple[list[str], list[tuple[str, str]]]:
            folders, files = [], []
            for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}", allow_not_found=True)):
                path = info.path.removeprefix(f"{base}/")
                if info.base_name.startswith("."):
                    continue
                if info.is_file:
                    files.append((path, _stamp(info.mtime_ns or 0)))
                elif info.type == pafs.FileType.Directory:
                    folders.append(path)
            return folders, files

        return far

    def near(folder: str) -> tuple[list[str], list[tuple[str, str]]]:
        folders, files = [], []
        try:
            with os.scandir(os.path.join(root, folder)) as found:
                for x in found:
                    path = os.path.relpath(x.path, root).replace(os.sep, "/")
                    if x.name.startswith("."):
                        continue
                    if x.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif x.is_file():
                        files.append((path, _stamp(x.stat().st_mtime_ns)))
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            pass
        return folders, files

    return near


class _Part(InputPartition):
    """A folder to list, with what lies below it unless it is ``flat``."""

    def __init__(self, folder: str, flat: bool):
        self.folder, self.flat = folder, flat


class _Listing(DataSourceReader):
    def __init__(self, root: str, dirs: list[str], parts: int):
        self.root, self.dirs, self.parts = root, dirs, parts

    def partitions(self) -> list[_Part]:
        """Folders to walk, some levels below the index directories; the driver sees folders only, and no more of them than it needs."""
        look, deep, flat = _look(self.root), list(self.dirs), []
        for _ in range(LEVELS):
            if not deep or len(deep) >= self.parts:
                break
            flat += deep
            deep = [f for folder in deep for f in look(folder)[0]]
        return [_Part(f, True) for f in flat] + [_Part(f, False) for f in deep]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        look, open_, held = _look(self.root), [partition.folder], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(2)], names=["file_path", "last_modified"])

        while open_:
            folders, files = look(open_.pop())
            open_ += [] if partition.flat else folders
            held += files
            if len(held) > 10_000:
                yield told()
                held.clear()
        yield told()


class WorkspaceFiles(DataSource):
    """``spark.read.format("workspace_files").option("path", root)``: file_path and last_modified of the visible plain files below the folders ``dirs`` (a JSON list).

    Tasks list folders side by side; names with a dot in front stay hidden, a missing folder is
    skipped, and folders that overlap list a file once for each.  The root is a folder that all
    see alike, or a path with a scheme that Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace_files"

    def schema(self) -> str:
        return "file_path string, last_modified string"

    def reader(self, schema) -> _Listing:
        return _Listing(self.options["path"], json.loads(self.options.get("dirs", '[""]')), int(self.options.get("parts", PARTS)))


def patterns_of(config: Config) -> list[str]:
    """The workspace's own ignore file, then the configured patterns."""
    own = Path(config.workspace_root) / ".gitignore"
    return (own.read_text(encoding="utf-8").splitlines() if own.is_file() else []) + list(config.exclude_patterns)


def derive(paths: DataFrame) -> DataFrame:
    """Add language and module to rows with file_path."""
    return paths.withColumns({"language": detect_language(F.col("file_path")), "module": detect_module(F.col("file_path"))})


def keep_indexable(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Text files that no pattern ignores."""
    return paths.filter(~ignored(F.col("file_path"), patterns) & is_text_file(F.col("file_path")))


def stored(config: Config) -> bool:
    """True for a workspace in a store, named by a path with a scheme; another one is a folder that driver and executors see alike."""
    return "://" in config.workspace_root


def _stored_reader(root: str) -> Callable[[str, int | None], tuple[str | None, str | None]]:
    """(text, problem) of a path in a store, looked at before it is read."""
    fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))

    def read(path: str, most: int | None = None) -> tuple[str | None, str | None]:
        try:
            info = fs.get_file_info(f"{base}/{path}")
            if info.type == pafs.FileType.NotFound:
                return None, "missing"
            if not info.is_file:
                return None, "directory"
            if most is not None and info.size > most:
                return None, "large"
            with fs.open_input_file(info.path) as f:
                return f.read().decode("utf-8", "replace"), None
        except OSError:
            return None, "unreadable"

    return read


def _folder_reader(root: str, *, inside: bool = True) -> Callable[[str, int | None], tuple[str | None, str | None]]:
    """(text, problem) of a path in a folder; with ``inside``, ``outside`` where links lead out of it."""
    home = os.path.realpath(root)

    def read(path: str, most: int | None = None) -> tuple[str | None, str | None]:
        at = os.path.realpath(os.path.join(root, path))
        if inside and at != home and not at.startswith(home.rstrip(os.sep) + os.sep):
            return None, "outside"
        if not os.path.exists(at):
            return None, "missing"
        if not os.path.isfile(at):
            return None, "directory"
        try:
            if most is not None and os.path.getsize(at) > most:
                return None, "large"
            return Path(at).read_text(encoding="utf-8", errors="replace"), None
        except OSError:
            return None, "unreadable"

    return read


def walk_files(spark: SparkSession, config: Config) -> DataFrame:
    """file_path, last_modified, language and module of the workspace's text files, listed by tasks."""
    spark.dataSource.register(WorkspaceFiles)
    listed = spark.read.format("workspace_files").option("path", config.workspace_root).option("dirs", json.dumps(list(config.index_dirs))).load()
    return derive(keep_indexable(listed, list(config.exclude_patterns) if stored(config) else patterns_of(config)))


def inside_root(path: str, root: str) -> str | None:
    """``path`` (relative, or absolute under ``root``) as a plain relative path; None if it leads out of the root."""
    if "://" in root:
        path, root = path.removeprefix(root.rstrip("/") + "/"), "/_"
    plain = os.path.relpath(os.path.normpath(os.path.join(root, path)), root).replace(os.sep, "/")
    return None if plain == ".." or plain.startswith("../") else plain


def read_named(spark: SparkSession, paths: list[str], config: Config) -> DataFrame:
    """file_path, content and problem of a few named files, each looked at before it is read.

    The problem is ``outside`` (where links resolve to), ``missing``, ``directory``, ``large`` or
    ``unreadable``; then the content is null.
    """
    make, root = (_stored_reader if stored(config) else _folder_reader), config.workspace_root

    def run(batches):
        read = make(root)
        for batch in batches:
            got = [read(p, MAX_BYTES) for p in batch.column("file_path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["file_path", "content", "problem"])

    named = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "file_path string")
    return named.mapInArrow(run, "file_path string, content string, problem string")


def with_content(files: DataFrame, config: Config, seen: Accumulator | None = None) -> DataFrame:
    """Add the content of each file, read by the executors; a file gone meanwhile is left out.  ``seen`` counts files."""
    far, root = stored(config), config.workspace_root

    def run(batches):
        read = _stored_reader(root) if far else _folder_reader(root, inside=False)  # a link among the walked files is followed
        for batch in batches:
            texts = [read(p)[0] for p in batch.column("file_path").to_pylist()]
            if seen is not None:
                seen.add(batch.num_rows)
            part = batch.take(pa.array([k for k, t in enumerate(texts) if t is not None], pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t in texts if t is not None], pa.string())], names=[*part.schema.names, "content"])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.StringType())])
    return files.mapInArrow(run, schema).select("file_path", "language", "module", "last_modified", "content")
