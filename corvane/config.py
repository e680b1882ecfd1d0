"""Settings: defaults, then the project's file, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

RC_NAME = ".corvanerc.json"
#: Directories that are walked, and patterns that never are.
INDEX_DIRS = ("src", "server/src", "docs", "wiki")
EXCLUDE = (
    "node_modules", ".next", "dist", "build", "coverage", "*.lock", "*.map", "*.min.js", "*.min.css", "uploads", ".git",
    "__pycache__", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp4",
    "*.webm", "*.pdf", "*.xlsx", "*.xls", "*.zip", "*.tar.gz", "*.DS_Store", "package-lock.json",
)


@dataclass(frozen=True)
class Config:
    workspace_root: str = "."
    index_dirs: tuple[str, ...] = INDEX_DIRS
    exclude_patterns: tuple[str, ...] = EXCLUDE
    embedder_url: str = ""
    embedding_model: str = "hashing"
    embedding_dimensions: int = 768
    collection_path: str = ".corvane/collection"
    ledger_path: str = ".corvane/ledger"
    collection_name: str = "codebase_chunks"
    max_chunk_tokens: int = 800
    chunk_overlap_lines: int = 5
    indexed_rows: int = 50_000
    cache_embeddings: bool = False
    port: int = 7700


def find_root(start: str = ".") -> Path:
    """The nearest folder at or above ``start`` with a settings file; else ``start``."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / RC_NAME).is_file()), here)


def load(start: str = ".", env: dict[str, str] | None = None) -> Config:
    """Settings for the project around ``start``; a broken settings file raises ValueError."""
    env = os.environ if env is None else env
    root, found = find_root(start), {}
    if (rc := root / RC_NAME).is_file():
        try:
            found = json.loads(rc.read_text(encoding="utf-8"))
        except json.JSONDecodeError as e:
            raise ValueError(f"Failed to parse {rc}: {e}") from e
    known = {f.name for f in fields(Config)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known}
    for name, key in (("embedder_url", "CORVANE_EMBEDDER_URL"), ("embedding_model", "CORVANE_EMBEDDING_MODEL"), ("collection_path", "CORVANE_COLLECTION")):
        if env.get(key):
            values[name] = env[key]
    if env.get("CORVANE_PORT"):
        values["port"] = int(env["CORVANE_PORT"])
    out = replace(Config(), **values)
    far = "://" in out.workspace_root
    base = root if far else (root / out.workspace_root).resolve()
    placed = {n: f"{out.workspace_root.rstrip('/')}/{getattr(out, n)}" if far else str(base / getattr(out, n)) for n in ("collection_path", "ledger_path") if "://" not in getattr(out, n)}
    return replace(out, workspace_root=out.workspace_root if far else str(base), **placed)


def write_default(root: str) -> Path:
    """A settings file with the defaults, unless there is one."""
    rc = Path(root) / RC_NAME
    if not rc.exists():
        rc.write_text(json.dumps({"index_dirs": list(INDEX_DIRS), "embedding_dimensions": 768}, indent=2) + "\n", encoding="utf-8")
    return rc
