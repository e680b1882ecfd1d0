"""``python -m corvane``: init, doctor, index, search, read, status, watch, serve, tools."""

from __future__ import annotations

import argparse
import json
import sys

from .config import load, write_default


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    for name in ("doctor", "status", "watch", "tools"):
        commands.add_parser(name)
    serve = commands.add_parser("serve")
    serve.add_argument("--port", type=int)
    serve.add_argument("--watch", action="store_true")
    index = commands.add_parser("index")
    index.add_argument("--full", action="store_true")
    index.add_argument("--dry-run", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    for name in ("top_k", "min_score", "min_score_diff", "module", "language", "chunk_type"):
        search.add_argument(f"--{name.replace('_', '-')}", dest=name)
    search.add_argument("--format", choices=("markdown", "json"), default="markdown")
    read = commands.add_parser("read")
    read.add_argument("file")
    read.add_argument("start", type=float)
    read.add_argument("end", type=float)
    args = parser.parse_args(argv)
    if args.command == "init":
        print(write_default(args.root))
        return 0

    from pyspark.sql import SparkSession

    from .api import Engine
    from .functions.requests import RequestError
    from .sources.embedders import EmbedError

    config = load(args.root)
    spark = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, config)
    try:
        if args.command == "index":
            print(engine.index(full=args.full, dry_run=args.dry_run, progress=lambda done, total: print(f"{done} of {total} files", file=sys.stderr)))
        elif args.command == "search":
            options = {k: getattr(args, k) for k in ("top_k", "min_score", "min_score_diff", "module", "language", "chunk_type", "format")}
            found = engine.search(args.query, **options)
            print(found["markdown"] if args.format == "markdown" else json.dumps(found, indent=2))
        elif args.command == "read":
            print(engine.read_slice(args.file, args.start, args.end)["content"])
        elif args.command == "status":
            print(json.dumps(engine.stats(), indent=2))
        elif args.command == "doctor":
            checks = engine.doctor()
            print("\n".join(f"{'ok ' if ok else 'bad'} {name}: {detail}" for name, ok, detail in checks))
            return int(not all(ok for _, ok, _ in checks))
        else:
            from .serve import http_server, serve_stdio
            from .sources.files import patterns_of
            from .streaming.watch import watch

            engine.collection.ensure()
            if args.command == "watch" or getattr(args, "watch", False):
                engine.index()
                stream = watch(spark, config.workspace_root, engine.index, f"{config.collection_path}-watch", dirs=config.index_dirs, patterns=patterns_of(config), on_error=lambda e: print(f"index failed: {e}", file=sys.stderr))
            if args.command == "watch":
                stream.awaitTermination()
            elif args.command == "serve":
                http_server(engine, args.port or config.port).serve_forever()
            else:
                serve_stdio(engine)
    except (RequestError, EmbedError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
