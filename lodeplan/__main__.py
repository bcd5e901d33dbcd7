"""python -m lodeplan serve|mcp|query|tools --data DIR: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import signal
import sys

from pyspark.sql import SparkSession

from .context import Context
from .engine import Engine
from .errors import EngineError
from .server import tools
from .server.auth import Key, Keyring
from .server.http import App, server
from .server.rpc import Rpc


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeplan")
    parser.add_argument("command", choices=["serve", "mcp", "query", "tools"])
    parser.add_argument("request", nargs="?", help="for query: a question in English")
    parser.add_argument("--data", default="lodeplan-data", help="the folder of catalog and tables")
    parser.add_argument("--tenant", default="local")
    parser.add_argument("--database")
    parser.add_argument("--plan", help="for query: a structured plan as JSON")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--keys", help="a JSON file with a list of API keys")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8080)
    args = parser.parse_args(argv)
    if args.command == "tools":
        print(json.dumps(tools.definitions(), indent=2))
        return 0
    spark = SparkSession.builder.appName("lodeplan").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine.open(spark, args.data)
    keys = [Key.from_json(k) for k in json.load(open(args.keys))] if args.keys else []
    local = Context(args.tenant, args.database)
    try:
        if args.command == "query":
            source = json.loads(args.plan) if args.plan else args.request
            if source is None:
                parser.error("query needs a question or --plan")
            names = engine.list_databases(local)
            ctx = local.into(names[0]) if local.database is None and len(names) == 1 else local
            print(json.dumps(engine.explain(ctx, source) if args.explain else engine.query(ctx, source).to_json(), indent=2, ensure_ascii=False))
        elif args.command == "mcp":
            Rpc(engine).serve(sys.stdin, sys.stdout, Keyring(keys, None if keys else local).session())
        else:
            http = server(App(engine, Keyring(keys, local)), args.host, args.port)
            for s in (signal.SIGINT, signal.SIGTERM):
                signal.signal(s, lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            try:
                http.serve_forever()
            except KeyboardInterrupt:
                http.server_close()
    except EngineError as error:
        print(f"{error.code}: {error.message}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
