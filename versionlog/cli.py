"""Command line: put, get, delete and flush on a store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from versionlog.errors import StoreError
from versionlog.plans.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="versionlog")
    parser.add_argument("root")
    commands = parser.add_subparsers(dest="command", required=True)
    put = commands.add_parser("put")
    put.add_argument("key")
    put.add_argument("value")
    for name in ("get", "delete"):
        commands.add_parser(name).add_argument("key")
    commands.add_parser("flush")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("versionlog").config("spark.ui.enabled", "false").getOrCreate()
    try:
        with Store.open(spark, args.root) as store:
            if args.command == "put":
                store.put(args.key.encode(), args.value.encode())
            elif args.command == "delete":
                store.delete(args.key.encode())
            elif args.command == "flush":
                store.flush()
            else:
                found = store.get(args.key.encode())
                print("(nil)" if found is None else found.decode(errors="replace"))
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
