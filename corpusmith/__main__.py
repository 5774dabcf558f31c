"""python -m corpusmith bundle|index|ask|similar …"""

from __future__ import annotations

import argparse
import sys
from os.path import realpath

from pyspark.sql import SparkSession

from .plans.ask import ask, similar
from .plans.index import load_index
from .plans.tree import bundle_tree, index_tree
from .settings import TOP_K, Settings


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusmith")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("bundle", help="write one text per folder")
    one.add_argument("root", nargs="?", default=".")
    one = commands.add_parser("index", help="index the files of a folder")
    one.add_argument("root")
    one.add_argument("index")
    one.add_argument("--web", action="store_true", help="smaller chunks, top level only")
    for name in ("ask", "similar"):
        one = commands.add_parser(name)
        one.add_argument("index")
        one.add_argument("text", nargs="+", help="one or more questions or snippets")
        one.add_argument("-k", type=int, default=TOP_K)
        one.add_argument("--sources", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("corpusmith").getOrCreate()
    try:
        return run(spark, args)
    except Exception as e:
        print(f"Error: {e}")
        return 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "bundle":
        root = args.root if "://" in args.root else realpath(args.root)
        written = bundle_tree(spark, root)
        for row in written.orderBy("out_path").toLocalIterator():
            print(f"Created {row['out_path']} from {row['n_files']} files")
        print("Concatenation complete!")
        return 0
    if args.command == "index":
        settings = Settings().web() if args.web else Settings()
        _, status, message = index_tree(spark, args.root, args.index, settings)
        print(message)
        return 0 if status == "ok" else 1
    index = load_index(spark, args.index)
    texts = spark.createDataFrame(list(enumerate(args.text)), "query_id bigint, query string")
    if args.command == "ask":
        done = ask(index, texts, args.k, show_sources=args.sources)
        for row in done.orderBy("query_id").collect():
            print(f"> {row['query']}\n{row['response']}\n")
        return 0
    for row in similar(index, texts, args.k).orderBy("query_id", "rank").collect():
        where = row["result"]["document"]["metadata"].get("file_path", "Unknown")
        print(f"{row['rank']}. {where}:{row['start_line']} {row['result']['score']:.6f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
