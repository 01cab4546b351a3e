"""The command line: python -m notequarry --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators.render import rendered
from .plans import service
from .plans.knowledge import Config, KnowledgeBase
from .sources import seed, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="notequarry", description="Hybrid retrieval over a folder of notes.")
    out.add_argument("--root", required=True, help="folder of the knowledge base")
    out.add_argument("--config", help="TOML file of defaults")
    out.add_argument("--format", choices=("table", "list", "json"), default="table")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *words: str) -> argparse.ArgumentParser:
        found = commands.add_parser(name, help=help)
        for word in words:
            found.add_argument(word)
        return found

    command("build", "bring the tables up to date with a folder of Markdown files", "source")
    search = command("search", "hybrid search", "query")
    search.add_argument("--alpha", type=float)
    search.add_argument("--min-weight", type=float)
    search.add_argument("--notes-only", action="store_true")
    similar = command("similar", "notes like a note, or like a file")
    one = similar.add_mutually_exclusive_group(required=True)
    one.add_argument("--label")
    one.add_argument("--file")
    fts = command("fts", "full-text search", "query")
    fts.add_argument("--limit", type=int)
    fts.add_argument("--notes-only", action="store_true")
    graph = command("graph", "neighbours of a node", "name")
    path = command("path", "the shortest path between two nodes", "start", "end")
    path.add_argument("--max-depth", type=int)
    ask = command("ask", "answer a question from the notes", "question")
    for found in (search, similar, ask):
        found.add_argument("-k", type=int)
    for found in (search, ask):
        found.add_argument("--filter", action="append", default=[], dest="filters", metavar="'FIELD OP VALUE'")
    for found in (search, graph):
        found.add_argument("--depth", type=int)
    command("detect", "find communities anew").add_argument("--resolution", type=float)
    for name, help in (("summarize", "summarise the communities"), ("stats", "count what is stored"), ("seed", "store the demo corpus"), ("reset", "empty all tables"), ("serve", "answer JSON-RPC lines")):
        command(name, help)
    return out


def run(spark: SparkSession, argv: Sequence[str]) -> str:
    """What a command prints."""
    args = vars(parser().parse_args(argv))
    root, form, name = args.pop("root"), args.pop("format"), args.pop("command")
    config = Config.from_toml(path) if (path := args.pop("config")) else Config()
    if name == "reset":
        store.reset(spark, root)
        return ""
    if name == "seed":
        store.save(store.empty(spark) | seed.demo(spark), root)
        return ""
    if name == "build":
        return json.dumps(vars(KnowledgeBase(spark, store.empty(spark), config=config).build(args["source"], root)))
    kb = KnowledgeBase.open(spark, root, config=config)
    if name == "serve":
        service.serve(kb, root=root)
        return ""
    if name == "path":
        found = kb.path(**args)
        return " -> ".join(found) if found else "no path"
    if name == "ask":
        return json.dumps(vars(kb.ask(**args)), ensure_ascii=False, indent=2, default=str)
    made = {"detect": kb.detect_communities, "summarize": kb.summarize_communities}
    found: DataFrame = made.get(name, getattr(kb, name, None))(**args)
    if name in made:
        kb.save(root)
        found = found.select("id", "label", "level", "member_count")
    # Only search results have the columns of the table.
    return rendered(found, form if name == "search" or form == "list" and "file" in found.columns and "type" in found.columns else "json")


def main() -> None:
    spark = SparkSession.builder.appName("notequarry").getOrCreate()
    try:
        if text := run(spark, sys.argv[1:]):
            print(text)
    except ValueError as error:
        sys.exit(str(error))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
