"""The store from the command line: python -m weftline COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.api import Store
from weftline.functions.spans import ChunkError, cut_source
from weftline.operators.formatting import review_spans
from weftline.operators.listing import NotFound
from weftline.sources.catalog import Catalog, DimensionMismatch, StoreExists, StoreNotFound

_REPLIES = {"extract": "chunk_id bigint, model string, response string", "summarize": "community_id bigint, model string, response string"}
_SPANS = ("index", "start", "end", "line_start", "line_end")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description=__doc__)
    top.add_argument("--data", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, store: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        if store:
            sub.add_argument("--store", default="default")
        return sub

    sub = add("note", "add a text")
    sub.add_argument("text")
    sub.add_argument("--source")
    sub = add("ask", "search")
    sub.add_argument("query")
    sub.add_argument("--limit", type=int, default=5)
    sub.add_argument("--expand", type=int, default=0)
    add("log", "newest texts first").add_argument("--limit", type=int, default=20)
    add("backfill-embeddings", "embed all chunks anew")
    sub = add("enrich", "detect communities and keep them")
    sub.add_argument("--hierarchical", action="store_true")
    sub.add_argument("--keep", action="store_true", help="keep those found before")
    add("embed", "embed the entities that lack a vector").add_argument("--limit", type=int)
    add("status", "what is done and what is next").add_argument("--json", action="store_true")
    sub = add("plan", "work units as JSON lines")
    sub.add_argument("phase", choices=["extract", "summarize", "embed"])
    sub.add_argument("--model", default="model")
    sub.add_argument("--limit", type=int)
    add("apply", "take in replies as JSON lines").add_argument("phase", choices=list(_REPLIES))
    commands.choices["apply"].add_argument("path", nargs="?", help="a file; without one they are read from standard input")
    add("export", "a store as JSON lines")
    add("stores", "all stores", store=False)
    add("info", "where the tables are", store=False)
    sub = add("chunk", "cut a file", store=False)
    sub.add_argument("path")
    sub.add_argument("--size", type=int, default=2000)
    sub.add_argument("--slack", type=int, default=200)
    sub.add_argument("--markdown", type=lambda x: x.lower() in ("1", "true", "yes"))
    sub.add_argument("--nth", type=int)
    sub.add_argument("--format", choices=["spans", "text", "review", "json"], default="spans")
    sub.add_argument("--code", action="store_true")
    sub.add_argument("--lang")
    sub.add_argument("--lines", action="store_true")
    sub.add_argument("--expand", type=int, default=0)
    return top


def chunk_file(args: argparse.Namespace) -> str:
    with open(args.path, encoding="utf-8", newline="") as file:
        text = file.read()
    found = cut_source(text, args.path, args.size, args.slack, args.markdown, args.lines, args.code, args.lang, args.nth, args.expand)
    if args.format == "text":
        return "\n".join(s["text"] for s in found)
    if args.format == "review":
        return review_spans(found, 100).rstrip("\n")
    if args.format == "json":
        return "\n".join(json.dumps(s, ensure_ascii=False) for s in found)
    rows = ["\t".join((*_SPANS, "bytes", "fingerprint", "sed_range"))]
    return "\n".join(rows + ["\t".join(map(str, (*(s[c] for c in _SPANS), s["end"] - s["start"], s["fingerprint"], f"{s['line_start']},{s['line_end']}p"))) for s in found])


def _lines(frame) -> None:
    for row in frame.toJSON().toLocalIterator():
        print(row)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    catalog = Catalog(spark, args.data)
    if args.command == "stores":
        return _lines(catalog.list_stores())
    if args.command == "info":
        return print(json.dumps(catalog.info(), sort_keys=True))
    # only a note makes a store
    store = Store(catalog, args.store, create=args.command == "note")
    if args.command == "note":
        print(store.note(args.text, args.source).first()["id"])
    elif args.command == "ask":
        print(store.search_text(args.query, args.limit, args.expand))
    elif args.command == "log":
        print("\n".join(r["line"] for r in store.log(args.limit).collect()))
    elif args.command == "backfill-embeddings":
        store.backfill_embeddings()
    elif args.command == "enrich":
        store.detect_communities(args.hierarchical, clear=not args.keep)
        print(store.communities().count())
    elif args.command == "embed":
        print(store.embed_entities(args.limit))
    elif args.command == "status":
        rows = store.status()
        _lines(rows) if args.json else [print(f"{r['phase']:<12} {r['done']}/{r['total']}  {r['guidance']}") for r in rows.collect()]
    elif args.command == "plan":
        _lines(store.plan(args.phase, args.model, args.limit))
    elif args.command == "apply":
        print(store.apply(args.phase, _replies(spark, args), "model" if args.phase == "extract" else None))
    elif args.command == "export":
        for row in store.export().orderBy("ord", "id").select("json").toLocalIterator():
            print(row["json"])


def _replies(spark: SparkSession, args: argparse.Namespace):
    from weftline.sources.jsonl import parse_replies, read_replies

    schema = _REPLIES[args.phase]
    rows = read_replies(spark, args.path, schema) if args.path else parse_replies(spark.createDataFrame([(line,) for line in sys.stdin], "value string"), schema)
    return rows.withColumn("received_at", F.current_timestamp())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "chunk":
            print(chunk_file(args))
        else:
            from weftline.session import local_session

            run(args, spark or local_session())
    except StoreNotFound as err:
        print(f"there is no store {err.args[0]}", file=sys.stderr)
    except NotFound as err:
        print(f"not found: {err.args[0]}", file=sys.stderr)
    except (StoreExists, DimensionMismatch, ChunkError, OSError) as err:
        print(f"{type(err).__name__}: {err}", file=sys.stderr)
    else:
        return 0
    return 1
