"""python -m quarry profile|index|eval-set|evaluate|search|serve ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from quarry.functions.encode import HashingEncoder, encoder_for
from quarry.operators import evaluation, profile
from quarry.operators.catalog import source_documents
from quarry.plans import engine, evaluate, index
from quarry.session import session
from quarry.sources import mapping


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("profile", "profile a mapping CSV"), ("index", "build an index version"), ("eval-set", "generate evaluation queries"), ("evaluate", "compare encoders")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("--csv", required=True)
        c.add_argument("--output", required=name != "index")
        if name in ("index", "evaluate"):
            c.add_argument("--root", required=True)
            c.add_argument("--dimension", type=int, nargs="+", default=[256])
        if name == "index":
            c.add_argument("--recreate", action="store_true", help="publish the new version")
        if name == "eval-set":
            c.add_argument("--documents", type=int, default=evaluation.DOCUMENTS)
        if name == "evaluate":
            c.add_argument("--queries", required=True)
            c.add_argument("--limit", type=int, default=evaluation.LIMIT)
            c.add_argument("--timed", type=int, default=evaluate.TIMED, help="queries that are also timed one by one")
        if name == "index":
            c.add_argument("--report", help="write the metadata as JSON")
    c = sub.add_parser("search", help="answer a query from an index")
    c.add_argument("query")
    c.add_argument("--root", required=True)
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("serve", help="answer queries over HTTP; settings come from the environment")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark = session()
    if a.command == "search":
        idx = index.open_index(spark, a.root)
        for row in engine.search_one(spark, a.query, idx, encoder_for(idx.meta.embedding_model, idx.meta.embedding_dimension), limit=a.limit):
            print(json.dumps(row, ensure_ascii=False, default=str))
        return 0
    if a.command == "serve":
        from quarry.service import Service, server
        from quarry.settings import from_environment

        s = from_environment()
        server(Service(spark, index.open_index(spark, s.index_root, model=s.model), encoder_for(s.model, s.dimension), s), a.host, a.port).serve_forever()
        return 0
    rows = mapping.read_csv(spark, a.csv)
    if a.command == "profile":
        report = profile.profile(rows, a.csv)
        mapping.write_report(report, a.output)
        print(f"rows: {report['rows']}, duplicates: {report['full_duplicates']}, conflicts: {report['conflicting_steel_articles_count']}")
    elif a.command == "index":
        meta = index.build_index(rows, a.root, HashingEncoder(a.dimension[0]), model=f"hashing-{a.dimension[0]}", checksum=mapping.checksum(spark, a.csv), recreate=a.recreate)
        if a.report:
            mapping.write_report(asdict(meta), a.report)
        print(meta.collection_name)
    elif a.command == "eval-set":
        mapping.write_queries(evaluation.eval_rows(rows, documents=a.documents), a.output)
    else:
        gold = evaluate.gold_of(mapping.read_queries(spark, a.queries)).cache()
        results = evaluate.compare({f"hashing-{d}": lambda d=d: HashingEncoder(d) for d in a.dimension}, rows, gold, a.root, limit=a.limit, timed=a.timed)
        evaluate.write_results(results, f"{a.output}/results.json")
        with open(f"{a.output}/comparison.md", "w", encoding="utf-8") as f:
            f.write(evaluate.markdown(results))
    return 0


if __name__ == "__main__":
    sys.exit(main())
