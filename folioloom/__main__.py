"""``python -m folioloom parse PATH`` and ``python -m folioloom evaluate --golden FILE --corpus PATH --report-dir DIR``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _labelled(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def _show(name: str, df: DataFrame, most: int = 50) -> None:
    """A table of a report as lines of JSON."""
    for row in df.limit(most).collect():
        print(name, json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioloom")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("parse", help="elements of a file, folder or archive")
    one.add_argument("path")
    one.add_argument("--clean", action="store_true")
    one.add_argument("--rows", type=int, default=5)
    two = commands.add_parser("evaluate", help="compare chunking strategies on labelled queries")
    two.add_argument("--golden", required=True)
    two.add_argument("--corpus", help="the document; its place in the labelled set's meta, if not given")
    two.add_argument("--strategies", default="sliding_window,header_aware")
    two.add_argument("--top-k", type=int, default=0, help="0: as the labelled set says")
    two.add_argument("--k-ratio", type=float, default=0.0)
    two.add_argument("--k-min", type=int, default=3)
    two.add_argument("--engine", default="text_hash")
    two.add_argument("--report-dir", default="reports")
    two.add_argument("--allow-mock", action="store_true", help="the text-hash engine says nothing about meaning: only to try things out")
    two.add_argument("--validate-golden", action="store_true", help="only check that chunks can cover the labelled spans")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("folioloom").getOrCreate()
    from .operators import chunk, evaluate
    from .plans import evaluation
    from .sources import readers

    if args.command == "parse":
        found, failed = readers.load_batch(spark, args.path, args.clean)
        _show("element", found.select("file_name", "element_idx", "type", "content").orderBy("file_name", "element_idx"), args.rows)
        _show("failure", failed)
        print("elements", found.count())
        return 0
    labelled = _labelled(args.golden)
    meta = labelled.get("meta", {})
    elements = readers.load_batch(spark, os.path.abspath(args.corpus or meta["document"]))[0]
    queries, spans = evaluation.golden(spark, labelled)
    strategies = tuple(s.strip() for s in args.strategies.split(",") if s.strip())
    if args.validate_golden:
        flaws = evaluate.invalid_golden(queries, spans, meta.get("corpus_lines"))
        _show("flaw", flaws)
        chunks = None
        for s in strategies:
            some = chunk.chunk(elements, s)[0].select("chunk_id", "location.start_line", "location.end_line").withColumn("strategy", F.lit(s))
            chunks = some if chunks is None else chunks.unionByName(some)
        covered = evaluate.coverage(chunks, spans).where("covered < total").orderBy("qid", "strategy")
        _show("not covered", covered)
        return int(not flaws.isEmpty() or not covered.isEmpty())
    if args.engine in ("text_hash", "mock") and not args.allow_mock:
        print("the text-hash engine says nothing about meaning; --allow-mock runs it all the same", file=sys.stderr)
        return 2
    settings = evaluation.Settings(strategies, args.top_k or int(meta.get("top_k", 5)), args.k_ratio, args.k_min, args.engine)
    run = evaluation.Run(os.path.abspath(args.report_dir), elements, queries, spans, settings)
    print("ran", json.dumps(run.run()))
    for name, df in run.results().items():
        _show(name, df)
    return 0


if __name__ == "__main__":
    sys.exit(main())
