"""Command line: ``python -m quarry dedupe | merge | low-evidence | evaluate`` over a saved corpus."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarry.config import RetrievalConfig
from quarry.corpus import Corpus
from quarry.operators.providers import HashEmbedder
from quarry.operators.shared import clear


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("folder", help="folder of a saved corpus")
    tasks = parser.add_subparsers(dest="task", required=True)
    dedupe = tasks.add_parser("dedupe", help="list pairs of entities with similar names")
    dedupe.add_argument("--threshold", type=float, default=0.85)
    low = tasks.add_parser("low-evidence", help="list entities that few chunks mention")
    low.add_argument("--most", type=int, default=1)
    merge = tasks.add_parser("merge", help="absorb one entity into another and save the corpus to another folder")
    merge.add_argument("keep"), merge.add_argument("absorb"), merge.add_argument("to")
    evaluate = tasks.add_parser("evaluate", help="hit rate and reciprocal rank of a JSON array of {query, expected_doc_id}")
    evaluate.add_argument("cases"), evaluate.add_argument("--top-k", type=int, default=5)
    evaluate.add_argument("--vector-size", type=int, default=64)
    return parser.parse_args(args)


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines to print."""
    corpus = Corpus.open(spark, args.folder)
    if args.task == "dedupe":
        rows = corpus.dedupe_candidates(args.threshold).orderBy("ratio", ascending=False).toLocalIterator()
        return [f"{r['ratio']:.2f}  ({r['type']}) {r['a_key']}  <->  {r['b_key']}" for r in rows]
    if args.task == "low-evidence":
        return [f"({r['type']}) {r['name']}: {r['n_chunks']}" for r in corpus.low_evidence(args.most).toLocalIterator()]
    if args.task == "merge":
        corpus.merge_names(args.keep, args.absorb).save(args.to)
        return [f"{args.absorb} is part of {args.keep} in {args.to}"]
    with open(args.cases) as file:
        cases = [(n, c["query"], c["expected_doc_id"]) for n, c in enumerate(json.load(file))]
    if not cases:
        raise SystemExit("there are no cases")
    table = spark.createDataFrame(cases, "case_id int, query string, expected string")
    row = corpus.evaluate(table, HashEmbedder(args.vector_size), RetrievalConfig(top_k=args.top_k)).first()
    return [f"cases {row['n']}, hit rate at {args.top_k} {row['hit_rate']:.1%}, mean reciprocal rank {row['mrr']:.3f}"]


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    print("\n".join(run(session, arguments())))
    if session.conf.get("spark.checkpoint.dir", None):
        clear(session)
    sys.exit(0)
