"""python -m matchloom.cli {train,evaluate,predict,run,check,package}"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from matchloom.plans import linkage
from matchloom.sources import package, tsv


def session() -> SparkSession:
    return SparkSession.builder.appName("matchloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m matchloom.cli", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, groups in (("train", "mt"), ("evaluate", "m"), ("predict", "mo"), ("run", "mto"), ("check", "o"), ("package", "op")):
        p = sub.add_parser(name)
        p.add_argument("--data-dir", default="dataset", help="folder with train/ and test/")
        if "m" in groups:
            p.add_argument("--model-dir", default="artifacts")
            p.add_argument("--threshold", type=float, default=None, help="instead of the tuned one")
        if "o" in groups:
            p.add_argument("--out-dir", default="output")
        if "t" in groups:
            p.add_argument("--val-frac", type=float, default=0.2)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--max-train-entities", type=int, default=400_000, help="0: all")
            p.add_argument("--k-name", type=int, default=15)
            p.add_argument("--k-addr", type=int, default=10)
            p.add_argument("--max-df", type=int, default=3000)
            p.add_argument("--fallback-df", type=int, default=30000)
            p.add_argument("--iterations", type=int, default=300, help="boosting rounds")
        if "p" in groups:
            p.add_argument("--team", required=True)
            p.add_argument("--dest", default=".")
            p.add_argument("--methodology", default="README.md")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "package":
        print(*package.build(args.team, args.out_dir, args.dest, args.methodology)[1], sep="\n")
        return
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(message)s")
    spark = session()
    if args.command in ("train", "run"):
        keys = ("threshold", "val_frac", "seed", "max_train_entities", "k_name", "k_addr", "max_df", "fallback_df", "iterations")
        print(json.dumps(linkage.train(spark, args.data_dir, args.model_dir, {k: getattr(args, k) for k in keys}), indent=2))
    if args.command == "evaluate":
        print(json.dumps(linkage.evaluate(spark, args.data_dir, args.model_dir, args.threshold), indent=2))
    if args.command in ("predict", "run"):
        summary = linkage.predict(spark, args.data_dir, args.model_dir, args.out_dir, args.threshold)
        print(json.dumps(summary, indent=2))
        if summary["issues"]:
            sys.exit(1)
    if args.command == "check":
        found = linkage.issues(spark, args.out_dir, *tsv.read_sources(spark, f"{args.data_dir}/test", "test"))
        for n, issue in enumerate(found, 1):
            print(f"{n}. {issue}")
        print("FAIL" if found else "PASS")
        sys.exit(bool(found))


if __name__ == "__main__":
    main()
