"""Command line: answer, search and evaluate over parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from candela import pipeline
from candela.config import load_config
from candela.operators import evaluate
from candela.session import local_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("candela")
    parser.add_argument("--config")
    parser.add_argument("--set", action="append", default=[], metavar="key=value")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ask", "eval"):
        p = sub.add_parser(name)
        p.add_argument("--units", required=True, help="parquet: unit_id, text")
        p.add_argument("--out", required=True)
    sub.choices["ask"].add_argument("question", nargs="+")
    sub.choices["eval"].add_argument("--questions", required=True, help="parquet: qid, text")
    sub.choices["eval"].add_argument("--gold", required=True, help="parquet: qid, page")
    args = parser.parse_args(argv)
    spark, config = local_session(), load_config(args.config, args.set)
    units = spark.read.parquet(args.units)
    if args.command == "ask":
        asked = spark.createDataFrame(list(enumerate(args.question)), "qid long, text string")
        pipeline.answer(asked, units, config).write.mode("overwrite").json(args.out)
    else:
        asked = spark.read.parquet(args.questions)
        hits = pipeline.retrieve(asked, units, config).select("qid", F.col("unit_id").alias("page"), "rank")
        evaluate.retrieval_metrics(hits, spark.read.parquet(args.gold), asked, tuple(config.eval.ks)).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
