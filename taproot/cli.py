"""Command line: ``spark-submit -m taproot.cli fragments --skeleton-csv .. --config .. ``."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import logging

from pyspark.sql import SparkSession

from taproot.config import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taproot")
    p.add_argument("--skeleton-csv", required=True)
    p.add_argument("--config", required=True, action="append", help="TOML; later files override earlier ones")
    p.add_argument("--output-file", default="-", help="folder to save under; - for none")
    p.add_argument("--log-level", type=int, default=logging.WARNING)
    sub = p.add_subparsers(dest="source", required=True)
    f = sub.add_parser("fragments", help="masks from a fragment graph")
    f.add_argument("--fragments", required=True)
    f.add_argument("--edges", required=True)
    m = sub.add_parser("model", help="masks from a model")
    m.add_argument("--segmenter", required=True, help="module:function that takes the configuration and gives a segmenter")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    out = None if args.output_file == "-" else args.output_file
    config = Config.from_toml(*args.config)
    config = dataclasses.replace(config, skeleton=dataclasses.replace(config.skeleton, csv=args.skeleton_csv, output_file_base=out))
    from taproot.plans import jobs

    spark = SparkSession.builder.appName("taproot").getOrCreate()
    if args.source == "fragments":
        tables = jobs.from_fragments(spark, config, args.fragments, args.edges)
    else:
        module, _, name = args.segmenter.partition(":")
        tables = jobs.from_model(spark, config, getattr(importlib.import_module(module), name)(config))
    if out is None:
        tables["rankings"].orderBy("branch_score", ascending=False).show(20)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
