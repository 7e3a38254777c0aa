"""Screen a prompt table: ``spark-submit … -m tidegate --input in --output out``."""

from __future__ import annotations

import argparse

import yaml
from pyspark.sql import SparkSession

from tidegate.operators.intake import accepted, rejected
from tidegate.plans.chain import inspect, screen
from tidegate.plans.profiles import build
from tidegate.session import ship
from tidegate.sources.prompts import read_prompts, read_requests, spread
from tidegate.sources.sinks import write_verdicts


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidegate", description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--input-format", default="parquet", help="parquet, json, … or requests (strict JSON bodies)")
    parser.add_argument("--output", required=True)
    parser.add_argument("--output-format", default="parquet")
    parser.add_argument("--rejects", help="where to write rejected prompts")
    parser.add_argument("--profile", default="full", help="default, clinical, full or a YAML file")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="e.g. stages.1.threshold=0.9")
    parser.add_argument("--bank", action="append", default=[], metavar="NAME=PATH", help="crisis, malign or patterns")
    parser.add_argument("--trace", action="store_true", help="add the per-stage trace")
    return parser.parse_args(argv)


def _pairs(items: list[str]) -> dict[str, str]:
    return dict(item.split("=", 1) for item in items)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = arguments(argv)
    overrides = {key: yaml.safe_load(value) for key, value in _pairs(options.set).items()}
    stages = build(options.profile, overrides, _pairs(options.bank))
    spark = spark or SparkSession.builder.appName("tidegate").getOrCreate()
    ship(spark)
    if options.input_format == "requests":
        prompts = read_requests(spark, options.input)
    else:
        prompts = spread(read_prompts(spark, options.input, options.input_format))
    run = inspect if options.trace else screen
    write_verdicts(run(accepted(prompts), stages), options.output, options.output_format)
    if options.rejects:
        rejected(prompts).write.parquet(options.rejects)


if __name__ == "__main__":
    main()
