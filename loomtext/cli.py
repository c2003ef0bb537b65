"""python -m loomtext.cli process INPUT -o OUTPUT"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

import loomtext
from loomtext.plans.pipeline import process_file
from loomtext.sources.files import ValidationError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtext")
    top.add_argument("--log-level", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    top.add_argument("--log-file")
    commands = top.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process", help="segment, deduplicate and classify text files")
    process.add_argument("input")
    process.add_argument("-o", "--output", required=True)
    process.add_argument("-g", "--granularity", default="sentence", choices=["sentence", "paragraph"])
    process.add_argument("--no-classify", action="store_true")
    process.add_argument("--no-dedup", action="store_true")
    process.add_argument("--cache", help="folder of the index that outlives runs")
    process.add_argument("--stats", help="folder for statistics; .txt for plain text")
    stream = process.add_mutually_exclusive_group()
    stream.add_argument("--streaming", action="store_true", help="no effect on results: Spark reads inputs of any size in parts")
    stream.add_argument("--no-streaming", action="store_true", help="no effect on results")
    process.add_argument("--streaming-threshold", type=float, default=50, help="MB; no effect on results")
    commands.add_parser("version")
    return top


def main(args: list[str] | None = None) -> int:
    """0: done; 1: an input can't be used or the run failed; 130: interrupted."""
    given = parser().parse_args(args)
    logging.basicConfig(level=given.log_level, filename=given.log_file)
    if given.command == "version":
        print(loomtext.__version__)
        return 0
    try:
        spark = SparkSession.builder.appName("loomtext").getOrCreate()
        process_file(spark, given.input, given.output, given.granularity, not given.no_classify, not given.no_dedup, given.cache, given.stats)
    except KeyboardInterrupt:
        return 130
    except ValidationError as e:
        print(e, file=sys.stderr)
        return 1
    except Exception:
        logging.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
