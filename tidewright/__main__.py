"""``python -m tidewright CONFIG STORE``: run a configuration."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidewright.functions.design import SignalError
from tidewright.functions.families import CandidateError
from tidewright.operators.fitting import DesignError
from tidewright.plans.config import ConfigError, load
from tidewright.plans.runner import TILES_PER_COMMIT, run
from tidewright.sources.inputs import InputError
from tidewright.sources.store import ResumeError

OK, WITH_FAILURES, ABORTED, BAD_CONFIG, BAD_DATA = range(5)


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.exit(BAD_CONFIG, f"{message}\n")


def main(args: list[str] | None = None) -> int:
    parser = Parser(prog="tidewright", description="Select noise models for many time series.")
    parser.add_argument("config")
    parser.add_argument("store")
    parser.add_argument("--reuse-fits-from", metavar="STORE", help="rank the fits of a complete store by this configuration's criteria")
    parser.add_argument("--max-failure-rate", type=float, metavar="SHARE", help="exit with 1 if a candidate failed on more than this share of the series it could be fitted to")
    parser.add_argument("--regressors", metavar="PARQUET", help="a table with ts and a column for each regressor:name")
    parser.add_argument("--tiles-per-commit", type=int, default=TILES_PER_COMMIT, metavar="N")
    got = parser.parse_args(args)
    try:
        config = load(got.config)
    except (ConfigError, SignalError, CandidateError) as e:
        print(e, file=sys.stderr)
        return BAD_CONFIG
    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    try:
        report = run(spark, config, got.store, got.reuse_fits_from, spark.read.parquet(got.regressors) if got.regressors else None, tiles_per_commit=got.tiles_per_commit)
    except (ConfigError, SignalError) as e:
        print(e, file=sys.stderr)
        return BAD_CONFIG
    except (InputError, ResumeError, DesignError) as e:
        print(e, file=sys.stderr)
        return BAD_DATA
    for w in report.warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(f"{report.n_fitted} of {report.n_series} series fitted, fit {report.fit_hash}")
    if report.stopped:
        print("stopped before the end; the same command goes on", file=sys.stderr)
        return ABORTED
    worst = max(report.failure_rates.values(), default=0.0)
    return WITH_FAILURES if got.max_failure_rate is not None and worst > got.max_failure_rate else OK


if __name__ == "__main__":
    sys.exit(main())
