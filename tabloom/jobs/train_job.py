"""spark-submit tabloom/jobs/train_job.py --data-path ... --target ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="train the best model for a table")
    p.add_argument("--data-path", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--rmse-weight", type=float, required=True)
    p.add_argument("--f1-weight", type=float, required=True)
    p.add_argument("--parallelism", type=int, default=4)
    p.add_argument("--n-iter", type=int, default=100)
    p.add_argument("--n-splits", type=int, default=5)
    p.add_argument("--out", help="folder that all executors share; a local master writes below the working folder without it")
    p.add_argument("--key")
    p.add_argument("--models", nargs="*")
    p.add_argument("--fast", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from tabloom.api import train_model

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tabloom-train").getOrCreate()
    result = train_model(
        a.data_path, a.target, a.rmse_weight, a.f1_weight, a.parallelism, a.n_iter, a.n_splits, a.out, a.fast,
        key=a.key, models=a.models, spark=spark,
    )
    print(json.dumps(result.report, default=str))


if __name__ == "__main__":
    main()
