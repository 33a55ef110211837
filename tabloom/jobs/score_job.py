"""spark-submit tabloom/jobs/score_job.py --model-dir ... --input ... --output ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="score a table with a trained model")
    p.add_argument("--model-dir", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--clean", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from tabloom.plans.score import score

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tabloom-score").getOrCreate()
    score(a.input, a.model_dir, spark, clean=a.clean).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
