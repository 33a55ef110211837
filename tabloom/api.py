"""The two calls most users need, with the arguments of a one-call training tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.score import score
from .plans.train import TrainResult, train


def train_model(
    data_path: str | DataFrame,
    dependent_feature: str,
    rmse_prob: float,
    f1_prob: float,
    n_jobs: int = -1,
    n_iter: int = 100,
    n_splits: int = 5,
    artifacts_dir: str | None = None,
    fast: bool = False,
    **options,
) -> TrainResult:
    """`n_jobs` is the number of fits submitted to Spark at a time; -1 leaves it to us.

    Without `artifacts_dir` a local master writes below the working folder; a cluster, where
    that is some machine's own disk, needs the argument.
    """
    spark = options.pop("spark", None) or _session(data_path)
    if artifacts_dir is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("artifacts_dir must name a folder that all executors share")
    return train(
        data_path,
        dependent_feature,
        rmse_weight=rmse_prob,
        f1_weight=f1_prob,
        parallelism=4 if n_jobs < 1 else n_jobs,
        n_iter=n_iter,
        n_splits=n_splits,
        out=artifacts_dir or ".",
        fast=fast,
        spark=spark,
        **options,
    )


class Predictions:
    """A scored table that also answers `"prediction" in result`; nothing is collected."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __contains__(self, column: str) -> bool:
        return column in self.df.columns

    def __getitem__(self, column):
        return self.df[column]

    def __getattr__(self, name: str):
        return getattr(self.__dict__["df"], name)


def predict(
    model_path: str,
    preprocessor_path: str | DataFrame | None = None,
    input_data: str | DataFrame | None = None,
    encoder_path: str | None = None,
    spark: SparkSession | None = None,
    **options,
) -> Predictions:
    """The input columns and `prediction`.

    Either `predict(folder, input)` with the artifacts folder of a run, or
    `predict(model, preprocessor, input)` with paths inside of it: its parts are stored side by
    side, so the folder of the model names all three.
    """
    if input_data is None:
        input_data = preprocessor_path
    spark = spark or _session(input_data)
    folder = model_path.rstrip("/").removesuffix(".pkl")
    return Predictions(score(input_data, folder.removesuffix("/model"), spark, **options))


def _session(data) -> SparkSession:
    return data.sparkSession if isinstance(data, DataFrame) else SparkSession.builder.getOrCreate()
