"""The fitted model as one saved artefact, shared by everything that predicts with it.

A model is known by a fingerprint of its training rows and its parameters. Whoever asks for the
same rows and parameters again, in this run or a later one, loads the saved model instead of fitting
it. The label dictionary that the rows were encoded with is saved beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotcast.config import BoostedConfig
from depotcast.operators import boosted
from depotcast.operators.features import feature_names
from depotcast.plans.run_log import RunLog, digest

#: Decimals to which training values enter the fingerprint: sums may differ in their last bits.
_DECIMALS = 6


def training_fingerprint(rows: DataFrame, config: BoostedConfig) -> str:
    """A digest of the training rows, in any order, and of the model's parameters: one scan."""
    columns = ["branch", "product", "date", "label", *feature_names(config)]
    kinds = dict(rows.dtypes)
    values = [F.round(c, _DECIMALS) if kinds[c] == "double" else F.col(c) for c in columns]
    row = rows.select(F.xxhash64(*values).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    ).first()
    return digest(config, columns, row["n"], row["x"], str(row["s"]))


@dataclass(frozen=True)
class SavedModel:
    """Trees, and the label dictionary that their rows were encoded with."""

    trees: GBTRegressionModel
    codes: DataFrame


class ModelStore:
    """Saved models below ``root``, one folder each."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = RunLog(spark, root, shared=True)

    def trained(self, training: boosted.Training) -> SavedModel:
        """The model of these training rows: loaded if it was ever fitted here, else fitted and saved."""
        fingerprint = training_fingerprint(boosted.training_part(training), training.config)

        def write(path: str) -> None:
            boosted.fit(training).write().overwrite().save(f"{path}/trees")
            training.codes.write.mode("overwrite").parquet(f"{path}/codes")

        # the name has the whole identity: models of other rows stay beside it
        name = f"model-{fingerprint[:24]}"
        self.log.artifact(name, write)
        return self.load(name)

    def load(self, name: str) -> SavedModel:
        """A saved model by the name of its folder."""
        commit = self.log.committed(name)
        if commit is None:
            raise ValueError(f"no finished model {name} below {self.log.root}")
        return SavedModel(
            GBTRegressionModel.load(f"{self.log.folder(commit)}/trees"),
            self.log.spark.read.schema("column string, label string, code long").parquet(f"{self.log.folder(commit)}/codes"),
        )
