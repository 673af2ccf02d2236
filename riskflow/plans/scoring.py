"""DEC8: the scoring job — guard, features, model, calibration, decision, explanation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession

from riskflow.config import RiskBands
from riskflow.operators.calibration import Calibrator
from riskflow.operators.decisions import decide
from riskflow.operators.encode import FrequencyEncoder
from riskflow.operators.explain import with_explanations
from riskflow.operators.leakage import assert_no_leakage
from riskflow.operators.splits import align_to
from riskflow.operators.training import FittedModel
from riskflow.plans.features import feature_table


@dataclass
class Scorer:
    """Everything a scoring run needs, fitted together."""

    model: FittedModel
    encoder: FrequencyEncoder
    calibrator: Calibrator | None = None
    bands: RiskBands = RiskBands()
    approve_below: float | None = None
    block_from: float | None = None

    @property
    def needs_history(self) -> bool:
        return any("_total_txn_count" in f or "_txn_count_" in f for f in self.model.features)

    def score_features(self, features: DataFrame, keep: list[str], error: str | None = None) -> DataFrame:
        """Score rows whose features are already computed."""
        kept = [*keep, *([error] if error else [])]
        aligned = align_to(features, self.model.features, kept)
        self.model.verify([c for c in aligned.columns if c not in kept])
        scored = self.model.score(aligned)
        column = "p"
        if self.calibrator is not None:
            scored, column = self.calibrator.transform(scored, "p", "calibrated"), "calibrated"
        decided = decide(scored, column, error, self.bands, self.approve_below, self.block_from)
        return decided.select(*keep, "fraud_probability", "risk_score", "risk_level", "decision")

    def score(self, transactions: DataFrame, history: DataFrame | None = None, explain: bool = False) -> DataFrame:
        """Score label-free transactions; ``history`` warms the entities' past."""
        assert_no_leakage(transactions)
        exact = any("_txn_count_" in f for f in self.model.features)
        features = feature_table(transactions, self.encoder, self.needs_history, exact, history)
        if not explain:
            return self.score_features(features, ["transaction_id"])
        # in the same row as the features, as ids alone don't tell rows apart
        return self.score_features(with_explanations(self.model, align_to(features, self.model.features, ["transaction_id"])), ["transaction_id", "explanations"])

    def save(self, path: str) -> None:
        """TRN8: everything a scoring job starts from, under one folder that Spark writes (any file system it knows)."""
        spark = SparkSession.active()
        self.model.save(f"{path}/scorer")
        about = {
            "created_at": datetime.now(UTC).isoformat(), "columns": self.encoder.columns, "joined": self.encoder.joined,
            "bands": asdict(self.bands), "approve_below": self.approve_below, "block_from": self.block_from,
        }
        if self.calibrator is not None:
            about["calibrator"] = {"slope": self.calibrator.slope, "intercept": self.calibrator.intercept, "active": self.calibrator.active, "isotonic": self.calibrator.isotonic is not None}
            if self.calibrator.isotonic is not None:
                self.calibrator.isotonic.write().overwrite().save(f"{path}/isotonic")
        # maps are small by construction; larger columns are a table already
        known = [(c, v, f) for c, m in self.encoder.maps.items() for v, f in m.items()]
        spark.createDataFrame(known, "col string, val string, freq double").write.mode("overwrite").parquet(f"{path}/frequencies")
        if self.encoder.joined:
            self.encoder.table.write.mode("overwrite").parquet(f"{path}/frequency_table")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about_scorer")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        """What ``save`` wrote, checked against the model's own feature list before anything is scored."""
        about = json.loads(spark.read.text(f"{path}/about_scorer").first()["value"])
        maps: dict[str, dict[str, float]] = {c: {} for c in about["columns"] if c not in about["joined"]}
        for row in spark.read.parquet(f"{path}/frequencies").collect():
            maps[row["col"]][row["val"]] = row["freq"]
        table = spark.read.parquet(f"{path}/frequency_table") if about["joined"] else None
        calibrator = None
        if "calibrator" in about:
            c = about["calibrator"]
            isotonic = IsotonicRegressionModel.load(f"{path}/isotonic") if c["isotonic"] else None
            calibrator = Calibrator(c["slope"], c["intercept"], isotonic, c["active"])
        encoder = FrequencyEncoder(about["columns"], maps, table, about["joined"])
        return cls(FittedModel.load(spark, f"{path}/scorer"), encoder, calibrator, RiskBands(**about["bands"]), about["approve_below"], about["block_from"])
