"""The training run: features once, four models, calibration, thresholds, report tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.config import SplitBounds
from riskflow.operators.bootstrap import bootstrap_ci
from riskflow.operators.calibration import Calibrator
from riskflow.operators.drift import population_drift
from riskflow.operators.encode import FrequencyEncoder
from riskflow.operators.explain import global_importance
from riskflow.operators.metrics import fraud_metrics, ranking
from riskflow.operators.splits import assign_split
from riskflow.operators.thresholds import best_thresholds, cost_at
from riskflow.operators.training import FittedModel, fit_boosted, fit_forest, fit_logistic
from riskflow.plans.features import BASIC, ENGINEERED, feature_table
from riskflow.plans.scoring import Scorer
from riskflow.session import freeze
from riskflow.sources.sinks import experiment_rows

LABEL = "true_fraud_label"
_KEEP = [LABEL, "amount", "event_timestamp", "split", "subsplit"]


@dataclass(frozen=True)
class TrainingPlan:
    """Sizes of the run; the defaults are the full-size ones."""

    boosted_basic: dict = field(default_factory=lambda: {"rounds": 300, "depth": 6, "step": 0.05, "column_share": 0.8})
    boosted_engineered: dict = field(default_factory=lambda: {"rounds": 500, "depth": 7, "step": 0.03, "column_share": 0.7})
    forest: dict = field(default_factory=lambda: {"trees": 500, "depth": 7})
    logistic: dict = field(default_factory=dict)
    grid_steps: int = 30
    bootstraps: int = 500


@dataclass
class Outcome:
    scorer: Scorer
    experiments: DataFrame
    calibration: DataFrame
    test_metrics: DataFrame
    threshold_choice: DataFrame
    test_cost: DataFrame
    intervals: DataFrame
    drift: DataFrame
    importance: DataFrame


def split_features(transactions: DataFrame, bounds: SplitBounds) -> tuple[DataFrame, FrequencyEncoder]:
    """Features of every split with all earlier rows as history, written once.

    Features look back only, so computing them over the whole table at once equals
    feeding each split its predecessors.
    """
    tagged = assign_split(transactions, bounds)
    encoder = FrequencyEncoder.fit(tagged.where("split = 'TRAIN'"))
    return freeze(feature_table(tagged, encoder, keep=_KEEP)), encoder


def labelled(model: FittedModel, rows: DataFrame) -> DataFrame:
    return model.score(rows).select("transaction_id", F.col(LABEL).alias("y"), "p", "amount", "split", "subsplit")


def run_experiments(transactions: DataFrame, bounds: SplitBounds, plan: TrainingPlan = TrainingPlan()) -> Outcome:
    features, encoder = split_features(transactions, bounds)
    train, val, test = (features.where(F.col("split") == s) for s in ("TRAIN", "VAL", "TEST"))
    models = [
        fit_logistic(train, BASIC, **plan.logistic),
        fit_boosted(train, val, BASIC, name="boosted_basic", **plan.boosted_basic),
        fit_boosted(train, val, ENGINEERED, name="boosted_engineered", **plan.boosted_engineered),
        fit_forest(train, ENGINEERED, **plan.forest),
    ]
    results = {}
    for m in models:
        row = ranking(labelled(m, val)).first()
        results[m.name] = {"val_pr_auc": row["pr_auc"], "val_roc_auc": row["roc_auc"]}
    best = max(models, key=lambda m: results[m.name]["val_pr_auc"])

    scored_val = labelled(best, val)
    calibrator = Calibrator.fit(scored_val.where("subsplit = 'VAL_CALIB'"))
    unseen = scored_val.where("subsplit = 'VAL_OPT'")
    calibration = calibrator.evaluate(unseen)
    calibrator.choose(calibration)

    def calibrated(df: DataFrame) -> DataFrame:
        return calibrator.transform(df, "p", "q").select("transaction_id", "y", F.col("q").alias("p"), "amount")

    choice = best_thresholds(calibrated(unseen), plan.grid_steps)
    chosen = choice.first()
    approve, block = chosen["approve_threshold"], chosen["block_threshold"]
    final = freeze(calibrated(labelled(best, test)))
    return Outcome(
        scorer=Scorer(best, encoder, calibrator, approve_below=approve, block_from=block),
        experiments=experiment_rows(transactions.sparkSession, results),
        calibration=calibration,
        test_metrics=fraud_metrics(final),
        threshold_choice=choice,
        test_cost=cost_at(final, approve, block),
        intervals=bootstrap_ci(final, approve, plan.bootstraps),
        drift=population_drift(train, test, best.features),
        importance=global_importance(best, val),
    )
