import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.config import JANUARY_2024
from riskflow.operators import calibration as C
from riskflow.operators import explain as X
from riskflow.operators import leakage as L
from riskflow.operators import metrics as M
from riskflow.operators import splits as S
from riskflow.operators import training as T
from riskflow.plans import catalogue
from riskflow.plans.experiment import TrainingPlan, labelled, run_experiments, split_features
from riskflow.plans.features import BASIC, ENGINEERED
from riskflow.plans.scoring import Scorer
from riskflow.sources.fixture import scored, transactions
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    features, encoder = split_features(transactions(spark, SMALL), JANUARY_2024)
    train, rest = features.where("split = 'TRAIN'"), features.where("split <> 'TRAIN'")
    return features, encoder, train, rest, T.fit_logistic(train, BASIC, max_iter=40)


def test_logistic_ranks_and_scores_in_range(fitted):
    *_, rest, model = fitted
    out = labelled(model, rest)
    assert out.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    assert M.ranking(out).first()["roc_auc"] > 0.8


def test_boosted_and_forest(fitted):
    _, _, train, rest, _ = fitted
    boosted = T.fit_boosted(train, rest.where("split = 'VAL'"), ENGINEERED, rounds=3, depth=3)
    forest = T.fit_forest(train, ENGINEERED, trees=5, depth=4)
    for m in (boosted, forest):
        assert labelled(m, rest).where("p BETWEEN 0 AND 1").count() == rest.count()
    importance = X.global_importance(boosted, rest).collect()
    assert [r["rank"] for r in importance] == list(range(1, len(ENGINEERED) + 1))
    for m, link in ((boosted, lambda x: 1 / (1 + np.exp(-2 * x))), (forest, lambda x: x)):
        parts = X.contributions(m, rest, ["transaction_id"]).toPandas().set_index("transaction_id").sort_index()
        want = labelled(m, rest).select("transaction_id", "p").toPandas().set_index("transaction_id").sort_index()
        assert len(parts) == rest.count()
        assert np.abs(link(parts.to_numpy().sum(axis=1) + X.node_table(m).base) - want["p"].to_numpy()).max() < 1e-9
        assert (parts.to_numpy() != 0).any(axis=0).sum() > 2
        texts = X.top_contributors(m, rest, top_n=3).first()["explanations"]
        assert len(texts) == 3 and all("risk, SHAP=" in t for t in texts)


def walked(table, row):
    """One row through every tree, node by node."""
    out = np.zeros(len(row))
    for at in table.roots.tolist():
        while table.left[at] >= 0:
            after = table.left[at] if row[table.feature[at]] <= table.threshold[at] else table.right[at]
            out[table.feature[at]] += table.value[after] - table.value[at]
            at = after
    return out


def test_tree_contributions_equal_a_walk_and_rows_that_share_an_id_stay(spark, fitted):
    features, encoder, train, rest, _ = fitted
    boosted = T.fit_boosted(train, rest.where("split = 'VAL'"), BASIC, rounds=3, depth=3)
    table = X.node_table(boosted)
    rows = rest.select("transaction_id", *BASIC).limit(300).withColumn("transaction_id", F.lit("same"))
    rows = rows.unionByName(rows.limit(5).withColumn("transaction_id", F.lit(None).cast("string")))
    found = X.attributed(boosted, rows).collect()
    assert len(found) == 305
    for r in found:
        assert np.allclose(r["_c"], walked(table, np.array([float(r[f]) for f in BASIC])))
    txns = L.strip_labels(transactions(spark, SMALL)).limit(200).withColumn("transaction_id", F.lit("same"))
    assert Scorer(boosted, encoder).score(txns, explain=True).where("size(explanations) = 5").count() == 200


def test_permutation_importance_equals_one_run_a_feature(spark, fitted, monkeypatch):
    *_, rest, model = fitted
    monkeypatch.setattr(X, "CELL_ROWS", 50)
    rows = rest.select("true_fraud_label", *BASIC)
    found = {r["feature"]: r["importance"] for r in X.permutation_importance(model, rows, "true_fraud_label").collect()}
    assert set(found) == set(BASIC)
    weights = dict(zip(BASIC, model.model.stages[-1].coefficients))
    unused = [f for f in BASIC if weights[f] == 0]
    assert all(abs(found[f]) < 1e-12 for f in unused) and max(found.values()) > 0
    # the same by hand for one feature: each row has the value of the next in its cell's order
    place = F.xxhash64(F.lit(42), *[F.col(c) for c in rows.columns])
    n = max(1, rows.count() // 50)
    best = max(found, key=found.get)
    ring = Window.partitionBy("_cell").orderBy("_place", "true_fraud_label")
    moved = rows.withColumn("_place", place).withColumn("_cell", F.pmod(F.xxhash64("_place"), F.lit(n)))
    moved = moved.withColumn(best, F.coalesce(F.lead(best).over(ring), F.first(best).over(ring)))

    def loss(df):
        p, y = F.least(F.greatest(F.col("q"), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col("true_fraud_label")
        return model.score(df, "q").agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).first()[0]

    assert found[best] == pytest.approx(loss(moved) - loss(rows), abs=1e-9)


def test_contributions_add_up_to_the_log_odds(fitted):
    *_, rest, model = fitted
    parts = X.contributions(model, rest, ["transaction_id"])
    total = sum((F.col(f) for f in BASIC), F.lit(float(model.model.stages[-1].intercept)))
    both = parts.select("transaction_id", (1 / (1 + F.exp(-total))).alias("q")).join(labelled(model, rest), "transaction_id")
    assert both.where("abs(p - q) > 1e-9").count() == 0
    texts = X.top_contributors(model, rest, top_n=3).first()["explanations"]
    assert len(texts) == 3 and all("risk, SHAP=" in t for t in texts)


def test_saved_model_is_checked_before_scoring(spark, fitted, tmp_path):
    *_, rest, model = fitted
    model.save(str(tmp_path / "m"))
    back = T.FittedModel.load(spark, str(tmp_path / "m"))
    assert back.features == model.features and back.digest == T.schema_hash(BASIC)
    with pytest.raises(T.IncompatibleModelError):
        back.verify(list(reversed(BASIC)))
    with pytest.raises(T.IncompatibleModelError):
        back.verify(BASIC[:-1])
    with pytest.raises(T.IncompatibleModelError):
        T.FittedModel("x", model.model, BASIC, digest="0" * 16).verify()
    with pytest.raises(T.IncompatibleModelError):
        back.score(rest.drop(BASIC[0]))


def test_saved_scorer_scores_the_same(spark, fitted, tmp_path):
    _, encoder, _, rest, model = fitted
    cal = C.Calibrator.fit(labelled(model, rest))
    for active in ("platt", "isotonic"):
        cal.active = active
        scorer = Scorer(model, encoder, cal, approve_below=0.2, block_from=0.8)
        scorer.save(str(tmp_path / active))
        back = Scorer.load(spark, str(tmp_path / active))
        assert back.bands == scorer.bands and back.calibrator.active == active and back.encoder.maps == encoder.maps
        rows = L.strip_labels(transactions(spark, SMALL)).limit(60)
        assert scorer.score(rows).exceptAll(back.score(rows)).count() == 0


def test_calibration_improves_and_is_monotone(spark):
    rows = S.assign_split(scored(spark, "/root/testdata/sf0.01"), JANUARY_2024)
    cal = C.Calibrator.fit(rows.where("split = 'VAL'"))
    quality = {r["method"]: r for r in cal.evaluate(rows.where("split = 'TEST'")).collect()}
    assert quality["platt"]["brier"] < quality["raw"]["brier"] and quality["isotonic"]["ece"] < quality["raw"]["ece"]
    assert cal.choose(cal.evaluate(rows.where("split = 'TEST'"))) in ("platt", "isotonic")
    grid = spark.range(-5, 106).select((F.col("id") / 100.0).alias("p"))
    for method in ("platt", "isotonic"):
        out = [r[0] for r in cal.transform(grid, method=method).orderBy("p").select("calibrated").collect()]
        assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1
    with pytest.raises(ValueError):
        cal.transform(grid, method="other")


def test_ece_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.1), (0, 0.05)], "y int, p double")
    row = C.score_quality(df, ["p"]).first()
    assert abs(row["ece"] - (0.05 / 4 + 0.9 / 4)) < 1e-12 and abs(row["brier"] - (0.81 + 0.0025) / 4) < 1e-12


def test_scoring_uses_history_and_refuses_labels(spark, fitted):
    _, encoder, train, _, _ = fitted
    scorer = Scorer(T.fit_logistic(train, ENGINEERED, max_iter=20), encoder)
    rows = S.assign_split(transactions(spark, SMALL), JANUARY_2024)
    clean = L.strip_labels(rows).drop("split", "subsplit")
    current = clean.where(F.col("event_timestamp") >= F.lit(JANUARY_2024.test_start))
    history = clean.where(F.col("event_timestamp") < F.lit(JANUARY_2024.test_start))
    warm, whole = scorer.score(current, history, explain=True), scorer.score(clean)
    joined = warm.alias("a").join(whole.alias("b"), "transaction_id")
    assert joined.count() == current.count()
    assert joined.where("abs(a.fraud_probability - b.fraud_probability) > 1e-9").count() == 0
    with pytest.raises(L.LeakageError):
        scorer.score(rows)


def test_whole_experiment(spark):
    plan = TrainingPlan(
        boosted_basic={"rounds": 2, "depth": 3}, boosted_engineered={"rounds": 3, "depth": 3}, forest={"trees": 4, "depth": 4},
        logistic={"max_iter": 20}, grid_steps=8, bootstraps=20,
    )
    out = run_experiments(transactions(spark, SMALL), JANUARY_2024, plan)
    assert out.experiments.count() == 4
    assert T.select_best(out.experiments).first()["model"] == out.scorer.model.name
    assert out.scorer.approve_below < out.scorer.block_from
    assert out.calibration.count() == 3 and out.intervals.count() == 8
    assert out.drift.count() == len(out.scorer.model.features)
    assert out.test_cost.first()["fraud_caught"] >= 0 and out.importance.first()["rank"] == 1


class Asked(Exception):
    """Raised in place of a fit, with what was asked for."""


def asked(spark, monkeypatch, learner, query):
    def fit(self, rows):
        raise Asked({p.name: v for p, v in self.extractParamMap().items()})

    monkeypatch.setattr(learner, "_fit", fit)
    with pytest.raises(Asked) as found:
        catalogue.QUERIES[query](spark, SMALL)
    return found.value.args[0]


def test_registered_forest_has_the_full_size(spark, monkeypatch):
    size = asked(spark, monkeypatch, T.RandomForestClassifier, "forest_scores")
    assert (size["numTrees"], size["maxDepth"]) == (500, 7)


@pytest.mark.parametrize("query", ["gbt_scores", "tree_contributors"])
def test_registered_boosted_trees_have_the_full_size(spark, monkeypatch, query):
    size = asked(spark, monkeypatch, T.GBTClassifier, query)
    assert (size["maxIter"], size["maxDepth"], size["stepSize"], size["featureSubsetStrategy"]) == (500, 7, 0.03, "0.7")
