"""Feature contributions and importances (EXP1-2)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.operators.training import FittedModel
from riskflow.session import checkpoint_dir

#: Rows among which permutation importance exchanges values, about.
CELL_ROWS = 10_000


def is_linear(fitted: FittedModel) -> bool:
    return isinstance(fitted.model.stages[-1], LogisticRegressionModel)


@dataclass(frozen=True)
class NodeTable:
    """The nodes of all trees of a model, in arrays; a node's children are places in the same arrays, -1 for leaves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @property
    def base(self) -> float:
        """The margin before any split is known."""
        return float(self.value[self.roots].sum())

    def attribute(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x`` and feature: what the splits on that feature add to the margin along the row's paths."""
        out = np.zeros_like(x)
        rows = np.arange(len(x))
        for root in self.roots:
            here, at = rows, np.full(len(x), root)
            while len(here):
                inner = self.left[at] >= 0
                here, at = here[inner], at[inner]
                f = self.feature[at]
                after = np.where(x[here, f] <= self.threshold[at], self.left[at], self.right[at])
                out[here, f] += self.value[after] - self.value[at]
                at = after
        return out


def node_table(fitted: FittedModel) -> NodeTable:
    """Node values are the mean of the training rows a node covers: for boosted trees the weighted prediction, so that they add up to the
    margin (half the log-odds); for forests the share of positives over the number of trees, so that they add up to the probability.

    The table is read from the saved model; its size is the model's, not the data's.
    """
    model, spark = fitted.model.stages[-1], SparkSession.active()
    folder = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(folder)
    n = F.col("nodeData")
    share = n["impurityStats"][1] / F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, v: a + v)
    known = spark.read.parquet(f"{folder}/data").select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), F.size(n["split"]["leftCategoriesOrThreshold"]).alias("n_bounds"),
        n["split"]["numCategories"].alias("categories"), (share if is_forest(fitted) else n["prediction"]).alias("value"))
    nodes = known.orderBy("treeID", "id").toPandas()
    if (nodes["categories"] >= 0).any():
        raise ValueError("splits on categories are not explained")
    weights = np.array(model.treeWeights, dtype=np.float64) / (len(model.treeWeights) if is_forest(fitted) else 1)
    tree = nodes["treeID"].to_numpy()
    starts = np.searchsorted(tree, np.arange(len(weights)))
    number = {(t, i): at for at, (t, i) in enumerate(zip(tree.tolist(), nodes["id"].tolist()))}
    child = lambda name: np.array([number.get((t, i), -1) for t, i in zip(tree.tolist(), nodes[name].tolist())])
    return NodeTable(starts, nodes["feature"].to_numpy(), nodes["threshold"].fillna(0.0).to_numpy(), child("left"), child("right"), nodes["value"].to_numpy() * weights[tree])


def is_forest(fitted: FittedModel) -> bool:
    return isinstance(fitted.model.stages[-1], RandomForestClassificationModel)


def attributed(fitted: FittedModel, df: DataFrame, out: str = "_c") -> DataFrame:
    """``df`` with an array of additive contributions, one a feature in the model's order.

    Linear: coefficient times the standardised value, which adds up to the log-odds less the intercept. Trees: differences of node values along
    the row's paths, which add up to the margin less ``NodeTable.base``.
    """
    kept = [F.col(c) for c in df.columns if c != out]
    if is_linear(fitted):
        weights = F.array(*[F.lit(float(w)) for w in fitted.model.stages[-1].coefficients])
        scaled = PipelineModel(fitted.model.stages[:-1]).transform(df)
        return scaled.select(*kept, F.zip_with(vector_to_array("features"), weights, lambda z, w: z * w).alias(out))
    shared = SparkSession.active().sparkContext.broadcast(node_table(fitted))

    @F.pandas_udf("array<double>")
    def paths(x: pd.Series) -> pd.Series:
        found = shared.value.attribute(np.stack(x.to_numpy()).astype(np.float64)) if len(x) else np.zeros((0, 0))
        return pd.Series(list(found))

    return df.select(*kept, paths(F.array(*[F.col(f).cast("double") for f in fitted.features])).alias(out))


def contributions(fitted: FittedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and one column a feature: its additive contribution (``attributed``)."""
    found = attributed(fitted, df)
    return found.select(*keep, *[F.col("_c")[i].alias(f) for i, f in enumerate(fitted.features)])


def global_importance(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """EXP1: rows ``(feature, importance, rank)`` — the mean absolute contribution over all
    rows of ``df``, or the split importance of a tree model."""
    features = fitted.features
    if is_linear(fitted):
        per_row = contributions(fitted, df, [])
        table = per_row.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features]).unpivot([], features, "feature", "importance")
    else:
        values = fitted.model.stages[-1].featureImportances.toArray()
        table = df.sparkSession.createDataFrame(list(zip(features, map(float, values))), "feature string, importance double")
    return _ranked(table)


def _ranked(table: DataFrame) -> DataFrame:
    # One row per model feature; collected into one array and numbered there.
    listed = table.agg(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("k"), "feature", "importance"))).alias("l"))
    return listed.select(F.posexplode("l").alias("pos", "e")).select("e.feature", "e.importance", (F.col("pos") + 1).alias("rank"))


def contribution_text(name: Column, value: Column) -> Column:
    arrow = F.when(value > 0, "↑").otherwise("↓")
    return F.concat(name, F.lit(" ("), arrow, F.lit(" risk, SHAP="), F.format_string("%.4f", value), F.lit(")"))


def with_explanations(fitted: FittedModel, df: DataFrame, top_n: int = 5, out: str = "explanations") -> DataFrame:
    """EXP2, DEC9: ``df`` with the texts of each row's largest contributions, of linear models and of trees. No row is joined, dropped or repeated."""
    found = attributed(fitted, df)
    pairs = F.array(*[F.struct((-F.abs(F.col("_c")[i])).alias("k"), F.lit(f).alias("f"), F.col("_c")[i].alias("c")) for i, f in enumerate(fitted.features)])
    best = F.slice(F.array_sort(pairs), 1, top_n)
    return found.select(*[c for c in df.columns if c != out], F.transform(best, lambda x: contribution_text(x["f"], x["c"])).alias(out))


def top_contributors(fitted: FittedModel, df: DataFrame, row_id: str = "transaction_id", top_n: int = 5) -> DataFrame:
    """EXP2: per row the texts of its largest contributions."""
    return with_explanations(fitted, df.select(row_id, *fitted.features), top_n).select(row_id, "explanations")


def permutation_importance(fitted: FittedModel, df: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """EXP1: rows ``(feature, importance, rank)`` — how much the mean logarithmic loss grows when one feature's values change places between rows.

    All features in one job. Rows get a place in one shuffled order; each row takes, for every feature in turn, the value of the next row in that
    order, and all replicas are scored in one projection and added up at once. The next row of a cell's last row is the first row of the cell, so
    cells need no order among each other.
    """
    names = fitted.features
    place = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    # cells of a hash: small whatever the table's size, and equal rows, which change nothing when swapped, may share one
    cells = F.lit(max(1, df.count() // CELL_ROWS))
    rows = df.select(F.col(label).cast("double").alias("_y"), F.array(*[F.col(f).cast("double") for f in names]).alias("_x"), place.alias("_place"))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("_place"), cells))
    ring = Window.partitionBy("_cell").orderBy("_place", "_y")
    other = F.coalesce(F.lead("_x").over(ring), F.first("_x").over(ring))
    paired = rows.select("_y", "_x", other.alias("_other"))

    def replaced(i: int) -> Column:
        return F.transform("_x", lambda v, j: F.when(j == i, F.col("_other")[i]).otherwise(v))

    replicas = paired.select("_y", F.posexplode(F.array(F.col("_x"), *map(replaced, range(len(names))))).alias("_r", "_v"))
    scored = fitted.score(replicas.select("_y", "_r", *[F.col("_v")[i].alias(f) for i, f in enumerate(names)]), "_p")
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))
    losses = scored.groupBy("_r").agg(F.avg(loss).alias("loss"))
    # one row a replica: as many as the model has features
    listed = losses.agg(F.map_from_entries(F.collect_list(F.struct("_r", "loss"))).alias("m"))
    per_feature = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("m")[i + 1] - F.col("m")[0]).alias("importance")) for i, f in enumerate(names)])
    return _ranked(listed.select(F.explode(per_feature).alias("e")).select("e.*"))
