"""Model features of pairs, and scorers: a logistic one as a Column, tree ensembles behind an interface."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, NUMERIC_FEATURES

DEFAULT_THRESHOLD = 0.5


def threshold(metrics: str | Path | None, default: float = DEFAULT_THRESHOLD) -> float:
    """`best_threshold` of a metrics file on the driver, the default if there is no file or no such entry."""
    if metrics is None or not Path(metrics).exists():
        return default
    return float(json.loads(Path(metrics).read_text(encoding="utf-8")).get("best_threshold", default))


def read_features(path: str | Path | None) -> list[str]:
    """The names that a model was fitted on, in its order, from a JSON list on the driver; those of FEATURES without a file."""
    return list(FEATURES) if path is None else [str(c) for c in json.loads(Path(path).read_text(encoding="utf-8"))]


#: Columns that make flags: a feature is the column's name, an underscore and a value; MISSING stands for none.
CATEGORIES = ("left_class_name", "right_class_name", "class_pair", "column_relation")
MISSING = "__missing__"


def feature(name: str, have: list[str]) -> Column:
    """A model feature of any model by its name. Infinite, missing and absent numbers are 0, as is a feature of an unknown kind.

    A source's flag says that the sources' names contain its name, so a longer name sets a shorter one's flag too.
    """
    if name in NUMERIC_FEATURES:
        if name not in have:
            return F.lit(0.0)
        value = F.col(name).cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
    if name.startswith("source__"):
        sources = F.coalesce("candidate_sources", F.lit("")) if "candidate_sources" in have else F.lit("")
        return F.contains(sources, F.lit(name.removeprefix("source__"))).cast("int")
    for column in CATEGORIES:
        if name.startswith(f"{column}_"):
            value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING)) if column in have else F.lit(MISSING)
            return (value == name[len(column) + 1 :]).cast("int")
    return F.lit(0)


def feature_matrix(pairs: DataFrame, keep: tuple[str, ...] = ("pair_id",), names: list[str] = FEATURES) -> DataFrame:
    return pairs.select(*keep, *(feature(c, pairs.columns).alias(c) for c in names))


#: Default weights: nearness in the page and in reading order speak for one article, text overlap too.
BIAS = 1.0
WEIGHTS = {
    "source__same_column_window": 1.4,
    "column_relation_cross_column": -1.2,
    "x_overlap_ratio": 0.9,
    "vertical_gap_norm": -22.0,
    "abs_center_dx_norm": -3.0,
    "reading_order_delta": -0.15,
    "class_pair_Text__Text": 0.3,
    "class_pair_Section-header__Text": 0.6,
    "left_class_name_Picture": -0.4,
    "right_class_name_Picture": -0.4,
    "ocr_cosine_similarity": 2.0,
    "text_similarity": 1.0,
    "entity_overlap": 1.5,
    "shared_keywords": 0.2,
}


def logistic(have: list[str], weights: dict[str, float] = WEIGHTS, bias: float = BIAS) -> Column:
    """Probability that a pair is of one article, inside the plan."""
    z = F.lit(bias)
    for name, weight in weights.items():
        z = z + feature(name, have).cast("double") * F.lit(weight)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


class Scorer(Protocol):
    """Features in the order of its names, or of FEATURES if it has none -> probabilities. It is sent to the executors, so it must be picklable."""

    def __call__(self, features: np.ndarray) -> np.ndarray: ...


def names_of(scorer: Scorer) -> list[str]:
    return list(getattr(scorer, "names", None) or FEATURES)


class Trees:
    """A boosted tree ensemble from the booster's JSON model: features below a split's value go left, missing ones by its default."""

    def __init__(self, model: dict, names: list[str] | None = None):
        """names: of the features, if the model itself has none."""
        learner = model["learner"]
        self.names = list(learner.get("feature_names") or names or FEATURES)
        base = float(str(learner["learner_model_param"].get("base_score", 0.5)).strip("[]"))
        self.base = float(np.log(base / (1 - base)))
        self.trees = [
            tuple(np.array(t[k]) for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")) for t in learner["gradient_booster"]["model"]["trees"]
        ]

    @classmethod
    def read(cls, path: str | Path, features: str | Path | None = None) -> Trees:
        """From the model's file and that of its features' names, both on the driver."""
        return cls(json.loads(Path(path).read_text(encoding="utf-8")), None if features is None else read_features(features))

    def __call__(self, features: np.ndarray) -> np.ndarray:
        x = features.astype(np.float32)
        total = np.full(len(x), self.base, np.float32)
        for left, right, split, value, default in self.trees:
            node = np.zeros(len(x), int)
            while (inner := left[node] >= 0).any():
                own = x[np.arange(len(x)), split[node]]
                goes_left = np.where(np.isnan(own), default[node].astype(bool), own < value[node].astype(np.float32))
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += value[node].astype(np.float32)
        return 1 / (1 + np.exp(-total))


def score(pairs: DataFrame, scorer: Scorer | None = None, cut: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds probability_same_article, prediction and prediction_threshold, for no pairs too. Without a scorer the logistic one is used."""
    if scorer is None:
        scored = pairs.withColumn("probability_same_article", logistic(pairs.columns))
    else:
        names = names_of(scorer)
        made = feature_matrix(pairs, ("pair_id",), names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"pair_id": batch["pair_id"], "probability_same_article": scorer(batch[names].to_numpy(float)).astype(float)})

        scored = pairs.join(made.mapInPandas(run, "pair_id string, probability_same_article double"), "pair_id")
    prediction = F.coalesce(F.col("probability_same_article") >= cut, F.lit(False)).cast("int")
    return scored.withColumns({"prediction": prediction, "prediction_threshold": F.lit(float(cut))})


def classifier_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: counts of the confusion matrix, accuracy, precision, recall and F1."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in (("tn", ~y & ~p), ("fp", ~y & p), ("fn", y & ~p), ("tp", y & p))))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tn", "fp", "fn", "tp", total.alias("rows"), over(F.col("tn") + tp, total).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1")
    )
