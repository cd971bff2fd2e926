"""Fits over a grid of pools and folds: purged, with early stop, and none done twice."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.publish import create_if_absent, publish, read_text
from tidemark.operators.sinks import path_exists

#: Rows below which a fold is not fitted.
LEAST_TRAIN, LEAST_VALID = 500, 100


class TooFewRows(ValueError):
    """A fold whose training or validation part cannot carry a fit."""


@dataclass(frozen=True)
class Fold:
    """Training from ``train`` to ``valid``, validation to ``test``, test to ``end``; days as ISO text, ends excluded."""

    name: str
    train: str
    valid: str
    test: str
    end: str

    def part(self) -> Column:
        """Which part a row belongs to, else NULL: a label must end before the next part begins, except in the test."""
        day, ends = F.col("trade_date"), F.col("label_end")
        at = lambda x: F.lit(x).cast("date")
        inside = lambda a, b: (day >= at(a)) & (day < at(b))
        return F.when(inside(self.train, self.valid) & (ends < at(self.valid)), "train").when(inside(self.valid, self.test) & (ends < at(self.test)), "valid").when(inside(self.test, self.end), "test")


Fit = Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], dict]]


def lasso(strength: float) -> Fit:
    """A lasso on the training rows: minimises half the mean square error and ``strength`` times the coefficients' sizes."""

    def fit(rows: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], dict]:
        model = LinearRegression(elasticNetParam=1.0, regParam=strength, fitIntercept=False, standardization=False, tol=1e-10, maxIter=500).fit(rows.where("part = 'train'"))
        return model.transform, {"coefficients": [float(c) for c in model.coefficients]}

    return fit


def trees(most: int = 20, depth: int = 3, step: float = 0.2, tolerance: float = 0.001, seed: int = 7) -> Fit:
    """Boosted trees that stop when the validation rows gain less than ``tolerance`` from another tree."""

    def fit(rows: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], dict]:
        learner = GBTRegressor(maxIter=most, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="held", validationTol=tolerance)
        model = learner.fit(rows.where("part in ('train', 'valid')").withColumn("held", F.col("part") == "valid"))
        return model.transform, {"trees": model.getNumTrees}

    return fit


def fit_grid(data: DataFrame, pools: list[str], folds: list[Fold], models: dict[str, Fit], root: str, plan: dict, least: tuple[int, int] = (LEAST_TRAIN, LEAST_VALID)) -> tuple[DataFrame, list[dict], int]:
    """Predictions of all models for the test rows of each pool and fold, the receipts, and how many fits were made.

    ``data`` has ``pool, symbol, trade_date, label_end, label, features``. What
    a pool and fold gave stands under ``root``: its predictions, then its
    receipt, each published in one step. A run that finds both under the same
    plan reads them and fits nothing; another plan has receipts of its own. A
    fold with too few rows raises ``TooFewRows`` before anything is fitted.
    """
    spark, digest = data.sparkSession, sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()[:16]
    receipts, made, found = [], 0, []
    for pool in pools:
        for fold in folds:
            place = f"{root}/{digest}/{pool}-{fold.name}"
            if not path_exists(spark, f"{place}/receipt.json"):
                rows = data.where(F.col("pool") == pool).withColumn("part", fold.part()).where("part is not null")
                counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
                if counts.get("train", 0) < least[0] or counts.get("valid", 0) < least[1]:
                    raise TooFewRows(f"{pool}, {fold.name}: {counts}")
                test, out, notes = rows.where("part = 'test'").select("pool", "symbol", "trade_date", "label", "features"), None, {}
                for name, fit in models.items():
                    score, notes[name] = fit(rows)
                    made += 1
                    one = score(test).select("pool", F.lit(fold.name).alias("fold"), "symbol", "trade_date", "label", F.lit(name).alias("model"), "prediction")
                    out = one if out is None else out.unionByName(one)
                publish(out, f"{place}/predictions")
                create_if_absent(spark, f"{place}/receipt.json", json.dumps({"pool": pool, "fold": fold.name, "plan": digest, "rows": counts, "notes": notes}))
            receipts.append(json.loads(read_text(spark, f"{place}/receipt.json")))
            found.append(f"{place}/predictions")
    return spark.read.parquet(*found), receipts, made
