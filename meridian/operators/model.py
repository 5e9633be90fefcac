"""A walk-forward model factor: gradient-boosted trees trained on past years, with an embargo before the test year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.xs import rank_pct, winsorize_mad, zscore

EMBARGO, TRAIN_YEARS = 10, 3


def walk_forward(features: dict[str, DataFrame], label: DataFrame, train_years: int = TRAIN_YEARS, embargo_days: int = EMBARGO, seed: int = 7, min_days: int = 300, min_rows: int = 50_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """``di, date, code, value``: predictions of each year by a model of the ``train_years`` before it, less their last ``embargo_days`` days.

    Features are winsorised and standardised by day, the label is its percentile rank. A year without enough days or rows before it gets no predictions.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = sorted(features)
    parts = []
    for name in names:
        part = winsorize_mad(features[name].withColumnRenamed("value", name), name)
        parts.append(part.select("di", "date", "code", zscore(F.col(name)).alias(name)))
    cells = reduce(lambda a, b: a.join(b, ["di", "date", "code"]), parts).dropna(subset=names)
    y = label.select("di", "code", rank_pct(F.col("value")).alias("label"))
    cells = VectorAssembler(inputCols=names, outputCol="__features").transform(cells.join(y, ["di", "code"], "left")).select("di", "date", "code", "__features", "label", F.year("date").alias("year")).persist()
    days = label.select("di", F.year("date").alias("year")).distinct().collect()
    out = []
    for year in sorted({d["year"] for d in days}):
        past = sorted(d["di"] for d in days if year - train_years <= d["year"] < year)
        past = past[:-embargo_days] if len(past) > embargo_days else past
        if len(past) < min_days:
            continue
        train = cells.where((F.col("di") >= past[0]) & (F.col("di") <= past[-1]) & F.col("label").isNotNull())
        if train.count() < min_rows:
            continue
        model = GBTRegressor(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed).fit(train)
        out.append(model.transform(cells.where(F.col("year") == year)).select("di", "date", "code", F.col("prediction").alias("value")))
    return reduce(DataFrame.unionByName, out) if out else cells.limit(0).select("di", "date", "code", F.lit(None).cast("double").alias("value"))
