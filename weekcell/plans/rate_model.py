"""Poisson rates of an encoded design: fitted on folded rows, saved as a contract, compared and explained from sufficient statistics.

A design is a list of input columns: categories (one-hot, the last level being the reference) and measures (ln(1 + x), nulls as 0).
Rows with equal inputs share one rate, so counts and exposures are added before the fit: the likelihood stays the same, and the panel is
read once however many iterations or variants follow.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekcell.functions.predicates import drop_prefixed
from weekcell.plans.poisson import base_rate, offset
from weekcell.session import cut_lineage

#: Sums over rows of equal inputs that fits and deviances need.
STATISTICS = ["rows", "y", "exposure", "y_ln_y", "y_ln_exposure"]


def fold(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each distinct design: its number of rows and the sums of STATISTICS. Rows without exposure say nothing and are left out."""
    y, e = F.col("y").cast("double"), F.col("exposure").cast("double")
    return rows.where(F.col("exposure") > 0).groupBy(*columns).agg(
        F.count("*").alias("rows"), F.sum(y).alias("y"), F.sum(e).alias("exposure"),
        F.sum(F.when(y > 0, y * F.ln(y)).otherwise(0.0)).alias("y_ln_y"), F.sum(y * F.ln(e)).alias("y_ln_exposure"))


def deviance(log_rate: Column) -> Column:
    """Mean Poisson deviance over folded rows whose rate per unit of exposure is exp(``log_rate``)."""
    gap = (F.sum("y_ln_y") - F.sum("y_ln_exposure") - F.sum(F.col("y") * log_rate) - F.sum("y")
           + F.sum(F.col("exposure") * F.exp(log_rate)))
    return 2 * gap / F.sum("rows")


@dataclass
class RateModel:
    pipeline: PipelineModel
    rate: float
    categories: list[str]
    measures: list[str]
    schema: list[tuple[str, str]]  # input columns in order, with their types

    @property
    def columns(self) -> list[str]:
        return [*self.categories, *self.measures]

    @classmethod
    def fit(cls, folded: DataFrame, categories: list[str], measures: list[str], max_iter: int = 50, ridge: float = 0.0) -> "RateModel":
        """Fit folded rows; columns of them that are in neither list are summed over. They are read three times before the fit: bring a table.

        Designs are encoded once and written: every iteration reads vectors, and neither strings nor indexes.
        A category without a second level says nothing beyond the intercept and is refused by the encoder.
        """
        columns = [*categories, *measures]
        same = folded  # rows of one design need not be one row: the likelihood is the same
        if set(folded.columns) - set(columns) - set(STATISTICS):
            same = cut_lineage(folded.groupBy(*columns).agg(F.sum("y").alias("y"), F.sum("exposure").alias("exposure")))
        rate = base_rate(same)
        if columns:
            parts = [f"coalesce('=' || CAST(`{c}` AS STRING), 'null') AS `_s_{c}`" for c in categories] + [
                f"ln(1 + coalesce(CAST(`{c}` AS DOUBLE), 0)) AS `_m_{c}`" for c in measures]
            stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
            if categories:
                stages += [StringIndexer(inputCols=[f"_s_{c}" for c in categories], outputCols=[f"_i_{c}" for c in categories],
                                         stringOrderType="alphabetAsc", handleInvalid="error"),
                           OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories])]
            stages.append(VectorAssembler(inputCols=[f"_h_{c}" for c in categories] + [f"_m_{c}" for c in measures], outputCol="_x"))
        else:
            raise ValueError("a design has a column at least")
        encoder = Pipeline(stages=stages).fit(same)
        rows = cut_lineage(encoder.transform(same).select("_x", "y", offset(rate).alias("_offset")))
        model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol="y", offsetCol="_offset",
                                            linkPredictionCol="_eta", maxIter=max_iter, tol=1e-12, regParam=ridge).fit(rows)
        types = dict(folded.dtypes)
        return cls(PipelineModel(stages=[*encoder.stages, model]), rate, list(categories), list(measures), [(c, types[c]) for c in columns])

    # -- scores

    def check(self, rows: DataFrame) -> None:
        """Refuse rows whose input columns lack, differ in type, or stand in another order than those of the fit."""
        known = {c for c, _ in self.schema}
        got = [(c, t) for c, t in rows.dtypes if c in known]
        if got != self.schema:
            raise ValueError(f"this model takes {self.schema}, the table has {got}")

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``score``: the logarithm of their rate over the base rate."""
        self.check(rows)
        scored = self.pipeline.transform(rows.withColumn("_offset", F.lit(0.0)))
        return scored.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_eta").alias("score"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``mu``, the expected count over their exposure."""
        return self.expected(self.score(rows))

    def expected(self, scored: DataFrame) -> DataFrame:
        """Rows with ``score`` and exposure, with ``mu`` in place of the score. Rows may take the score of their design."""
        return scored.withColumn("mu", F.exp(F.col("score") + offset(self.rate))).drop("score")

    def log_rate(self) -> Column:
        """Logarithm of the rate of a row with ``score``."""
        return F.col("score") + F.ln(F.lit(self.rate))

    def contributions(self) -> dict[str, Column]:
        """What each input column adds to a row's score."""
        weights = iter(self.pipeline.stages[-1].coefficients.toArray().tolist())
        out = {}
        if self.categories:
            for c, labels in zip(self.categories, self.pipeline.stages[1].labelsArray):
                pairs = [x for level in labels[:-1] for x in (F.lit(level), F.lit(next(weights)))]
                level = F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
                out[c] = F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(0.0)) if pairs else F.lit(0.0)
        for c in self.measures:
            out[c] = F.ln(1 + F.coalesce(F.col(c).cast("double"), F.lit(0.0))) * next(weights)
        return out

    # -- contract

    def save(self, path: str) -> None:
        """The pipeline first, the contract last: a folder without a contract is no model."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        text = json.dumps({"rate": self.rate, "categories": self.categories, "measures": self.measures, "schema": self.schema})
        spark = SparkSession.getActiveSession()
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/contract")

    @classmethod
    def load(cls, path: str) -> "RateModel":
        said = json.loads(SparkSession.getActiveSession().read.text(f"{path}/contract", wholetext=True).first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), said["rate"], said["categories"], said["measures"],
                   [(c, t) for c, t in said["schema"]])


def balance(model: RateModel, folded: DataFrame) -> DataFrame:
    """(input, level, observed, fitted): counts by level of each category, and sums of count times measure.

    At the maximum of the likelihood both agree for every column of the design, and nowhere else.
    """
    scored = model.score(folded).withColumn("mu", F.col("exposure") * F.exp(model.log_rate()))
    terms = [F.struct(F.lit(c).alias("input"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("level"), F.lit(1.0).alias("x")) for c in model.categories]
    terms += [F.struct(F.lit(c).alias("input"), F.lit("").alias("level"), F.ln(1 + F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("x"))
              for c in model.measures]
    rows = scored.select("y", "mu", F.explode(F.array(*terms)).alias("t"))
    return rows.groupBy("t.input", "t.level").agg(F.sum(F.col("t.x") * F.col("y")).alias("observed"), F.sum(F.col("t.x") * F.col("mu")).alias("fitted"))


def ablation(train: DataFrame, valid: DataFrame, categories: list[str], measures: list[str], prefixes: tuple[str, ...]) -> dict[str, float]:
    """Deviances on ``valid`` of the whole design ("full") and of the one without the columns that begin with a prefix ("ablated").

    Both tables are folded by the whole design once; every variant is fitted and judged on their sums.
    """
    columns = [*categories, *measures]
    seen, asked = cut_lineage(fold(train, columns)), cut_lineage(fold(valid, columns))
    out = {}
    for name, kept in (("full", columns), ("ablated", drop_prefixed(columns, prefixes))):
        model = RateModel.fit(seen, [c for c in categories if c in kept], [c for c in measures if c in kept])
        out[name] = model.score(asked).agg(deviance(model.log_rate()).alias("d")).first()["d"]
    return out


def importance(model: RateModel, folded: DataFrame) -> DataFrame:
    """(feature, deviance_lost, share): by how much the deviance grows when a column's part of the score is replaced by its mean over exposure.

    The variants of a row are stacked in one array, so all columns are measured in one pass over the folded rows.
    """
    parts = model.contributions()
    scored = model.score(folded).select(*STATISTICS, F.col("score"), *[p.alias(f"_p{k}") for k, p in enumerate(parts.values())])
    means = scored.agg(*[(F.sum(F.col("exposure") * F.col(f"_p{k}")) / F.sum("exposure")).alias(f"_m{k}") for k in range(len(parts))]).first()
    variants = [F.struct(F.lit(None).cast("string").alias("feature"), F.col("score").alias("score"))]
    variants += [F.struct(F.lit(c).alias("feature"), (F.col("score") - F.col(f"_p{k}") + F.lit(float(means[k]))).alias("score"))
                 for k, c in enumerate(parts)]
    stacked = scored.select(*STATISTICS, F.explode(F.array(*variants)).alias("v")).select(*STATISTICS, "v.feature", "v.score")
    by = stacked.groupBy("feature").agg(deviance(model.log_rate()).alias("d"))
    whole = by.where(F.col("feature").isNull()).select("d")
    lost = by.where(F.col("feature").isNotNull()).select("feature", (F.col("d") - whole.scalar()).alias("deviance_lost"))
    total = lost.agg(F.sum(F.greatest("deviance_lost", F.lit(0.0))).alias("t"))
    return lost.withColumn("share", F.try_divide(F.greatest("deviance_lost", F.lit(0.0)), total.scalar()))
