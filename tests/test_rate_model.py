"""M6-M10: the encoded Poisson model, its contract, ablation and importance, against closed forms and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcell.plans import poisson, rate_model
from weekcell.plans.rate_model import RateModel


def drawn(spark, seed=1, size=3000):
    draw = np.random.default_rng(seed)
    zone, hour = draw.integers(0, 3, size), draw.integers(0, 4, size)
    x, e = draw.exponential(2.0, size), draw.integers(0, 6, size)
    y = draw.poisson(e * np.exp(-2.5 + np.array([0, 0.8, -0.5])[zone] + 0.3 * hour + 0.4 * np.log1p(x)))
    data = [(None if z == 2 else f"z{z}", int(h), float(v), int(a), int(b)) for z, h, v, a, b in zip(zone, hour, x, y, e)]
    return spark.createDataFrame(data, "zone string, hour int, size double, y int, exposure int")


def newton(rows):
    """Rates by Newton steps on the rows themselves, with zone, hour and ln(1 + size) as columns."""
    rows = [r for r in rows if r.exposure]
    zones, hours = ["z0", "z1", ""], sorted({str(r.hour) for r in rows})
    x = np.array([[1.0, *[float((r.zone or "") == z) for z in zones[:-1]], *[float(str(r.hour) == h) for h in hours[:-1]], np.log1p(r["size"] or 0)] for r in rows])
    y, e = np.array([r.y for r in rows], float), np.array([r.exposure for r in rows], float)
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.sum() / e.sum())
    for _ in range(40):
        mu = e * np.exp(x @ beta)
        beta += np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
    return {(r.zone, r.hour, r["size"]): v for r, v in zip(rows, np.exp(x @ beta))}, beta


def test_M6_fit_equals_newton_on_all_rows(spark):
    df = drawn(spark)
    folded = rate_model.fold(df, ["zone", "hour", "size"])
    model = RateModel.fit(folded, ["zone", "hour"], ["size"])
    want, _ = newton(df.collect())
    for r in model.score(folded).withColumn("rate", F.exp(model.log_rate())).collect():
        assert r.rate == pytest.approx(want[r.zone, r.hour, r["size"]], rel=1e-7)
    for r in rate_model.balance(model, folded).collect():
        assert r.fitted == pytest.approx(r.observed, rel=1e-8)


def test_M6_folding_changes_nothing(spark):
    """Deviance of folded rows equals that of the rows; rows without exposure take no part."""
    df = drawn(spark, 2, 500)
    folded = rate_model.fold(df, ["hour"])
    assert folded.agg(F.sum("rows")).first()[0] == df.where("exposure > 0").count()
    model = RateModel.fit(folded, ["hour"], [])
    by_fold = model.score(folded).agg(rate_model.deviance(model.log_rate())).first()[0]
    rows = df.where("exposure > 0")
    assert by_fold == pytest.approx(poisson.deviance_of(model.predict(rows)), rel=1e-10)
    for r in folded.join(model.score(folded).select("hour", F.exp(model.log_rate()).alias("rate")), "hour").collect():
        assert r.rate == pytest.approx(r.y / r.exposure, rel=1e-8)


def test_M6_no_design_and_unknown_levels(spark):
    df = drawn(spark, 3, 300)
    with pytest.raises(ValueError):
        RateModel.fit(rate_model.fold(df, []), [], [])
    model = RateModel.fit(rate_model.fold(df, ["zone"]), ["zone"], [])
    with pytest.raises(Exception, match="(?i)unseen label"):
        model.predict(df.limit(1).withColumn("zone", F.lit("elsewhere"))).collect()


def test_M8_contract(spark, tmp_path):
    df = drawn(spark, 4, 600).where("exposure > 0")
    folded = rate_model.fold(df, ["zone", "size"])
    model = RateModel.fit(folded, ["zone"], ["size"])
    model.save(str(tmp_path / "m"))
    again = RateModel.load(str(tmp_path / "m"))
    assert (again.rate, again.schema, again.columns) == (model.rate, [("zone", "string"), ("size", "double")], ["zone", "size"])
    keys = ["zone", "size", "exposure"]
    assert sorted(map(str, again.predict(df.select(*keys)).collect())) == sorted(map(str, model.predict(df.select(*keys)).collect()))
    for refused in (df.select("size", "zone", "exposure"), df.select("zone", "exposure"), df.select("zone", F.col("size").cast("int"), "exposure")):
        with pytest.raises(ValueError, match="this model takes"):
            again.predict(refused)
    other = df.select("exposure", "zone", F.lit(1).alias("more"), "size")  # other columns may stand between
    assert again.predict(other).columns == ["exposure", "zone", "more", "size", "mu"]
    (tmp_path / "m" / "pipeline").rename(tmp_path / "alone")
    with pytest.raises(Exception):
        RateModel.load(str(tmp_path / "alone"))


def test_M9_variants_share_their_sums(spark):
    train, valid = drawn(spark, 5).withColumnRenamed("size", "lots_size"), drawn(spark, 6, 900).withColumnRenamed("size", "lots_size")
    got = rate_model.ablation(train, valid, ["zone", "hour"], ["lots_size"], ("lots_",))
    judged = valid.where("exposure > 0")
    for name, measures in (("full", ["lots_size"]), ("ablated", [])):
        model = RateModel.fit(rate_model.fold(train, ["zone", "hour", *measures]), ["zone", "hour"], measures)
        assert got[name] == pytest.approx(poisson.deviance_of(model.predict(judged)), rel=1e-8)
    assert got["full"] < got["ablated"]
    assert poisson.choose_model({**got, "baseline": 9.0}, ablated="ablated") == {"chosen_variant": "full", "ships": "model"}


def test_M10_importance_against_rows(spark):
    df = drawn(spark, 7)
    folded = rate_model.fold(df, ["zone", "hour", "size"])
    model = RateModel.fit(folded, ["zone", "hour"], ["size"])
    rows = [r for r in df.collect() if r.exposure]
    _, beta = newton(rows)
    e, y = np.array([r.exposure for r in rows], float), np.array([r.y for r in rows], float)
    part = {"zone": np.array([beta[1] * (r.zone == "z0") + beta[2] * (r.zone == "z1") for r in rows]),
            "hour": np.array([beta[3 + r.hour] if r.hour < 3 else 0.0 for r in rows]), "size": np.array([beta[6] * np.log1p(r["size"]) for r in rows])}
    eta = beta[0] + sum(part.values())

    def dev(eta):
        mu = e * np.exp(eta)
        return np.mean(2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)))
    want = {c: dev(eta - p + np.sum(e * p) / e.sum()) - dev(eta) for c, p in part.items()}
    got = {r.feature: r for r in rate_model.importance(model, folded).collect()}
    for c in want:
        assert got[c].deviance_lost == pytest.approx(want[c], rel=1e-6, abs=1e-9)
        assert got[c].share == pytest.approx(want[c] / sum(want.values()), rel=1e-6)


def test_M6_glm_iterations_read_encoded_rows(spark, monkeypatch):
    read = []
    fit = rate_model.GeneralizedLinearRegression.fit
    monkeypatch.setattr(rate_model.GeneralizedLinearRegression, "fit", lambda self, df: read.append(df) or fit(self, df))
    rows_ = spark.range(0, 400).selectExpr("concat('h', id % 3) AS hour", "id % 5 AS size", "id % 4 AS y", "4 AS exposure")
    folded = rate_model.fold(rows_, ["hour", "size"])
    once = rate_model.RateModel.fit(folded, ["hour"], ["size"])
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert read[0].columns == ["_x", "y", "_offset"] and "UDF" not in plan and "Aggregate" not in plan
    twice = rate_model.RateModel.fit(folded.unionByName(folded), ["hour"], ["size"])  # a design need not be one row
    assert twice.pipeline.stages[-1].coefficients.toArray().tolist() == pytest.approx(once.pipeline.stages[-1].coefficients.toArray().tolist(), abs=1e-9)


def test_M7_scores_slots_and_writes_no_dense_panel(spark, folder):
    from weekcell.catalog import load_catalog, stages
    from weekcell.catalog.registry import QUERIES
    load_catalog()
    stages._WRITTEN.clear()
    assert QUERIES["M7_expected_counts"](spark, folder).where("mu > 0").count() > 0
    assert {name for _, _, name in stages._WRITTEN}.isdisjoint({"model_panel", "panel"})


def test_M6_boosted_tasks_are_sized_by_rows(spark, folder, monkeypatch):
    from weekcell.catalog import models
    whole = sum(models.boosted_rows(spark, folder, "validate").rdd.glom().map(len).collect())
    monkeypatch.setattr(poisson, "ROWS_OF_A_TASK", 2_000)
    parts = models.boosted_rows(spark, folder, "validate").rdd.glom().map(len).collect()
    assert sum(parts) == whole == models.split(models.model_panel(spark, folder), "validate").count()
    assert len(parts) == -(-whole // 2_000) > 1


def test_M6_boosted_rounds_work_on_designs(spark, monkeypatch):
    """Rows of equal bins are one row of the trainer; the deviance of a round is that of the rows, and months may come added up."""
    rows_ = spark.range(0, 6_000).selectExpr("concat('c', id % 50) AS cell", "id % 50 * 1.0 AS f", "cast(id % 3 AS double) AS g", "cast(id div 50 % 4 AS int) AS hour_of_week",
                                             "cast((id % 50) * (id % 7) % 11 > 6 AS int) AS y", "4 + cast(id % 2 AS int) AS exposure")
    params = {"learning_rate": 0.5, "max_depth": 2, "min_rows_in_leaf": 100, "feature_fraction": 1.0, "bagging_fraction": 1.0, "lambda_l2": 1.0, "max_bin": 20}
    read = []
    fit = poisson.RandomForestRegressor.fit
    monkeypatch.setattr(poisson.RandomForestRegressor, "fit", lambda self, df: read.append(df.count()) or fit(self, df))
    model = poisson.train_boosted(rows_, rows_, ["f", "g"], params, rounds=3, early_stop=3)
    assert max(read) <= 20 * 3 and all(len(e) <= 20 for e in model.edges) and model.edges[1] == [0.0, 1.0, 2.0]
    assert poisson.deviance_of(model.predict(rows_)) == pytest.approx(model.log[len(model.trees) - 1], rel=1e-9)
    slots = rows_.groupBy("cell", "f", "g", "hour_of_week").agg(F.sum("y").alias("y"), F.sum("exposure").alias("exposure"), F.count("*").alias("rows"))
    monkeypatch.setattr(poisson, "bin_edges", lambda rows, feature, most: model.edges[["f", "g"].index(feature)])  # quantiles of slots are those of slots
    assert poisson.train_boosted(slots, rows_, ["f", "g"], params, rounds=3, early_stop=3).log == pytest.approx(model.log, rel=1e-9)


def test_M6_boosted_query_boosts_to_the_end(spark, folder, monkeypatch):
    """Rounds and early stop are the operator's own, whatever the query sets besides."""
    import inspect
    from weekcell.catalog import load_catalog
    from weekcell.catalog.registry import QUERIES
    load_catalog()
    signature, asked = inspect.signature(poisson.train_boosted), []

    def train(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append((bound.arguments["rounds"], bound.arguments["early_stop"]))
        raise InterruptedError
    monkeypatch.setattr(poisson, "train_boosted", train)
    with pytest.raises(InterruptedError):
        QUERIES["M6_poisson_boosted"](spark, folder)
    assert asked == [(poisson.ROUNDS, poisson.EARLY_STOP)] == [(3000, 100)]
