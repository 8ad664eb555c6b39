"""The models over all rows that the queries say."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrank.operators import linear, numbering, pairwise, together
from skeinrank.plans import queries
from skeinrank.schemas import FEATURES

DIR = "/root/testdata/sf0.001"


def test_fit_together_is_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, (300, 2))
    rows = [(float(a), float(b), 1 if a - b + e > 0 else -1, i % 3) for i, ((a, b), e) in enumerate(zip(x, rng.normal(0, 1, 300), strict=True))]
    table = spark.createDataFrame(rows, "a double, b double, Y int, fold int").cache()
    jobs = [(1.0, 0), (1.5, 2), (2.0, None)]
    for (penalty, left), got in zip(jobs, linear.fit_together(table, ["a", "b"], jobs, epochs=12), strict=True):
        want = linear.LogisticModel(penalty).fit(table if left is None else table.where(f"fold <> {left}"), ["a", "b"], epochs=12)
        assert np.allclose([*got.weights, got.bias, *got.losses], [*want.weights, want.bias, *want.losses])


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables here")
def test_queries_take_all_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(linear, "grid_search", lambda df, columns, key, penalties, folds=5, **k: seen.update(n=df.count(), columns=columns, penalties=penalties, folds=folds, **k) or (1.0, [(1.0, 1.0)]))
    queries.cv_argmax(spark, DIR)
    assert seen == {"n": pairwise.pairs(queries._judged(spark, DIR)).count(), "columns": list(FEATURES), "penalties": [1.0, 1.25, 1.5, 1.75, 2.0, 2.25], "folds": 5, "epochs": 100}
    monkeypatch.setattr(queries.residual, "fit", lambda df, held, *a, **k: seen.update(fit=df.count(), held=held.count()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.neural_eval(spark, DIR)
    assert seen["fit"] + seen["held"] > 0.7 * queries._scaled(spark, DIR).count()


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables here")
def test_neural_rows_are_made_once(spark, monkeypatch):
    """the quantiles, which go through the rows a dozen times, read rows that are written with their folds, all of them."""
    seen = {}
    monkeypatch.setattr(queries.scaling, "robust_fit", lambda df, columns: seen.update(files=df.inputFiles(), n=df.count()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.neural_eval(spark, DIR)
    assert not any("lineitem" in f for f in seen["files"])
    assert seen["n"] == queries._numbers(spark, DIR).where("pmod(xxhash64(rid), 5) > 1").count()


def test_grid_search_is_fit_of_folds(spark):
    """The folds are the runs of the keys' order, and every accuracy is that of a model of its own; a constant column and
    labels beside 1 and -1 (never right) as well. With equal keys the folds are as even."""
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, (203, 2))
    rows = [(float(a), float(b), 0.1, (1 if a - b + e > 0 else -1) if i % 50 else 0, f"{i * 7919 % 65521:04x}") for i, ((a, b), e) in enumerate(zip(x, rng.normal(0, 2, 203), strict=True))]
    table = spark.createDataFrame(rows, "a double, b double, c double, Y int, o string").repartition(3).cache()
    starts = numbering.cuts(table, "o", 5)
    keys = sorted(r[4] for r in rows)
    assert starts == [keys[i] for i in (40, 80, 120, 160)] == numbering.cuts(table, "o", 5, few=1)
    best, means = linear.grid_search(table, ["a", "b", "c"], "o", [0.01, 1.0], 5, epochs=8)
    placed = linear.with_folds(table, "o", 5).cache()
    for penalty, mean in means:
        want = []
        for fold in range(5):
            model = linear.LogisticModel(penalty).fit(placed.where(F.col("fold") != fold), ["a", "b", "c"], epochs=8)
            want.append(placed.where(F.col("fold") == fold).agg(F.avg(F.when(model.predicted() == F.col("Y"), 100.0).otherwise(0.0))).first()[0])
        assert mean == pytest.approx(sum(want) / 5)
    assert best == max(means, key=lambda m: m[1])[0]
    tied = table.withColumn("o", F.substring("o", 1, 1))
    assert numbering.cuts(tied, "o", 5) is None and len(linear.grid_search(tied, ["a", "b", "c"], "o", [1.0], 5, epochs=1)[1]) == 1
    assert numbering.cuts(table.limit(1), "o", 5) == [] == numbering.cuts(table.where("false"), "o", 5)


def test_packed_rows_hold_what_varies(spark):
    """A pass reads a block of doubles for many rows, without the columns that are constant."""
    table = spark.range(10_000).select(F.col("id").cast("double").alias("a"), F.lit(7.0).alias("b"), F.lit(0.1).alias("c"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("Y")).coalesce(1)
    rows = linear.packed(table, ["a", "b", "c"], "Y", F.lit(-1))
    got = rows.data.select("n", F.length("data").alias("bytes")).collect()
    assert rows.varying == [0] and sum(r.n for r in got) == 10_000 and len(got) == 3 and all(r.bytes == 16 * r.n for r in got)


@pytest.mark.parametrize("at_once", [True, False])
def test_one_job_or_many(spark, monkeypatch, at_once):
    """Tasks that hold their rows, in memory or in a file, and meet in each epoch come to what a job for each epoch does."""
    if not at_once:
        monkeypatch.setattr(linear.together, "slots", lambda spark: 0)
    monkeypatch.setattr(linear, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), 1 if a > b else -1, i % 3) for i, (a, b) in enumerate(rng.normal(5, 2, (300, 2)))]
    table = spark.createDataFrame(rows, "a double, b double, Y int, fold int").repartition(6)
    began = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    models = linear.fit_together(table, ["a", "b"], [(1.0, None), (0.5, 1)], epochs=20)
    assert (len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(began) < 12) == at_once
    want = linear.LogisticModel(0.5).fit(table.where("fold <> 1"), ["a", "b"], epochs=20)
    assert np.allclose([*models[1].weights, models[1].bias, *models[1].losses], [*want.weights, want.bias, *want.losses])


def test_held_blocks(monkeypatch):
    monkeypatch.setattr(together, "HELD", 10)
    blocks = [(i, True, 1, bytes([i]) * 8) for i in range(4)]
    held = together.Held(blocks)
    assert held.file and len(held.near) == 1 and list(held) == blocks == list(held)
