from __future__ import annotations

import random
import re

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from packetloom.operators.models import train_base
from packetloom.operators.trees import TreeModel, fit_boosted, fit_extra_trees


def table(spark, rows):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "row_key int, x array<double>, y int")
    return df.select("row_key", array_to_vector("x").alias("features"), "y", F.lit(1.0).alias("weight"))


def steps(n=900, noise=0, seed=1):
    """Three classes by thresholds of two columns, and columns of noise."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rng.uniform(0, 100), rng.uniform(-5, 5)
        rows.append(([a, b, *(rng.uniform(0, 1) for _ in range(noise))], 0 if a < 30 else 1 if b < 1 else 2))
    return rows


def accuracy(model, df, k=3):
    p = model.probabilities(df, "features", "p").select("y", "p").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and len(r.p) == k for r in p)
    return sum(max(range(k), key=lambda c: r.p[c]) == r.y for r in p) / len(p)


def test_extra_trees_learn_thresholds_exactly(spark):
    df = table(spark, steps()).repartition(5).persist()
    model = fit_extra_trees(df, 3, trees=25, depth=14, per_node=2)
    assert accuracy(model, df) > 0.995
    again = fit_extra_trees(df.repartition(2, "y"), 3, trees=25, depth=14, per_node=2)
    assert [t.threshold for t in again.trees] == [t.threshold for t in model.trees]
    assert [t.value for t in again.trees] == [t.value for t in model.trees]
    assert fit_extra_trees(df, 3, seed=7, trees=1, depth=3).trees[0].threshold != model.trees[0].threshold[:7]
    df.unpersist()


def test_extra_trees_on_unseen_rows_beside_noise(spark):
    df, held = table(spark, steps(1500, noise=6)).persist(), table(spark, steps(500, noise=6, seed=2))
    extra = fit_extra_trees(df, 3, trees=40, depth=12)
    forest = train_base("random_forest", df, 3, numTrees=40, maxDepth=12)
    assert accuracy(extra, held) > 0.9 and accuracy(extra, held) >= accuracy(forest, held) - 0.05
    df.unpersist()


def test_boosting_fits_all_classes_at_once_and_its_loss_falls(spark):
    df = table(spark, steps()).repartition(4).persist()
    model = fit_boosted(df, 3, rounds=12, depth=3, rate=0.4, subsample=0.9)
    assert len(model.trees) == 36 and len(model.losses) == 13
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    assert accuracy(model, df) > 0.97
    again = fit_boosted(df.repartition(3, "y"), 3, rounds=2, depth=3, rate=0.4, subsample=0.9)
    assert [t.value for t in again.trees] == [t.value for t in model.trees[:6]]
    df.unpersist()


def test_a_round_takes_one_pass_per_level(spark, monkeypatch):
    from packetloom.operators import trees

    passes = []
    sums = trees._sums
    monkeypatch.setattr(trees, "_sums", lambda rows, add, size: passes.append(size) or sums(rows, add, size))
    fit_boosted(table(spark, steps(300)), 3, rounds=2, depth=4, subsample=1.0)
    assert len(passes) <= 2 * 4
    passes.clear()
    fit_extra_trees(table(spark, steps(300)), 3, trees=10, depth=5)
    assert len(passes) <= 5 + trees.TRIES - 1


def test_passes_read_plain_columns_kept_on_disk(spark, monkeypatch):
    from packetloom.operators import trees

    read = []
    sums = trees._sums
    monkeypatch.setattr(trees, "_sums", lambda rows, add, size: read.append(rows) or sums(rows, add, size))
    kept = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, level: kept.append(df) or persist(df, level))
    fit_extra_trees(table(spark, steps(200)), 3, trees=3, depth=3)
    assert read and all(dict(r.dtypes) == {"y": "int", "w": "double", "x0": "double", "x1": "double"} and r in kept for r in read)
    assert not any(r.storageLevel.useDisk for r in kept)


def test_predictions_of_all_folds_are_dealt_evenly(spark, monkeypatch):
    from packetloom.operators import models

    fitted = []
    fit = models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: fitted.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = table(spark, steps(120)).repartition(11).persist()
    params = {"extra_trees": {"numTrees": 2, "maxDepth": 2}, "meta_iter": 3}
    models.fit_stacking(df, ["extra_trees"], 3, ["row_key"], folds=2, params=params)
    assert fitted == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    df.unpersist()


def test_scores_are_those_of_a_walk_down_each_tree_and_stay_in_arrow(spark):
    x = [[a, b] for a in (-1.0, 30.0, float("nan"), 1e300) for b in (float("-inf"), 0.0, 1.0, float("nan"))]
    model = fit_extra_trees(table(spark, steps(300)), 3, trees=4, depth=6)

    def walk(tree, row):
        n = 0
        while tree.feature[n] >= 0:
            n = tree.below[n] if row[tree.feature[n]] <= tree.threshold[n] else tree.above[n]
        return tree.value[n]

    scored = model.probabilities(table(spark, [(row, 0) for row in x]).orderBy("row_key"), "features", "p")
    for row, r in zip(x, scored.collect(), strict=True):
        each = [walk(tree, row) for tree in model.trees]
        assert r.p == pytest.approx([sum(v[c] for v in each) / 4 for c in range(3)], abs=1e-12)
    # 250 is the scalar Arrow function, 200 the pandas one.
    assert re.search(r"ArrowEvalPython \[shares.*, 250", scored._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["gbt", "extra_trees"])
def test_models_survive_save_and_load(spark, tmp_path, name):
    df = table(spark, steps(200))
    model = train_base(name, df, 3, maxDepth=3, **({"maxIter": 2} if name == "gbt" else {"numTrees": 4})).models[0]
    model.save(str(tmp_path / name))
    loaded = TreeModel.load(str(tmp_path / name))
    assert loaded == model


def test_odd_tables(spark):
    same = table(spark, [([1.0, 2.0], i % 2) for i in range(20)])
    for model in (fit_extra_trees(same, 2, trees=3, depth=4), fit_boosted(same, 2, rounds=2, depth=2, subsample=1.0)):
        shares = [r.p for r in model.probabilities(same, "features", "p").collect()]
        assert all(abs(p[0] - 0.5) < 1e-6 for p in shares)
        assert model.probabilities(same.limit(0), "features", "p").count() == 0
