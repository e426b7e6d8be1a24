"""Training, scoring and storing of ensembles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.operators.models import Ensemble, train_pipeline
from packetloom.streaming import model_versions

PARAMS = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "gbt": {"maxIter": 3, "maxDepth": 3}, "meta_iter": 10}


@pytest.fixture(scope="module")
def rows(spark):
    """One split on ``size`` separates the classes; the other columns are noise with gaps."""
    return spark.range(600).selectExpr(
        "id", "if(id % 3 = 0, 5.0, 50.0) + id % 4 AS size", "if(id % 7 = 0, NULL, cast(id % 5 AS STRING)) AS noise",
        "if(id % 11 = 0, NULL, concat('k', id % 4)) AS kind", "cast(timestamp_seconds(1700000000 + id) AS STRING) AS seen_time",
        "if(id % 3 = 0, 10, 20) AS code", "if(id % 3 = 0, 'quiet', 'loud') AS label",
    )


COLUMNS = ["size", "noise", "kind", "seen_time"]


@pytest.mark.parametrize("label", ["code", "label"])
@pytest.mark.parametrize("models", ["rf", "gbt"])
def test_separable_classes_are_learned_whatever_the_label(rows, label, models):
    model = train_pipeline(rows, label, ["id"], COLUMNS, models=models, params=PARAMS)
    assert model.metrics["accuracy"] == 1.0 and model.metrics["test_rows"] == 120
    wrong = model.score(rows).where(F.col("prediction_label") != F.col(label).cast("string"))
    assert wrong.count() == 0


def test_raw_rows_score_like_training_rows(spark, rows):
    model = train_pipeline(rows, "label", ["id"], COLUMNS, models="rf", params=PARAMS)
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "x"), (2, "5.5", "inf", "never seen", "no time", "y"), (3, "52", "", "k1", None, None)],
        "id int, size string, noise string, kind string, seen_time string, features string",
    )
    got = {r["id"]: r for r in model.score(odd).collect()}
    assert got[2]["prediction_label"] == "quiet" and got[3]["prediction_label"] == "loud"
    assert got[2]["kind"] == "never seen" and got[1]["features"] == "x" and got[1]["prediction_label"] is not None
    # The fitted median stands in for a missing column.
    assert model.score(odd.drop("size")).select("prediction_label").distinct().count() == 1


def test_saved_ensemble_predicts_alike(spark, rows, tmp_path):
    model = train_pipeline(rows, "label", ["id"], COLUMNS, models="rf,gbt", stacking=True, k_best=3, params=PARAMS)
    model.save(str(tmp_path / "m"))
    loaded = Ensemble.load(spark, str(tmp_path / "m"))
    assert loaded.features == model.features and loaded.metrics == model.metrics
    pick = lambda m: {r["id"]: (r["prediction_label"], r["probabilities"]) for r in m.score(rows).collect()}
    assert pick(model) == pick(loaded)
    with pytest.raises(Exception, match="exists"):
        model.save(str(tmp_path / "m"))


def test_replayed_batch_keeps_its_version_and_an_uncommitted_folder_is_no_version(spark, rows, tmp_path):
    root, notes = str(tmp_path / "models"), str(tmp_path / "notes")
    with pytest.raises(ValueError, match="no ensemble"):
        model_versions.version_scorer(root, notes)(rows, 0)
    exchanged = rows.withColumn("label", F.when(F.col("label") == "quiet", "loud").otherwise("quiet"))
    first, second = (
        train_pipeline(r, "label", ["id"], ["size"], models="rf", params=PARAMS) for r in (rows, exchanged)
    )
    assert model_versions.publish(first, root) == 1
    score = model_versions.version_scorer(root, notes)
    pick = lambda df: {(r["id"], r["prediction_label"], r["model_version"]) for r in df.collect()}
    before = pick(score(rows, 0))
    assert {v for _, _, v in before} == {1}
    # Stored, but its run died before the row that commits it.
    second.save(f"{root}/ensembles/2-dead")
    assert pick(score(rows, 1)) == before
    assert model_versions.publish(second, root) == 2
    other = {True: "quiet", False: "loud"}
    assert pick(score(rows, 2)) == {(i, other[label == "loud"], 2) for i, label, _ in before}
    # Replays of the earlier batches, by a restarted job as well, score as they did.
    assert pick(score(rows, 1)) == before
    assert pick(model_versions.version_scorer(root, notes)(rows, 0)) == before
