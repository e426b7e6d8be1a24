from __future__ import annotations

import pytest

from packetloom.operators import evaluate as ev

LABELS = ["BENIGN", "LDAP", "MSSQL", "NETBIOS", "PORTMAP", "SYN", "UDP", "UDPLAG"]
# A published confusion matrix (rows true, columns predicted) and its metrics.
MATRIX = [
    [56874, 69, 5, 17, 0, 0, 0, 0],
    [30, 1914798, 3, 280, 11, 0, 0, 0],
    [134, 16112, 5771155, 35, 17, 0, 0, 0],
    [75, 71, 0, 3657110, 241, 0, 0, 0],
    [0, 0, 0, 50083, 136877, 0, 0, 0],
    [186, 295037, 4595813, 22, 442, 0, 0, 0],
    [14, 124, 3859034, 7976, 7, 0, 0, 0],
    [1, 149, 1708, 4, 11, 0, 0, 0],
]
METRICS = {
    "accuracy": 0.5665152513991856, "precision_weighted": 0.38484352486994516,
    "recall_weighted": 0.5665152513991856, "f1_weighted": 0.43954440127495625,
    "precision_macro": 0.5296235155202094, "recall_macro": 0.5909288269839144,
    "f1_macro": 0.541524309736459, "balanced_accuracy": 0.5909288269839144, "support": 20364525,
}


def pairs_of(spark, labels, matrix):
    cells = [(t, p, n) for t, row in zip(labels, matrix) for p, n in zip(labels, row) if n]
    return spark.createDataFrame(cells, "y_true string, y_pred string, n bigint")


def test_published_metrics(spark):
    pairs = pairs_of(spark, LABELS, MATRIX)
    row = ev.overall_metrics(ev.per_class(pairs)).first().asDict()
    for name, value in METRICS.items():
        assert row[name] == pytest.approx(value, abs=1e-15), name
    classes = {r["label"]: r for r in ev.per_class(pairs).collect()}
    assert classes["LDAP"]["precision"] == pytest.approx(0.8600576726135934, abs=1e-15)
    assert classes["SYN"]["predicted"] == 0 and classes["SYN"]["precision"] == 0.0


def test_zero_support_classes_count_in_macro(spark):
    pairs = pairs_of(spark, ["BENIGN", "NETBIOS", "PORTMAP"], [[4734, 0, 0], [0, 0, 0], [0, 50083, 136877]])
    mapping = spark.createDataFrame([(x, i) for i, x in enumerate(["BENIGN", "LDAP", "MSSQL", "NETBIOS", "PORTMAP"])],
                                    "label string, code bigint")
    universe = ev.label_universe(pairs, mapping)
    row = ev.overall_metrics(ev.per_class(pairs, universe)).first()
    assert row["precision_macro"] == pytest.approx(0.4)
    assert row["recall_macro"] == pytest.approx(0.34642383397518184)
    assert row["f1_weighted"] == pytest.approx(0.849164333188698)


def test_empty_input_is_all_zero(spark):
    pairs = pairs_of(spark, LABELS, MATRIX).where("n < 0")
    row = ev.overall_metrics(ev.per_class(pairs)).first().asDict()
    assert set(row.values()) == {0.0}


def test_blank_labels_drop_out(spark):
    df = spark.createDataFrame(
        [("f", " syn ", "SYN", 0.5), ("f", "  ", "SYN", 0.9), ("f", None, "SYN", 0.9)],
        "source_file string, y_true string, y_pred string, confidence double",
    )
    rows = ev.scored_counts(df).collect()
    assert [(r["y_true"], r["n"]) for r in rows] == [("SYN", 1)]


def test_dense_and_wide(spark):
    pairs = pairs_of(spark, ["A", "B"], [[1, 0], [2, 3]])
    assert {(r["y_true"], r["y_pred"]): r["n"] for r in ev.dense_confusion(pairs, ["A", "B"]).collect()} == {
        ("A", "A"): 1, ("A", "B"): 0, ("B", "A"): 2, ("B", "B"): 3,
    }
    assert {r["y_true"]: (r["A"], r["B"]) for r in ev.wide_confusion(pairs, ["A", "B"]).collect()} == {"A": (1, 0), "B": (2, 3)}
