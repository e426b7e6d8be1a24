"""Evaluation and soft voting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import evaluate as ev
from packetloom.operators.models import decode_predictions, soft_vote, soft_vote_long
from packetloom.plans.registry import query, rounded
from packetloom.sources.adapters import adapter, oracle_cte

C = oracle_cte("scored") + """,
s AS (SELECT source_file, nullif(upper(trim(y_true)), '') AS t, upper(trim(y_pred)) AS p, confidence FROM scored WHERE trim(y_true) <> ''),
pairs AS (SELECT t, p, count(*) AS n FROM s GROUP BY t, p),
labels AS (SELECT DISTINCT label FROM (SELECT t AS label FROM s UNION SELECT p FROM s)),
cls AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM pairs WHERE t = label)::BIGINT AS support,
  (SELECT coalesce(sum(n), 0) FROM pairs WHERE p = label)::BIGINT AS predicted,
  (SELECT coalesce(sum(n), 0) FROM pairs WHERE t = label AND p = label)::BIGINT AS tp FROM labels),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS pre, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS rec FROM cls),
m AS (SELECT *, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS f1 FROM pr)"""


def _counts(spark, sf_dir):
    return ev.scored_counts(adapter(spark, sf_dir, "scored"))


def _pairs(spark, sf_dir):
    return ev.overall_pairs(_counts(spark, sf_dir))


@query(
    "eval_confusion",
    f"{C} SELECT 'file' AS level, source_file, t AS y_true, p AS y_pred, count(*) AS n FROM s GROUP BY ALL "
    "UNION ALL SELECT 'overall', NULL, t, p, n FROM pairs",
)
def eval_confusion(spark, sf_dir):
    """AGG3: label pairs per file and overall."""
    return ev.confusion_counts(_counts(spark, sf_dir))


STATS = """count(*) AS rows, count(*) FILTER (t = p) AS correct, round(avg((t = p)::INT), 6) AS accuracy, round(avg(confidence), 6) AS confidence_mean,
  round(min(confidence), 6) AS confidence_min, round(max(confidence), 6) AS confidence_max, count(DISTINCT t) AS true_classes, count(DISTINCT p) AS pred_classes"""


@query(
    "eval_stats",
    f"{C} SELECT 'file' AS level, source_file, {STATS} FROM s GROUP BY source_file UNION ALL SELECT 'overall', NULL, {STATS} FROM s",
)
def eval_stats(spark, sf_dir):
    """AGG4: rows, accuracy, confidence and classes per file and overall."""
    return rounded(ev.running_stats(_counts(spark, sf_dir)))


# Weighted scores per file, from the pairs of each file.
FILE_SCORES = """,
fp AS (SELECT source_file, t, p, count(*) AS n FROM s GROUP BY ALL),
ft AS (SELECT source_file, t AS label, sum(n) AS support, coalesce(sum(CASE WHEN t = p THEN n END), 0) AS tp FROM fp GROUP BY ALL),
fq AS (SELECT source_file, p AS label, sum(n) AS predicted FROM fp GROUP BY ALL),
fr AS (SELECT source_file, support, coalesce(tp::DOUBLE / predicted, 0) AS pre, tp::DOUBLE / support AS rec FROM ft LEFT JOIN fq USING (source_file, label)),
fm AS (SELECT source_file, round(sum(pre * support) / sum(support), 6)::DOUBLE AS precision_weighted,
  round(sum(rec * support) / sum(support), 6)::DOUBLE AS recall_weighted,
  round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END * support) / sum(support), 6)::DOUBLE AS f1_weighted
  FROM fr GROUP BY source_file)"""


@query("eval_file_scores", f"{C}{FILE_SCORES} SELECT * FROM fm")
def eval_file_scores(spark, sf_dir):
    """AGG4: weighted precision, recall and F1 per file."""
    return rounded(ev.file_scores(_counts(spark, sf_dir)))


@query(
    "eval_per_class",
    f"{C} SELECT label, round(pre, 6)::DOUBLE AS precision, round(rec, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support, predicted, tp AS true_positive FROM m",
)
def eval_per_class(spark, sf_dir):
    """AGG5: precision, recall and F1 per class."""
    return rounded(ev.per_class(_pairs(spark, sf_dir)))


OVERALL = ", ".join(
    [f"round(sum({c} * support) / sum(support), 6)::DOUBLE AS {n}_weighted" for c, n in (("pre", "precision"), ("rec", "recall"), ("f1", "f1"))]
    + [f"round(avg({c}), 6)::DOUBLE AS {n}_macro" for c, n in (("pre", "precision"), ("rec", "recall"), ("f1", "f1"))]
)


@query(
    "eval_overall",
    f"{C} SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, {OVERALL}, sum(support)::BIGINT AS support, round(avg(rec), 6)::DOUBLE AS balanced_accuracy FROM m",
)
def eval_overall(spark, sf_dir):
    """AGG6: accuracy, weighted and macro averages."""
    return rounded(ev.overall_metrics(ev.per_class(_pairs(spark, sf_dir))))


DENSE = """, d AS (SELECT a.label AS y_true, b.label AS y_pred, coalesce(n, 0) AS n FROM labels a CROSS JOIN labels b LEFT JOIN pairs ON t = a.label AND p = b.label)"""


def _labels(pairs):
    return ev.label_list(ev.label_universe(pairs))


@query("confusion_dense", f"{C}{DENSE} SELECT y_true, y_pred, n FROM d")
def confusion_dense(spark, sf_dir):
    """JON5: every label pair, zeros included."""
    pairs = _pairs(spark, sf_dir)
    return ev.dense_confusion(pairs, _labels(pairs))


@query(
    "confusion_normalised",
    f"{C}{DENSE} SELECT y_true, y_pred, n, CASE WHEN sum(n) OVER (PARTITION BY y_true) = 0 THEN 0.0 "
    "ELSE round(n::DOUBLE / sum(n) OVER (PARTITION BY y_true), 6) END::DOUBLE AS share FROM d",
)
def confusion_normalised(spark, sf_dir):
    """AGG7: row-normalised confusion."""
    pairs = _pairs(spark, sf_dir)
    return rounded(ev.row_normalised(ev.dense_confusion(pairs, _labels(pairs))))


@query(
    "confusion_wide",
    f"{C}{DENSE} SELECT y_true, "
    + ", ".join(f"coalesce(sum(n) FILTER (y_pred = '{x}'), 0)::BIGINT AS \"{x}\"" for x in ("BENIGN", "LDAP", "SYN", "UDP"))
    + " FROM d GROUP BY y_true",
)
def confusion_wide(spark, sf_dir):
    """AGG8: wide confusion matrix."""
    pairs = _pairs(spark, sf_dir)
    return ev.wide_confusion(pairs, _labels(pairs))


@query("class_distribution", f"{C} SELECT label, support AS true_count, predicted AS pred_count FROM m")
def class_distribution(spark, sf_dir):
    """AGG9: rows per class, true against predicted."""
    return ev.class_distribution(ev.per_class(_pairs(spark, sf_dir)))


MAPPING = "(VALUES ('UDP', 0), ('portmap', 1), ('Benign ', 2)) k(label, code)"


@query(
    "label_order",
    f"{C}, k AS (SELECT upper(trim(label)) AS label, code::BIGINT AS code FROM {MAPPING}), u AS (SELECT * FROM labels FULL JOIN k USING (label)) "
    "SELECT label, code, row_number() OVER (ORDER BY code NULLS LAST, label) - 1 AS ordinal FROM u",
)
def label_order(spark, sf_dir):
    """AGG10, SET2: model labels by code, then the observed ones."""
    mapping = spark.createDataFrame([("UDP", 0), ("portmap", 1), ("Benign ", 2)], "label string, code bigint")
    return ev.label_universe(_pairs(spark, sf_dir), mapping)


@query(
    "eval_per_file",
    f"{C}, f AS (SELECT source_file, count(*) AS rows, avg((t = p)::INT) AS a FROM s GROUP BY source_file) "
    "SELECT source_file, rows, round(a, 6) AS accuracy, row_number() OVER (ORDER BY a DESC, rows DESC, source_file) AS rank FROM f",
)
def eval_per_file(spark, sf_dir):
    """AGG11: file ranking."""
    return rounded(ev.file_ranking(ev.running_stats(_counts(spark, sf_dir))).select("source_file", "rows", "accuracy", "rank"))


@query("observed_labels", f"{C} SELECT label FROM labels")
def observed_labels(spark, sf_dir):
    """SET2: union of true and predicted labels."""
    return ev.observed_labels(_pairs(spark, sf_dir))


@query(
    "unmatched_labels",
    f"{C} SELECT label, support = 0 AS never_seen, predicted = 0 AS never_predicted FROM m WHERE support = 0 OR predicted = 0",
)
def unmatched_labels(spark, sf_dir):
    """SET3: labels never seen or never predicted."""
    return ev.unmatched_labels(ev.per_class(_pairs(spark, sf_dir)))


# Three models' class probabilities per line item; the third only votes.
PROBS = """SELECT l_orderkey, l_linenumber, l_partkey,
  array(l_discount * 5, 0.5 - l_discount * 5, 0.5D) AS p1, array(l_tax * 5, 0.6D, 0.4 - l_tax * 5) AS p2, cast(l_partkey % 3 AS INT) AS vote FROM {lineitem}"""
VOTE_SQL = """WITH p AS (SELECT l_orderkey, l_linenumber, (l_discount * 5 + l_tax * 5 + (l_partkey % 3 = 0)::INT) / 3 AS a,
  (0.5 - l_discount * 5 + 0.6::DOUBLE + (l_partkey % 3 = 1)::INT) / 3 AS b, (0.5 + 0.4::DOUBLE - l_tax * 5 + (l_partkey % 3 = 2)::INT) / 3 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN round(a, 6) >= round(b, 6) AND round(a, 6) >= round(c, 6) THEN 0 WHEN round(b, 6) >= round(c, 6) THEN 1 ELSE 2 END AS prediction,
  round(greatest(a, b, c), 5) AS confidence FROM p"""


def _probs(spark, sf_dir):
    return spark.sql(PROBS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("soft_vote", VOTE_SQL)
def soft_vote_query(spark, sf_dir):
    """ML13: mean of class probabilities in the row, ties to the lowest class."""
    out = soft_vote(_probs(spark, sf_dir), ["p1", "p2"], 3, votes=["vote"])
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction", "confidence"), 5)


@query("score_decode", oracle_cte("scored") + """, x AS (SELECT source_file, y_pred, confidence,
  CASE y_pred WHEN 'BENIGN' THEN 0 WHEN 'LDAP' THEN 1 WHEN 'SYN' THEN 2 ELSE 7 END AS prediction FROM scored)
SELECT source_file, prediction, CASE prediction WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'LDAP' WHEN 2 THEN 'SYN' ELSE '7' END AS prediction_label,
  prediction <> 0 AS is_attack, round(CASE WHEN confidence < 0.5 THEN 0.5 ELSE confidence END, 6)::DOUBLE AS confidence, count(*) AS n FROM x GROUP BY ALL""")
def score_decode(spark, sf_dir):
    """ML16, JON2: label decode with code text as fallback, confidence from probabilities."""
    mapping = spark.createDataFrame([("BENIGN", 0), ("LDAP", 1), ("SYN", 2)], "label string, code bigint")
    rows = adapter(spark, sf_dir, "scored").selectExpr(
        "source_file", "CASE y_pred WHEN 'BENIGN' THEN 0 WHEN 'LDAP' THEN 1 WHEN 'SYN' THEN 2 ELSE 7 END AS prediction",
        "if(confidence < 0.5, NULL, array(1 - confidence, confidence)) AS probabilities",
    )
    out = rounded(decode_predictions(rows, mapping).select("source_file", "prediction", "prediction_label", "is_attack", "confidence"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("soft_vote_long", oracle_cte("scored") + """, v AS (SELECT source_file, y_true, y_pred AS class, avg(confidence) AS p FROM scored GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_file, y_true ORDER BY round(p, 6) DESC, class) AS rn FROM v)
SELECT source_file, y_true, class AS prediction, round(p, 6) AS confidence FROM r WHERE rn = 1""")
def soft_vote_long_query(spark, sf_dir):
    """ML13 on long rows: mean per class, then the best class."""
    votes = adapter(spark, sf_dir, "scored").selectExpr("source_file", "y_true", "y_pred AS class", "confidence AS p")
    return rounded(soft_vote_long(votes, ["source_file", "y_true"], "class", "p"))
