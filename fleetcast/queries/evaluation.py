"""Evaluation of scored rows; scores are rounded so that many tie."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.operators import evaluate
from fleetcast.queries.base import query, rounded
from fleetcast.sources.tables import read_table

SCORED_SQL = """
scored AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  round(1 / (1 + exp(-(value - 50) / 50)), 3) AS score FROM events),
h AS (SELECT score, count(*) AS n, sum(y) AS p FROM scored GROUP BY score),
c AS (SELECT score, n, p, sum(n) OVER w AS flagged, sum(p) OVER w AS tp, sum(p) OVER () AS pos,
  sum(n) OVER () AS tot FROM h WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT score AS threshold, tp / flagged AS precision, tp / pos AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / flagged) * (tp / pos) / (tp / flagged + tp / pos) ELSE 0 END AS f1,
  CASE WHEN tp > 0 THEN 5 * (tp / flagged) * (tp / pos) / (4 * (tp / flagged) + tp / pos) ELSE 0 END AS f2 FROM c)
"""


def scored(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 50)), 3).alias("score"),
    )


def _confusion_sql(t: str) -> str:
    return f"""count(*) FILTER (WHERE y = 0 AND score < {t}) AS tn, count(*) FILTER (WHERE y = 0 AND score >= {t}) AS fp,
    count(*) FILTER (WHERE y = 1 AND score < {t}) AS fn, count(*) FILTER (WHERE y = 1 AND score >= {t}) AS tp"""


_METRICS_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(
    "confusion_metrics",
    f"WITH {SCORED_SQL}, k AS (SELECT {_confusion_sql('0.5')} FROM scored) SELECT tn, fp, fn, tp, {_METRICS_SQL} FROM k",
)
def confusion_metrics(spark, sf):
    return rounded(evaluate.confusion(scored(spark, sf), "y", "score"), "precision", "recall", "f1")


@query(
    "threshold_table",
    f"""WITH {SCORED_SQL}, k AS (SELECT t AS threshold, {_confusion_sql('t')} FROM scored, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS t) GROUP BY t)
    SELECT threshold, tn, fp, fn, tp, {_METRICS_SQL} FROM k""",
)
def threshold_table(spark, sf):
    out = evaluate.threshold_table(scored(spark, sf), "y", "score", [0.3, 0.5, 0.7])
    return rounded(out, "precision", "recall", "f1")


@query(
    "average_precision",
    f"WITH {SCORED_SQL} SELECT round(sum(p / pos * (tp / flagged)), 6) AS average_precision FROM c",
)
def average_precision(spark, sf):
    return rounded(evaluate.average_precision(scored(spark, sf), "y", "score"), "average_precision")


@query(
    "roc_auc",
    f"""WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)
    SELECT round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)), 6) AS roc_auc FROM r""",
)
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(scored(spark, sf), "y", "score"), "roc_auc")


@query(
    "pr_curve",
    f"WITH {SCORED_SQL} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM curve",
)
def pr_curve(spark, sf):
    return rounded(evaluate.pr_curve(scored(spark, sf), "y", "score"), "precision", "recall", "f1", "f2")


@query(
    "best_threshold",
    f"""WITH {SCORED_SQL}, b AS (SELECT 'f1' AS metric, threshold, f1 AS best FROM (SELECT * FROM curve ORDER BY f1 DESC, threshold LIMIT 1)
    UNION ALL SELECT 'f2', threshold, f2 FROM (SELECT * FROM curve ORDER BY f2 DESC, threshold LIMIT 1))
    SELECT metric, threshold, round(best, 6) AS best FROM b""",
)
def best_threshold(spark, sf):
    curve = evaluate.pr_curve(scored(spark, sf), "y", "score")
    parts = [
        evaluate.best_threshold(curve, m).select(F.lit(m).alias("metric"), "threshold", F.col(m).alias("best"))
        for m in ("f1", "f2")
    ]
    return rounded(parts[0].unionByName(parts[1]), "best")


@query(
    "class_weights",
    f"""WITH {SCORED_SQL}, k AS (SELECT count(*) FILTER (WHERE y = 0) AS n_neg, count(*) FILTER (WHERE y = 1) AS n_pos FROM scored)
    SELECT n_neg, n_pos, round((n_neg + n_pos) / (2 * n_neg), 6) AS weight_neg, round((n_neg + n_pos) / (2 * n_pos), 6) AS weight_pos,
    round(n_neg / n_pos, 6) AS scale_pos_weight FROM k""",
)
def class_weights(spark, sf):
    return rounded(evaluate.class_weights(scored(spark, sf), "y"), "weight_neg", "weight_pos", "scale_pos_weight")
