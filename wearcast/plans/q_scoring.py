"""Queries over scoring."""

from __future__ import annotations

from wearcast import schema as S
from wearcast.operators.scoring import label_accuracy, score_table, weighted_accuracy
from wearcast.plans.catalog import register
from wearcast.plans.inputs import EVENT_SCENARIO, spark_view, sql_view
from wearcast.session import read_table

# Stand-in predictions next to the scenario's actual labels: simple rules,
# one exact copy (face_cover, a perfect label) and NULLs on one side.
PREDICTIONS = [
    ("pred_outer_layer", "CASE WHEN (event_id * 7) % 120 - 5 < 40 THEN 'Long-sleeve' ELSE 'Short-sleeve' END"),
    ("pred_base_layer", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'None' END"),
    ("pred_jacket", "CASE WHEN (event_id * 13) % 35 >= 15 THEN 'Wind' ELSE 'None' END"),
    ("pred_lower_body", "CASE WHEN (event_id * 7) % 120 - 5 < 45 THEN 'Long tights' ELSE 'Shorts' END"),
    ("pred_shoe_cover", "'None'"),
    ("pred_ears_hat", "((event_id * 7) % 120 - 5 < 35)"),
    ("pred_gloves", "((event_id * 7) % 120 - 5 < 30)"),
    ("pred_heavy_socks", "(event_id % 6 < 3)"),
    ("pred_arm_warmers", "false"),
    ("pred_face_cover", "(event_id % 10 = 0)"),
]
SCORED = [(n, e) for n, e in EVENT_SCENARIO if n in ["row_id", *S.LABELS]] + PREDICTIONS
_SCORED_SQL = sql_view("events", SCORED)

WEIGHTS = {"outer_layer": 2.0, "jacket": 1.5, "gloves": 0.5, "heavy_socks": 1.0}


def _scored(spark, sf_dir):
    return spark_view(read_table(spark, sf_dir, "events"), SCORED)


def _hits_sql() -> str:
    parts = [
        f"SELECT '{lab}' AS label, count(*) FILTER (WHERE COALESCE(pred_{lab} = {lab}, false)) AS hits, "
        f"count(*) AS n_rows FROM s"
        for lab in S.LABELS
    ]
    return " UNION ALL ".join(parts)


@register(
    "label_accuracy",
    f"""WITH s AS ({_SCORED_SQL}),
h AS ({_hits_sql()}),
k AS (SELECT * FROM h WHERE hits <> n_rows)
SELECT label, hits / n_rows AS accuracy FROM k
UNION ALL
SELECT 'overall' AS label, SUM(hits) / (MAX(n_rows) * COUNT(*)) AS accuracy FROM k""",
)
def label_accuracy_query(spark, sf_dir):
    """A1-A3 + J6: per-label accuracy of same-row predictions, perfect labels
    dropped, and the macro overall."""
    return score_table(_scored(spark, sf_dir), S.LABELS, drop_perfect=True)


_W_SQL = " UNION ALL ".join(f"SELECT '{k}' AS label, {v} AS weight" for k, v in WEIGHTS.items())


@register(
    "weighted_accuracy",
    f"""WITH s AS ({_SCORED_SQL}),
h AS ({_hits_sql()}),
w AS ({_W_SQL})
SELECT SUM(h.hits * w.weight) / (MAX(h.n_rows) * COUNT(*)) AS weighted, COUNT(*) AS n_weighted
FROM w JOIN h ON w.label = h.label""",
)
def weighted_accuracy_query(spark, sf_dir):
    """A4: weighted overall over four weighted labels."""
    scores = label_accuracy(_scored(spark, sf_dir), S.LABELS)
    return weighted_accuracy(scores, WEIGHTS)
