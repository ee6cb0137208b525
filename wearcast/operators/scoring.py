"""Accuracy of predicted labels against actual ones.

Predictions are columns of the same row (``pred_<label>`` next to
``<label>``), so no join is needed: all labels are counted in ONE global
aggregate (partial per task, one tiny final merge), then unpivoted to a long
``(label, hits, n_rows, accuracy)`` table.  A NULL on either side is a miss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hit_counts(df: DataFrame, labels: Sequence[str], pred_prefix: str, weight_col: str | None = None) -> DataFrame:
    """One global aggregate: the row count and, per label, the rows where the
    prediction equals the actual value (a NULL on either side is a miss).
    With ``weight_col`` each row counts as its weight (compressed rows)."""

    def same(lab: str):
        return F.coalesce(F.col(pred_prefix + lab) == F.col(lab), F.lit(False))

    if weight_col is None:
        hits = [F.count_if(same(lab)).alias(lab) for lab in labels]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), *hits)
    w = F.col(weight_col)
    hits = [F.sum(F.when(same(lab), w).otherwise(F.lit(0.0))).alias(lab) for lab in labels]
    return df.agg(F.sum(w).alias("n_rows"), *hits)


def label_accuracy(
    df: DataFrame, labels: Sequence[str], pred_prefix: str = "pred_", drop_perfect: bool = False
) -> DataFrame:
    """A1 (+A2 with ``drop_perfect``): per-label share of rows where the
    prediction equals the actual value, as ``(label, hits, n_rows, accuracy)``;
    an empty table has NULL accuracies."""
    labels = list(labels)
    long = _hit_counts(df, labels, pred_prefix).unpivot(["n_rows"], labels, "label", "hits")
    out = long.select("label", "hits", "n_rows", F.try_divide(F.col("hits"), F.col("n_rows")).alias("accuracy"))
    if drop_perfect:
        out = out.filter(F.col("hits") != F.col("n_rows"))
    return out


def overall_accuracy(scores: DataFrame) -> DataFrame:
    """A3: unweighted mean of the label accuracies (one row; NULL when no
    label remains).  Computed as total hits / (rows x labels), which is the
    mean of the per-label shares with a single rounding."""
    return scores.agg(
        F.try_divide(F.sum("hits"), F.max("n_rows") * F.count(F.lit(1))).alias("overall"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def score_table(
    df: DataFrame,
    labels: Sequence[str],
    pred_prefix: str = "pred_",
    drop_perfect: bool = False,
    weight_col: str | None = None,
) -> DataFrame:
    """A1-A3 in one pass: the long table of label accuracies plus an
    ``overall`` row, all derived from the single aggregate row (the input is
    scanned once; the unpivot works on one row).  ``weight_col`` makes each
    row count as its weight."""
    labels = list(labels)
    wide = _hit_counts(df, labels, pred_prefix, weight_col)
    n = F.col("n_rows")
    kept = [F.col(lab) != n if drop_perfect else F.lit(True) for lab in labels]
    kept_hits = sum(F.when(k, F.col(lab)).otherwise(F.lit(0)) for k, lab in zip(kept, labels))
    kept_count = sum(F.when(k, F.lit(1)).otherwise(F.lit(0)) for k in kept)
    with_overall = wide.withColumn(
        "overall", F.when(kept_count > 0, F.try_divide(kept_hits, n * kept_count))
    ).select(
        *[F.when(k, F.try_divide(F.col(lab), n)).alias(lab) for k, lab in zip(kept, labels)], "overall"
    )
    long = with_overall.unpivot([], [*labels, "overall"], "label", "accuracy")
    return long.filter(F.col("accuracy").isNotNull() | (F.col("label") == "overall"))


def weighted_accuracy(scores: DataFrame, weights: DataFrame | Mapping[str, float]) -> DataFrame:
    """A4: mean over the weighted labels of accuracy x weight (not divided by
    the weight sum).  A weighted label missing from ``scores`` fails the job."""
    if isinstance(weights, Mapping):
        spark = scores.sparkSession
        weights = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "label string, weight double")
    joined = weights.join(F.broadcast(scores), on="label", how="left")
    checked = joined.withColumn(
        "hits",
        F.when(F.col("hits").isNotNull(), F.col("hits")).otherwise(
            F.raise_error(F.concat(F.lit("no score for weighted label "), F.col("label")))
        ),
    )
    return checked.agg(
        F.try_divide(F.sum(F.col("hits") * F.col("weight")), F.max("n_rows") * F.count(F.lit(1))).alias("weighted"),
        F.count(F.lit(1)).alias("n_weighted"),
    )
