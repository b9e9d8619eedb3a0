"""How well a detector's scores tell labelled windows apart, at every threshold at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

_RANGES = 64


def _worse_first(higher_is_worse: bool) -> Column:
    return F.desc("score") if higher_is_worse else F.asc("score")


def threshold_curve(scored: DataFrame, score_col: str = "anomaly_score", label_col: str = "label",
                    higher_is_worse: bool = True) -> DataFrame:
    """One row per distinct score, taken as threshold: confusion counts, precision, recall, F1.

    A row is flagged if its score is at least as bad as ``threshold``. Rows without a score or
    label are left out. Scores are counted before they are put in order, so ties are one row;
    the order is made by ranges, each summed in its own task and shifted by the sums of those
    before it. Without positive rows recall is 0, without negative ones nothing is false.
    """
    label = F.col(label_col).cast("boolean")
    counts = (scored.select(F.col(score_col).cast("double").alias("score"), label.alias("label"))
              .filter("score is not null and not isnan(score) and label is not null")
              .groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n")))
    order = _worse_first(higher_is_worse)
    # Stored, so that the ranges are what they were when their sums were made.
    ranges = materialize(counts.repartitionByRange(_RANGES, order)
                         .withColumn("part", F.spark_partition_id()), "score-ranges")[0]
    sums = ranges.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))  # one row a range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shift = sums.select(
        "part", F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.sum("p").over(everything).alias("positives"), F.sum("n").over(everything).alias("negatives"))
    inside = Window.partitionBy("part").orderBy(order)
    tp, fp = F.col("p0") + F.sum("p").over(inside), F.col("n0") + F.sum("n").over(inside)
    run = (ranges.join(F.broadcast(shift), "part")
           .select("score", "p", "n", "positives", "negatives", tp.alias("tp"), fp.alias("fp")))
    return run.select(
        F.col("score").alias("threshold"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"),
        (F.col("negatives") - F.col("fp")).alias("tn"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall"),
        (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))).alias("f1"),
        # Area of the step to this threshold under the curve of hits over false alarms.
        F.coalesce(F.try_divide(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2,
                                F.col("positives") * F.col("negatives")), F.lit(0.0)).alias("area"))


def detector_evaluation(scored: DataFrame, score_col: str = "anomaly_score",
                        flag_col: str = "is_anomaly", label_col: str = "label",
                        higher_is_worse: bool = True) -> DataFrame:
    """One row: confusion counts of the flags, precision, recall and F1, and of the scores the area
    under the curve and the best F1 with the threshold it is reached at (the least strict).
    """
    flag, label = F.col(flag_col).cast("boolean"), F.col(label_col).cast("boolean")
    counts = scored.filter(flag.isNotNull() & label.isNotNull()).agg(
        F.count_if(flag & label).alias("tp"), F.count_if(flag & ~label).alias("fp"),
        F.count_if(~flag & label).alias("fn"), F.count_if(~flag & ~label).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = counts.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                           ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                           ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    strict = F.col("threshold") if higher_is_worse else -F.col("threshold")
    curve = threshold_curve(scored, score_col, label_col, higher_is_worse).agg(
        F.sum("area").alias("auc"), F.max("f1").alias("best_f1"),
        F.max_by("threshold", F.struct(F.round("f1", 12), -strict)).alias("best_threshold"))
    return counts.join(F.broadcast(curve), F.lit(True))  # one row each
