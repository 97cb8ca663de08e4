"""Accuracy and calibration of scored answers.

A scored table has item_id, probs, target, label_index, qtype, source, answerable and evidence. All
metrics of all levels (overall, each type, each source) come from one shuffle: rows are reduced to
sums by (type, source, confidence bin) first, and the levels are rolled up from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.sources.files import written

ECE_BINS, TABLE_BINS = 15, 10
CONFIDENT = 0.9


def edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def per_item(scored: DataFrame) -> DataFrame:
    """The numbers of each item that metrics add up."""
    p, label = F.col("probs"), F.col("label_index")
    top = F.array_max(p)
    right = (A.first_argmax(p) == label).cast("double")
    return scored.select(
        "item_id", "qtype", "source", "answerable", "evidence", "label_index",
        top.alias("p_max"), right.alias("correct"),
        (-F.log(F.greatest(F.get(p, label), F.lit(A.EPS)))).alias("nll"),
        A.nll(p, F.col("target")).alias("nll_soft"),
        A.squared_distance(p, A.one_hot(label, F.size(p))).alias("brier"),
        A.squared_distance(p, F.col("target")).alias("brier_soft"),
        ((top >= CONFIDENT) & (right == 0)).cast("double").alias("confident_error"),
        F.when(F.col("qtype") == "score", F.abs(A.expected_score(p) - label)).alias("score_error"),
    )


SUMS = ["correct", "brier", "brier_soft", "nll", "nll_soft", "p_max", "confident_error", "score_error"]


def binned(items: DataFrame, bins: int, *keys: str) -> DataFrame:
    at = A.bin_of(F.col("p_max"), edges(bins)).alias("bin")
    sums = [F.sum(c).alias(c) for c in SUMS]
    return items.groupBy(*keys, at).agg(F.count("*").alias("n"), *sums, F.count("score_error").alias("n_score"))


def levels() -> Column:
    """The levels a (type, source) group counts for."""
    one = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    return F.explode(F.array(one("overall", F.lit("")), one("type", F.col("qtype")), one("source", F.col("source"))))


def summary(scored: DataFrame) -> DataFrame:
    """One row for each level and key: all metrics; score_mae is null without score items and evidence_auc
    null if no item is unanswerable (NaN if none is answerable)."""
    items = written(per_item(scored))  # read by the sums, and twice for the ranks
    rolled = binned(items, ECE_BINS, "qtype", "source").withColumn("l", levels())
    totals = [F.sum(c).alias(c) for c in ["n", *SUMS, "n_score"]]
    bins = rolled.groupBy("l.level", "l.key", "bin").agg(*totals)
    gap = F.sum(F.abs(F.col("correct") - F.col("p_max")))
    sums = bins.groupBy("level", "key").agg(gap.alias("gap"), *totals)
    n = F.col("n")
    metrics = sums.select(
        "level", "key", n.alias("count"),
        (F.col("correct") / n).alias("accuracy"), (F.col("brier") / n).alias("brier"), (F.col("brier_soft") / n).alias("brier_soft"),
        (F.col("nll") / n).alias("nll"), (F.col("nll_soft") / n).alias("nll_soft"), (F.col("gap") / n).alias("ece"),
        (F.col("p_max") / n).alias("mean_confidence"), (F.col("confident_error") / n).alias("confident_error_rate"),
        F.when(F.col("n_score") > 0, F.col("score_error") / F.col("n_score")).alias("score_mae"),
    )
    return metrics.join(auc(items), ["level", "key"], "left")


def auc(items: DataFrame) -> DataFrame:
    """evidence_auc by level: rank statistic of evidence for answerable items, ties by item_id.

    Rows are dealt out by ranges of (level, key, evidence, item_id), so a level whose evidence crowds at one value is
    spread like any other. Within a range rows are counted off in order; sums by range and level are added up
    behind the counts of lower ranges. Levels where all are answerable have no row.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = items.select("item_id", "evidence", F.col("answerable").cast("int").alias("pos"), levels().alias("l"))
    order = ["level", "key", "evidence", "item_id"]
    dealt = each.select("item_id", "evidence", "pos", "l.level", "l.key").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place within its range
    exact = lambda c: c.cast("decimal(38,0)")
    counted = dealt.select("level", "key", "pos", F.spark_partition_id().alias("part"), at.alias("at"))
    sums = counted.groupBy("level", "key", "part").agg(
        F.sum(exact(F.col("at") * F.col("pos"))).alias("r"), F.min("at").alias("first"), F.sum("pos").alias("pos"), F.count("*").alias("n")
    )
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("level", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sums.withColumn("ranks", F.col("r") + exact((lower - F.col("first") + 1) * F.col("pos")))  # a row a range and level
    whole = ranked.groupBy("level", "key").agg(F.sum("ranks").cast("double").alias("ranks"), F.sum("pos").cast("double").alias("pos"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("pos")
    value = F.when((F.col("pos") == 0), F.lit(float("nan"))).otherwise((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg))
    return whole.where(neg > 0).select("level", "key", value.alias("evidence_auc"))


def reliability(scored: DataFrame, bins: int = TABLE_BINS) -> DataFrame:
    """bin, count, confidence and accuracy of every bin; empty bins have NaN."""
    items = written(per_item(scored).select("p_max", "correct"))  # so that what makes probs runs once a row
    at_bin = A.bin_of(F.col("p_max"), edges(bins)).alias("bin")
    own = items.groupBy(at_bin).agg(F.count("*").alias("n"), F.sum("p_max").alias("p_max"), F.sum("correct").alias("correct"))
    at = edges(bins)
    every = scored.sparkSession.createDataFrame([(i, f"{at[i]:.1f}-{at[i + 1]:.1f}") for i in range(bins)], "bin int, name string")
    mean = lambda c: F.coalesce(F.col(c) / F.col("n"), F.lit(float("nan")))
    return every.join(own, "bin", "left").select(
        F.col("name").alias("bin"), F.coalesce("n", F.lit(0)).cast("long").alias("count"), mean("p_max").alias("confidence"), mean("correct").alias("accuracy")
    )


def training_loss(scored: DataFrame, weight: float = 1.0) -> DataFrame:
    """Mean cross entropy over answerable items plus weight times the cross entropy of evidence over all."""
    ce = F.avg(F.when(F.col("answerable"), A.nll(F.col("probs"), F.col("target"))))
    e = F.least(F.greatest(F.col("evidence"), F.lit(A.EPS)), F.lit(1 - A.EPS))
    bce = F.avg(-F.when(F.col("answerable"), F.log(e)).otherwise(F.log(1 - e)))
    return scored.agg(F.count("*").alias("count"), ce.alias("answer_loss"), bce.alias("evidence_loss"), (ce + weight * bce).alias("loss"))
