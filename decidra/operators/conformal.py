"""Prediction sets and act thresholds with finite-sample guarantees, by question type."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.sources.files import written

#: Types of questions that thresholds may be given for.
MOST_TYPES = 256
ACT_GRID = [round(0.5 + 0.01 * i, 2) for i in range(50)]
#: Buckets of scores double in width so many times as often as scores do: fine near 0, where confident scores crowd.
PER_OCTAVE, LEAST_SCORE = 256, 2.0**-40


def log_factorials(spark, most: int) -> DataFrame:
    """n, lf: log(n!) for n up to most. The table is cumulated within blocks, then over blocks."""
    block = 4096
    base = spark.range(most + 1).select(F.col("id").alias("n"), F.floor(F.col("id") / block).alias("b"), F.log(F.greatest(F.col("id"), F.lit(1)).cast("double")).alias("l"))
    sums = base.groupBy("b").agg(F.sum("l").alias("s"))
    before = sums.select(F.col("b").alias("bb"), F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inner = F.sum("l").over(Window.partitionBy("b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return base.withColumn("inner", inner).join(before, F.col("b") == F.col("bb")).select("n", (F.col("inner") + F.col("before")).alias("lf"))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 1: Stirling's series at x + 8, taken down by the recurrence. Error below 1e-12.

    The coefficients are fixed values of the series."""
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 + z * (-1 / 360 + z * (1 / 1260 + z * (-1 / 1680 + z * (1 / 1188))))) / y
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.918938533204672741780 + series - F.log(product)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in log space over the places within 12 standard deviations (and 60)
    of the mean, or of k where that is smaller. What lies outside is below 1e-30, absolutely or next to the sum; the number of terms
    grows with the root of n only."""
    log_p, log_q = math.log(p), math.log1p(-p)
    lg = lambda c: log_gamma(c.cast("double") + 1)
    term = lambda i: F.exp(lg(n) - lg(i) - lg(n - i) + i * log_p + (n - i) * log_q)
    mean, reach = n * p, F.ceil(12 * F.sqrt(n * (p * (1 - p)))) + 60
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.least(k.cast("double"), mean) - reach).cast("long"))
    last = F.least(k.cast("long"), F.ceil(mean + reach).cast("long"))
    summed = F.when(last < first, F.lit(1.0)).otherwise(F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0.0), lambda a, i: a + term(i)))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), summed))


def _usable(scored: DataFrame) -> DataFrame:
    """The few numbers of each answerable item that thresholds are fitted on, written once: what makes probs (a scorer)
    runs once, however many passes follow."""
    p = F.col("probs")
    return written(_numbers(scored, p))


def _numbers(scored: DataFrame, p: Column) -> DataFrame:
    return scored.where("answerable").select(
        "qtype", "item_id", (1 - F.get(p, F.col("label_index"))).alias("s"), F.array_max(p).alias("p_max"), (A.first_argmax(p) != F.col("label_index")).cast("int").alias("wrong")
    )


def set_thresholds(scored: DataFrame, alpha: float) -> DataFrame:
    """qtype, count, set_threshold: the score 1 - p(label) of rank min(n, ceil((n + 1)(1 - alpha))).

    The rank is located in a histogram of the scores first; of that bucket equal scores are counted map-side, and
    only its distinct scores are ranked.
    """
    return _set_thresholds(_usable(scored), alpha)


def _set_thresholds(usable: DataFrame, alpha: float) -> DataFrame:
    items = usable.withColumn("b", F.floor(F.log2(F.greatest(F.col("s"), F.lit(LEAST_SCORE))) * PER_OCTAVE))
    sizes = items.groupBy("qtype", "b").agg(F.count("*").alias("n"))
    group = Window.partitionBy("qtype")
    upto = F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(group)
    ranked = sizes.select("qtype", F.col("b").alias("b2"), (upto - F.col("n")).alias("before"), upto.alias("upto"), total.alias("total"))
    rank = F.least(F.col("total"), F.ceil((F.col("total") + 1) * (1 - alpha)))
    wanted = ranked.withColumn("rank", rank).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    wanted = wanted.select(F.col("qtype").alias("q2"), "b2", (F.col("rank") - F.col("before")).alias("k"), F.col("total").alias("count"))
    bucket = items.join(F.broadcast(wanted), (F.col("qtype") == F.col("q2")) & (F.col("b") == F.col("b2")))  # a row a type
    equal = bucket.groupBy("qtype", "s", "k", F.col("count").alias("n_all")).agg(F.count("*").alias("n"))
    at = F.sum("n").over(Window.partitionBy("qtype").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = equal.withColumn("at", at).where("at >= k AND at - n < k")
    return ranked.select("qtype", F.col("n_all").alias("count"), F.col("s").alias("set_threshold"))


def act_counts(scored: DataFrame) -> DataFrame:
    """qtype, threshold, acted, wrong at every grid point, cumulated from one histogram over the grid."""
    return _act_counts(_usable(scored))


def _act_counts(items: DataFrame) -> DataFrame:
    grid = F.array(*[F.lit(t) for t in ACT_GRID])
    bin_ = A.let(F.col("p_max"), lambda p: F.size(F.filter(grid, lambda t: p >= t))) - 1
    counts = items.groupBy("qtype", bin_.alias("bin")).agg(F.count("*").alias("m"), F.sum("wrong").alias("w"))
    each = counts.where("bin >= 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("bin"))))
    return each.groupBy("qtype", F.get(grid, F.col("at")).alias("threshold")).agg(F.sum("m").alias("acted"), F.sum("w").alias("wrong"))


def fit(scored: DataFrame, alpha: float = 0.1, delta: float = 0.05) -> DataFrame:
    """qtype, count, set_threshold, act_threshold (null if no grid point passes its test at delta / grid size)."""
    items = _usable(scored)
    passed = _act_counts(items).where(binomial_cdf(F.col("wrong"), F.col("acted"), alpha) <= delta / len(ACT_GRID))
    act = passed.groupBy("qtype").agg(F.min("threshold").alias("act_threshold"))
    return _set_thresholds(items, alpha).join(act, "qtype", "left")


def prediction_set(probs: Column, threshold: Column) -> Column:
    """Indices of the options in the set, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(probs) - 1), lambda k: 1 - F.get(probs, k) <= threshold)


def should_act(probs: Column, threshold: Column) -> Column:
    return F.coalesce(F.array_max(probs) >= threshold, F.lit(False))


def decorate(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scored with pred_set and act; both null for a type that has no thresholds. thresholds: a row a type, at most MOST_TYPES
    (more are an error): they are read once, made a local table and broadcast."""
    small = thresholds.select(F.col("qtype").alias("t_qtype"), "set_threshold", "act_threshold")
    rows = small.limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"thresholds of more than {MOST_TYPES} types")
    local = scored.sparkSession.createDataFrame(rows, small.schema)
    joined = scored.join(F.broadcast(local), F.col("qtype") == F.col("t_qtype"), "left")
    known = F.col("t_qtype").isNotNull()
    own_set = F.when(known, prediction_set(F.col("probs"), F.col("set_threshold")))
    return joined.withColumn("pred_set", own_set).withColumn("act", F.when(known, should_act(F.col("probs"), F.col("act_threshold")))).drop("t_qtype", "set_threshold", "act_threshold")


def evaluate(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Coverage and size of the sets, rate and error of acting, by type; NaN where there is nothing to average."""
    asked = written(scored.where("answerable").select("qtype", "probs", "label_index"))
    items = decorate(asked, thresholds).where(F.col("act").isNotNull())
    right = (A.first_argmax(F.col("probs")) == F.col("label_index")).cast("double")
    size = F.size("pred_set")
    nan = F.lit(float("nan"))
    return items.groupBy("qtype").agg(
        F.count("*").alias("count"),
        F.avg(F.array_contains("pred_set", F.col("label_index")).cast("double")).alias("coverage"),
        F.avg(size).alias("mean_set_size"),
        F.avg((size == 1).cast("double")).alias("singleton_rate"),
        F.avg(F.col("act").cast("double")).alias("act_rate"),
        F.coalesce(F.avg(F.when(F.col("act"), 1 - right)), nan).alias("act_error"),
        F.coalesce(F.avg(F.when(~F.col("act"), right)), nan).alias("abstain_accuracy"),
    )
