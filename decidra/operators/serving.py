"""Request logs: batch packing limits, latency quantiles and service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVOIR = 1024
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latest(events: DataFrame, key: str, order: list[str], keep: int = RESERVOIR) -> DataFrame:
    """The last keep rows of each key.

    A rank within hashed parts of a key first cuts every part to keep rows, so that a hot key never meets in
    one task as a whole; the last ranking sees parts * keep rows at most.
    """
    desc = [F.col(c).desc() for c in order]
    part = F.pmod(F.xxhash64(*order), F.lit(32))
    first = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*desc))
    some = events.withColumn("_part", part).withColumn("_r", first).where(F.col("_r") <= keep)
    last = F.row_number().over(Window.partitionBy(key).orderBy(*desc))
    return some.withColumn("_r", last).where(F.col("_r") <= keep).drop("_r", "_part")


def floor_quantile(values: Column, q: float) -> Column:
    """The element at index min(n - 1, floor(q n)) of the sorted array; 0 for an empty one."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * q).cast("int"))
    return F.when(n > 0, F.get(F.sort_array(values), at)).otherwise(F.lit(0.0))


def latency_quantiles(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """requests of each key in all, and quantiles of its last RESERVOIR values."""
    kept = latest(events, key, order).groupBy(key).agg(F.collect_list(value).alias("v"))
    counts = events.groupBy(key).agg(F.count("*").alias("requests"))
    return counts.join(kept, key).select(key, "requests", *[floor_quantile(F.col("v"), q).alias(name) for name, q in QUANTILES.items()])


def snapshot(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """One row of totals: requests, errors, rejected, batches, mean batch size."""
    r = requests.agg(F.count_if(F.col("status") == "ok").alias("requests"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    b = batches.agg(F.count("*").alias("batches"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_batch_size"))
    return r.crossJoin(b)  # one row each


def prometheus(row: dict, quantiles: dict[str, float], prefix: str = "decisions") -> str:
    """The text of a metrics page."""
    kinds = {"requests": "counter", "errors": "counter", "rejected": "counter", "batches": "counter", "mean_batch_size": "gauge"}
    out = []
    for name, kind in kinds.items():
        full = f"{prefix}_{name}" + ("_total" if kind == "counter" else "")
        out += [f"# TYPE {full} {kind}", f"{full} {row[name]}"]
    out.append(f"# TYPE {prefix}_latency_ms summary")
    out += [f'{prefix}_latency_ms{{quantile="{q}"}} {v}' for q, v in quantiles.items()]
    return "\n".join(out) + "\n"


def answer_groups(answers: DataFrame) -> DataFrame:
    """A response by request: answers by name, grouped as choices, nouls (yes probabilities) and scores."""
    at = lambda kind, value: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("qtype") == kind, F.struct("name", value.alias("v"))))))
    top = F.get("keys", F.array_position("probs", F.array_max("probs")).cast("int") - 1)
    score = F.aggregate(F.transform("probs", lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)
    return answers.groupBy("request").agg(at("choice", top).alias("choices"), at("bool", F.get("probs", F.lit(0))).alias("nouls"), at("score", score).alias("scores"))
