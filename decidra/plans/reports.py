"""Reports of evaluations: their files, their tables, and what a run is made of."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.operators import metrics
from decidra.plans.pipeline import cell, markdown
from decidra.sources import files
from decidra.sources.records import write_scored

MOST_KEYS = 10_000
COLUMNS = ["level", "key", "count", "accuracy", "brier", "nll", "ece", "mean_confidence"]


def scored_path(report: str) -> str:
    """Where the scored rows of a report lie: eval-x.json and eval-x.scored.jsonl are siblings."""
    return report.removesuffix(".json") + ".scored.jsonl"


def report(scored: DataFrame) -> dict[str, Any]:
    """overall, by_type, by_source and reliability. A report has a row a type and source, MOST_KEYS at most; more are an error:
    metrics.summary gives them as a table."""
    rows = [r.asDict() for r in metrics.summary(scored).orderBy("level", "key").limit(MOST_KEYS + 1).collect()]
    if len(rows) > MOST_KEYS:
        raise ValueError(f"a report of more than {MOST_KEYS} types and sources")
    by = lambda level: {r["key"]: {k: v for k, v in r.items() if k not in ("level", "key")} for r in rows if r["level"] == level}
    overall = by("overall")
    return {"overall": overall.get("", {"count": 0}), "by_type": by("type"), "by_source": by("source"), "reliability": [r.asDict() for r in metrics.reliability(scored).orderBy("bin").collect()]}


def write_report(scored: DataFrame, path: str) -> dict[str, Any]:
    """A report as one JSON text, and its scored rows beside it; both by Spark's writers."""
    held = scored.persist()
    out = report(held)
    spark = scored.sparkSession
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    write_scored(held, scored_path(path))
    held.unpersist()
    return out


def read_report(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def format_report(found: dict[str, Any]) -> str:
    rows = [{"level": "overall", "key": ""} | found["overall"]]
    rows += [{"level": level[3:], "key": k} | v for level in ("by_type", "by_source") for k, v in found[level].items()]
    return markdown(rows, COLUMNS)


def format_sweep(node: str, rows: list[dict[str, Any]]) -> str:
    columns = ["min_probability", "routed", "routed_accuracy", "handed_over", "hand_over_rate"]
    return f"Threshold at {node}\n\n" + markdown(sorted(rows, key=lambda r: r["min_probability"]), columns)


def run_table(spark: SparkSession, reports: dict[tuple[str, str], dict[str, Any]]) -> DataFrame:
    """run by split: accuracy / Brier / ECE cells, a dash where a run has no such report."""
    rows = []
    for (run, split), found in reports.items():
        o = found["overall"]
        rows.append((run, split, " / ".join(cell(o.get(k)) for k in ("accuracy", "brier", "ece"))))
    each = spark.createDataFrame(rows, "run string, split string, cell string")
    return each.groupBy("run").pivot("split", sorted({s for _, s in reports})).agg(F.first("cell")).na.fill("-")


def save_thresholds(thresholds: DataFrame, path: str, **settings: float) -> None:
    """Thresholds (a row a type) and the settings they were fitted with, as one JSON text."""
    types = {r["qtype"]: {k: v for k, v in r.asDict().items() if k != "qtype"} for r in thresholds.collect()}
    out = json.dumps(settings | {"types": types}, sort_keys=True)
    thresholds.sparkSession.createDataFrame([(out,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_thresholds(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    raw = json.loads(spark.read.text(path).first()[0])
    rows = [(k, v["count"], v["set_threshold"], v["act_threshold"]) for k, v in raw.pop("types").items()]
    return spark.createDataFrame(rows, "qtype string, count long, set_threshold double, act_threshold double"), raw


def temperature_of(config: str | None) -> float:
    """The temperature that a model's JSON config states, 1 without one."""
    return float((json.loads(config) if config else {}).get("temperature") or 1.0)


TIERS = {"decoder_config.json": "decoder", "encoder_config.json": "encoder", "seq2seq_config.json": "seq2seq"}


def tier_of(spark: SparkSession, folder: str, tiers: dict[str, str] = TIERS) -> str | None:
    """What kind of model a folder holds, by the config file that is there; null if none is."""
    return next((tier for name, tier in tiers.items() if files.exists(spark, f"{folder.rstrip('/')}/{name}")), None)


def abstention_cell(thresholds: dict[str, dict[str, Any]] | None, qtype: str) -> str:
    """Act rate and the error among what is acted on, a dash where nothing is fitted or nothing acts."""
    found = (thresholds or {}).get(qtype) or {}
    rate, error = found.get("act_rate"), found.get("act_error")
    return "-" if not rate else f"{100 * rate:.0f}% at {'-' if error is None or error != error else f'{100 * error:.1f}%'}"


def latency_cell(latencies: dict[int, float] | None, questions: list[int]) -> str:
    """Mean milliseconds for each number of questions, a dash where it was not measured."""
    shown = [cell((latencies or {}).get(n), 1) for n in questions]
    return "-" if set(shown) <= {"-"} else " / ".join(shown) + " ms"


def run_summary(temperature: float, reports: dict[str, dict[str, Any]], types: list[str]) -> dict[str, Any]:
    """What a whole run came to: counts and accuracy of each evaluation, and the types that may act."""
    return {"temperature": temperature, "evaluations": {k: {m: v["overall"].get(m) for m in ("count", "accuracy", "ece")} for k, v in reports.items()}, "conformal_types": sorted(types)}
