import json

from pyspark.sql import functions as F
from test_metrics import item, scored

from decidra.operators import conformal, tasks
from decidra.plans import reports
from decidra.sources import forms


def test_report_round_trip(spark, tmp_path):
    df = scored(spark, [item([0.7, 0.3], 0), item([0.2, 0.3, 0.5], 2, "score", "t")])
    path = str(tmp_path / "eval-x.json")
    out = reports.write_report(df, path)
    assert reports.read_report(spark, path)["overall"]["count"] == 2 and out["overall"]["accuracy"] == 1.0
    assert spark.read.json(reports.scored_path(path)).count() == 2
    assert "| overall |" in reports.format_report(out)
    table = reports.run_table(spark, {("a", "dev"): out, ("b", "test"): out}).orderBy("run").collect()
    assert table[0].dev.startswith("1.000 / ") and table[0].test == "-"
    assert reports.report(df.limit(0))["overall"] == {"count": 0}


def test_thresholds_round_trip(spark, tmp_path):
    t = conformal.fit(scored(spark, [item([0.9, 0.1], 0)] * 30))
    reports.save_thresholds(t, str(tmp_path / "t"), alpha=0.1, temperature=1.5)
    back, settings = reports.load_thresholds(spark, str(tmp_path / "t"))
    assert settings == {"alpha": 0.1, "temperature": 1.5} and [tuple(r) for r in back.collect()] == [tuple(r) for r in t.collect()]
    assert reports.temperature_of(None) == 1.0 and reports.temperature_of('{"temperature": 2}') == 2.0
    assert reports.format_sweep("n", [{"min_probability": 0.5, "routed": 1}]).endswith("| 0.500 | 1 | - | - | - |")


def test_forms(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{broken",), ('say "hi"',), (" [1, 2] ",)], "t string")
    assert [json.loads(r[0]) for r in df.select(forms.form_state(F.col("t"))).collect()] == [{"a": 1}, "{broken", 'say "hi"', [1, 2]]
    got = spark.createDataFrame([("a: x: y\n\n b \n",)], "t string").select(forms.form_options(F.col("t"))).first()[0]
    assert [tuple(r) for r in got] == [("a", "x: y"), ("b", None)]


def test_requests(spark):
    q = {"type": "choice", "instructions": "i", "options": {"a": None, "b": None}}
    bodies = [(1, json.dumps({"state": {"k": 1}, "questions": {"x": q, "y": {"type": "noul", "instructions": "j"}}})), (2, "nonsense"), (3, json.dumps({"state": "s", "questions": {f"q{i}": q for i in range(256)}}))]
    rows = forms.parse_requests(spark.createDataFrame(bodies, "request int, body string"))
    found = {(r.request, r.name): r for r in rows.collect()}
    assert found[1, "x"]["keys"] == ["a", "b"] and found[1, "y"].qtype == "bool" and json.loads(found[1, "x"].state) == {"k": 1}
    assert found[2, None].problem == "no questions" and found[3, None].problem == "too many questions"
    assert forms.within_limits(rows).first().ok


def test_task_helpers(spark):
    df = spark.createDataFrame([("['a', 'b']", "0", "Human: x\nAssistant: y\nAssistant: z", 3, 1), ('["c"]', "-1", "none", 0, 0), (None, "REFUTES", "", 1, 1)], "l string, n string, d string, a int, b int")
    before, behind = tasks.last_turn(F.col("d"), "Assistant:")
    rows = df.select(tasks.parsed_list(F.col("l")).alias("l"), tasks.entailment(F.col("n")).alias("n"), before.alias("p"), behind.alias("q"), tasks.vote_target(F.col("a"), F.col("b")).alias("v"), tasks.lettered(F.array(F.lit("u"), F.lit("w"))).alias("o")).collect()
    assert [r.l for r in rows] == [["a", "b"], ["c"], None] and [r.n for r in rows] == [0, None, 2]
    assert (rows[0].p, rows[0].q, rows[1].p, rows[1].q) == ("Human: x\nAssistant: y", "z", "none", "")
    assert rows[0].v == [0.75, 0.25] and rows[1].v is None and [tuple(x) for x in rows[0].o] == [("a", "u"), ("b", "w")]
    bank = tasks.rubric_bank()
    assert len(bank) == 33 and {q.type for q in bank.values()} == {"bool", "score", "choice"}
    assert spark.range(1).select(tasks.label_name(["Sci/Tech", "World-News"], F.lit(1))).first()[0] == "world_news"
    t = spark.range(1).select(tasks.value_target(F.lit(2.5), 0.0, 5.0, 3)).first()[0]
    assert max(t) == t[1]
