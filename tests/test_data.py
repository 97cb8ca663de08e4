import json
import random

import pytest
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.operators import datasets as D
from decidra.operators import scoring, serving, synthetic
from decidra.plans import pipeline as P
from decidra.plans import reports
from decidra.sources import hub, remote
from decidra.streaming import requests as RQ
from decidra.streaming import turns as T


@pytest.mark.parametrize("size,budget,wait", [(3, 9, None), (2, 50, None), (5, 4, None), (4, 50, 1.5)])
def test_batches(spark, size, budget, wait):
    sizes = [1, 4, 4, 2, 7, 1, 1, 1, 12, 3]
    df = spark.createDataFrame([(g, i, k, i * 0.5) for g in "ab" for i, k in enumerate(sizes)], "g string, i long, k int, t double")
    at = {} if wait is None else {"at": F.col("t"), "wait": wait}
    got = {(r.g, r.i): r.batch for r in D.make_batches(df, "g", "i", F.col("k"), size, budget, **at).collect()}
    for g in "ab":
        want, n, total, since = [0], 1, sizes[0], 0.0
        for i, k in enumerate(sizes[1:], 1):
            if n >= size or total + k > budget or (wait is not None and i * 0.5 - since > wait):
                want.append(want[-1] + 1)
                n, total, since = 0, 0, i * 0.5
            else:
                want.append(want[-1])
            n, total = n + 1, total + k
        assert [got[g, i] for i in range(len(sizes))] == want


def test_mask_rules(spark):
    blocks = [-1, -1, 0, 0, 1, 1, -2]
    mask = spark.createDataFrame([(blocks,)], "b array<int>").select(scoring.attention_mask(F.col("b"))).first()[0]
    for q in range(7):
        for k in range(7):
            want = k == q or (k <= q and blocks[k] != -2 and (blocks[k] == -1 or blocks[k] == blocks[q]))
            assert mask[q][k] == want


def test_splits_and_swaps(spark):
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 3).alias("y"))
    task = D.Task("t", "bool", ("yes", "no"), ("one?", "two?"), F.col("text"), F.when(F.col("y") < 2, F.col("y")), max_train=40, max_eval=11)
    ex = D.build(df, task, 1)
    assert ex.count() == 67 and ex.where("label_index not in (0, 1)").count() == 0
    got = D.splits(ex, task, 1)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"calibration": 5, "dev": 6, "train": 40}
    for split, n in counts.items():
        assert sorted(r.number for r in got.where(F.col("split") == split).collect()) == list(range(n))
    swapped = D.swap_passages(ex, 0.25, 2)
    lost = swapped.where("not answerable")
    assert lost.count() == 16 and lost.join(ex.select("id", F.col("state").alias("s")), "id").where("state = s").count() == 0
    assert D.swap_passages(ex.limit(1), 0.9, 2).count() == 1


def test_majority_and_counts(spark):
    df = spark.createDataFrame([([2, 2, 1],), ([5, 0, 1],), ([0, 0, 0],)], "c array<int>")
    rows = df.select(D.majority(F.col("c")).alias("m"), D.majority(F.col("c"), 0).alias("n"), D.count_target(F.col("c")).alias("t")).collect()
    assert [r.m for r in rows] == [0, 0, 0] and [r.n for r in rows][:2] == [1, 2]
    assert rows[0].t == [0.4, 0.4, 0.2] and rows[2].t is None
    assert spark.range(1).select(D.yes_target(F.lit(1.5))).first()[0] == [1.0, 0.0]


def test_teacher_and_resume(spark):
    df = spark.createDataFrame([(1, "bool", ["yes", "no"], [0.2, 0.8]), (2, "score", ["0", "1"], [0.5, 0.5]), (3, "choice", ["a", "b"], [0.1, 0.9])], "id long, qtype string, keys array<string>, probs array<double>")
    assert [r.label for r in D.teacher_examples(df).orderBy("id").collect()] == ["false", "0", "b"]
    assert [r.id for r in D.not_done(df, df.where("id < 3"), "id").collect()] == [3]


def test_policies(spark):
    tests = [synthetic.Test("a", "gt", 5), synthetic.Test("b", "in", ("x", "y")), synthetic.Test("a", "between", (1, 3)), synthetic.Test("b", "same", "c"), synthetic.Test("c", "has_word", "x")]
    df = spark.createDataFrame([(a, b, c) for a in range(8) for b in "xyz" for c in ("x", "y w", "z")], "a int, b string, c string")
    plain = {"gt": lambda r, t: r[t.fact] > t.value, "in": lambda r, t: r[t.fact] in t.value, "between": lambda r, t: t.value[0] <= r[t.fact] <= t.value[1], "same": lambda r, t: r[t.fact] == r[t.value], "has_word": lambda r, t: t.value in r[t.fact].split(" ")}

    def holds(rule, r):
        if isinstance(rule, synthetic.Test):
            return plain[rule.op](r, rule)
        found = [holds(p, r) for p in rule.parts]
        return {"all": all, "any": any, "not": lambda x: not x[0]}[rule.how](found)

    rng = random.Random(4)
    for _ in range(5):
        picked = [synthetic.Rule("not", (t,)) if rng.random() < 0.3 else t for t in rng.sample(tests, 4)]
        rule = synthetic.Rule(rng.choice(["all", "any"]), (synthetic.Rule(rng.choice(["all", "any"]), tuple(picked[:2])), *picked[2:]))
        out = synthetic.policy_cases(df, rule, "a", [0, 2, 7]).collect()
        for r in out:
            d = r.asDict()
            assert (r.verdict == "approve") == holds(rule, d)
            assert r.answerable == all(holds(rule, d | {"a": v}) == holds(rule, d) for v in (0, 2, 7))
        assert rule.text() and set(rule.facts()) <= {"a", "b", "c"}


def test_serving_numbers(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(3000)] + [("one", 1, 5.0)], "k string, t int, v double")
    got = {r.k: r for r in serving.latency_quantiles(df, "k", "v", ["t"]).collect()}
    assert (got["k"].requests, got["k"].p50, got["k"].p99) == (3000, 1976.0 + 512, 1976.0 + 1013) and got["one"].p95 == 5.0
    req = spark.createDataFrame([("ok",), ("ok",), ("error",), ("rejected",)], "status string")
    row = serving.snapshot(req, spark.createDataFrame([(4,), (2,)], "size int")).first().asDict()
    assert row == {"requests": 2, "errors": 1, "rejected": 1, "batches": 2, "mean_batch_size": 3.0}
    assert "decisions_requests_total 2" in serving.prometheus(row, {"p50": 1.0})
    answers = spark.createDataFrame([(1, "c", "choice", ["a", "b"], [0.1, 0.9]), (1, "n", "bool", ["yes", "no"], [0.7, 0.3]), (1, "s", "score", ["0", "1"], [0.5, 0.5])], "request int, name string, qtype string, keys array<string>, probs array<double>")
    r = serving.answer_groups(answers).first()
    assert (r.choices, r.nouls, r.scores) == ({"c": "b"}, {"n": 0.7}, {"s": 0.5})


def test_remote_scorers(spark):
    body = {"completion_probabilities": [{"top_logprobs": [{"token": "A", "logprob": -1.0}, {"token": "B", "logprob": -1.0}]}]}
    assert remote.option_probabilities(remote.completion_logprobs(body), ["A", "B"]) == [0.5, 0.5]
    assert remote.generate_logprobs({"meta_info": {"output_top_logprobs": [[(-1.0, 5, "A")]]}}) == {"A": -1.0}
    with pytest.raises(remote.MissingLabel):
        remote.option_probabilities({"A": 0.0}, ["A", "B"])
    df = spark.createDataFrame([(1, "p", ["A", "B"])], "id long, prompt string, labels array<string>")
    assert remote.score_remote(df, lambda: lambda request: body, remote.completion_logprobs).first().probs == [0.5, 0.5]


def test_stages_are_skipped_when_done(spark, tmp_path):
    ran = []

    def make(name):
        def f(s, tables):
            ran.append(name)
            return s.range(3) if name == "a" else tables["a"].where("id > 0")

        return f

    stages = [P.Stage("a", make("a"), {"n": 1}), P.Stage("b", make("b"))]
    assert P.run(spark, stages, str(tmp_path))["b"].count() == 2
    P.run(spark, stages, str(tmp_path))
    assert ran == ["a", "b"]
    assert [(r.stage, r.done, r.rows) for r in P.manifest(spark, stages, str(tmp_path)).collect()] == [("a", True, 3), ("b", True, 2)]
    with pytest.raises(ValueError):
        P.run(spark, [stages[0], stages[0]], str(tmp_path))
    changed = [P.Stage("a", make("a"), {"n": 2}), stages[1]]
    P.run(spark, changed, str(tmp_path))
    assert ran == ["a", "b", "a", "b"]  # a config that changed makes its stage anew, and those behind it
    names = P.release(spark, str(tmp_path / "rel"), {"t": spark.range(2).withColumn("split", F.lit("train"))}, "card", {"v": 1})
    assert names == ["README.md", "metadata.json", "t"]
    assert P.markdown([{"a": 0.5, "b": None}], ["a", "b"]).endswith("| 0.500 | - |")


def test_checkpoints_are_not_replaced_by_less(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    P.save_checkpoint(spark.range(10000), path)
    P.save_checkpoint(spark.range(9999), path)
    with pytest.raises(ValueError):
        P.save_checkpoint(spark.range(3), path)
    assert spark.read.parquet(path).count() == 9999
    monkeypatch.setattr(P.files, "free", lambda s, p: 10)
    with pytest.raises(P.NoRoom):
        P.save_checkpoint(spark.range(9999), path)
    assert spark.read.parquet(path).count() == 9999


def test_hub_layouts(spark, tmp_path):
    root = tmp_path / "hub" / "set" / "v1" / "conf"
    root.mkdir(parents=True)
    (root / "train-00.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (root / "train-01.jsonl").write_text('{"a": 3}\n')
    (root / "test.csv").write_text('a,b\n1,"x, y"\n')
    load = lambda split: hub.load_rows(spark, str(tmp_path / "hub"), "set", split, config="conf", revision="v1")
    assert sorted(r.a for r in load("train").collect()) == [1, 2, 3] and load("test").first().b == "x, y"
    with pytest.raises(FileNotFoundError):
        load("dev")
    (root / "train-02.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        load("train")


def test_tier_and_cells(spark, tmp_path):
    assert reports.tier_of(spark, str(tmp_path)) is None
    (tmp_path / "encoder_config.json").write_text("{}")
    assert reports.tier_of(spark, str(tmp_path)) == "encoder"
    assert reports.abstention_cell({"bool": {"act_rate": 0.62, "act_error": 0.0871}}, "bool") == "62% at 8.7%"
    assert reports.abstention_cell(None, "bool") == reports.abstention_cell({"bool": {"act_rate": 0.0}}, "bool") == "-"
    assert reports.latency_cell({1: 17.25, 6: 20.0}, [1, 6, 24]) == "17.2 / 20.0 / - ms" and reports.latency_cell(None, [1]) == "-"
    assert reports.run_summary(1.5, {"dev": {"overall": {"count": 2, "accuracy": 1.0}}}, ["score", "bool"])["conformal_types"] == ["bool", "score"]


def test_admission(spark):
    from decidra.streaming.requests import admit

    df = spark.createDataFrame([(i % 5, i) for i in range(20)], "t int, id long")
    got = admit(df, ["t", "id"], queue=6).collect()
    first = {(r.t, r.id) for r in got if r.status == "accepted"}
    assert first == set(sorted((i % 5, i) for i in range(20))[:6]) and all((r.retry_after == 1) == (r.status == "rejected") for r in got)
    assert admit(df, ["t", "id"], queue=20).where("status = 'rejected'").count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(20).repartition(2).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")
    RQ.decide(stream, lambda df: df.withColumn("answer", F.col("id") * 2), out, str(tmp_path / "c1"), dead).awaitTermination()
    assert spark.read.parquet(out).count() == 20

    def fail(df):
        raise ValueError("no model")

    RQ.decide(stream, fail, out + "2", str(tmp_path / "c2"), dead).awaitTermination()
    lost = spark.read.parquet(dead)
    assert lost.count() == 20 and lost.first().problem == "no model"

    bad = F.when(F.col("id") == 13, F.raise_error(F.lit("unlucky"))).otherwise(F.col("id"))
    RQ.decide(stream, lambda df: df.withColumn("answer", bad.cast("long")), out + "3", str(tmp_path / "c3"), dead + "3").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out + "3").collect()) == [i for i in range(20) if i != 13]
    lost = spark.read.parquet(dead + "3").collect()
    assert [r.id for r in lost] == [13] and "unlucky" in lost[0].problem


def test_turns(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "again"), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.history, r.outcome) for r in T.decide_turns(df, lambda h, t: f"{len(h)}{t}").collect()}
    assert got == {(1, 0): (0, "0hi"), (1, 2): (3, "3again"), (2, 0): (0, "0")}
    df.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    live = RQ.drain(spark, T.decide_stream(stream, lambda h, t: f"{len(h)}{t}"), "turns_live")
    assert {(r.conv_id, r.turn): (r.history, r.outcome) for r in live.collect()} == got


def test_windows_drop_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 03:00:00", "a", 2.0), ("2024-01-01 05:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    got = RQ.drain(spark, RQ.windowed(stream, "ts", "k", "v"), "win_live").collect()
    assert sorted(r.total for r in got) == [1.0, 2.0]  # the last window is still open


def test_routes(spark):
    from decidra.streaming.routes import respond, routed

    sound = '{"state": "x", "questions": {"b": {"type": "noul", "instructions": "q"}, "a \\"": {"type": "score", "instructions": "q", "levels": ["l", "h"]}}}'
    rows = [
        (1, "post", "/v1/decide?x=1", "Bearer k", sound), (2, "POST", "/v1/decide", "k2", sound), (3, "POST", "/v1/decide", "k", "no json"), (4, "POST", "/v1/decide", "k", None),
        (5, "GET", "/health", None, None), (6, None, "/health", None, None), (7, "GET", None, None, None), (8, "GET", "/v1/agents/", "k", None), (9, "GET", "/v1/agents/t", "k", None),
        (10, "GET", "/v1/agents/t/run", "k", None), (11, "GET", "/v1/agents/u", "k", None), (12, "POST", "/v1/decide", "k", '{"questions": {"a": {"type": "score", "instructions": " ", "levels": [1, 2]}}}'),
    ]
    df = spark.createDataFrame(rows, "request long, method string, path string, authorization string, body string")
    answer = lambda t: t.withColumn("probs", F.array(F.lit(3.0), F.lit(1.0))).withColumn("evidence", F.lit(1.0))
    got = {r.request: r for r in respond(df, answer, 'm"', {"t": '{"name": "t"}'}, "k").collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 401, 3: 422, 4: 422, 5: 200, 6: 405, 7: 404, 8: 404, 9: 200, 10: 405, 11: 404, 12: 422}
    body = json.loads(got[1].body)
    assert body["model"] == 'm"' and body["answers"]["b"]["p_true"] == 0.75 and body["answers"]['a "']["score"] == 0.25
    assert all(json.loads(r.body) for r in got.values()) and json.loads(got[9].body) == {"name": "t"}
    assert respond(df.limit(0), answer, "m").count() == 0 and routed(df).where("status = 401").count() == 0


def test_label_readout(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2, -1, 0]), ([1.0, 2.0, 3.0], [9, -1])], "z array<double>, i array<int>")
    got = [r.p for r in df.select(A.label_readout(F.col("z"), F.col("i"), 2.0).alias("p")).collect()]
    assert got[0] == pytest.approx([0.7310585786, 0.0, 0.2689414214]) and got[1] is None
