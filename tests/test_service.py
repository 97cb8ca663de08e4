"""Graphs as rows, registries and batchers with keyed state: against the driver-side graphs and plain folds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from decidra.operators import graph as DG
from decidra.operators import graph_tables as G
from decidra.streaming import batcher, registry
from decidra.streaming.requests import in_steps

ASK = {"type": "bool", "instructions": "?"}
ENDS = {"end": {"outcome": "end"}, "other": {"outcome": {"a": 1}}}


def random_graph(rng):
    """A graph of some layers, sound or with one fault or more."""
    n = rng.randint(1, 6)
    names = [f"n{i}" for i in range(n)]
    nodes = dict(ENDS)
    for i, name in enumerate(names):
        ahead = names[i + 1 :] + list(ENDS)
        pick = lambda ahead=ahead: rng.choice(ahead if rng.random() < 0.95 else [*names, "lost"])
        kind = rng.choice([ASK, {"type": "choice", "instructions": "which?", "options": {"a": None, "b": "bee", "c": None}}, {"type": "score", "instructions": "how?", "levels": ["lo", "hi"]}])
        keys = {"bool": ["yes", "no"], "choice": ["a", "b", "c"], "score": ["0", "1"]}[kind["type"]]
        node = {"question": kind, "edges": {k: pick() for k in keys if rng.random() < 0.7}}
        if rng.random() < 0.03:
            node["edges"]["maybe"] = "end"
        for field, value in (("default", pick), ("fallback", pick), ("min_probability", lambda: 0.6), ("min_evidence", lambda: 0.4), ("require_act", lambda: True)):
            if rng.random() < 0.35:
                node[field] = value()
        nodes[name] = node if rng.random() > 0.02 else {"edges": {}}
    return {"start": "n0" if rng.random() > 0.05 else "nowhere", "nodes": nodes}


def reason(raw):
    try:
        DG.Graph.parse(raw)
    except DG.InvalidGraph as e:
        return str(e).partition(": ")[0]
    return None


ACT = {"bool": 0.7, "choice": 0.5}


def test_many_graphs_are_refused_and_walked_like_one(spark):
    """Each random graph as a row gives what its compiled column gives on the driver."""
    rng = random.Random(11)
    graphs = {i: random_graph(rng) for i in range(120)}
    answers = {}
    for i, g in graphs.items():
        for name, x in g["nodes"].items():
            if x.get("question"):
                n = {"bool": 2, "choice": 3, "score": 2}[x["question"]["type"]]
                w = [rng.choice([1, 1, 2, 5]) for _ in range(n)]
                answers[i, name] = ([v / sum(w) for v in w], rng.choice([0.2, 0.9]))
    bodies = spark.createDataFrame([(i, json.dumps(g)) for i, g in graphs.items()], "request long, body string")
    given = spark.createDataFrame([(i, n, p, e) for (i, n), (p, e) in answers.items()], "request long, node string, probs array<double>, evidence double")
    got = {r.request: r for r in G.decide(bodies, given, ACT).collect()}
    assert got.keys() == graphs.keys()
    order = [DG.TOO_MANY, DG.NO_START, DG.EMPTY_NODE, DG.LOST_TARGET, DG.LOST_OPTION, DG.CYCLE]
    assert {r.detail for r in got.values()} >= set(order[1:]) and sum(r.status == 200 for r in got.values()) > 40
    kind = "struct<probs: array<double>, evidence: double>"
    for i, g in list(graphs.items()):
        assert got[i].detail == reason(g)
    sound = [i for i in graphs if got[i].status == 200][:25]
    for i in sound:
        names = [n for n in graphs[i]["nodes"] if (i, n) in answers]
        row = spark.createDataFrame([(tuple(answers[i, n] for n in names),)], f"answers struct<{', '.join(f'{n}: {kind}' for n in names)}>")
        want = row.select(DG.walk(DG.Graph.parse(graphs[i]), F.col("answers"), ACT).alias("w")).first().w
        said = lambda w: w.outcome and w.outcome.replace(" ", "")  # objects are written without blanks where Spark reads them
        assert (got[i].node, said(got[i]), got[i].complete, got[i].path) == (want.node, said(want), want.complete, want.path)
        assert got[i].path_probability == pytest.approx(want.path_probability) and (got[i].stopped is None) == (want.stopped is None)


def test_odd_graphs(spark):
    many = {"start": "a", "nodes": {"a": {"question": ASK, "default": "e0"}, **{f"e{i}": {"outcome": i} for i in range(300)}}}
    loop = {"start": "a", "nodes": {"a": {"question": ASK, "edges": {"yes": "a"}}}}
    rows = [
        (1, None), (2, "no json"), (3, "{}"), (4, json.dumps(many)), (5, json.dumps(loop)), (6, json.dumps({"start": "end", "nodes": ENDS})),
        (7, json.dumps({"start": "a", "nodes": {"a": {"question": {"type": "choice", "instructions": "?", "options": {"one": None}}, "default": "end"}, **ENDS}})),
        (8, json.dumps({"start": "a", "nodes": {"a": {"question": ASK, "default": "end"}, **ENDS}})), (9, json.dumps({"start": "a", "nodes": {"a": {"question": ASK}, **ENDS}})),
        (10, json.dumps({"start": "a", "nodes": {"a": {"question": ASK, "default": "end"}, **ENDS}})),
    ]
    bodies = spark.createDataFrame([(*r, "mine") for r in rows], "request long, body string, node string")
    answers = spark.createDataFrame([(8, "a", [0.5, 0.5], 1.0), (9, "a", [0.5, 0.5], None), (99, "a", [1.0, 0.0], 1.0)], "request long, node string, probs array<double>, evidence double")
    got = {r.request: r for r in G.decide(bodies, answers).collect()}
    assert [got[i].detail for i in range(1, 9)] == [G.UNREADABLE] * 3 + [G.TOO_MANY, G.CYCLE, G.NO_QUESTION, G.UNSOUND, None]
    assert (got[8].outcome, got[8].path_probability) == ("end", 0.5) and got[8].path[0].chosen == "yes"
    assert not got[9].complete and got[9].stopped == "no edge for option 'yes'"
    assert not got[10].complete and got[10].stopped == "no answer that fits the question" and got[10].path == []
    assert G.decide(bodies.limit(0), answers).collect() == []


def test_a_long_chain_and_a_hot_graph(spark):
    """Two hundred steps, and many requests with one graph."""
    n = 200
    chain = {f"c{i}": {"question": ASK, "edges": {"yes": f"c{i + 1}" if i < 6 else "end"}, "default": "other"} for i in range(7)} | ENDS
    bodies = spark.range(3000).select(F.col("id").alias("request"), F.lit(json.dumps({"start": "c0", "nodes": chain})).alias("body"))
    answers = bodies.select("request", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    p = F.when(F.col("request") % 7 == F.col("i"), 0.0).otherwise(1.0)
    given = answers.select("request", F.concat(F.lit("c"), F.col("i").cast("string")).alias("node"), F.array(p, 1 - p).alias("probs"), F.lit(1.0).alias("evidence"))
    got = G.decide(bodies, given).groupBy(F.size("path").alias("n"), "outcome").count().collect()
    assert {(r.n, r.outcome) for r in got} == {(i + 1, '{"a":1}') for i in range(7)}
    ways = spark.createDataFrame([("g", f"c{i}", f"c{i + 1}") for i in range(n % 9)] + [("h", "a", "b"), ("h", "b", "c"), ("h", "c", "b"), ("h", "x", "y")], "graph string, node string, target string")
    assert {tuple(r) for r in G.leading_to_cycles(ways).collect()} == {("h", "a"), ("h", "b"), ("h", "c")}


# --- registries


def agent(name, version, outcome="y"):
    graph = {"start": "q", "nodes": {"q": {"question": ASK | {"instructions": str(version)}, "edges": {"yes": "y"}}, "y": {"outcome": "y"}}}
    return json.dumps({"name": name, "graph": graph, "actions": {outcome: "go"}})


def log(rng, n):
    rows = []
    for i in range(n):
        op, name = rng.choice(["register", "register", "run", "show", "list", "delete", "shout"]), rng.choice(["a", "b", "c", None])
        body = agent(name, i, rng.choice(["y", "y", "y", "z"])) if op == "register" and name else rng.choice([None, "{"])
        rows.append((rng.choice(["r1", "r2"]), i, op, name, body))
    return rows


def plain(rows, most):
    agents, out = {}, {}
    for r, i, op, name, body in rows:
        own = agents.setdefault(r, {})
        if op == "list":
            out[i] = (200, None, sorted(own))
        elif op == "register":
            ok = name and json.loads(body)["actions"].keys() == {"y"} and (name in own or len(own) < most)
            if ok:
                own[name] = body
            out[i] = (200, body, None) if ok else (422, None, None)
        elif op == "shout":
            out[i] = (405, None, None)
        else:
            out[i] = (200, own[name], None) if name in own else (404, None, None)
            if op == "delete":
                own.pop(name, None)
    return out


@pytest.mark.parametrize("most", [2, 256])
def test_registry_sees_the_agents_of_its_moment(spark, most):
    rows = log(random.Random(most), 160)
    df = spark.createDataFrame(rows, "registry string, seq long, op string, name string, body string")
    want = plain(rows, most)
    assert {r.seq: (r.status, r.agent, r.names) for r in registry.replay(df, most).collect()} == want
    for steps in (1, 4):  # every step stops the query and starts it from its checkpoint
        out = in_steps(spark, df, "seq", steps, lambda s: registry.follow(s, most), "r")
        assert {r.seq: (r.status, r.agent, r.names) for r in out.collect()} == want
    assert in_steps(spark, df.limit(0), "seq", 2, registry.follow, "none").collect() == []


# --- batches


def plain_batches(rows, size, budget, wait):
    out, now = [], {}
    for lane, request, tokens, at in rows:
        b = now.get(lane)
        if b and (len(b[0]) >= size or b[1] + tokens > budget or at - b[2] > wait):
            out.append((lane, tuple(b[0]), b[1]))
            b = None
        b = b or [[], 0, at]
        b[0].append(request)
        b[1] += tokens
        now[lane] = b
    return sorted(out + [(lane, tuple(b[0]), b[1]) for lane, b in now.items()])


@pytest.mark.parametrize(("size", "budget", "wait"), [(4, 10**9, 1e9), (100, 50, 1e9), (100, 10**9, 3.0), (3, 40, 4.0)])
def test_batches_do_not_depend_on_micro_batches(spark, size, budget, wait):
    rng = random.Random(size)
    rows, at = [], 0.0
    for i in range(120):
        at += rng.choice([0.0, 0.5, 2.0])
        rows.append((rng.choice("ab"), i, rng.choice([1, 10, 60]), at))
    ends = [(lane, None, 0, float("inf"), 119) for lane in "ab"]
    df = spark.createDataFrame([(*r, r[1]) for r in rows] + ends, "lane string, request long, tokens long, at double, seq long")
    want = plain_batches(rows, size, budget, wait)
    for steps in (1, 5):
        out = in_steps(spark, df, "seq", steps, lambda s: batcher.batched(s, size, budget, wait), "b").collect()
        assert sorted((r.lane, tuple(r.requests), r.tokens) for r in out) == want
        for lane in "ab":
            assert sorted(r.batch for r in out if r.lane == lane) == list(range(sum(x[0] == lane for x in want)))
    assert {r.why for r in out} <= {"size", "tokens", "time", "flush"}


def test_an_idle_batch_is_closed_by_the_timer(spark, tmp_path):
    """A live stream: nothing comes after the first rows, and the timer hands the batch over."""
    rows = spark.createDataFrame([("a", i, 1, 0.0) for i in range(3)], "lane string, request long, tokens long, at double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = batcher.batched(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), idle_ms=5)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        for i in range(60):
            if spark.table("idle").count():
                break
            query.awaitTermination(1)
            if i == 5:  # micro-batches without rows of lane a
                spark.createDataFrame([("b", 9, 1, 0.0)], rows.schema).write.mode("append").parquet(f"{tmp_path}/in")
        found = [r for r in spark.table("idle").collect() if r.lane == "a"]
        assert [(sorted(r.requests), r.why) for r in found] == [([0, 1, 2], "idle")]
    finally:
        query.stop()


def test_windows_keep_the_last_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y"]), i, rng.choice(["ok", "ok", "error"]), rng.choice([None, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "route string, seq long, status string, value double")
    out = in_steps(spark, df, "seq", 4, lambda s: batcher.windows(s, 10), "w")
    last = {r.route: r for r in out.orderBy("step").collect()}
    for route in ("x", "y"):
        good = [r for r in rows if r[0] == route and r[2] == "ok"]
        values = sorted([r[3] for r in good if r[3] is not None][-10:])
        assert (last[route].requests, last[route].errors, last[route].kept) == (len(good), sum(r[0] == route and r[2] != "ok" for r in rows), 10)
        assert [last[route].p50, last[route].p95, last[route].p99] == [values[5], values[9], values[9]]


# --- routes


def service(spark, rows, **more):
    from decidra.streaming.routes import respond

    df = spark.createDataFrame([(i, "POST", path, None, body if body is None or isinstance(body, str) else json.dumps(body)) for i, (path, body) in enumerate(rows)], "request long, method string, path string, authorization string, body string")
    return {r.request: (r.status, json.loads(r.body), r.route) for r in respond(df, answered, "own", **more).collect()}


def answered(asked):
    """The longer the state, the surer of the first option."""
    p = F.least(F.lit(0.9), F.length("state") / 20)
    n = F.size("keys")
    rest = F.transform(F.sequence(F.lit(1), n - 1), lambda _: (1 - p) / (n - 1))
    return asked.withColumn("probs", F.concat(F.array(p), rest)).withColumn("evidence", F.lit(0.5))


QUESTIONS = {"b": {"type": "noul", "instructions": "?"}, "c": {"type": "choice", "instructions": "?", "criteria": {"x": None, "y": "z"}}, "s": {"type": "score", "instructions": "?", "criteria": ["lo", "hi"]}}


def test_grouped_and_batched_requests(spark):
    one = {"state": "x" * 8, "questions": QUESTIONS}
    bad = {"state": "x", "questions": {"q": {"type": "bool", "instructions": " "}}}
    many = {"requests": [{"state": "x", "questions": {f"q{i}": ASK for i in range(255)}}] * 3}
    rows = [
        ("/v1/decide/grouped", one), ("/v1/decide/grouped", bad), ("/v1/decide/batch", {"requests": [one, bad, {"state": "", "questions": {"c": QUESTIONS["c"]}}]}), ("/v1/decide/batch", {"requests": []}),
        ("/v1/decide/batch", None), ("/v1/decide/batch", {"requests": [one] * 129}), ("/v1/decide/batch", many), ("/v1/decide/batch", {"requests": [one] * 60}), ("/v1/decide/batch", {"requests": [3, None]}),
    ]
    got = service(spark, rows)
    assert [got[i][0] for i in range(9)] == [200, 422, 200, 422, 422, 422, 422, 200, 200]
    whole = got[0][1]
    assert whole["nouls"]["b"]["noul"] == whole["nouls"]["b"]["p_true"] == 0.5 and whole["choices"]["c"]["choice"] == "x" and whole["scores"]["s"]["score"] == 0.5
    results = got[2][1]["results"]
    assert results[0] == whole and results[1]["status"] == 422 and "detail" in results[1] and results[2]["choices"]["c"]["probabilities"]["x"] == 0.1
    assert got[2][1]["usage"] == {"requests": 3, "decisions": 5} and "129 requests" in got[5][1]["detail"] and "765 decisions" in got[6][1]["detail"]
    assert len(got[7][1]["results"]) == 60 and all(r == whole for r in got[7][1]["results"])
    assert [r["status"] for r in got[8][1]["results"]] == [422, 422]


def test_graph_requests_and_pages(spark):
    graph = {"start": "a", "nodes": {"a": {"question": ASK, "edges": {"yes": "b"}, "default": "other"}, "b": {"question": QUESTIONS["c"], "edges": {"x": "end"}, "min_probability": 0.8, "fallback": "other"}, **ENDS}}
    loop = {"start": "a", "nodes": {"a": {"question": ASK, "edges": {"yes": "b", "no": "b"}}, "b": {"question": ASK, "edges": {"yes": "a", "no": "a"}}}}
    rows = [("/v1/decide_graph", {"state": "x" * n, "graph": graph}) for n in (2, 12, 18)] + [("/v1/decide_graph", {"state": "x", "graph": loop}), ("/v1/decide_graph", None), ("/v1/agents", {}), ("/metrics", None)]
    got = service(spark, rows, stats={"requests": 3}, metrics="m 1\n")
    assert [got[i][0] for i in range(7)] == [200, 200, 200, 422, 422, 409, 405] and "cycle" in got[3][1]["detail"]
    assert json.loads(got[0][1]["outcome"]) == {"a": 1} and [s["node"] for s in got[1][1]["path"]] == ["a", "b"] and got[1][1]["path"][1]["guard"].startswith("probability 0.70")
    assert got[2][1]["outcome"] == "end" and got[2][1]["path_probability"] == 0.81 and got[2][1]["complete"]


def test_agents_through_requests(spark):
    from decidra.streaming import routes

    raw = json.loads(agent("a", 1))
    calls = [("POST", "/v1/agents", raw), ("POST", "/v1/agents/a/run", {"state": "x" * 30}), ("GET", "/v1/agents", None), ("POST", "/v1/agents", raw | {"actions": {"y": {"action": "stop", "arguments": {"n": 1}}}}),
             ("POST", "/v1/agents/a/run", {"state": "x" * 30}), ("DELETE", "/v1/agents/a", None), ("POST", "/v1/agents/a/run", {"state": ""}), ("GET", "/v1/agents/a", None), ("POST", "/v1/agents", {"name": "b"}), ("GET", "/v1/agents/b/c", None)]
    rows = [(i, t, m, p, None, b and json.dumps(b)) for i, (m, p, b) in enumerate(calls) for t in ("t1",)]
    df = spark.createDataFrame(rows, "seq long, tenant string, method string, path string, authorization string, body string")
    log_ = routes.agent_log(df, "tenant", "seq")
    streamed = in_steps(spark, log_, "seq", 3, registry.follow, "agents")
    for found in (registry.replay(log_), streamed):
        got = {r.request: (r.status, json.loads(r.body)) for r in routes.agent_responses(found, answered, "own").collect()}
        assert {i: s for i, (s, _) in got.items()} == {0: 200, 1: 200, 2: 200, 3: 200, 4: 200, 5: 200, 6: 404, 7: 404, 8: 422}
        assert got[1][1]["action"] == "go" and got[4][1]["action"] == "stop" and json.loads(got[4][1]["arguments"]) == {"n": 1} and got[1][1]["outcome"] == "y"
        assert got[2][1] == {"agents": ["a"]} and got[5][1] == {"deleted": "a"}


def test_routes_are_found_once_and_requests_of_one_task_are_spread(spark):
    """Routes stood in the plan of every answer, whose generated code did not compile; and one task answered a small file."""
    from decidra.streaming.routes import respond

    bodies = "concat('{\"state\": \"', id, '\", \"questions\": {\"a\": {\"type\": \"bool\", \"instructions\": \"Is it?\"}}}')"
    some = spark.range(0, 4000, 1, 1).selectExpr("id AS request", "'POST' AS method", "if(id % 2 = 0, '/v1/decide', '/nowhere') AS path", "'' AS authorization", f"{bodies} AS body")
    answer = lambda asked: asked.selectExpr("*", "array(0.5D, 0.5D) AS probs", "0.5D AS evidence")
    out = respond(some, answer, "m")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "/v1/" not in plan and "from_json" not in plan
    assert {(r["route"], r["status"], r["count"]) for r in out.groupBy("route", "status").count().collect()} == {("decide", 200, 2000), (None, 404, 2000)}
    assert out.rdd.getNumPartitions() > 1
