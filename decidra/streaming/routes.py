"""Request rows to response rows: paths, authorisation and answers of a decision service.

A front end that speaks HTTP appends a row for each request and sends what comes back; everything between is
columns, so a batch of requests is one job however many there are. Works on a table or inside a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.operators import graph_tables as G
from decidra.schema import LIMITS
from decidra.sources.files import written
from decidra.sources.forms import parse_requests
from decidra.sources.records import answer_json, state_json

#: Fixed values, part of the interface: method, path and name of each route. {} is an agent's name.
ROUTES = [
    ("GET", "/health", "health"),
    ("GET", "/v1/models", "models"),
    ("POST", "/v1/decide", "decide"),
    ("POST", "/v1/decide/grouped", "grouped"),
    ("POST", "/v1/decide/batch", "batch"),
    ("POST", "/v1/decide_graph", "graph"),
    ("GET", "/metrics", "metrics"),
    ("GET", "/v1/stats", "stats"),
    ("GET", "/v1/agents", "agents"),
    ("GET", "/v1/agents/{}", "agent"),
    ("POST", "/v1/agents", "register"),
    ("DELETE", "/v1/agents/{}", "delete"),
    ("POST", "/v1/agents/{}/run", "run"),
]
#: Operations of a registry by route.
OPERATIONS = {"agents": "list", "agent": "show", "register": "register", "delete": "delete", "run": "run"}


def _hole(path: Column, pattern: str) -> Column:
    """What stands in the place of {} if the path fits the pattern, else null."""
    head, _, tail = pattern.partition("{}")
    inside = F.substring(path, len(head) + 1, F.length(path) - len(head) - len(tail))
    return F.when(path.startswith(head) & path.endswith(tail) & (F.length(path) > len(head) + len(tail)) & ~inside.contains("/"), inside)


def _matches(path: Column, pattern: str) -> Column:
    return _hole(path, pattern).isNotNull() if "{}" in pattern else path == pattern


def routed(requests: DataFrame, api_key: str | None = None) -> DataFrame:
    """requests (request, method, path, authorization, body) with route, and status where it is decided already.

    With an api_key every path below /v1/ needs it as a bearer token (401); health stays open. A path that no route
    has gives 404, a route's path with another method 405. What follows a question mark in a path is left out. Null
    methods and paths match nothing.
    """
    path = F.substring_index(F.coalesce(F.col("path"), F.lit("")), "?", 1)
    method = F.upper(F.coalesce(F.col("method"), F.lit("")))
    known, route = F.lit(False), F.lit(None).cast("string")
    for verb, pattern, name in ROUTES:
        fits = _matches(path, pattern)
        known, route = known | fits, F.when(fits & (method == verb), name).otherwise(route)
    status = F.when(~known, 404).when(F.col("route").isNull(), 405)
    if api_key:
        given = F.trim(F.regexp_replace(F.coalesce(F.col("authorization"), F.lit("")), "^Bearer ", ""))
        status = F.when(path.startswith("/v1/") & (given != api_key), 401).otherwise(status)
    return requests.withColumn("route", route).withColumn("status", status)


def _text(c: Column) -> Column:
    """c as a JSON string."""
    listed = F.to_json(F.array(c))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _detail(said: Column) -> Column:
    return F.concat(F.lit('{"detail": '), _text(said), F.lit("}"))


def decided(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str, grouped: bool = False) -> DataFrame:
    """request, status and body of requests (request, body) to decide.

    answer adds probs and evidence to rows of (request, state, name, qtype, instructions, keys). A request with a
    body that can't be parsed, too many questions or an unsound one gives 422, and none of its questions is asked.
    At most LIMITS["questions"] rows of a request are put together again: by name, or grouped as choices, nouls and scores.
    """
    parsed = parse_requests(requests)
    unsound = ~F.coalesce(F.col("qtype").isin("bool", "choice", "score") & (F.trim("instructions") != "") & F.size("keys").between(2, F.when(F.col("qtype") == "score", 10).otherwise(255)), F.lit(False))
    problem = F.coalesce(F.col("problem"), F.when(unsound, F.concat(F.lit("unsound question "), F.coalesce("name", F.lit("")))))
    parsed = written(parsed.withColumn("problem", problem))  # read twice
    bad = parsed.groupBy("request").agg(F.min("problem").alias("why")).where("why IS NOT NULL")
    asked = parsed.drop("problem").join(bad.select("request"), "request", "left_anti")
    scored = answer(asked).withColumn("probs", A.checked_probabilities(F.col("probs"), F.size("keys")))
    said = answer_json(F.col("qtype"), F.col("keys"), F.col("probs"), F.col("evidence"), F.col("keys"))
    pair = F.concat(_text(F.col("name")), F.lit(": "), said)
    listed = lambda held: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(held, F.struct("name", pair.alias("j"))))), lambda x: x["j"]), ", ")
    if grouped:
        noul = F.concat(_text(F.col("name")), F.lit(': {"noul": '), F.round(F.get("probs", F.lit(0)), 4).cast("string"), F.lit(", "), said.substr(F.lit(2), F.length(said)))
        pair = F.when(F.col("qtype") == "bool", noul).otherwise(pair)
        kinds = [("choices", "choice"), ("nouls", "bool"), ("scores", "score")]
        answers = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": {{'), listed(F.col("qtype") == kind), F.lit("}")) for name, kind in kinds])
    else:
        answers = F.concat(F.lit('"answers": {'), listed(F.lit(True)), F.lit("}"))
    whole = F.concat(F.lit('{"model": '), _text(F.lit(model)), F.lit(", "), F.col("a"), F.lit("}"))
    good = scored.groupBy("request").agg(answers.alias("a")).select("request", F.lit(200).alias("status"), whole.alias("body"))
    return good.unionByName(bad.select("request", F.lit(422).alias("status"), _detail(F.col("why")).alias("body")))


def decided_batches(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """request, status and body of envelopes (request, body) of several requests, as under the body's ``requests``.

    An envelope holds LIMITS["requests"] requests and LIMITS["decisions"] questions at most, else it gives 422 as a whole. One
    request that is unsound fails alone, in its place. Results are grouped by type, in the order of the requests.
    """
    inner = F.from_json("body", "requests array<string>")["requests"]
    size = lambda r: F.coalesce(F.size(F.json_object_keys(F.get_json_object(r, "$.questions"))), F.lit(0))
    opened = requests.select("request", inner.alias("inner")).withColumn("n", F.coalesce(F.size("inner"), F.lit(0)))
    opened = opened.withColumn("decisions", F.coalesce(F.aggregate(F.transform("inner", size), F.lit(0), lambda a, x: a + x), F.lit(0)))
    why = F.when(F.col("n") <= 0, "no requests")
    for name, count in (("requests", "n"), ("decisions", "decisions")):
        why = why.when(F.col(count) > LIMITS[name], F.concat(F.col(count).cast("string"), F.lit(f" {name}, the limit is {LIMITS[name]}")))
    opened = opened.withColumn("why", why)
    sound = opened.where("why IS NULL")
    each = sound.select("request", F.posexplode("inner").alias("at", "body")).select(F.struct("request", "at").alias("request"), "body")
    done = decided(each, answer, model, grouped=True)
    shown = F.when(F.col("status") == 200, F.col("body")).otherwise(F.concat(F.lit('{"status": '), F.col("status").cast("string"), F.lit(", "), F.col("body").substr(F.lit(2), F.length("body"))))
    rows = done.select("request.request", F.struct("request.at", shown.alias("j")).alias("x")).groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["j"]), ", ").alias("results"))
    usage = F.concat(F.lit('"usage": {"requests": '), F.col("n").cast("string"), F.lit(', "decisions": '), F.col("decisions").cast("string"), F.lit("}}"))
    body = F.concat(F.lit('{"model": '), _text(F.lit(model)), F.lit(', "results": ['), F.col("results"), F.lit("], "), usage)
    good = rows.join(sound.select("request", "n", "decisions"), "request").select("request", F.lit(200).alias("status"), body.alias("body"))
    return good.unionByName(opened.where("why IS NOT NULL").select("request", F.lit(422).alias("status"), _detail(F.col("why")).alias("body")))


def walked(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], act: dict[str, float] | None = None) -> DataFrame:
    """request, status, detail and the walk (graph_tables.ENDED) of requests (request, state, graph): all questions of a graph
    that is not refused are asked at once, then its nodes are followed."""
    bodies = requests.select("request", F.col("graph").alias("body"))
    g = G.read(bodies)
    named = requests.select("request", "state", G.graph_key(F.col("graph")).alias("graph"))
    sound = named.join(G.refused(g), "graph", "left_anti")
    asked = sound.join(g.nodes.where("qtype IS NOT NULL"), "graph").select("request", "state", F.col("node").alias("name"), "qtype", "instructions", "keys")
    answers = answer(asked).select("request", F.col("name").alias("node"), "probs", "evidence")
    return G.decide(bodies, answers, act)


def decided_graphs(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str, act: dict[str, float] | None = None) -> DataFrame:
    """request, status and body of requests (request, body) that bring a state and a graph."""
    rows = requests.select("request", state_json(F.col("body")).alias("state"), F.get_json_object("body", "$.graph").alias("graph"))
    out = walked(rows, answer, act)
    body = F.to_json(F.struct(F.lit(model).alias("model"), *G.ENDED[1:]))
    return out.select("request", "status", F.when(F.col("status") == 200, body).otherwise(_detail(F.col("detail"))).alias("body"))


def agent_log(requests: DataFrame, registry: str, order: str, api_key: str | None = None) -> DataFrame:
    """The rows of requests that list, show, register, delete or run agents, as a log for registry.follow or replay. registry and
    order: the columns that name a request's registry and its place; order also names the request."""
    rows = routed(requests, api_key).where(F.col("status").isNull() & F.col("route").isin(*OPERATIONS))
    path = F.substring_index("path", "?", 1)
    name = F.coalesce(_hole(path, "/v1/agents/{}/run"), _hole(path, "/v1/agents/{}"), F.when(F.col("route") == "register", F.get_json_object("body", "$.name")))
    op = F.try_element_at(F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair]), F.col("route"))
    return rows.select(F.col(registry).cast("string").alias("registry"), F.col(order).cast("long").alias("seq"), op.alias("op"), name.alias("name"), "body")


def agent_responses(answered: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str, act: dict[str, float] | None = None) -> DataFrame:
    """request (the log's seq), status and body of what registry.follow or replay gave. Runs are decided by the agent's own
    graph on the state that the request brought; the action is named, not performed."""
    done = answered.withColumn("request", F.col("seq"))
    runs = done.where("op = 'run' AND status = 200")
    went = walked(runs.select("request", state_json(F.col("given")).alias("state"), F.get_json_object("agent", "$.graph").alias("graph")), answer, act)
    told = F.try_element_at(F.from_json(F.get_json_object("agent", "$.actions"), "map<string, string>"), F.col("outcome"))
    both = went.join(runs.select("request", "name", "agent"), "request").withColumn("_a", told)
    action = F.coalesce(F.get_json_object("_a", "$.action"), F.when(~F.startswith("_a", F.lit("{")), F.col("_a")))
    ran = F.to_json(F.struct(F.lit(model).alias("model"), F.col("name").alias("agent"), action.alias("action"), F.get_json_object("_a", "$.arguments").alias("arguments"), *G.ENDED[1:]))
    rows = both.select("request", "status", F.when(F.col("status") == 200, ran).otherwise(_detail(F.col("detail"))).alias("body"))
    plain = (
        F.when(F.col("status") != 200, _detail(F.coalesce("detail", F.lit("nothing of that name"))))
        .when(F.col("op") == "list", F.to_json(F.struct(F.col("names").alias("agents"))))
        .when(F.col("op") == "delete", F.to_json(F.struct(F.col("name").alias("deleted"))))
        .otherwise(F.col("agent"))
    )
    return rows.unionByName(done.where("op <> 'run' OR status <> 200").select("request", "status", plain.alias("body")))


def respond(
    requests: DataFrame, answer: Callable[[DataFrame], DataFrame], model: str, agents: dict[str, str] | None = None, api_key: str | None = None,
    stats: dict | None = None, metrics: str | None = None, act: dict[str, float] | None = None,
) -> DataFrame:
    """request, route, status and body of every request; ids are taken to be distinct.

    agents: the registered ones as JSON by name, at most LIMITS["agents"]. An agent that is not among them gives 404. Requests
    that register, delete or run agents depend on those before them: they go through agent_log and agent_responses, and give 409
    here. stats and metrics: what those pages show (serving.snapshot, serving.prometheus). An empty table gives no rows. The
    requests with their routes are written once, and only what some request asks for is planned.
    """
    agents = agents or {}
    if len(agents) > LIMITS["agents"]:
        raise ValueError(f"{len(agents)} agents, the limit is {LIMITS['agents']}")
    # a request takes far longer to answer than to read, so requests are spread over tasks first; routes are found once
    rows = written(routed(requests.repartition("request"), api_key).select("request", "path", "body", "route", "status"))
    name = F.substring_index(F.substring_index("path", "?", 1), "/", -1)
    found = F.lit(None).cast("string")
    if agents:
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(agents.items()) for x in pair]), name)
    listed = F.lit(json.dumps({"agents": sorted(agents)}))
    fixed = (
        F.when(F.col("route") == "health", F.concat(F.lit('{"status": "ok", "model": '), _text(F.lit(model)), F.lit("}")))
        .when(F.col("route") == "models", F.concat(F.lit('{"models": [{"id": '), _text(F.lit(model)), F.lit("}]}")))
        .when(F.col("route") == "stats", F.lit(json.dumps(stats or {})))
        .when(F.col("route") == "metrics", F.lit(metrics or ""))
        .when(F.col("route") == "agents", listed)
        .when(F.col("route") == "agent", found)
    )
    ordered = F.col("route").isin("register", "delete", "run")
    status = F.coalesce(F.col("status"), F.when(ordered, 409), F.when(fixed.isNull(), 404).otherwise(200))
    reason = F.when(status == 401, "a bearer token is needed").when(status == 405, "another method is needed").when(status == 409, "it depends on the requests before it").otherwise("nothing of that name")
    makers = {
        "decide": lambda df: decided(df, answer, model), "grouped": lambda df: decided(df, answer, model, grouped=True),
        "batch": lambda df: decided_batches(df, answer, model), "graph": lambda df: decided_graphs(df, answer, model, act),
    }
    ask = F.col("status").isNull() & F.coalesce(F.col("route").isin(*makers), F.lit(False))
    out = rows.where(~ask).select("request", "route", status.alias("status"), F.when(status == 200, fixed).otherwise(_detail(reason)).alias("body"))
    asked = {r["route"] for r in rows.where(ask).select("route").distinct().collect()}  # one of makers each
    for route, make in makers.items():
        if route not in asked:
            continue
        own = rows.where(ask & (F.col("route") == route)).select("request", "body")
        out = out.unionByName(make(own).select("request", F.lit(route).alias("route"), "status", "body"))
    return out
