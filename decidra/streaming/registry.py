"""Registries of agents as keyed state: requests that register, show, list, delete and run agents, each seeing the agents of its
own moment.

A log row is (registry, seq, op, name, body); a registry is one tenant's set of agents and holds MOST of them at most, so its
state is bounded however long the log is. Rows of a registry are taken by seq, across micro-batches in the order in which they
arrive: the order is part of the meaning, so one registry is one key. Many registries run beside each other.

What a row brought (a run's state) comes back with its answer as given. `follow` is the stream (state in the checkpoint, so a restart goes on where it was), `replay` the same over a table. What a run
is to do comes back with the agent as registered then; `decide_runs` walks those agents' graphs as tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.operators import graph_tables
from decidra.operators.agent import Agent
from decidra.schema import LIMITS
from decidra.sources.files import written

RESULT = "registry string, seq long, op string, name string, status int, agent string, names array<string>, detail string, given string"
COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


def _fault(name: str | None, body: str | None) -> str | None:
    """Why a body can't be registered under a name, null if it can."""
    try:
        agent = Agent.parse(json.loads(body or ""))
    except (ValueError, KeyError, TypeError, AttributeError) as problem:
        return f"{type(problem).__name__}: {problem}"[:200]
    return None if agent.name == name else "the agent has another name"


def _apply(agents: dict[str, str], rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The answers to the rows (by seq) of one registry, whose agents change with them."""
    out = []
    for registry, seq, op, name, body in rows.sort_values(["seq", "op", "name"])[["registry", "seq", "op", "name", "body"]].itertuples(index=False):
        status, names, detail, shown = 200, None, None, None
        known = name in agents
        if op == "list":
            names = sorted(agents)
        elif op == "register":
            detail = f"there are {most} agents already" if not known and len(agents) >= most else _fault(name, body)
            if detail is None:
                agents[name] = shown = body
            else:
                status = 422
        elif op not in ("show", "run", "delete"):
            status, detail = 405, "no such operation"
        elif not known:
            status, detail = 404, "no agent of that name"
        else:
            shown = agents.pop(name) if op == "delete" else agents[name]
        out.append((registry, seq, op, name, status, shown, names, detail, body))
    return pd.DataFrame(out, columns=COLUMNS)


def replay(log: DataFrame, most: int = LIMITS["agents"]) -> DataFrame:
    """The answer to each row of a whole log. Null operations and names match nothing; repeated rows are answered each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _apply({}, rows, most)

    return log.groupBy("registry").applyInPandas(run, RESULT)


def follow(log: DataFrame, most: int = LIMITS["agents"]) -> DataFrame:
    """The same for a stream. The state of a registry is its agents as JSON by name."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agents = json.loads(state.get[0]) if state.exists else {}
        yield _apply(agents, pd.concat(batches), most)
        state.update((json.dumps(agents, ensure_ascii=False),))

    return log.groupBy("registry").applyInPandasWithState(run, RESULT, "agents string", "append", GroupStateTimeout.NoTimeout)


def decide_runs(answered: DataFrame, answers: DataFrame, act: dict[str, float] | None = None) -> DataFrame:
    """request, status, outcome, action, arguments and complete of the runs in answered (rows of follow or replay with a
    column request). answers: request, node, probs and evidence. A run of an agent that was not there is 404. The runs are written,
    as they are read several times and the log should be replayed once."""
    runs = written(answered.where("op = 'run'").select("request", "status", "agent"))
    known = runs.where("status = 200").withColumn("body", F.get_json_object("agent", "$.graph"))
    walked = graph_tables.decide(known.select("request", "body"), answers, act)
    told = F.try_element_at(F.from_json(F.get_json_object("agent", "$.actions"), "map<string, string>"), F.col("outcome"))
    done = walked.select("request", F.col("status").alias("_s"), "outcome", "complete").join(known.select("request", "agent"), "request").withColumn("_a", told)
    action = F.coalesce(F.get_json_object("_a", "$.action"), F.when(~F.startswith("_a", F.lit("{")), F.col("_a")))
    rows = done.select("request", F.col("_s").alias("status"), "outcome", action.alias("action"), F.get_json_object("_a", "$.arguments").alias("arguments"), "complete")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("outcome", "string"), ("action", "string"), ("arguments", "string"), ("complete", "boolean"))]
    return rows.unionByName(runs.where("status <> 200").select("request", "status", *none))
