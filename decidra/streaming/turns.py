"""An agent that decides at every turn of a conversation, on what was said and decided before."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "conv_id long, turn long, history int, outcome string"


def decide_turns(turns: DataFrame, decide: Callable[[list[dict], str], str]) -> DataFrame:
    """conv_id, turn, history (entries seen) and outcome of each user turn, in order.

    The state of a turn is the history and the latest text; afterwards the text and the decision are added
    to the history, so a turn depends on the decision of the one before: a fold over each conversation,
    run in Python on one conversation at a time. Null texts count as empty.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        history: list[dict] = []
        out = []
        for conv, turn, role, text in rows.sort_values(["turn", "role", "text"])[["conv_id", "turn", "role", "text"]].itertuples(index=False):
            said = text or ""
            if role == "user":
                outcome = decide(history, said)
                out.append((conv, turn, len(history), outcome))
                history += [{"from": "user", "text": said}, {"from": "agent", "decided": outcome}]
            else:
                history.append({"from": role, "text": said})
        return pd.DataFrame(out, columns=["conv_id", "turn", "history", "outcome"])

    return turns.groupBy("conv_id").applyInPandas(run, RESULT)


def decide_stream(turns: DataFrame, decide: Callable[[list[dict], str], str]) -> DataFrame:
    """The same for a stream whose turns arrive in order. The state kept of a conversation is its history as JSON,
    texts and decisions, so a turn depends on the decisions before it across micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = json.loads(state.get[0]) if state.exists else []
        out = []
        for conv, turn, role, text in pd.concat(batches).sort_values(["turn", "role", "text"])[["conv_id", "turn", "role", "text"]].itertuples(index=False):
            if role == "user":
                outcome = decide(history, text or "")
                out.append((conv, turn, len(history), outcome))
                history += [{"from": "user", "text": text or ""}, {"from": "agent", "decided": outcome}]
            else:
                history.append({"from": role, "text": text or ""})
        state.update((json.dumps(history, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "outcome"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, RESULT, "history string", "append", GroupStateTimeout.NoTimeout)
