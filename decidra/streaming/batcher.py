"""The timed batcher and the latency windows of a service as keyed state.

`batched`: requests of a lane (a worker, a model) are put into batches in the order of their arrival. A batch closes before it
would hold more than SIZE requests or more than TOKENS tokens, and before a request that came more than WAIT after its first. A
request over the budget is a batch of its own. State: the open batch's numbers and the requests' ids, SIZE of them at
most. A closed batch is one row; which batch a request is in does not depend on how arrivals are cut into micro-batches, nor on
restarts. What is open at the end is handed over by a row without a request (flush), or, in a live service, by a processing-time timer,
which is when a clock other than the arrivals' own takes part.

`windows`: the last KEEP values of each route and counters, from which quantiles are read after each micro-batch (the last
row of a route is the one that holds). State: KEEP numbers a route.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from decidra.operators.serving import QUANTILES, RESERVOIR

SIZE, TOKENS, WAIT = 16, 16384, 0.005
BATCH = "lane string, batch long, requests array<long>, tokens long, first double, why string"
OPEN = "batch long, requests array<long>, tokens long, first double"
WINDOW = "route string, step long, requests long, errors long, kept int, p50 double, p95 double, p99 double"


class _Batch:
    """The open batch of a lane."""

    def __init__(self, number: int = 0, requests: list[int] | None = None, tokens: int = 0, first: float = 0.0) -> None:
        self.number, self.requests, self.tokens, self.first = number, list(requests or []), tokens, first

    def closes(self, tokens: int, at: float, size: int, budget: int, wait: float) -> str | None:
        """Why the batch closes before a request of so many tokens at such a time."""
        if not self.requests:
            return None
        return "size" if len(self.requests) >= size else "tokens" if self.tokens + tokens > budget else "time" if at - self.first > wait else None

    def row(self, lane: str, why: str) -> tuple:
        return lane, self.number, self.requests, self.tokens, self.first, why

    def add(self, request: int, tokens: int, at: float) -> None:
        self.first = self.first if self.requests else at
        self.requests.append(request)
        self.tokens += tokens

    def state(self) -> tuple:
        return self.number, self.requests, self.tokens, self.first


def _taken(lane: str, batch: _Batch, rows: pd.DataFrame, size: int, budget: int, wait: float) -> tuple[_Batch, list[tuple]]:
    """The open batch after the rows of a lane, and the rows of the batches that they close."""
    closed = []
    for request, tokens, at in rows.sort_values(["at", "request"])[["request", "tokens", "at"]].itertuples(index=False):
        if pd.isna(request):
            if batch.requests:
                closed.append(batch.row(lane, "flush"))
                batch = _Batch(batch.number + 1)
            continue
        if why := batch.closes(int(tokens), float(at), size, budget, wait):
            closed.append(batch.row(lane, why))
            batch = _Batch(batch.number + 1)
        batch.add(int(request), int(tokens), float(at))
    return batch, closed


def batched(arrivals: DataFrame, size: int = SIZE, budget: int = TOKENS, wait: float = WAIT, idle_ms: int | None = None) -> DataFrame:
    """Closed batches (BATCH) of a stream of arrivals (lane, request, tokens, at in the unit of wait), which come in order within
    a lane; a null request flushes. With idle_ms a batch that gets nothing for so long is closed too (why: idle), as soon
    as Spark runs another micro-batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split(" ")[0] for c in BATCH.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = _Batch(*state.get) if state.exists else _Batch()
        if state.hasTimedOut:
            state.update(_Batch(batch.number + 1).state())
            yield pd.DataFrame([batch.row(key[0], "idle")] if batch.requests else [], columns=names)
            return
        batch, closed = _taken(key[0], batch, pd.concat(batches), size, budget, wait)
        state.update(batch.state())
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(closed, columns=names)

    timer = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return arrivals.groupBy("lane").applyInPandasWithState(run, BATCH, OPEN, "append", timer)


def _quantiles(values: list[float]) -> list[float]:
    ordered = sorted(values)
    return [ordered[min(len(ordered) - 1, int(q * len(ordered)))] if ordered else 0.0 for q in QUANTILES.values()]


def windows(served: DataFrame, keep: int = RESERVOIR) -> DataFrame:
    """For each route and micro-batch a row (WINDOW) of what holds after it. served: route, seq, status (ok or another) and value (a
    latency), in order of seq within a route. Failed requests count as errors and leave no value; null values neither."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split(" ")[0] for c in WINDOW.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, requests, errors, values = state.get if state.exists else (0, 0, 0, [])
        rows = pd.concat(batches).sort_values("seq")
        good = rows[rows["status"] == "ok"]
        values = (list(values) + good["value"].dropna().tolist())[-keep:]
        step, requests, errors = step + 1, requests + len(good), errors + len(rows) - len(good)
        state.update((step, requests, errors, values))
        yield pd.DataFrame([(key[0], step, requests, errors, len(values), *_quantiles(values))], columns=names)

    kept = "step long, requests long, errors long, values array<double>"
    return served.groupBy("route").applyInPandasWithState(run, WINDOW, kept, "append", GroupStateTimeout.NoTimeout)
