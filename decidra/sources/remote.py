"""Remote model servers as scorers: one HTTP client a partition, nothing on the driver.

Two protocols: ``completion`` servers return top log-probabilities of the next token, ``generate`` servers the
same inside their metadata, by text or by token id, and hidden states. A label that the server did not return, and a hidden state
that is empty or of another width, is an error, never a zero. A partition has some requests under way at once, at most
in_flight, and tries one again that fails in a way that may pass.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame


class MissingLabel(ValueError):
    """The server's answer lacks an option's label."""


class BadHidden(ValueError):
    """The server's answer has no hidden state, or one of another width."""


def completion_logprobs(body: dict) -> dict[str, float]:
    """token to log-probability of the first generated token, in either spelling of completion servers."""
    first = (body.get("completion_probabilities") or [{}])[0]
    rows = first.get("top_logprobs") or first.get("probs") or []
    out = {}
    for r in rows:
        token = r.get("token", r.get("tok_str"))
        p = r.get("logprob")
        out[token] = p if p is not None else math.log(max(r["prob"], 1e-12))
    return out


def generate_logprobs(body: dict) -> dict[str, float]:
    """token text to log-probability from the metadata of generate servers: (logprob, id, text) triples."""
    info = body.get("meta_info") or {}
    rows = (info.get("output_top_logprobs") or [[]])[0] or []
    return {r[2]: r[0] for r in rows}


def generate_id_logprobs(body: dict) -> dict[int, float]:
    """token id to log-probability from generate servers: of the ids that were asked for, else of the likeliest. Entries are
    triples or objects; what lacks an id or a number is passed over."""
    body = body[-1] if isinstance(body, list) else body
    info = body.get("meta_info") or {}
    rows = (info.get("output_token_ids_logprobs") or info.get("output_top_logprobs") or [[]])[0] or []
    pairs = [(r.get("token_id"), r.get("logprob")) if isinstance(r, dict) else (r[1], r[0]) for r in rows if isinstance(r, dict) or len(r) > 1]
    return {int(i): float(p) for i, p in pairs if i is not None and p is not None}


def last_hidden(body: dict, width: int | None = None) -> list[float]:
    """The hidden state of the last position, however deep the server nests it (sequences of rows, fewer rows where it has
    cached a prefix)."""
    body = body[-1] if isinstance(body, list) else body
    vector = (body.get("meta_info") or {}).get("hidden_states") or body.get("hidden_states") or []
    while vector and isinstance(vector[-1], list):
        vector = vector[-1]
    if not vector or (width is not None and len(vector) != width):
        raise BadHidden(f"a hidden state of {len(vector)} numbers" + (f", not {width}" if width is not None else ""))
    return [float(x) for x in vector]


def option_probabilities(found: dict, labels: list, temperature: float = 1.0) -> list[float]:
    lost = [x for x in labels if x not in found]
    if lost:
        raise MissingLabel(f"no log-probability for {lost}")
    z = [found[x] / temperature for x in labels]
    top = max(z)
    weights = [math.exp(x - top) for x in z]
    return [w / sum(weights) for w in weights]


def http_post(url: str, timeout: float = 60.0) -> Callable[[dict], dict]:
    def post(body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)

    return post


def _may_pass(problem: OSError) -> bool:
    """Whether a failure may be over at the next try: no connection, a time-out, too many requests, or the server's own fault."""
    return not isinstance(problem, urllib.error.HTTPError) or problem.code == 429 or problem.code >= 500


def persistent(post: Callable[[dict], dict], attempts: int, pause: float) -> Callable[[dict], dict]:
    """post, tried again up to ``attempts`` times in all, with pauses that double."""

    def again(body: dict) -> dict:
        for i in range(attempts):
            try:
                return post(body)
            except OSError as problem:
                if i == attempts - 1 or not _may_pass(problem):
                    raise
                time.sleep(pause * 2**i)
        raise AssertionError("no attempt was made")

    return again


def score_remote(
    prompts: DataFrame, client: Callable[[], Callable[[dict], dict]], parse: Callable[[dict], dict], temperature: float = 1.0, hidden: Callable[[dict], list[float]] | None = None,
    in_flight: int = 8, attempts: int = 3, pause: float = 0.2,
) -> DataFrame:
    """prompts (id, prompt, labels: texts or token ids) to id, probs and hidden (what hidden() reads, for
    scoring.evidence_head, else null). client makes a partition's post function. Rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = persistent(client(), attempts, pause)

        def one(row: dict) -> tuple[list[float], list[float] | None]:
            body = post({"prompt": row["prompt"], "labels": row["labels"]})
            return option_probabilities(parse(body), row["labels"], temperature), hidden(body) if hidden else None

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 8 * in_flight):  # so that few answers wait for those before them
                    rows = batch.slice(at, 8 * in_flight).to_pylist()
                    done = list(pool.map(one, rows))
                    columns = [pa.array([r["id"] for r in rows], pa.int64()), *[pa.array([d[i] for d in done], pa.list_(pa.float64())) for i in (0, 1)]]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "probs", "hidden"])

    return prompts.select("id", "prompt", "labels").mapInArrow(run, "id long, probs array<double>, hidden array<double>")
