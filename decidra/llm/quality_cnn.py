"""Byte-level convolutional quality classifier in numpy.

Every filter is a table of weights by tap and byte, so a response is TAPS table look-ups and one sum:
no embedding, no multiplication over the text. Responses are max-pooled over overlapping chunks that
together cover the whole document (chunks of CHUNK bytes that start every STEP bytes). The document's
vector is the mean, the maximum and the standard deviation over its chunks of each pooled response,
and the log of the number of chunks; a hidden layer combines it into one probability.

Training reads at most ``max_rows`` labelled rows (those with the smallest hash of their id), each of
them whole: the filters learn from chunks drawn over the whole text, the hidden layer from vectors of
whole texts, as scoring makes them. Texts stay on the executors, the driver gets chunks and vectors.
Everything is seeded.
"""

from __future__ import annotations

import binascii
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, packed, unpacked, utf8

TAPS = 6
FILTERS = 16
HIDDEN = 24
BLOCK = 64
CHUNK = 4 * BLOCK
STEP = 2 * BLOCK
#: Bytes of which responses are held at once while scoring.
SLICE = 1 << 18
FOLDS = 5


@dataclass
class Model:
    filters: np.ndarray  # TAPS, 256, FILTERS
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float


def _responses(filters: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Responses at len(body) - TAPS + 1 places."""
    n = len(body) - TAPS + 1
    out = filters[0].take(body[:n], axis=0)
    for tap in range(1, TAPS):
        out += filters[tap].take(body[tap : tap + n], axis=0)
    return out


def _padded(body: bytes) -> np.ndarray:
    """Zero bytes fill the text up to whole blocks, one chunk at least, and TAPS - 1 more."""
    blocks = max(CHUNK // BLOCK, -(-len(body) // BLOCK))
    blocks += blocks % 2  # chunks start at every second block
    out = np.zeros(blocks * BLOCK + TAPS - 1, dtype=np.uint8)
    out[: len(body)] = np.frombuffer(body, dtype=np.uint8)
    return out


def pooled(filters: np.ndarray, bias: np.ndarray, body: bytes) -> np.ndarray:
    """Chunks by FILTERS: the rectified maximum over each overlapping chunk of the whole text."""
    padded = _padded(body)
    blocks = (len(padded) - TAPS + 1) // BLOCK
    tops = np.empty((blocks, FILTERS), dtype=np.float32)
    for at in range(0, blocks, SLICE // BLOCK):
        to = min(blocks, at + SLICE // BLOCK)
        part = _responses(filters, padded[at * BLOCK : to * BLOCK + TAPS - 1])
        tops[at:to] = part.reshape(to - at, BLOCK, FILTERS).max(axis=1)
    pairs = tops.reshape(-1, 2, FILTERS).max(axis=1)
    return np.maximum(np.maximum(pairs[:-1], pairs[1:]) + bias, 0)


def describe(chunks: np.ndarray) -> np.ndarray:
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.std(axis=0), [np.log(len(chunks))]]).astype(np.float64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def score(model: Model, body: bytes) -> float:
    x = (describe(pooled(model.filters, model.bias, body)) - model.mean) / model.scale
    hidden = np.maximum(x @ model.w1 + model.b1, 0)
    return float(_sigmoid(hidden @ model.w2 + model.b2))


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(params[k].dtype)


def windows(body: bytes, seed: int, chunks_per_row: int) -> np.ndarray:
    """At most chunks_per_row chunks (rows, with the bytes that the last taps read), drawn over the whole text."""
    padded = _padded(body)
    starts = np.arange(0, len(padded) - TAPS + 1 - CHUNK + 1, STEP)
    if len(starts) > chunks_per_row:
        starts = np.random.default_rng([seed, binascii.crc32(body)]).choice(starts, chunks_per_row, replace=False)
    return padded[starts[:, None] + np.arange(CHUNK + TAPS - 1)]


def _train_filters(drawn: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, steps: int):
    """Filters from a linear read-out of single chunks; a chunk carries the label of its document."""
    x, y = np.concatenate(drawn), np.repeat(labels, [len(w) for w in drawn])
    positive = max(1e-3, min(1 - 1e-3, y.mean()))
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive))
    p = {
        "filters": rng.normal(0, 0.1, (TAPS, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "out": rng.normal(0, 0.3, FILTERS),
        "c": np.zeros(1),
    }
    adam, size, span = _Adam(0.02), 128, CHUNK
    for _ in range(-(-steps * size // len(x))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            flat = np.concatenate([x[i] for i in rows])
            every = np.zeros((len(flat), FILTERS), dtype=np.float32)
            every[: len(flat) - TAPS + 1] = _responses(p["filters"], flat)
            grid = every.reshape(len(rows), span + TAPS - 1, FILTERS)[:, :span]
            where = grid.argmax(axis=1)  # rows, FILTERS
            top = np.take_along_axis(grid, where[:, None, :], axis=1)[:, 0] + p["bias"]
            act = np.maximum(top, 0)
            error = (_sigmoid(act @ p["out"] + p["c"][0]) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(error, p["out"]) * (top > 0)
            g = np.zeros_like(p["filters"])
            for tap in range(TAPS):
                letters = np.take_along_axis(x[rows].astype(np.int64), where + tap, axis=1)
                np.add.at(g[tap], (letters, np.arange(FILTERS)[None, :]), back)
            g += 1e-5 * p["filters"]
            adam.step(p, {"filters": g, "bias": back.sum(axis=0), "out": act.T @ error + 1e-4 * p["out"], "c": np.array([error.sum()])})
    return p["filters"], p["bias"]


def _constant(y: np.ndarray) -> Model | None:
    """The constant share of label 1 (0.5 without any row) if rows of both labels are not there."""
    if len(y) and y.min() != y.max():
        return None
    size = 3 * FILTERS + 1
    share = 0.5 if len(y) == 0 else min(0.99, max(0.01, float(y.mean())))
    flat = np.zeros((TAPS, 256, FILTERS), dtype=np.float32)
    return Model(flat, np.zeros(FILTERS, dtype=np.float32), np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(bodies: list[bytes], labels: list[int], seed: int = 11, filter_steps: int = 600, chunks_per_row: int = 8, epochs: int = 150) -> Model:
    """A model from labelled texts. Without rows of both labels it returns the constant share of label 1
    (0.5 without any row)."""
    y = np.array(labels, dtype=np.float64)
    if (model := _constant(y)) is not None:
        return model
    rng = np.random.default_rng(seed)
    filters, bias = _train_filters([windows(b, seed, chunks_per_row) for b in bodies], y, rng, filter_steps)
    return _combine(filters, bias, np.stack([describe(pooled(filters, bias, b)) for b in bodies]), y, rng, epochs)


def _combine(filters: np.ndarray, bias: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int) -> Model:
    """The hidden layer over the vectors x of whole texts."""
    size = x.shape[1]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.array([np.log(y.mean() / (1 - y.mean()))])}
    adam = _Adam(0.005)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            pre = x[rows] @ p["w1"] + p["b1"]
            act = np.maximum(pre, 0)
            error = (_sigmoid(act @ p["w2"] + p["b2"][0]) - y[rows]) / len(rows)
            back = np.outer(error, p["w2"]) * (pre > 0)
            adam.step(p, {"w1": x[rows].T @ back + 1e-3 * p["w1"], "b1": back.sum(axis=0), "w2": act.T @ error + 1e-3 * p["w2"], "b2": np.array([error.sum()])})
    return Model(filters, bias, mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, seed: int = 11, filter_steps: int = 600, chunks_per_row: int = 8, epochs: int = 150) -> Model:
    """Fit on labelled rows outside fold 0: the max_rows with the smallest hash of their id. An id that has several labels, or several
    texts, gives a row for each; rows with a null id or label are left out.

    The sample is taken from the narrow label table, so only its documents' texts move; with
    max_rows ids it is broadcast whatever the size of the corpus. Whole texts are written once to the
    shared folder and read twice there, for the chunks of the filters and for the vectors.
    """
    usable = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = usable.select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    body = utf8(F.col("text")).alias("body")
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", body))

    def of_rows(made, kind: str) -> list:
        """What made gives for each body, in the order of the sample; repeated ids could bring more rows than it has."""
        value = F.arrow_udf(lambda bodies: made([x.as_buffer().to_pybytes() for x in bodies]), returnType=kind).asNondeterministic()(F.col("body"))
        keyed = rows.select("doc_id", "quality", F.xxhash64("body").alias("_h"), value.alias("v"))
        return keyed.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "_h").limit(max_rows).collect()

    found = of_rows(lambda bodies: pa.array([windows(b, seed, chunks_per_row).tobytes() for b in bodies], pa.binary()), "binary")
    y = np.array([r["quality"] > 0 for r in found], dtype=np.float64)
    if (model := _constant(y)) is not None:
        return model
    rng = np.random.default_rng(seed)
    drawn = [np.frombuffer(bytes(r["v"]), dtype=np.uint8).reshape(-1, CHUNK + TAPS - 1) for r in found]
    filters, bias = _train_filters(drawn, y, rng, filter_steps)
    vectors = of_rows(lambda bodies: pa.array([describe(pooled(filters, bias, b)) for b in bodies], pa.list_(pa.float64())), "array<double>")
    return _combine(filters, bias, np.array([r["v"] for r in vectors]), y, rng, epochs)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and the probability of good quality of each whole text, in a last column of that name (with
    underscores behind it if docs has such a column, which stays).

    Null texts score as empty ones; an empty table gives no rows. Rows stay as they are, repeated ones too, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([score(shared.value, x.as_buffer().to_pybytes()) for x in bodies], pa.float64())

    return docs.withColumn(free_name(docs, name), F.arrow_udf(run, returnType="double").asNondeterministic()(utf8(F.col("text"))))


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents that score at least least, with all columns of docs. Null texts count as empty, repeated rows are
    scored one by one, of equal scores all stay or none; an empty table gives no rows."""
    return unpacked(with_score(packed(docs, "text"), model).where(F.col("score") >= least))


def held_out(doc_id) -> bool:
    return binascii.crc32(str(doc_id).encode()) % FOLDS == 0
