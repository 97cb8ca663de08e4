"""Scorers: from states and questions to a probability for each option.

A scorer maps a DataFrame with the inputs it names to logits ARRAY<DOUBLE>; softmax and everything after
are column functions. Built-in scorers are deterministic; a model plugs in as a FunctionScorer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.schema import LIMITS, check_limits
from decidra.sources.files import written

COSINE_SCALE = 20.0


class Scorer(Protocol):
    def logits(self) -> Column: ...


@dataclass(frozen=True)
class CosineScorer:
    """COSINE_SCALE times the cosine of the state's vector with each option's, 0 where either has no length. The product is divided
    by both lengths at once: dividing each component first rounds so often that sixth digits change in large tables."""

    state: str
    options: str

    def logits(self) -> Column:
        own, length = F.col(self.state), lambda v: F.sqrt(A.dot(v, v))
        each = lambda n: F.transform(F.col(self.options), lambda o: COSINE_SCALE * A.dot(own, o) / F.greatest(n * length(o), F.lit(A.EPS)))
        return A.let(length(own), each)


@dataclass(frozen=True)
class MaxSimScorer:
    """COSINE_SCALE times the late interaction of each option's token vectors with the state's; all are unit."""

    state_tokens: str
    option_tokens: str

    def logits(self) -> Column:
        return F.transform(F.col(self.option_tokens), lambda o: COSINE_SCALE * A.max_sim(o, F.col(self.state_tokens)))


@dataclass(frozen=True)
class LinearScorer:
    """Logits given as columns, for scorers that are a formula of the row."""

    columns: tuple[Column, ...]

    def logits(self) -> Column:
        return F.array(*self.columns)


@dataclass(frozen=True)
class FunctionScorer:
    """A Python model: a function from a list of texts to a list of logit lists, called with Arrow batches of at
    most ``rows`` texts at a time."""

    text: str
    model: Callable[[list[str]], list[list[float]]]
    rows: int = 64

    def logits(self) -> Column:
        model, size = self.model, self.rows

        def run(texts: pa.Array) -> pa.Array:
            said, out = texts.to_pylist(), []
            for at in range(0, len(said), size):
                out += model(said[at : at + size])
            return pa.array(out, pa.list_(pa.float64()))

        return F.arrow_udf(run, returnType="array<double>").asNondeterministic()(F.col(self.text))


def score(df: DataFrame, scorer: Scorer, temperature: float = 1.0, name: str = "probs") -> DataFrame:
    return df.withColumn("_logits", scorer.logits()).withColumn(name, A.softmax(F.transform("_logits", lambda z: z / temperature))).drop("_logits")


#: Built-in scorers by name; a model's own is added with register().
REGISTRY: dict[str, Callable[..., Scorer]] = {"cosine": CosineScorer, "max_sim": MaxSimScorer, "linear": LinearScorer, "function": FunctionScorer}


def register(name: str, make: Callable[..., Scorer]) -> None:
    REGISTRY[name] = make


def load_scorer(spec: str, **inputs) -> Scorer:
    """The scorer of a spec ``name`` or ``name:argument=value,...``; inputs are what else its constructor takes."""
    name, _, rest = spec.partition(":")
    if name not in REGISTRY:
        raise KeyError(f"no scorer {name!r}; there are {sorted(REGISTRY)}")
    given = dict(x.split("=", 1) for x in rest.split(",") if x)
    return REGISTRY[name](**given, **inputs)


def evidence_head(vector: Column, weights: list[float], bias: float) -> Column:
    """sigmoid(w . layer_norm(vector) + b)"""
    n = float(len(weights))

    def body(v: Column) -> Column:
        mean = A.total(v) / n
        return A.let(F.transform(v, lambda x: x - mean), lambda c: F.transform(c, lambda x: x / F.sqrt(A.total(F.transform(c, lambda y: y * y)) / n + 1e-5)))

    normed = A.let(F.transform(vector, lambda x: x.cast("double")), body)
    z = A.dot(normed, F.array(*[F.lit(float(w)) for w in weights])) + bias
    return 1 / (1 + F.exp(-z))


def encode_distinct(df: DataFrame, text: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every distinct text is encoded once and joined back. encode adds columns to a table of that one column. What it gives is
    written, so that Spark can split the join at a text that very many rows have."""
    coded = written(encode(df.select(F.col(text).alias("_text")).distinct()))
    return df.join(coded, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def ask(states: DataFrame, questions: DataFrame) -> DataFrame:
    """Every state with every question. A question set has at most 255 rows, which is checked: they are read to the
    driver once, made a local table and broadcast. More are an error."""
    rows = questions.limit(LIMITS["questions"] + 1).collect()
    check_limits(questions=len(rows))
    return states.crossJoin(F.broadcast(states.sparkSession.createDataFrame(rows, questions.schema)))


def agreement(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Largest difference of probs and of evidence between two scorers; ok if neither passes the tolerance and
    every answer is on both sides."""
    left = ours.select(*keys, F.col("probs").alias("p1"), F.col("evidence").alias("e1"))
    both = left.join(theirs.select(*keys, F.col("probs").alias("p2"), F.col("evidence").alias("e2")), keys, "full")
    gap = F.array_max(F.zip_with("p1", "p2", lambda a, b: F.abs(a - b)))
    lost = F.count_if(F.col("p1").isNull() | F.col("p2").isNull())
    sums = both.agg(F.max(gap).alias("max_probability_gap"), F.max(F.abs(F.col("e1") - F.col("e2"))).alias("max_evidence_gap"), lost.alias("unmatched"))
    within = (F.coalesce("max_probability_gap", F.lit(0.0)) <= tolerance) & (F.coalesce("max_evidence_gap", F.lit(0.0)) <= tolerance)
    return sums.withColumn("ok", within & (F.col("unmatched") == 0))


# --- packing of a state and its questions, for model scorers


def pack(state_ids: Column, blocks: Column, most: int = 2048) -> Column:
    """input_ids, position_ids, block_ids of a state (cut at most ids) followed by question blocks, whose
    positions all restart behind the state. The state's block is -1."""

    def body(s: Column) -> Column:
        n = F.size(s)
        start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        positions = F.flatten(F.transform(blocks, lambda b: F.transform(b, lambda _, i: n + i)))
        numbers = F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda _: k)))
        return F.struct(
            F.concat(s, F.flatten(blocks)).alias("input_ids"),
            F.concat(start, positions).alias("position_ids"),
            F.concat(F.transform(s, lambda _: F.lit(-1)), numbers).alias("block_ids"),
        )

    return A.let(F.slice(state_ids, 1, most), body)


def attention_mask(block_ids: Column) -> Column:
    """For each token the tokens it sees: earlier ones of the state or of its own block, never padding (-2), and
    itself."""
    numbered = F.transform(block_ids, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def seen(q: Column, k: Column) -> Column:
        allowed = (k["i"] <= q["i"]) & ((k["b"] == -1) | (k["b"] == q["b"])) & (k["b"] != -2)
        return allowed | (k["i"] == q["i"])

    return A.let(numbered, lambda n: F.transform(n, lambda q: F.transform(n, lambda k: seen(q, k))))
