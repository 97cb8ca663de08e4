"""Column functions over probability arrays. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def normalise(weights: Column) -> Column:
    return let(F.struct(weights.alias("w"), total(weights).alias("s")), lambda v: F.transform(v["w"], lambda x: F.try_divide(x, v["s"])))


def softmax(logits: Column) -> Column:
    shifted = let(F.struct(logits.alias("z"), F.array_max(logits).alias("m")), lambda v: F.transform(v["z"], lambda x: F.exp(x - v["m"])))
    return normalise(shifted)


def label_readout(logits: Column, label_ids: Column, temperature: float = 1.0) -> Column:
    """Probabilities of the labels whose ids are given, from the logits of a whole vocabulary. An id below 0 is a place
    left empty and gets 0, an id beyond the vocabulary counts as one; null if no id is left."""
    held = lambda i: F.when((i >= 0) & (i < F.size(logits)), F.get(logits, i).cast("double") / temperature)
    found = F.transform(label_ids, lambda i: F.coalesce(held(i), F.lit(float("-inf"))))
    return let(found, lambda z: F.when(F.array_max(z) > float("-inf"), softmax(z)))


def rescale(probs: Column, temperature: Column | float) -> Column:
    """Probabilities at another temperature: softmax(log(max(p, EPS)) / T)."""
    t = F.lit(temperature) if isinstance(temperature, int | float) else temperature
    return softmax(F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(EPS))) / t))


def first_argmax(probs: Column) -> Column:
    """Index (from 0) of the first largest element."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    """(max - 1/K) / (1 - 1/K) clamped to [0, 1]; 1 with fewer than two options."""
    k = F.size(probs)
    raw = (F.array_max(probs) - 1 / k) / (1 - 1 / k)
    return F.when(k < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def checked_probabilities(probs: Column, n_options: Column) -> Column:
    """Probabilities normalised to 1; an error if they don't fit the options or have no finite positive sum."""
    bad_length = F.raise_error(F.lit("probability vector does not match the question's options")).cast("array<double>")
    bad_sum = F.raise_error(F.lit("probabilities must be finite and positive")).cast("array<double>")
    s = total(probs)
    finite = s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf"))
    return F.when(F.size(probs) != n_options, bad_length).when(~finite, bad_sum).otherwise(normalise(probs))


def expected_score(probs: Column) -> Column:
    return total(F.transform(probs, lambda p, k: p * k))


def one_hot(index: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == index, 1.0).otherwise(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def nll(probs: Column, target: Column) -> Column:
    return -total(F.zip_with(probs, target, lambda p, t: t * F.log(F.greatest(p, F.lit(EPS)))))


def ordinal_target(center: Column, levels: Column, sigma: float = 0.4) -> Column:
    """Soft target over levels that decays with the squared distance from center, which may be fractional."""
    weight = F.transform(F.sequence(F.lit(0), levels - 1), lambda k: F.exp(-(k - center) * (k - center) / (2 * sigma * sigma)))
    return normalise(weight)


def training_target(qtype: Column, target: Column, label_index: Column, hard: bool = False, sigma: float = 0.5) -> Column:
    """The target a training loss uses: hard or nearly one-hot targets become ordinal ones for scores and one-hot for other types."""
    sharp = F.lit(hard) | (F.array_max(target) >= 0.999)
    n = F.size(target)
    firm = F.when(qtype == "score", ordinal_target(label_index, n, sigma)).otherwise(one_hot(label_index, n))
    return F.when(sharp, firm).otherwise(target)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit(vector: Column) -> Column:
    return let(F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.greatest(s["n"], F.lit(EPS))))


def mean_pool(vectors: Column, dims: int) -> Column:
    """Mean of an array of vectors of dims numbers, element by element."""
    zero = F.array_repeat(F.lit(0.0), dims)
    summed = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return let(F.struct(summed.alias("s"), F.size(vectors).alias("n")), lambda v: F.transform(v["s"], lambda x: x / v["n"]))


def last_pool(vectors: Column) -> Column:
    return F.element_at(vectors, -1)


def max_sim(option_tokens: Column, state_tokens: Column) -> Column:
    """Late interaction: mean over option tokens of the largest cosine with any state token; vectors are unit."""
    best = F.transform(option_tokens, lambda o: F.array_max(F.transform(state_tokens, lambda s: dot(o, s))))
    return let(F.struct(best.alias("b"), F.size(best).alias("n")), lambda v: total(v["b"]) / v["n"])


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the bin (lo, hi] between edges that holds the value; 0 also holds the lowest edge.

    Comparisons with literal edges: no join, and no arithmetic that could miss an edge. The value stands in the
    plan once, so what it is computed from is not written out for each edge.
    """
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    return let(value, lambda v: F.size(F.filter(inner, lambda e: v > e)))
