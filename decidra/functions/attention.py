"""Attention and bilinear scores as column functions, for decisions over token vectors that a table holds.

Vectors are arrays of numbers, token sequences arrays of vectors, matrices arrays of rows. Weights are arguments (columns or nested
lists), so a trained head runs in the JVM, row by row, without a shuffle. A null or empty token sequence gives null.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions import arrays as A

Matrix = Column | list


def constant(values: Matrix) -> Column:
    """A list of numbers, or a list of such lists, as a literal column."""
    if isinstance(values, Column):
        return values
    return F.array(*[constant(v) if isinstance(v, list | tuple) else F.lit(float(v)) for v in values])


def matvec(matrix: Matrix, vector: Column) -> Column:
    return F.transform(constant(matrix), lambda row: A.dot(row, vector))


def layer_norm(vector: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + eps)."""
    plain = F.transform(vector, lambda x: x.cast("double"))
    centred = A.let(plain, lambda v: A.let(A.total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))
    return A.let(centred, lambda c: A.let(F.sqrt(A.dot(c, c) / F.size(c) + eps), lambda s: F.transform(c, lambda x: x / s)))


def weighted(weights: Column, vectors: Column) -> Column:
    """The sum of vectors, each times its weight."""
    pairs = F.zip_with(weights, vectors, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, p["v"], lambda x, y: x + p["w"] * y.cast("double")))


def attention_weights(query: Column, tokens: Column, mask: Column, heads: int = 1) -> list[Column]:
    """For each head the weights over tokens: softmax of scaled products, 0 where mask (one boolean a token) is false. A row
    whose mask is all false gives null weights."""
    width = F.size(query) / heads

    def head(h: int) -> Column:
        part = lambda v: F.slice(v, (h * width + 1).cast("int"), width.cast("int"))
        own = part(query)
        logits = F.transform(tokens, lambda t: A.dot(own, part(t)) / F.sqrt(width))
        held = F.zip_with(logits, mask, lambda z, m: F.when(m, z).otherwise(F.lit(float("-inf"))))
        return A.let(held, lambda z: F.when(F.array_max(z) > float("-inf"), A.softmax(z)))

    return [head(h) for h in range(heads)]


def attend(queries: Column, keys: Column, values: Column, mask: Column, heads: int = 1) -> Column:
    """For each query a struct: context (the values by weight, head by head) and weights (the mean over heads)."""

    def one(query: Column) -> Column:
        weights = F.array(*attention_weights(query, keys, mask, heads))

        def body(w: Column) -> Column:
            width = F.size(query) / heads
            part = lambda h: F.transform(values, lambda v: F.slice(v, (h * width + 1).cast("int"), width.cast("int")))
            context = F.flatten(F.array(*[weighted(F.get(w, F.lit(h)), part(h)) for h in range(heads)]))
            mean = F.transform(F.get(w, F.lit(0)), lambda _, i: sum((F.get(F.get(w, F.lit(h)), i) for h in range(heads)), F.lit(0.0)) / heads)
            return F.struct(context.alias("context"), mean.alias("weights"))

        return A.let(weights, body)

    return F.transform(queries, one)


def entropy(weights: Column, least: float = 1e-9) -> Column:
    """-sum of w log w, each w at least ``least``."""
    return -A.total(F.transform(weights, lambda w: F.greatest(w, F.lit(least)) * F.log(F.greatest(w, F.lit(least)))))


def compiled_decision(tokens: Column, mask: Column, queries: Matrix, options: Matrix, reader: Matrix, bilinear: Matrix, bias: Matrix, evidence: Matrix, heads: int = 1, late_scale: float | None = None, option_tokens: Matrix | None = None) -> Column:
    """A question that was compiled to query vectors, asked of a state's tokens: a struct of logits (one an option) and evidence.

    z = reader . (the contexts of all queries, one behind the other); a logit is (bilinear . z) . option / sqrt(d) + bias . option,
    with late_scale times the late interaction of option_tokens where given. evidence = sigmoid(evidence . [z, mean entropy of the
    weights, 1]). Tokens outside the mask take no part. Options may differ in number by row (a column) and are scored in order.
    """
    opts, unit_all = constant(options), lambda ts: F.transform(ts, A.unit)
    seen = attend(constant(queries), tokens, tokens, mask, heads)

    def body(s: Column) -> Column:
        z = matvec(reader, F.flatten(F.transform(s, lambda x: x["context"])))
        spread = A.let(F.transform(s, lambda x: entropy(x["weights"])), lambda e: A.total(e) / F.size(e))

        def ends(v: Column) -> Column:
            turned = matvec(bilinear, v["z"])
            plain = A.let(turned, lambda t: F.transform(opts, lambda o: A.dot(t, o) / F.sqrt(F.size(o).cast("double")) + A.dot(constant(bias), o)))
            if late_scale is not None:
                shown = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"]), lambda x: A.unit(x["t"]))
                late = F.transform(constant(option_tokens), lambda o: late_scale * A.max_sim(unit_all(o), shown))
                plain = F.zip_with(plain, late, lambda a, b: a + b)
            given = F.concat(v["z"], F.array(v["e"], F.lit(1.0)))
            return F.struct(plain.alias("logits"), (1 / (1 + F.exp(-A.dot(constant(evidence), given)))).alias("evidence"))

        return A.let(F.struct(z.alias("z"), spread.alias("e")), ends)

    return F.when(F.exists(mask, lambda m: m), A.let(seen, body))


def span_mean(tokens: Column, first: Column, end: Column) -> Column:
    """The mean of tokens first to end - 1."""
    return A.let(F.slice(tokens, first + 1, F.greatest(end - first, F.lit(1))), lambda ts: A.let(F.transform(ts, lambda _: 1.0 / F.size(ts)), lambda w: weighted(w, ts)))


def content_scores(tokens: Column, decision: Column, spans: Column, weights: Matrix) -> Column:
    """For each option's span (first, end) the bilinear score (weights . norm(decision)) . norm(mean of the span) / sqrt(d),
    which is added to the option's logit; 0 where the option has no line (first below 0)."""
    turned = matvec(weights, layer_norm(decision))

    def one(q: Column, s: Column) -> Column:
        pooled = layer_norm(span_mean(tokens, s["first"], s["end"]))
        return F.when(s["first"] < 0, F.lit(0.0)).otherwise(A.dot(q, pooled) / F.sqrt(F.size(q).cast("double")))

    return A.let(turned, lambda q: F.transform(spans, lambda s: one(q, s)))


# --- masks of a state that is encoded once


def causal_mask(n: Column) -> Column:
    """n rows of n booleans: a token sees itself and those before it."""
    places = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.transform(places, lambda i: F.transform(places, lambda j: j <= i))).otherwise(F.array().cast("array<array<boolean>>"))


def suffix_mask(real: Column, state_length: Column) -> Column:
    """For a question's block behind a cached state: each of its tokens sees the whole state, the real tokens of the block up to
    itself, and itself even if it is padding. real: one boolean a token of the block."""
    before = F.array_repeat(F.lit(True), state_length)
    numbered = F.transform(real, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    return A.let(numbered, lambda n: F.transform(n, lambda q: F.concat(before, F.transform(n, lambda k: (k["r"] & (k["i"] <= q["i"])) | (k["i"] == q["i"])))))
