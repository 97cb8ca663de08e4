"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Ratios of a document (symbols, capitals, repeated lines, repeated three-word windows) are compared
with a fence that its own language and source set, not with a fixed number. The sketch of a group is
a histogram over geometric bins: two sketches merge by adding counts, so partial ones from any task
add up to the same result in any order, and the sketch of a language or of the whole corpus is the
sum of its groups'. A quantile read from it is within ``(GAMMA - 1)`` of the true one, relatively.

A group's fence comes from its own upper half: the quantiles at 50, 51, ... 99 percent. Junk is apart from the rest, so going up from the
median the first jump between two of these levels shows where it begins, whatever share of the group it is:

    fence = the middle of the first jump of JUMP grains or more,
            without one: the 99 percent level + the larger of REACH * (that level - median) and ROOM grains

A grain is the least step that the ratio can take in a document of the group's median length (one symbol, one capital, one line, three
words), read from the sketches of the lengths; so what counts as a jump is the group's own matter too. A few documents within a jump
don't hide it, as a level is a percent of the group.

The fence of a group of n documents is shrunk towards that of its language's sketch, and the latter towards
that of all documents: (n * own + SHRINK * wider) / (n + SHRINK). So a group decides for itself in so far
as it has rows; there is no size at which it stops to count, and no fence lies outside those it is made of.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, unpacked, utf8

GAMMA = 1.02
LEAST = 1e-4
REACH, JUMP, ROOM = 8.0, 32.0, 64.0
#: Quantile levels in percent.
LEVELS = range(50, 100)
#: Documents of its group that weigh as much as the wider fence.
SHRINK = 20.0
BROADCAST_GROUPS = 100_000
#: name, numerator, denominator, numerator of a grain
METRICS = [
    ("symbols", "n_symbols", "word_chars", 1),
    ("capitals", "n_upper", "word_chars", 1),
    ("lines", "n_dup_lines", "n_lines", 1),
    ("repeats", "n_repeat_words", "n_words", 3),
]
#: Lengths whose sketches give the grains.
LENGTHS = ["word_chars", "n_lines", "n_words"]
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
COUNT_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    pair = ids[:-1] * len(names) + ids[1:]
    if len(names) > 2_000_000:  # three factors would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(names) + ids[2:]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    hit = np.zeros(len(words), dtype=bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def count_text(body: bytes) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    words = body.split()
    points = len(body.decode("utf-8", "replace"))
    lines = [x for x in body.split(b"\n") if x.strip()]
    return (
        len(words),
        points - (len(body) - len(body.translate(None, SPACE))),
        len(body) - len(body.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(body) - len(body.translate(None, UPPER)),
    )


def _count_arrays(bodies: pa.Array) -> pa.Array:
    counts = [count_text(x.as_buffer().to_pybytes()) for x in bodies]
    columns = zip(*counts, strict=True) if counts else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


def with_counts(docs: DataFrame) -> DataFrame:
    """docs and a struct column _counts; not deterministic by declaration, so that it runs once a row."""
    count = F.arrow_udf(_count_arrays, returnType=COUNT_TYPE).asNondeterministic()
    return docs.withColumn("_counts", count(utf8(F.col("text"))))


def text_counts(docs: DataFrame) -> DataFrame:
    return with_counts(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "_counts.*")


def _bin(ratio: Column) -> Column:
    return F.when(ratio <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(ratio / LEAST) / math.log(GAMMA))).cast("int")


def _ratio(top: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: the sketch of each group, summed map-side before any shuffle."""
    values = [(name, _ratio(a, b)) for name, a, b, _ in METRICS] + [(name, F.col(name).cast("double")) for name in LENGTHS]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), _bin(value).alias("bin")) for name, value in values]))
    return counts.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of keys: n_group and a fence for each metric."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))

    level = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("total"), F.col("bin")))
    each = ranked.groupBy(*keys, "metric").agg(F.array(*[level(k) for k in LEVELS]).alias("bins"), F.first("total").alias("total"))
    value = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), b))
    each = each.withColumn("v", F.transform("bins", value))
    picked = [F.max(F.when(F.col("metric") == name, F.col("v"))).alias(name) for name in [m[0] for m in METRICS] + LENGTHS]
    whole = each.groupBy(*keys).agg(F.max("total").cast("double").alias("n_group"), *picked)
    return whole.select(*keys, "n_group", *[_fence(F.col(name), grain / F.greatest(F.lit(1.0), F.get(under, F.lit(0)))).alias(name) for name, _, under, grain in METRICS])


def _fence(v: Column, grain: Column) -> Column:
    """The fence of a metric from its values at LEVELS."""
    step = lambda i: F.get(v, i + 1) - F.get(v, i)
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(len(LEVELS) - 2)), lambda i: step(i) >= JUMP * grain), F.lit(0))
    top = F.get(v, F.lit(len(LEVELS) - 1))
    return F.when(first.isNotNull(), (F.get(v, first) + F.get(v, first + 1)) / 2).otherwise(top + F.greatest(REACH * (top - F.get(v, F.lit(0))), ROOM * grain))


def thresholds(counts: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """t_lang, t_source and the fence of each metric (t_ and its name), shrunk towards the wider sketches'."""
    sketch = cut(sketches(counts))
    own = _fences(sketch, ["lang", "source"])
    wide = _fences(sketch, ["lang"]).select(F.col("lang").alias("w_lang"), F.col("n_group").alias("w_n"), *[F.col(m[0]).alias(f"w_{m[0]}") for m in METRICS])
    whole = _fences(sketch, []).select(*[F.col(m[0]).alias(f"a_{m[0]}") for m in METRICS])
    joined = own.join(wide, F.col("lang").eqNullSafe(F.col("w_lang")), "left").crossJoin(F.broadcast(whole))  # whole: one row

    def fence(name: str) -> Column:
        wider = (F.col("w_n") * F.col(f"w_{name}") + shrink * F.col(f"a_{name}")) / (F.col("w_n") + shrink)
        return ((F.col("n_group") * F.col(name) + shrink * wider) / (F.col("n_group") + shrink)).alias(f"t_{name}")

    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[fence(m[0]) for m in METRICS])


def _with_fences(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """counts and the fences of its group. The table of fences has a row for each language and source; it is
    broadcast only if that is at most BROADCAST_GROUPS rows, else both sides are shuffled."""
    fences = cut(fences)
    small = fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return counts.join(F.broadcast(fences) if small else fences, same, "left")


def _clean(prefix: str = "") -> Column:
    failed = (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))
    clean = ~failed
    for name, a, b, _ in METRICS:
        clean = clean & (_ratio(prefix + a, prefix + b) <= F.col(f"t_{name}"))
    return F.coalesce(clean, F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept of every document; repeated rows are judged one by one.

    Null and empty texts have no words, so the base rule fails them. Null languages and sources form
    groups of their own. An empty table gives no rows; other columns are ignored.
    """
    counts = cut(text_counts(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = _with_fences(counts, thresholds(counts))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), _clean().alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with all columns of docs. Texts are counted twice, once for the
    sketches and once to decide, so that no text is shuffled. Nulls, repeats and an empty table are as in judge()."""
    fences = thresholds(text_counts(docs))
    counted = with_counts(packed(docs, "lang", "source", "text")).drop("text")
    return unpacked(_with_fences(counted, fences).where(_clean("_counts.")))
