"""How rows are given to a model: passes of a bounded size, pairs of a state and an option, and states that are encoded once.

A model is a Python function of a list of inputs. What it can take at once is bounded by ROWS rows and by TOKENS tokens, counted with
padding: rows of a pass times the longest of them. Rows are dealt to lanes by a hash, sorted in each lane by length, longest
first, and cut into passes. Where passes begin follows from how many rows of each length a lane has; so a lane is cut into parts at the
starts of passes, about PART of length each, and the parts of one lane are spread over tasks, each a sorted stream of which a task
holds one pass at a time. What a request's questions, or a question's options, add up to is put together again behind the passes, in
their order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from decidra.operators.datasets import seeded
from decidra.operators.scoring import encode_distinct
from decidra.sources.files import written

ROWS, TOKENS = 64, 16384
#: Length that a part of a lane holds (with LINE a row), and the most parts, whose starts the driver sees; parts grow beyond that.
PART, PARTS, LINE = 1 << 24, 4096, 16
#: From so many questions on a state is encoded once for all of them; below, its questions are packed behind it.
FAN_OUT = 8


def lane_of(key: Column, lanes: int) -> Column:
    """A lane by the hash of a key, in the same way everywhere."""
    return F.pmod(F.conv(F.substring(seeded("lane", key), 1, 8), 16, 10).cast("long"), F.lit(lanes))


def _starts(rows: int, tokens: int, part: int):
    """Streams (_lane, _length, count) sorted by lane and falling length; gives the starts of parts: lane, length, at (how many rows of
    that length lie before, by key) and pass, the number of the pass that begins there."""
    schema = pa.schema([(c, pa.int64()) for c in ("lane", "length", "at", "pass")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, free, weight = (), 0, 0, 0
        for batch in batches:
            out = []
            for lane, length, count in zip(*(batch.column(c).to_pylist() for c in ("_lane", "_length", "count"))):
                if lane != now:
                    now, number, free, weight = lane, 0, 0, part  # a lane begins with a part
                at = min(free, count)  # what the open pass still takes
                free, weight = free - at, weight + at * (length + LINE)
                size = max(1, min(rows, tokens // length if length > 0 else rows))
                while at < count:
                    if weight >= part:
                        out.append((lane, length, at, number))
                        weight = 0
                    passes = min(-(-(count - at) // size), max(1, -(-(part - weight) // (size * (length + LINE)))))
                    to = min(count, at + passes * size)
                    free, weight, number, at = at + passes * size - to, weight + (to - at) * (length + LINE), number + passes, to
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], schema)

    return run


def _keys_at(dealt: DataFrame, places: list[tuple]) -> dict[tuple, str]:
    """The keys at places (lane, length, at), counted by key within lane and length; none where the row before has the same
    key. Only rows of those lengths are sorted, without their inputs, and over all tasks."""
    spark = dealt.sparkSession
    own = spark.createDataFrame(sorted({p[:2] for p in places}, key=str), "_l long, _n long")
    both = (F.col("_lane").eqNullSafe(F.col("_l"))) & (F.col("_length") == F.col("_n"))
    rows = dealt.select("_lane", "_length", "_key").join(F.broadcast(own), both, "left_semi")
    ordered = rows.repartitionByRange("_lane", "_length", "_key").sortWithinPartitions("_lane", "_length", "_key")
    ordered = written(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)))
    run = ["_lane", "_length"]
    counts = ordered.groupBy(*run, "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*run).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select(F.col("_lane").alias("_l"), F.col("_length").alias("_n"), F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"))
    ranked = ordered.join(F.broadcast(heads), both & (F.col("_task") == F.col("_t"))).select(*run, "_key", (F.col("_id") + F.col("_shift")).alias("_at"))
    wanted = spark.createDataFrame([(*p[:2], p[2] - i) for p in places for i in (0, 1)], "_l long, _n long, _a long").distinct()
    found = {(r["_lane"], r["_length"], r["_at"]): r["_key"] for r in ranked.join(F.broadcast(wanted), both & (F.col("_at") == F.col("_a"))).select(*run, "_at", "_key").collect()}
    return {p: found[p] for p in places if found[p] != found[(*p[:2], p[2] - 1)]}


def _place(lane: int | None, length: int, key: str | None) -> tuple:
    return (-1 if lane is None else lane, -length, key or "")


def _parted(dealt: DataFrame, rows: int, tokens: int, part: int | None) -> tuple[DataFrame, list[int]]:
    """dealt with _part, and for each part the number of the pass that it begins with."""
    runs = written(dealt.groupBy("_lane", "_length").count())
    if part is None:
        part = max(PART, (runs.agg(F.sum(F.col("count") * (F.col("_length") + LINE))).first()[0] or 0) // PARTS)
    ordered = runs.repartition("_lane").sortWithinPartitions("_lane", F.col("_length").desc())
    found = [tuple(r) for r in ordered.mapInArrow(_starts(rows, tokens, part), "lane long, length long, at long, pass long").collect()]
    inside = [p[:3] for p in found if p[2]]
    keys = _keys_at(dealt, inside) if inside else {}
    begins = sorted((_place(*p[:2], keys.get(p[:3])), p[3]) for p in found if not p[2] or p[:3] in keys)
    places = [p for p, _ in begins]

    def at(lanes: pa.Array, lengths: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([bisect_right(places, _place(*x)) - 1 for x in zip(lanes.to_pylist(), lengths.to_pylist(), names.to_pylist())], pa.int32())

    return dealt.withColumn("_part", F.arrow_udf(at, returnType="int").asNondeterministic()("_lane", "_length", "_key")), [n for _, n in begins]


def _passes(rows: int, tokens: int, model: Callable[[list], list], kind: pa.DataType, schema: pa.Schema, numbers: list[int]):
    """Streams (part, length, input, ...) sorted by part and falling length; gives the rows with pass, width and result. numbers: of the
    pass that a part begins with."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[pa.RecordBatch, int, int]]]]:
        part, number, width, n, parts = None, 0, 0, 0, []
        for batch in batches:
            begin = 0
            places, lengths = batch.column("_part").to_pylist(), batch.column("_length").to_pylist()
            for i, (at, length) in enumerate(zip(places, lengths)):
                if n and (at != part or n >= rows or (n + 1) * width > tokens):
                    yield number, width, [*parts, (batch, begin, i)]
                    number, n, parts, begin = number + 1, 0, [], i
                if at != part:
                    part, number = at, numbers[at]
                if not n:
                    width = length
                n += 1
            parts.append((batch, begin, batch.num_rows))
        if n:
            yield number, width, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, width, parts in cut(batches):
            held = [b.slice(lo, hi - lo) for b, lo, hi in parts if hi > lo]
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = model(whole.column("_input").to_pylist())
            if len(found) != whole.num_rows:
                raise ValueError(f"the model gave {len(found)} results for {whole.num_rows} inputs")
            columns = [whole.column(name) for name in schema.names[:-3]]
            both = [pa.array([x] * whole.num_rows, pa.int64()) for x in (number, width)]
            yield pa.record_batch([*columns, *both, pa.array(found, kind)], schema)

    return run


def run_passes(items: DataFrame, key: Column, length: Column, given: Column, model: Callable[[list], list], result: str, lanes: int, rows: int = ROWS, tokens: int = TOKENS, keep: list[str] | None = None, part: int | None = None) -> DataFrame:
    """items (of its columns those in keep, all without) with lane, pass (its number within the lane), width (the longest length of the
    pass) and result.

    model: from a list of what the column given holds to as many results of the Spark type result. A row longer than the budget is a
    pass of its own. key: names a row, and decides its lane and its place among equal lengths. Null lengths count as 0. An
    empty table gives no rows. Lengths and keys are read once more before the inputs are moved, so items must give the same rows
    again. part: length of a part, PART without.
    """
    kept = [f for f in items.schema.fields if keep is None or f.name in keep]
    dealt = items.select(lane_of(key, lanes).alias("_lane"), F.coalesce(length, F.lit(0)).cast("long").alias("_length"), key.cast("string").alias("_key"), given.alias("_input"), *[F.col(f"`{f.name}`") for f in kept])
    parted, numbers = _parted(dealt, rows, tokens, part)
    sorted_ = parted.repartition(max(1, len(numbers)), "_part").sortWithinPartitions("_part", F.col("_length").desc(), "_key")
    kind: DataType = DataType.fromDDL(result)
    out = StructType([StructField("lane", LongType()), *kept, StructField("pass", LongType()), StructField("width", LongType()), StructField("result", kind)])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    renamed = sorted_.select("_part", "_length", "_input", F.col("_lane").alias("lane"), *[F.col(f"`{f.name}`") for f in kept])
    return renamed.mapInArrow(_passes(rows, tokens, model, to_arrow_type(kind), schema, numbers), out)


def padding(passed: DataFrame, length: Column) -> DataFrame:
    """passes, rows, tokens and padded: what the passes of run_passes held, and how many tokens of it were padding."""
    each = passed.groupBy("lane", "pass").agg(F.count("*").alias("n"), F.first("width").alias("w"), F.sum(length).alias("t"))
    return each.agg(F.count("*").alias("passes"), F.sum("n").alias("rows"), F.sum("t").alias("tokens"), F.sum(F.col("n") * F.col("w") - F.col("t")).alias("padded"))


def answer_requests(requests: DataFrame, model: Callable[[list], list], lanes: int, rows: int = ROWS, tokens: int = TOKENS) -> DataFrame:
    """request, answers (logits of each question, in order) and passes (how many its questions were spread over).

    requests: request, state and questions (texts). A row of a pass is a state with one question; a request with many questions over a
    long state is spread over several passes and put together again. model: from texts to lists of logits.
    """
    each = requests.select("request", "state", F.length(F.coalesce("state", F.lit(""))).alias("n"), F.posexplode("questions").alias("at", "question"))
    text = F.concat(F.coalesce("state", F.lit("")), F.lit("\n"), "question")
    key = F.concat_ws("/", F.col("request").cast("string"), F.col("at").cast("string"))
    passed = run_passes(each, key, F.col("n") + 1 + F.length("question"), text, model, "array<double>", lanes, rows, tokens, ["request", "at"])
    grouped = passed.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("at", "result"))).alias("x"), F.countDistinct("lane", "pass").alias("passes"))
    return grouped.select("request", F.transform("x", lambda x: x["result"]).alias("answers"), "passes")


# --- pairs


SEPARATOR = " | "


def score_pairs(states: DataFrame, questions: DataFrame, model: Callable[[list], list], lanes: int, rows: int = ROWS, tokens: int = TOKENS) -> DataFrame:
    """id, name, logits (in the order of the options), evidence and cost (the largest rows x width of the passes that its pairs
    were in): each pair of a state and an option is one input, scored by (logit, evidence logit).

    states: id and state; questions: id, name and options (texts), as many as they may be. The evidence of a question is the
    sigmoid of its pairs' mean. Pairs of different questions and states share passes. A question without options gives no row.
    """
    sized = states.select("id", "state", F.length(F.coalesce("state", F.lit(""))).alias("n"))
    pairs = questions.join(sized, "id").select("id", "name", F.posexplode("options").alias("k", "option"), "state", "n")
    text = F.concat("option", F.lit(SEPARATOR), F.coalesce("state", F.lit("")))
    key = F.concat_ws("/", F.col("id").cast("string"), "name", F.col("k").cast("string"))
    length = F.length("option") + len(SEPARATOR) + F.col("n")
    passed = run_passes(pairs, key, length, text, model, "struct<logit: double, evidence: double>", lanes, rows, tokens, ["id", "name", "k"])
    passed = written(passed)  # the sizes of the passes and the answers are read from it
    sizes = passed.groupBy("lane", "pass").agg((F.count("*") * F.first("width")).alias("cost"))
    each = passed.join(sizes, ["lane", "pass"])
    grouped = each.groupBy("id", "name").agg(F.sort_array(F.collect_list(F.struct("k", F.col("result.logit").alias("z")))).alias("x"), F.avg("result.evidence").alias("e"), F.max("cost").alias("cost"))
    return grouped.select("id", "name", F.transform("x", lambda x: x["z"]).alias("logits"), (1 / (1 + F.exp(-F.col("e")))).alias("evidence"), "cost")


# --- states encoded once


def fan_out(requests: DataFrame, encode: Callable[[DataFrame], DataFrame], continue_: Callable[[Column, Column], Column], packed: Callable[[Column, Column], Column], least: int = FAN_OUT) -> DataFrame:
    """request, way (prefix or packed) and answers of requests (request, state, questions).

    From ``least`` questions on the distinct states are encoded once (encode adds columns to a table of one column _text, one of them
    called prefix) and every question continues from the prefix: continue_(prefix, question). Below, packed(state, question) answers
    from the state itself. Both must give the same for one state and question; which is taken is a matter of cost only. Null states
    are encoded like any other.
    """
    many = F.size("questions") >= least
    shared = encode_distinct(requests.where(many), "state", encode)
    one = lambda df, way, f: df.select("request", F.lit(way).alias("way"), F.transform("questions", f).alias("answers"))
    few = requests.where(F.coalesce(~many, F.lit(True)))
    return one(shared, "prefix", lambda q: continue_(F.col("prefix"), q)).unionByName(one(few, "packed", lambda q: packed(F.col("state"), q)))


def encodings(requests: DataFrame, least: int = FAN_OUT) -> DataFrame:
    """asked (state and question pairs) and encoded (states that fan_out encodes: distinct ones with many questions, and one a
    packed request)."""
    many = F.size("questions") >= least
    sums = requests.agg(F.sum(F.size("questions")).cast("long").alias("asked"), F.count_if(~many).alias("packed"))
    return sums.crossJoin(requests.where(many).select("state").distinct().agg(F.count("*").alias("distinct"))).select("asked", (F.col("packed") + F.col("distinct")).alias("encoded"))  # a row each
