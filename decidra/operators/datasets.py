"""Building labelled question data from tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from decidra.functions import arrays as A
from decidra.functions.text import strip

MIN_CHARS, MAX_CHARS = 40, 1500


def seeded(seed: int | str, key: Column) -> Column:
    """A pseudo-random order key that any SQL engine can make: md5 of seed:key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the same hash."""
    return F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0


@dataclass(frozen=True)
class Task:
    """How a table becomes one question a row. label: index of the right option as a column, null to skip the
    row. target: probabilities, or null for a hard label. keep: rows that can be built at all."""

    name: str
    qtype: str
    keys: tuple[str, ...]
    instructions: tuple[str, ...]
    state: Column
    label: Column
    target: Column | None = None
    key: str = "id"
    max_train: int = 1500
    max_eval: int = 200
    eval_split: bool = False
    holdout: bool = False
    synthetic: bool = False
    extra: dict = field(default_factory=dict)


def build(rows: DataFrame, task: Task, seed: int) -> DataFrame:
    """id, state, qtype, instructions, keys, label_index, target, answerable, source of the rows that can be built."""
    n = len(task.keys)
    given = task.target if task.target is not None else F.lit(None).cast("array<double>")
    wording = F.array(*[F.lit(x) for x in task.instructions])
    out = rows.select(
        F.col(task.key).alias("id"), task.state.alias("state"), F.lit(task.qtype).alias("qtype"),
        F.get(wording, F.pmod(F.xxhash64(F.col(task.key), F.lit(seed)), F.lit(len(task.instructions))).cast("int")).alias("instructions"),
        F.array(*[F.lit(k) for k in task.keys]).alias("keys"), task.label.cast("int").alias("label_index"), given.alias("target"),
        F.lit(True).alias("answerable"), F.lit(task.name).alias("source"),
    )
    fits = F.col("label_index").between(0, n - 1) & F.col("state").isNotNull()
    return out.where(fits).withColumn("target", F.coalesce("target", A.one_hot(F.col("label_index"), F.lit(n))))


def choice_task(name: str, options: list[str], instructions: list[str], state: Column, label: Column, **more) -> Task:
    """A choice question a row; label is the option's name, and a row whose label is none of them is skipped."""
    place = F.array_position(F.array(*[F.lit(o) for o in options]), label)
    return Task(name, "choice", tuple(options), tuple(instructions), state, F.when(place > 0, place - 1), **more)


def bool_task(name: str, instructions: list[str], state: Column, label: Column | None = None, p_yes: Column | None = None, **more) -> Task:
    """A yes/no question a row, from a boolean or from a probability of yes, which is clamped to [0, 1]."""
    target = yes_target(p_yes) if p_yes is not None else None
    yes = label if label is not None else p_yes >= 0.5
    return Task(name, "bool", ("yes", "no"), tuple(instructions), state, F.when(yes.isNotNull(), F.when(yes, 0).otherwise(1)), target, **more)


def score_task(name: str, levels: int, instructions: list[str], state: Column, label: Column | None = None, counts: Column | None = None, value: Column | None = None, **more) -> Task:
    """A score question a row: from a level, from annotators' counts by level, or from a value on the scale 0 to
    levels - 1. Counts and values give soft targets; their label is the first largest level and the nearest one."""
    keys = tuple(str(i) for i in range(levels))
    if counts is not None:
        return Task(name, "score", keys, tuple(instructions), state, A.first_argmax(counts), count_target(counts), **more)
    if value is not None:
        near = F.round(F.greatest(F.lit(0.0), F.least(F.lit(levels - 1.0), value)))
        return Task(name, "score", keys, tuple(instructions), state, near, A.ordinal_target(value, F.lit(levels)), **more)
    return Task(name, "score", keys, tuple(instructions), state, label, **more)


def yes_target(p_yes: Column) -> Column:
    return A.let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_yes)), lambda p: F.array(p, 1 - p))


def count_target(counts: Column) -> Column:
    """Shares of annotator counts; null if there are none."""
    return F.when(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) > 0, A.normalise(F.transform(counts, lambda c: c.cast("double"))))


def numbered(df: DataFrame, order: Column, name: str = "rn") -> DataFrame:
    """df with its place (from 1) in a total order, without sorting it in one task: places within buckets of the
    order key's first three hex digits, moved by the counts of lower buckets. order: an md5 string."""
    each = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 3))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_o", "id"))
    sizes = each.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 rows at most
    upto = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("_b", upto.alias("_before"))
    return each.withColumn("_i", inner).join(F.broadcast(before), "_b").withColumn(name, F.col("_i") + F.col("_before")).drop("_o", "_b", "_i", "_before")


def splits(examples: DataFrame, task: Task, seed: int) -> DataFrame:
    """The rows a task uses, with split (train, calibration, dev or holdout) and number within the split, from 0.

    A shuffle by hash; the first max_eval of the pool are for evaluation: the first half of them calibrate,
    the rest are dev. Holdout tasks have evaluation rows only.
    """
    budget = task.max_eval if task.holdout else task.max_train + task.max_eval
    pool = numbered(examples, seeded(seed, F.col("id"))).where(F.col("rn") <= budget)
    n_eval = F.least(F.lit(task.max_eval), F.lit(pool.count()))
    half = F.floor(n_eval / 2)
    if task.holdout:
        return pool.withColumn("split", F.lit("holdout")).withColumn("number", F.col("rn") - 1)
    split = F.when(F.col("rn") <= half, "calibration").when(F.col("rn") <= n_eval, "dev").otherwise("train")
    start = F.when(F.col("rn") <= half, F.lit(0)).when(F.col("rn") <= n_eval, half).otherwise(n_eval)
    return pool.withColumn("split", split).withColumn("number", F.col("rn") - 1 - start)


def build_task(rows: DataFrame, task: Task, seed: int, swapped: float = 0.0, swap_key: str | None = None) -> DataFrame:
    """All of a task in one call: examples, splits, and in the training split the unanswerable ones. id is
    ``task/split/number``; swapped rows are numbered behind the others."""
    cut = splits(build(rows, task, seed), task, seed)
    plain = [c for c in cut.columns if c not in ("rn", "number")]
    out = cut.select(*plain, "number")
    if swapped and not task.holdout:
        train = cut.where("split = 'train'").select(*plain)
        more = numbered(swap_passages(train, swapped, seed, swap_key).where("NOT answerable"), seeded(f"{seed}-number", F.col("id")))
        n = train.count()
        out = out.unionByName(more.withColumn("number", F.col("rn") - 1 + n).select(*plain, "number"))
    return out.withColumn("key", F.col("id")).withColumn("id", F.concat_ws("/", F.lit(task.name), "split", F.col("number").cast("string")))


def build_stats(splits_df: DataFrame) -> DataFrame:
    """Rows by task and split, and by split over all tasks (task null)."""
    return splits_df.rollup("split", "source").agg(F.count("*").alias("n")).where(F.col("split").isNotNull())


def _with_key(state: Column, other: Column, key: str) -> Column:
    """The JSON object state with other's value of key; null unless both are objects that have it."""

    def run(own: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(own.to_pylist(), others.to_pylist(), strict=True):
            a, b = (json.loads(x) if x else None for x in (a, b))
            fits = isinstance(a, dict) and isinstance(b, dict) and key in a and key in b
            out.append(json.dumps(a | {key: b[key]}, ensure_ascii=False) if fits else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, returnType="string")(state, other)


def swap_passages(examples: DataFrame, fraction: float, seed: int, key: str | None = None) -> DataFrame:
    """examples and, appended, floor(n * fraction) unanswerable ones: the question of one row with the passage of
    another. Both rows come from a second hash order, the other one being the next in it (cyclically), so
    they always differ and no row is paired with many. With key, states are JSON objects of which only that
    field is swapped (a question kept in another field stays); rows whose state has no such field are not swapped."""
    n = examples.count()
    wanted = int(n * fraction)
    if n < 2 or not wanted:
        return examples
    order = numbered(examples.select("id", "state"), seeded(f"{seed}-swap", F.col("id")))
    other = order.select(F.when(F.col("rn") == 1, F.lit(n)).otherwise(F.col("rn") - 1).alias("rn"), F.col("state").alias("_state"))
    pairs = order.where(F.col("rn") <= wanted).select("id", "rn").join(other, "rn").select("id", "_state")
    put = F.col("_state") if key is None else _with_key(F.col("state"), F.col("_state"), key)
    swapped = examples.join(pairs, "id").withColumn("state", put).where(F.col("state").isNotNull()).withColumn("answerable", F.lit(False))
    swapped = swapped.withColumn("target", A.one_hot(F.col("label_index"), F.size("keys"))).drop("_state")
    return examples.unionByName(swapped)


def in_band(text: Column) -> Column:
    return F.length(text).between(MIN_CHARS, MAX_CHARS)


def corpus(states: DataFrame, seed: int) -> DataFrame:
    """text, source, place: distinct stripped texts of MIN_CHARS to MAX_CHARS, each with its smallest source,
    in a seeded order."""
    texts = states.select(strip(F.col("text")).alias("text"), "source").where(in_band(F.col("text")))
    return texts.groupBy("text").agg(F.min("source").alias("source")).withColumn("place", seeded(seed, F.col("text")))


def task_states(tasks: list[tuple[Task, DataFrame]], per_task: int, seed: int) -> DataFrame:
    """text and source of at most per_task built rows of each task that is neither held out nor synthetic."""
    out = None
    for task, rows in tasks:
        if task.holdout or task.synthetic:
            continue
        own = numbered(build(rows, task, seed), seeded(seed, F.col("id"))).where(F.col("rn") <= per_task)
        own = own.select(F.col("state").alias("text"), "source")
        out = own if out is None else out.union(own)
    if out is None:
        raise ValueError("no task is left")
    return out


def train_texts(records: DataFrame, seed: int, leave_out: tuple[str, ...] = ("policy_application",)) -> DataFrame:
    """text, source, place of the training records' states (state: raw JSON, source), without those of the sources
    left out: a text state as it is, of an object its longest text field (the first of equals), other states none."""
    fields = F.map_values(F.from_json("state", "map<string, string>"))
    types = F.map_values(F.transform_values(F.from_json("state", "map<string, variant>"), lambda _, v: F.schema_of_variant(v)))
    texts = F.transform(F.filter(F.arrays_zip(fields.alias("v"), types.alias("t")), lambda x: x["t"] == "STRING"), lambda x: x["v"])
    kind = F.schema_of_variant(F.try_parse_json("state"))
    text = F.when(kind == "STRING", F.get(F.from_json(F.concat(F.lit("["), "state", F.lit("]")), "array<string>"), F.lit(0))).when(F.startswith(kind, F.lit("OBJECT")) & (F.size(texts) > 0), longest_field(texts))
    kept = records.where(~F.col("source").isin(*leave_out)).select(text.alias("text"), "source")
    return corpus(kept.where(F.col("text").isNotNull()), seed)


def longest_field(fields: Column) -> Column:
    """The first longest string of an array of strings."""
    sizes = F.transform(fields, lambda x: F.length(x))
    return F.get(fields, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)


def sample_per_key(df: DataFrame, key: str, item: str, k: int, seed: int) -> DataFrame:
    """k rows of each key without replacement, chosen by a hash of key and item. The choice is made within 64 parts of
    a key first, so that a hot key never meets in one task: the last one sees 64 * k rows of it at most."""
    draw = seeded(seed, F.concat_ws("/", F.col(key).cast("string"), F.col(item).cast("string")))
    drawn = df.withColumn("_d", draw).withColumn("_part", F.substring("_d", 31, 2))
    drawn = drawn.withColumn("_part", F.pmod(F.conv("_part", 16, 10).cast("int"), F.lit(64)))
    order = lambda *keys: Window.partitionBy(*keys).orderBy("_d", item)
    some = drawn.withColumn("_r", F.row_number().over(order(key, "_part"))).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(order(key))).where(F.col("_r") <= k).drop("_r", "_d", "_part")


def teacher_examples(scored: DataFrame) -> DataFrame:
    """Scorer output as training examples: the label is the first largest option, the target its probabilities."""
    at = A.first_argmax(F.col("probs"))
    label = F.when(F.col("qtype") == "bool", (at == 0).cast("string")).when(F.col("qtype") == "score", at.cast("string")).otherwise(F.get(F.col("keys"), at))
    return scored.withColumn("label", label).withColumn("label_index", at).withColumn("target", F.col("probs"))


def label_texts(texts: DataFrame, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], done: DataFrame | None, seed: int, k: int) -> DataFrame:
    """Teacher labels that are still missing: k questions of each text (id, state) drawn without replacement from
    questions (name, qtype, instructions, keys; a question set), less what done (id, name) holds, answered (answer adds
    probs) and turned into examples. Append the result to what done is read from; running again gives the rest."""
    from decidra.operators.scoring import ask

    drawn = sample_per_key(ask(texts, questions), "id", "name", k, seed)
    if done is not None:
        drawn = drawn.join(done.select("id", "name").distinct(), ["id", "name"], "left_anti")
    return teacher_examples(answer(drawn))


def packed_records(examples: DataFrame) -> DataFrame:
    """One record for each state: all its questions as an array (name, label, target), by name."""
    each = F.struct("name", "qtype", "label", "target")
    return examples.groupBy("id").agg(F.first("state").alias("state"), F.sort_array(F.collect_list(each)).alias("questions"))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do of a resumable labelling run."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def rater_counts(votes: DataFrame, item: str, level: Column, n_levels: int, quorum: int = 1) -> DataFrame:
    """item, raters and counts by level, of items with at least quorum raters."""
    counts = F.array(*[F.count_if(level == k) for k in range(n_levels)])
    return votes.groupBy(item).agg(F.count("*").alias("raters"), counts.alias("counts")).where(F.col("raters") >= quorum)


def label_counts(votes: DataFrame, item: str, labels: dict[str, Column], unclear: Column, quorum: int = 3) -> DataFrame:
    """item, raters and counts by label where a rater may give several labels: votes marked very unclear are left
    out first; items with fewer than quorum raters, or without any label, are dropped."""
    counts = F.array(*[F.count_if(c) for c in labels.values()])
    out = votes.where(~F.coalesce(unclear, F.lit(False))).groupBy(item).agg(F.count("*").alias("raters"), counts.alias("counts"))
    return out.where((F.col("raters") >= quorum) & (F.array_max("counts") > 0))


def majority(counts: Column, neutral: int | None = None) -> Column:
    """Index of the first largest count; with neutral, any other option that has votes comes before it."""
    if neutral is not None:
        counts = F.transform(counts, lambda c, i: F.when(i == neutral, F.least(c, F.lit(1)) * 0).otherwise(c))
    return A.first_argmax(counts)


def make_batches(items: DataFrame, group: str, order: str, size: Column, batch_size: int, budget: int, at: Column | None = None, wait: float = 0.0) -> DataFrame:
    """item, batch number of a greedy packing in the given order within each group: a batch closes before it has
    more than batch_size items or more than budget in total; an item over the budget is a batch on its own. With
    at (a time in seconds) it also closes before an item that came more than wait after its first.

    A sequential rule, so a group (what one worker batches: a partition or shard) is one task's; it is read as a
    sorted stream that holds nothing but the open batch's numbers.
    """
    types = {f.name: f.dataType for f in items.schema}
    kind = pa.schema([("g", to_arrow_type(types[group])), ("o", to_arrow_type(types[order])), ("batch", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total, batch, since = object(), 0, 0, 0, 0.0
        for rows in batches:
            out = []
            for g, k, t in zip(*(rows.column(c).to_pylist() for c in ("g", "k", "t")), strict=True):
                if g != now:
                    now, n, total, batch, since = g, 0, 0, 0, t
                elif n and (n >= batch_size or total + k > budget or t - since > wait):
                    n, total, batch, since = 0, 0, batch + 1, t
                n, total = n + 1, total + k
                out.append(batch)
            yield pa.record_batch([rows.column("g"), rows.column("o"), pa.array(out, pa.int64())], kind)

    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), size.cast("long").alias("k"), (F.lit(0.0) if at is None else at.cast("double")).alias("t"))
    dealt = rows.repartition("g").sortWithinPartitions("g", "o", "k")
    done = dealt.mapInArrow(run, f"g {types[group].simpleString()}, o {types[order].simpleString()}, batch long")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), "batch")
