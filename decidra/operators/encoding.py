"""What a model scorer needs besides texts: token spans of lines, length estimates, batches, padding, display orders."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.operators.datasets import seeded

#: Pads token ids; block ids of padding are PAD_BLOCK, as in scoring.attention_mask.
PAD_ID, PAD_BLOCK = 0, -2


def line_spans(lines: Column, tokenize: Callable[[str], list[tuple[int, int, int]]]) -> Column:
    """ids and spans (first, end) of an array of lines. tokenize gives (id, start, end) in characters of the lines
    joined by line breaks; a token belongs to the line in which it starts, and a line without one has (-1, -1)."""

    def one(said: list[str] | None) -> dict | None:
        if said is None:
            return None
        tokens = tokenize("\n".join(said))
        starts, spans, at, left = [t[1] for t in tokens], [], 0, 0
        for line in said:
            right = left + len(line)
            inside = [i for i in range(at, len(starts)) if left <= starts[i] < right]
            spans.append({"first": inside[0], "end": inside[-1] + 1} if inside else {"first": -1, "end": -1})
            at, left = (inside[-1] + 1 if inside else at), right + 1
        return {"ids": [t[0] for t in tokens], "spans": spans}

    def run(values: pa.Array) -> pa.Array:
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])
        return pa.array([one(v) for v in values.to_pylist()], kind)

    return F.arrow_udf(run, returnType="ids array<int>, spans array<struct<first: int, end: int>>")(lines)


def approx_length(state: Column, option_texts: Column) -> Column:
    """Characters of the state and of all option texts: what batches are sorted by before anything is tokenised."""
    return F.length(state) + F.aggregate(option_texts, F.lit(0), lambda a, x: a + F.length(x))


def length_batches(items: DataFrame, length: Column, batch_size: int, shards: int = 1) -> DataFrame:
    """items with shard, place and batch: within each shard (a hash of id, one a worker) longest first, ties by id, cut into
    batches of batch_size. What a batch pads is then little, and no order over all rows is needed."""
    from pyspark.sql import Window

    shard = F.pmod(F.conv(F.substring(seeded("shard", F.col("id")), 1, 8), 16, 10).cast("long"), F.lit(shards))
    order = Window.partitionBy("shard").orderBy(F.col("_n").desc(), "id")
    out = items.withColumn("shard", shard).withColumn("_n", length)
    out = out.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return out.withColumn("batch", F.floor(F.col("place") / batch_size)).drop("_n")


def collate(packed: DataFrame, batch: list[str], ids: Column, positions: Column, blocks: Column) -> DataFrame:
    """packed with input_ids, position_ids and block_ids padded to the longest row of its batch, and padding: how many
    places were added. A batch is bounded by what a model takes, so its longest length is one small aggregate."""
    longest = packed.groupBy(*batch).agg(F.max(F.size(ids)).alias("_width"))
    out = packed.join(longest, batch)
    more = F.col("_width") - F.size(ids)
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), more))
    out = out.withColumn("_a", fill(ids, PAD_ID)).withColumn("_b", fill(positions, 0)).withColumn("_c", fill(blocks, PAD_BLOCK)).withColumn("padding", more)
    kept = [c for c in packed.columns if c not in ("input_ids", "position_ids", "block_ids", "padding")]
    return out.select(*kept, F.col("_a").alias("input_ids"), F.col("_b").alias("position_ids"), F.col("_c").alias("block_ids"), "padding")


def display_order(key: Column, n: Column, seed: int | str) -> Column:
    """A seeded permutation of 0..n-1 for each row: canonical indices in the order of display."""
    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(seeded(seed, F.concat(key.cast("string"), F.lit("/"), i.cast("string"))).alias("h"), i.alias("i")))), lambda x: x["i"])


def displayed(values: Column, order: Column) -> Column:
    """Values by canonical index, as displayed."""
    return F.transform(order, lambda i: F.get(values, i))


def canonical(values: Column, order: Column) -> Column:
    """Values as displayed (a model's answer), back by canonical index."""
    return F.transform(order, lambda _, k: F.get(values, F.array_position(order, k).cast("int") - 1))
