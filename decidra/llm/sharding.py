"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. A document's id and text hash to a cell, each shard owns
``vnodes`` points on the ring, and a cell belongs to the first point clockwise. A shard takes at
most its capacity; what overflows goes on clockwise to the next shard with room.

One pass counts the load of each cell (at most ``2**cell_bits`` rows reach the driver, whatever the
input size). The driver pours cells into shards, which yields segments ``(cell, from, to, shard)``;
a second pass ranks documents within their cell and looks the segment up in that table, whose size
is bounded by cells + shards * shards and not by the data. Rows that agree in id, size and text are counted
before any shuffle and dealt out again behind the ranking, so that however often one repeats, no task ranks
its copies: a task holds the distinct rows of its cells.
"""

from __future__ import annotations

import bisect
import itertools
import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8

#: Copies of one row that a task deals out at once.
COPIES = 100_000
SEGMENT_SCHEMA = "cell long, seg_from long, seg_to long, shard int"


class Clockwise:
    """The distinct shards met clockwise from a cell; only as far round as was asked for."""

    def __init__(self, points: list[tuple[int, int, int]], shards: int) -> None:
        self.starts, self.owners, self.shards = [p[0] for p in points], [p[2] for p in points], shards
        self.met: dict[int, tuple[dict[int, None], int]] = {}

    def shard(self, cell: int, step: int) -> int:
        """The shard that cell's load is offered to in round step."""
        point = bisect.bisect_left(self.starts, cell) % len(self.starts)
        found, gone = self.met.get(point, ({}, 0))
        while len(found) <= step:
            found[self.owners[(point + gone) % len(self.owners)]] = None
            gone += 1
        self.met[point] = found, gone
        return next(itertools.islice(found, step, None))


@dataclass(frozen=True)
class Ring:
    """epsilon: how far a shard's load may exceed the mean; 0 makes capacities exact."""

    shards: int
    vnodes: int = 64
    cell_bits: int = 15
    epsilon: float = 0.05

    def points(self) -> list[tuple[int, int, int]]:
        """(cell, hash, shard) of every virtual node, clockwise."""
        out = []
        for shard in range(self.shards):
            for v in range(self.vnodes):
                h = xxhash.xxh64_intdigest(f"{shard}/{v}", seed=7)
                out.append((h >> (64 - self.cell_bits), h, shard))
        return sorted(out)

    def clockwise(self) -> Clockwise:
        return Clockwise(self.points(), self.shards)

    def capacities(self, total: int) -> list[int]:
        if self.epsilon == 0:
            base, more = divmod(total, self.shards)
            return [base + (s < more) for s in range(self.shards)]
        return [math.ceil((1 + self.epsilon) * total / self.shards)] * self.shards

    def pour(self, loads: dict[int, int]) -> list[tuple[int, int, int, int]]:
        """Segments (cell, from, to, shard) that cover each cell's load, no shard beyond its capacity.

        Every cell first offers its load to its own shard, in ring order; what is left over is
        offered to the next shard clockwise in the next round, and so on.
        """
        ring = self.clockwise()
        room = self.capacities(sum(loads.values()))
        left = {c: 0 for c in sorted(loads) if loads[c] > 0}
        out = []
        for step in range(self.shards):
            rest = {}
            for cell, done in left.items():
                shard = ring.shard(cell, step)
                took = min(room[shard], loads[cell] - done)
                if took:
                    out.append((cell, done, done + took, shard))
                    room[shard] -= took
                if done + took < loads[cell]:
                    rest[cell] = done + took
            left = rest
        return out


def assign(docs: DataFrame, ring: Ring, load: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within a shard) of each document.

    load: "rows" or "bytes", what capacities count. With "bytes" a document belongs to the segment
    in which its first byte falls, so a shard exceeds its capacity by one document at most.
    Null texts count as empty (size 1, crc 0); null ids are an id like any other; repeated rows are placed one
    by one; an empty table gives no rows. Other columns are ignored.
    """
    body = utf8(F.col("text"))
    keyed = docs.select("doc_id", (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    equal = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    equal = equal.withColumn("ring_pos", F.xxhash64("doc_id", "text_crc32"))
    equal = equal.withColumn("cell", F.shiftrightunsigned("ring_pos", 64 - ring.cell_bits))
    unit = F.lit(1).cast("long") if load == "rows" else F.col("size")
    found = equal.groupBy("cell").agg(F.sum(F.col("n") * unit).alias("w"), F.max("n").alias("most")).collect()
    poured = ring.pour({r["cell"]: r["w"] for r in found})
    segments = docs.sparkSession.createDataFrame(poured, SEGMENT_SCHEMA)

    order = Window.partitionBy("cell").orderBy("ring_pos", "doc_id", "text_crc32", "size")
    before = lambda x: F.coalesce(F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranked = equal.withColumn("rank", before(F.col("n")))
    ranked = ranked.withColumn("start", F.col("rank") if load == "rows" else before(F.col("n") * F.col("size")))
    # copy i of n lies at start + i * unit
    copy_at = lambda edge: F.ceil((F.col(edge) - F.col("start")) / unit)
    lo, hi = F.greatest(F.lit(0).cast("long"), copy_at("seg_from")), F.least(F.col("n"), copy_at("seg_to"))
    placed = ranked.join(F.broadcast(segments), "cell").withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")

    if load == "rows":
        met = [(c, a, s, b - a, a) for c, a, b, s in poured]
    else:
        each = placed.groupBy("cell", "seg_from", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("k"), F.min(F.col("rank") + F.col("lo")).alias("first")).collect()
        met = [(r["cell"], r["seg_from"], r["shard"], r["k"], r["first"]) for r in each]
    offsets, at = [], {}
    for cell, seg_from, shard, n, first in sorted(met):
        offsets.append((cell, seg_from, at.get(shard, 0) - first))
        at[shard] = at.get(shard, 0) + n
    slots = docs.sparkSession.createDataFrame(offsets, "cell long, seg_from long, slot_base long")
    out = placed.join(F.broadcast(slots), ["cell", "seg_from"])
    out = out.withColumn("part", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(COPIES).cast("long"))))
    if max((r["most"] for r in found), default=0) > COPIES:  # many copies of one row are dealt out again by several tasks
        out = out.repartition("cell", "seg_from", "doc_id", "part")
    out = out.withColumn("i", F.explode(F.sequence("part", F.least(F.col("hi"), F.col("part") + COPIES) - 1)))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("i") + F.col("slot_base")).alias("slot"))
