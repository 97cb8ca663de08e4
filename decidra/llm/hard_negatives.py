"""Hard negatives by inner products of whole numbers, computed bit-plane by bit-plane.

A component x becomes floor(SCALE * x). A score is the inner product of an anchor with a row. In two's complement a row's
component is its sign plane times -2^B plus its lower planes times 2^b, so a score is a sum over planes of the anchor's product
with rows of zeros and ones. Planes are taken most significant first. Behind plane b each component has between 0 and
2^b - 1 still to come, so the score lies between

    so far + (2^b - 1) * (sum of the anchor's negative components)    and
    so far + (2^b - 1) * (sum of its positive ones),

and the interval halves with every plane. A row is dropped for an anchor as soon as its interval can't qualify:

* positives: its upper end is below the k-th largest lower end of the anchor's label;
* negatives: the interval lies outside what all the anchor's positives allow, or, for each positive, its upper end is below
  the k-th largest lower end of those that certainly lie inside.

Ends that are equal are kept, since ties go by id. Once few pairs of a block are left, their remaining planes are summed pair
by pair. Sums are exact: doubles while they can't pass 2^53, else 64-bit integers.

Rows are dealt to blocks by a hash; anchors (a stated query set) are sent to every block, and there stream past the rows in
batches, so a task holds a block's rows and one batch. A block gives at most k rows an anchor (and positive); these are ranked
by a window, whose rows are cut to k in each task before they meet. A block has BLOCK rows at least and
grows to MOST, so the copies of an anchor stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release_memory

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative's has at least and at most.
LOW, HIGH = 30, 90
BLOCK, MOST, BLOCKS = 2048, 1 << 16, 1024
#: Anchors that are compared with a block at once, so that anchors x rows is PAIRS at most.
PAIRS = 1 << 22
#: Share of pairs still open below which they are finished pair by pair.
SPARSE = 1 / 16


# --- bit-planes


class Planes:
    """The bit-planes of a block's rows (rows x components, whole numbers), most significant first."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.bits = int(max(rows.max(initial=0), -1 - rows.min(initial=0), 0)).bit_length()
        self.cache: dict[tuple[int, type], np.ndarray] = {}

    def weight(self, b: int) -> int:
        return -(1 << b) if b == self.bits else 1 << b

    def plane(self, b: int, kind: type) -> np.ndarray:
        if (b, kind) not in self.cache:
            self.cache[b, kind] = ((self.rows >> b) & 1).astype(kind)
        return self.cache[b, kind]

    def low(self, b: int) -> np.ndarray:
        """What planes below b hold."""
        return self.rows & ((1 << b) - 1)

    def kind(self, anchors: np.ndarray) -> type:
        most = (2 << self.bits) * int(np.abs(anchors).sum(axis=1).max(initial=0))
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf or the least integer if a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), _least(values.dtype), dtype=values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _least(kind) -> float | int:
    return -np.inf if np.issubdtype(kind, np.floating) else np.iinfo(kind).min


def survivors(anchors: np.ndarray, planes: Planes, allowed: np.ndarray, drop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs that drop leaves. allowed: which pairs are candidates at all. drop(low, high,
    open) gives the open pairs whose intervals still qualify."""
    kind = planes.kind(anchors)
    a = anchors.astype(kind)
    below, above = np.minimum(a, 0).sum(axis=1)[:, None], np.maximum(a, 0).sum(axis=1)[:, None]
    so_far = np.zeros(allowed.shape, dtype=kind)
    open_ = allowed.copy()
    for b in range(planes.bits, -1, -1):
        so_far += planes.weight(b) * (a @ planes.plane(b, kind).T)
        rest = (1 << b) - 1
        open_ = drop(so_far + rest * below, so_far + rest * above, open_)
        i, j = np.nonzero(open_) if np.count_nonzero(open_) <= SPARSE * open_.size else (None, None)
        if i is not None:
            score = so_far[i, j].astype(np.int64)
            low = planes.low(b)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] += np.einsum("pd,pd->p", anchors[i[part]], low[j[part]])
            return i, j, score
    i, j = np.nonzero(open_)
    return i, j, so_far[i, j].astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(g)]])))
    return order[rank < k]


def nearest(anchors: np.ndarray, planes: Planes, allowed: np.ndarray, ids: np.ndarray, k: int):
    """(anchor, row, score): the first k allowed rows of each anchor."""

    def drop(low, high, open_):
        least = _kth_largest(np.where(open_, low, _least(low.dtype)), k)[:, None]
        return open_ & (high >= least)

    i, j, score = survivors(anchors, planes, allowed, drop)
    best = _first(i, score, ids[j], k)
    return i[best], j[best], score[best]


def within(anchors: np.ndarray, planes: Planes, allowed: np.ndarray, ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int):
    """(anchor, range, row, score): for each of an anchor's ranges (lows, highs: anchors x ranges) the first k allowed rows
    whose scores lie inside. A range with low above high holds none."""

    lowest, highest, widest = lows.min(axis=1)[:, None], highs.max(axis=1)[:, None], (highs - lows).max(initial=0)

    def drop(low, high, open_):
        some = open_ & (high >= lowest) & (low <= highest)
        if not low.size or (high[:, 0] - low[:, 0]).min() > widest:  # no interval lies inside a range yet
            return some
        keep = np.zeros_like(open_)
        for r in range(lows.shape[1]):
            lo, hi = lows[:, r, None], highs[:, r, None]
            may = some & (high >= lo) & (low <= hi)
            surely = may & (low >= lo) & (high <= hi)
            if surely.any():
                may &= high >= _kth_largest(np.where(surely, low, _least(low.dtype)), k)[:, None]
            keep |= may
        return keep

    i, j, score = survivors(anchors, planes, allowed, drop)
    out = []
    for r in range(lows.shape[1]):
        own = np.flatnonzero((score >= lows[i, r]) & (score <= highs[i, r]))
        best = own[_first(i[own], score[own], ids[j[own]], k)]
        out.append((i[best], np.full(len(best), r), j[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- blocks


def _matrix(values: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an array of lists of whole numbers; shorter rows end in zeros."""
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), width or 0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class _Block:
    """Rows of a block, each distinct one once, sorted by label."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        rows, ids, labels = _matrix(table["v"]), table["id"].to_numpy(), table["label"].to_numpy()
        order = np.lexsort((ids, labels))
        rows, ids, labels = rows[order], ids[order], labels[order]
        if ((np.diff(ids) == 0) & (np.diff(labels) == 0)).any():
            whole = np.unique(np.column_stack([labels, ids, rows]), axis=0)
            labels, ids, rows = whole[:, 0], whole[:, 1], np.ascontiguousarray(whole[:, 2:])
        self.labels, self.ids, self.rows = labels, ids, rows
        self.planes = Planes(self.rows)
        self.by_label: dict[int, tuple[np.ndarray, Planes]] = {}

    def of_label(self, label: int) -> tuple[np.ndarray, Planes]:
        if label not in self.by_label:
            at = np.flatnonzero(self.labels == label)
            self.by_label[label] = at, Planes(self.rows[at])
        return self.by_label[label]


def _fit(block: _Block, anchors: np.ndarray) -> np.ndarray:
    """Anchors cut or filled with zeros to the block's width: what a row lacks counts as zero."""
    width = block.rows.shape[1]
    own = anchors[:, :width]
    return np.pad(own, ((0, 0), (0, width - own.shape[1])))


def _blocks(batches, found):
    """Streams (block, is_anchor, ...) sorted by block and is_anchor: the rows of a block, then its anchors in batches, for
    which found(block, batch) gives a record batch."""
    block, parts, now = None, [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        asks = batch.column("is_anchor").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
            if hi == lo:
                continue
            if numbers[lo] != now:
                block, parts, now = None, [], numbers[lo]
            part = batch.slice(lo, hi - lo)
            if not asks[lo]:
                parts.append(part)
                continue
            if block is None and parts:
                block, parts = _Block(parts), []
            if block is not None:
                size = max(1, PAIRS // max(1, len(block.ids)))
                for at in range(0, len(part), size):
                    yield found(block, part.slice(at, size))
    release_memory()


_NEAR = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
_INSIDE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _near_batches(k: int):
    def found(block: _Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        vectors = _fit(block, _matrix(batch.column("v")))
        out = []
        for label in np.unique(labels).tolist():
            at, planes = block.of_label(label)
            if not len(at):
                continue
            mine = np.flatnonzero(labels == label)
            others = block.ids[at]
            i, j, score = nearest(vectors[mine], planes, ids[mine][:, None] != others, others, k)
            out.append((ids[mine][i], np.full(len(i), label), others[j], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], _NEAR)

    return lambda batches: _blocks(batches, found)


def _inside_batches(k: int, low: int, high: int):
    def found(block: _Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        vectors = _fit(block, _matrix(batch.column("v")))
        positives, scores = _matrix(batch.column("positives")), _matrix(batch.column("scores"))
        there = np.arange(positives.shape[1]) < np.diff(batch.column("positives").offsets.to_numpy())[:, None]
        # whole numbers s with low * p <= 100 * s <= high * p
        lows, highs = np.where(there, -(-low * scores // 100), 1), np.where(there, high * scores // 100, 0)
        i, r, j, score = within(vectors, block.planes, labels[:, None] != block.labels, block.ids, lows, highs, k)
        columns = [ids[i], positives[i, r], block.ids[j], scores[i, r], score]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], _INSIDE)

    return lambda batches: _blocks(batches, found)


# --- the operator


def numbers(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, label and v (whole numbers of 32 bits; beyond them is an error) of the rows that take part: no null or non-finite
    component, and no null in id, label or vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return rows.where(usable).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("int")).alias("v"))


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows and anchors by block, sorted so that a block's rows come before its anchors. Anchors go to every block."""
    extra = [c for c in anchors.columns if c not in ("id", "label", "v")]
    own = rows.withColumn("block", F.pmod(F.xxhash64("id", "label"), F.lit(blocks)).cast("int")).withColumn("is_anchor", F.lit(False))
    own = own.select("block", "is_anchor", "id", "label", "v", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_anchor", F.lit(True))
    both = own.unionByName(asked.select(own.columns))
    return both.repartition(blocks, "block").sortWithinPartitions("block", "is_anchor")


def block_count(rows: int) -> int:
    """Blocks for so many rows: BLOCK rows each at least, at most BLOCKS of them until a block has MOST rows."""
    return max(1, -(-rows // min(MOST, max(BLOCK, rows // BLOCKS))))


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: id, label and v (see numbers()); anchors: a condition on id. An anchor's positives are its first other rows
    of its label by score, then smaller id; a positive's negatives are the first rows of other labels whose score is low
    to high percent of the positive's. Rows that are equal in id, label and v count once; a row of the anchor's own id is
    never its positive. Of several rows of an anchor's id the one with the smallest label and v asks. Where vectors differ in length, what one lacks counts as zero; empty ones score 0. An anchor without
    positives, and a positive without negatives, give no row. An empty table gives no rows.
    """
    blocks = block_count(rows.count())
    asked = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    near = _dealt(rows, asked, blocks).mapInArrow(_near_batches(positives), "anchor_id long, label long, other long, score long")
    first = Window.partitionBy("anchor_id", "label").orderBy(F.col("score").desc(), "other")
    best = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    lists = F.sort_array(F.collect_list(F.struct("r", "other", "score")))
    grouped = cut(best.groupBy(F.col("anchor_id").alias("id"), "label").agg(lists.alias("p")))
    full = asked.join(grouped, ["id", "label"]).select("id", "label", "v", F.col("p.other").alias("positives"), F.col("p.score").alias("scores"))
    kind = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    inside = _dealt(rows, full, blocks).mapInArrow(_inside_batches(negatives, low, high), kind)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
