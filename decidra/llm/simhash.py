"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code [23, 12, 7]. The codewords within distance 4 of a word are 1 (if one lies
within 2) or 6 (one at 3, five at 4); their 12-bit indices are the word's keys. Two words that differ
in at most 2 bits always have a key in common:

* if one lies within 2 of a codeword, the other lies within 4 of it;
* else both lie at 3 of theirs. Seen from the first one's codeword the first word is a 3-set A, the
  other adds or removes two places. If it removes one, it is within 3 of that codeword. If it adds x
  and y, the five codewords through A split the other places into blocks of 4, and the codeword
  whose block holds x is at distance 4 of the first word and at 2 or 4 of the other.

Two fingerprints that differ in at most LIMIT = 4 bits share one of these keys (pigeonhole):

* some segment is equal: of the other two, one has at most 2 errors, and (its index, the equal
  segment) is a key of 33 or 34 bits;
* none is equal: the errors are (1, 1, 1) or (1, 1, 2). The worst segment has at most 2 errors and
  the other two one each, so a half of each is equal: (its index, a half of each of the others).

That makes at most 108 keys for a fingerprint. Fingerprints are put together by key with a shuffle and
a sort; in each run of equal keys distances are verified and a spanning forest of the links is
emitted (never all pairs), which keeps every connection. Equal fingerprints are one node from the
start, so large groups of exact copies cost one fingerprint. Components come from star contraction.

A task holds RUN fingerprints of a run at most. A longer run is dealt out again: the bits not yet used
are parted into LIMIT + 1 pieces, of which a linked pair agrees in one whole piece at least, and every
fingerprint gets a new key for each piece. What is still too long goes round again; a run whose
remaining bits are 14 holds RUN values at most, so this ends, and no link is lost.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, unpacked, utf8
from .components import components

LIMIT = 4
SEED = 42
SHINGLE = 4
WIDTHS = (22, 21, 21)
HALF = 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code. Fixed value of the code.
GENERATOR = 0xAE3
#: Shingles of which hashes are held at once.
SLICE = 1 << 16
#: Fingerprints of a run of equal keys that a task holds at most.
RUN = 1 << 14


# --- fingerprints


def fingerprint(body: bytes) -> int:
    """Unsigned SimHash of one whole text: bits set in over half of its shingles' hashes; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a column _fp, the fingerprint as a signed long. Null texts have no words."""

    def run(bodies: pa.Array) -> pa.Array:
        values = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in bodies], dtype=np.uint64)
        return pa.array(values.view(np.int64))

    return docs.withColumn("_fp", F.arrow_udf(run, returnType="long").asNondeterministic()(utf8(F.col("text"))))


# --- keys


@functools.cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """parity of each 12-bit message; for each syndrome the error patterns of weight 4 at most, -1 where there are fewer than 6."""
    parity = np.zeros(4096, dtype=np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        parity[message] = rest
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            error = sum(1 << p for p in places)
            found[parity[error >> 11] ^ (error & 2047)].append(error)
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    for syndrome, errors in enumerate(found):
        patterns[syndrome, : len(errors)] = errors
    return parity, patterns


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance 4 of each 23-bit word, and which of the 6 places hold one."""
    parity, patterns = _decoder()
    errors = patterns[parity[words >> 11] ^ (words & 2047)]
    return (words[:, None] ^ np.maximum(errors, 0)) >> 11, errors >= 0


def fingerprint_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint) for all keys of the unsigned fingerprints."""
    segments, at = [], 0
    for width in WIDTHS:
        segments.append(((values >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    row = np.arange(len(values))[:, None]
    keys, rows = [], []

    def add(family: int, index: np.ndarray, held: np.ndarray, rest: np.ndarray) -> None:
        key = (np.int64(family) << 58) | (index << 24) | rest[:, None]
        keys.append(key[held])
        rows.append(np.broadcast_to(row, held.shape)[held])

    for i in range(3):
        index, held = golay_indices(segments[i])
        j, k = (x for x in range(3) if x != i)
        add(i * 2, index, held, segments[j])
        add(i * 2 + 1, index, held, segments[k])
        for a, b in itertools.product((0, 1), repeat=2):
            left = (segments[j] >> (HALF * a)) & ((1 << HALF) - 1)
            right = (segments[k] >> (HALF * b)) & ((1 << HALF) - 1)
            add(6 + i, index | (a * 2 + b) << 12, held, left << HALF | right)
    return np.concatenate(keys), np.concatenate(rows)


def _key_batches(batches):
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            keys, rows = fingerprint_keys(part.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(part[rows])], schema)


# --- links


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (of at most LIMIT bits) that connect the unsigned values just as all their links do."""
    left, out = values, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= LIMIT
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def _run_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    pairs = starts[sizes == 2]
    a, b = values[pairs], values[pairs + 1]
    near = np.bitwise_count(a ^ b) <= LIMIT
    more = [x for s, n in zip(starts[sizes > 2], sizes[sizes > 2]) for x in forest(values[s : s + n])]
    extra = np.array(more, dtype=np.uint64).reshape(-1, 2)
    return np.concatenate([a[near], extra[:, 0]]), np.concatenate([b[near], extra[:, 1]])


def _piece_keys(keys: np.ndarray, values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, value, free) for each piece of the bits in free; a piece's bits are not free any more."""
    out = []
    for mask in np.unique(free):
        own = free == mask
        bits = [i for i in range(64) if int(mask) >> i & 1]
        for piece in range(LIMIT + 1):
            used = np.uint64(sum(1 << i for i in bits[piece :: LIMIT + 1]))
            mixed = keys[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(piece)
            for part in (np.uint64(SEED), values[own] & used):
                mixed = (mixed ^ (mixed >> np.uint64(29)) ^ part) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed ^ (mixed >> np.uint64(32)), values[own], np.full(own.sum(), mask & ~used)))
    return tuple(np.concatenate(x) for x in zip(*out))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("free", pa.int64())])


def _link_batches(batches, run: int):
    """Links (a, b) from (key, fp and perhaps free) sorted by key; rows (a, key, free) of runs above run values.

    The last run of a batch is held back, as it may go on in the next one; one that is too long is passed on at once.
    """

    def linked(keys, values):
        a, b = (x.view(np.int64) for x in _run_links(keys, values))
        none = pa.nulls(len(a), pa.int64())
        return pa.record_batch([pa.array(a), pa.array(b), none, none], _FOUND)

    def dealt(keys, values, free):
        again, own, left = (x.view(np.int64) for x in _piece_keys(keys, values, free))
        return pa.record_batch([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(again), pa.array(left)], _FOUND)

    held, over = None, None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
        if len(rows) == 2:
            rows.append(np.full(len(rows[0]), -1, dtype=np.int64))
        rows = [rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64)]
        if over is not None:
            more = int(np.searchsorted(rows[0], over, "right"))
            if more:
                yield dealt(*(x[:more] for x in rows))
            rows = [x[more:] for x in rows]
        if not len(rows[0]):
            continue
        over = None
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [len(rows[0])]]))
        long = np.repeat(sizes > run, sizes)
        if long.any():
            yield dealt(*(x[long] for x in rows))
        if last:
            whole = ~long[:last]
            if whole.any():
                yield linked(*(x[:last][whole] for x in rows[:2]))
        held, over = (None, rows[0][-1]) if long[-1] else ([x[last:] for x in rows], None)
    if held:
        yield linked(*held[:2])


def links(distinct: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links to connect all that are linked.

    run: fingerprints of one key that a task holds, 2^(LIMIT + 1) at least."""
    run = max(run, 2 << LIMIT)
    keyed, found = distinct.select("fp").mapInArrow(_key_batches, "key long, fp long"), None
    while True:
        dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
        # a pair shares up to 108 keys, so its links are made one before they are written
        each = cut(dealt.mapInArrow(lambda batches: _link_batches(batches, run), "a long, b long, key long, free long").distinct())
        own = each.where("key IS NULL").select("a", "b")
        found = own if found is None else found.unionByName(own)
        keyed = each.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), "free")
        if keyed.isEmpty():
            return found


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each _fp of nodes: first, the smallest own key (null keys last) in its component by edges (a, b)."""
    roots = components(edges)
    linked = cut(roots.join(nodes, roots["node"] == nodes["_fp"]).select("node", "root", "own"))
    # both sides are written tables, so Spark can split the join at the root of a giant component
    firsts = cut(linked.groupBy("root").agg(F.min("own").alias("first")))
    moved = linked.join(firsts, "root").select(F.col("node").alias("_node"), "first")
    return nodes.join(moved, nodes["_fp"] == moved["_node"], "left").select("_fp", F.when(F.col("_node").isNotNull(), F.col("first")).otherwise(F.col("own")).alias("first"))


def _nodes(found: DataFrame, key: Column | str) -> DataFrame:
    return cut(found.groupBy("_fp").agg(F.min(key).alias("own")))


def _edges(nodes: DataFrame) -> DataFrame:
    return links(nodes.select(F.col("_fp").alias("fp")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row.

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids never name a
    component unless all its ids are null; then component_id is null. Repeated rows stay. An empty
    table gives no rows; other columns are ignored.
    """
    found = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "_fp"))
    nodes = _nodes(found, "doc_id")
    named = cut(classes(nodes, _edges(nodes)))  # a join of two plain exchanges, which Spark can split at a hot fingerprint
    joined = found.join(named.withColumnRenamed("_fp", "_f"), F.col("_fp") == F.col("_f"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def ranked(docs: DataFrame) -> DataFrame:
    """docs with two hashes of id and text, which name a row whatever its id."""
    return docs.select("*", F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64("text", "doc_id", F.lit("j")).alias("_j"))


def kept_firsts(docs: DataFrame, found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of docs whose own key (doc_id, _k, _j) comes first in its component; repeats give one row."""
    firsts = cut(classes(nodes, edges).select("first").distinct().select("first._k", "first._j"))
    kept = ranked(packed(docs, "doc_id", "text")).select("_row", "_k", "_j").join(firsts, ["_k", "_j"], "left_semi")
    repeats = found.join(firsts, ["_k", "_j"], "left_semi").groupBy("_k", "_j").count().where("count > 1")
    if not repeats.isEmpty():  # a second shuffle of texts only where whole rows repeat
        kept = kept.dropDuplicates(["_k", "_j"])
    return unpacked(kept)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest id (null ids
    last), and among equal ids the one with the smallest hash; repeats of id and text give one row."""
    found = cut(fingerprints(ranked(docs.select("doc_id", "text"))).select("doc_id", "_k", "_j", "_fp"))
    nodes = _nodes(found, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k", "_j"))
    return kept_firsts(docs, found, nodes, _edges(nodes))
