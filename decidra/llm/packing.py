"""Packing of documents into sequences by the cutting-stock method, with column generation.

A document's ids and an end id are packed into sequences of at most SIZE ids. Lengths are counted in units of UNIT ids, rounded
up, so whatever the table's size the histogram has SIZE / UNIT classes at most. Over it a linear program chooses how often
each pattern (how many pieces of each class share a sequence) is used:

    least sum of x_p,  sum over p of a_up x_p = d_u for each class u,  x_p >= 0

Patterns are not listed: a knapsack over a sequence's units, by dynamic programming, finds the pattern worth most at the
program's present prices, and it enters the basis while it is worth more than a sequence. Counts are then rounded down,
and the few pieces that are left (less than one sequence a class) are placed first-fit, longest first. All of that works
on the histogram, on the driver. The documents of a class are ranked, and the rank says which pattern's place a document takes.

What the rounding leaves free is filled with pieces that are cut anyway: a text above SIZE ids gives whole sequences
and a tail; tails form one stream, laid into the gaps in order and cut where a gap ends. Where the tails would not fill the gaps,
the longest documents join them (`_plan` lowers the length from which they do). What is left of the stream makes full
sequences, and at its end sequences of the powers of two that its rest is made of. So no sequence needs padding, if there
is a stream at all.

Ranks, and places in the streams, are running sums within hashed buckets of about BUCKET rows plus the sums of the
buckets before, so no task holds a class or a stream; streams meet in blocks of BLOCK ids. Texts are tokenised once, and their ids
written; only keys and lengths are shuffled until the last join brings the pieces to the ids.
"""

from __future__ import annotations

import functools
import gc
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release_memory, shared_dir

SIZE = 4096
UNIT = 16
END = 2
BUCKET = 2048
BLOCK = SIZE * 64
#: Words whose ids a worker remembers at most; beyond them it starts anew.
REMEMBERED = 500_000
#: New words that are encoded at once, and characters of texts whose new words are gathered.
LEARNED_AT_ONCE, AT_ONCE = 16_000, 1 << 21


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens


#: Texts of these characters only are parted here: ASCII, Latin letters and common punctuation, which no normal form changes and whose
#: lower case does not depend on their neighbours. Dotted capital I (two characters when lowered) is left out.
PLAIN = re.compile(r"[\x00-\x7f\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")
_LETTER, _NUMBER = r"a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The tokenizer's own pattern for words (fixed value), for the lower-case characters of PLAIN. Letters stand first as most words are
#: letters; no other alternative starts with one.
WORD = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r {_LETTER}{_NUMBER}]+")


class WordIds:
    """Ids of texts as little-endian integers of ``width`` bytes. Plain texts are parted into the tokenizer's words here, whose ids
    are remembered; what stands between white space is looked up once a batch of texts, and joined in Arrow by its places. New words
    are encoded many at once, each word's last id being one that ends words. All other
    texts, and those with a special token's string, go through the tokenizer whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups = [words[at : at + LEARNED_AT_ONCE] for at in range(0, len(words), LEARNED_AT_ONCE)]
        while groups:
            some = groups.pop()
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) or len(some) == 1:
                ends = (last if len(some) > 1 else np.array([len(ids)])) * self.kind.itemsize
                body, ends = ids.tobytes(), ends.tolist()
                out.update(zip(some, map(body.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:  # a word whose ids don't end one
                groups += [some[: len(some) // 2], some[len(some) // 2 :]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The collector of cycles rests meanwhile: there are none, and it would walk all words."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(PLAIN.fullmatch(text)) and not any(x in text for x in self.special) for text in texts]
        parted = iter(self._parted([text.lower() for text, own in zip(texts, plain) if own]))
        whole = lambda text: np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return [next(parted) if own else whole(text) for text, own in zip(texts, plain)]

    def _parted(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts in lower case. What stands between white space is looked up once, however often it comes."""
        if not texts:
            return []
        each = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = each.flatten().dictionary_encode()
        found = self._chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = pa.array(found, pa.large_binary()).take(chunks.indices)
        _, ends, body = taken.buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(taken) + 1)[each.offsets.to_numpy()].tolist()
        body = body.to_pybytes() if body else b""
        return [body[a:b] for a, b in zip(ends, ends[1:])]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without white space: a word, or several that meet there."""
        known = self.known
        found = list(map(known.get, chunks))
        odd = [i for i, ids in enumerate(found) if ids is None]
        words = [WORD.findall(chunks[i]) for i in odd]
        new = {w for own in words for w in own if w not in known}
        if new:
            known.update(extra := self._learn(list(new)))
            if len(known) > REMEMBERED:  # what is in use stays
                self.known = extra | {c: ids for c, ids in zip(chunks, found) if ids is not None}
        for i, own in zip(odd, words):
            found[i] = known[own[0]] if len(own) == 1 else b"".join(map(known.__getitem__, own))
        return found


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """_key (one a row), doc_id, x (width: bytes of an id; ids: those of the text and the end id) and n, written once to the shared
    folder by columns, so that what needs lengths only doesn't read the ids."""
    path = tokenizer or default_tokenizer()

    def run(texts: pa.Array) -> pa.Array:
        words, ids, held, chars = _word_ids(path), [], [], 0
        last = np.array([end], dtype=words.kind).tobytes()
        for i, x in enumerate(texts):
            held.append(x.as_py() or "")
            chars += len(held[-1])
            if chars >= AT_ONCE or i == len(texts) - 1:
                ids += [found + last for found in words.encode(held)]
                held, chars = [], 0
        release_memory()
        return pa.StructArray.from_arrays([pa.array([words.kind.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["width", "ids"])

    ids = F.arrow_udf(run, returnType="width int, ids binary").asNondeterministic()(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", ids.alias("x"))
    named = found.select(F.monotonically_increasing_id().alias("_key"), "doc_id", "x", (F.octet_length("x.ids") / F.col("x.width")).cast("long").alias("n"))
    at = shared_dir(docs.sparkSession, "tokens")
    named.write.parquet(at)
    return docs.sparkSession.read.schema(named.schema).parquet(at)


# --- the plan, from a histogram


def knapsack(worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The largest worth of a pattern and the pattern: copies of each class (class u takes u + 1 units)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        m = min(c, len(worth))
        value = worth[:m] + best[c - m : c][::-1]
        u = int(value.argmax())
        best[c], took[c] = (value[u], u) if value[u] > best[c - 1] else (best[c - 1], -1)
    pattern, c = np.zeros(len(worth), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= took[c] + 1
    return float(best[capacity]), pattern


def generate_columns(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, of an optimal fractional plan for the demand by class. After so many
    rounds it stops with the plan it has, which meets the demand too."""
    used = np.flatnonzero(demand)
    m = len(used)
    fit = capacity // (used + 1)
    patterns = np.zeros((m, len(demand)), dtype=np.int64)
    patterns[np.arange(m), used] = fit
    inverse, x = np.diag(1.0 / fit), demand[used] / fit
    worth = np.zeros(len(demand))
    for _ in range(rounds):
        worth[:] = 0
        worth[used] = inverse.sum(axis=0)  # prices: a sequence costs 1
        value, pattern = knapsack(worth, capacity)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern[used]
        ratios = np.full(m, np.inf)
        np.divide(x, column, out=ratios, where=column > 1e-9)
        out = int(ratios.argmin())
        step = ratios[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, x


def first_fit(demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that place the demand exactly, longest pieces first, each in the first sequence with room."""
    free: list[int] = []
    out: list[np.ndarray] = []
    for u in np.flatnonzero(demand)[::-1]:
        left, at = int(demand[u]), 0
        while left:
            if at == len(free):
                free.append(capacity)
                out.append(np.zeros(len(demand), dtype=np.int64))
            k = min(left, free[at] // (u + 1))
            out[at][u] += k
            free[at] -= k * (u + 1)
            left -= k
            at += 1
    return out


def packed_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, how many sequences follow it) that hold the demand exactly."""
    patterns, x = generate_columns(demand, capacity)
    out, left = [], demand.astype(np.int64).copy()
    for pattern, k in zip(patterns, np.floor(x + 1e-7).astype(np.int64)):
        held = pattern > 0
        k = int(min(k, (left[held] // pattern[held]).min())) if held.any() else 0
        if k > 0:
            out.append((pattern, k))
            left -= k * pattern
    return out + [(p, 1) for p in first_fit(left, capacity)]


def _plan(histogram: dict[int, int], tails: int, size: int, unit: int) -> tuple[int, list[tuple[np.ndarray, int]]]:
    """The longest length that stays whole, and the patterns of those up to it. histogram: documents by length, up to
    size; tails: ids in the stream besides. The limit falls until the stream fills what the patterns leave free."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    limit, capacity = size, size // unit
    while True:
        whole = lengths <= limit
        demand = np.zeros(capacity, dtype=np.int64)
        np.add.at(demand, (lengths[whole] - 1) // unit, counts[whole])
        plan = packed_patterns(demand, capacity) if demand.any() else []
        stream = tails + int((lengths * counts)[~whole].sum())
        gaps = size * sum(k for _, k in plan) - int((lengths * counts)[whole].sum())
        if stream >= gaps or not plan:
            return limit, plan
        # lengths from the top down until the stream would fill the gaps as they are now
        more = np.cumsum((lengths * counts)[whole][::-1])
        enough = int(np.searchsorted(more, gaps - stream))
        limit = int(lengths[whole][::-1][min(enough, whole.sum() - 1)]) - 1


# --- running sums


def running(df: DataFrame, group: list[str], key: str, value: str, name: str, total: int) -> DataFrame:
    """df with name, the sum of value over the rows of its group before it, in an order of hashed buckets and then key. total:
    rows of df at most, from which the number of buckets is taken; key: one a row."""
    buckets = 1 + total // BUCKET
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    by = [*group, "_b"]
    sums = dealt.groupBy(*by).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    within = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(before, by).withColumn(name, F.col("_s") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_b", "_s")


# --- placing


def _places(spark: SparkSession, plan: list[tuple[np.ndarray, int]]) -> DataFrame:
    """A row for each class of each pattern: class, first and last rank that it takes, copies a sequence, first sequence, and
    which place its copies take. At most classes x patterns rows, so bounded by the histogram."""
    rows, taken, base = [], {}, 0
    for pattern, k in plan:
        at = 0
        for u in np.flatnonzero(pattern).tolist():
            a, lo = int(pattern[u]), taken.get(u, 0)
            rows.append((u, lo, lo + a * k, a, base, at))
            taken[u], at = lo + a * k, at + a
        base += k
    return spark.createDataFrame(rows, "class int, lo long, hi long, copies long, base long, place long")


def _whole(docs: DataFrame, plan: list[tuple[np.ndarray, int]], unit: int, total: int) -> DataFrame:
    """_key, start, length, sequence_id and offset of the documents (_key, n) that stay whole."""
    ranked = running(docs.select("_key", "n", F.floor((F.col("n") - 1) / unit).cast("int").alias("class"), F.lit(1).alias("one")), ["class"], "_key", "one", "rank", total)
    places = F.broadcast(_places(docs.sparkSession, plan))
    nth = F.col("rank") - F.col("lo")
    at = ranked.join(places, "class").where("rank >= lo AND rank < hi").select("_key", "n", (F.col("base") + F.floor(nth / F.col("copies"))).alias("sequence_id"), (F.col("place") + nth % F.col("copies")).alias("place"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return at.select("_key", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), "sequence_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def _blocks(first: str, length: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(first) / BLOCK), F.floor((F.col(first) + F.col(length) - 1) / BLOCK)))


def _poured(stream: DataFrame, gaps: DataFrame) -> DataFrame:
    """The pieces where rows of stream (_key, start, size, f: place in the stream) meet gaps (sequence_id, free, used, g:
    place in the gaps). Both lie in blocks of BLOCK ids, and meet by block."""
    left = stream.select("*", _blocks("f", "size").alias("block"))
    right = gaps.select("*", _blocks("g", "free").alias("block"))
    from_, to = F.greatest("f", "g"), F.least(F.col("f") + F.col("size"), F.col("g") + F.col("free"))
    met = left.join(right, "block").withColumn("from", from_).withColumn("to", to).where((F.col("from") < F.col("to")) & (F.floor(F.col("from") / BLOCK) == F.col("block")))
    return met.select("_key", (F.col("start") + F.col("from") - F.col("f")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "sequence_id", (F.col("used") + F.col("from") - F.col("g")).alias("offset"))


def placed(found: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame | None:
    """_key, start, length, sequence_id and offset of all pieces of found (_key, n); null without rows."""
    spark = found.sparkSession
    lengths = found.select("_key", "n")
    short = {r["n"]: r["count"] for r in lengths.where(F.col("n") <= size).groupBy("n").count().collect()}  # at most size rows
    rest = F.col("n") % size
    tail_ids, parts, longs = lengths.where(F.col("n") > size).agg(F.coalesce(F.sum(rest), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("n") / size)), F.lit(0)), F.count("*")).first()
    if not short and not longs:
        return None
    limit, plan = _plan(short, tail_ids, size, unit)
    n_whole = sum(k for _, k in plan)
    total = sum(short.values()) + longs
    out = []
    gaps = None
    if plan:
        whole = cut(_whole(lengths.where(F.col("n") <= limit), plan, unit, total))
        out.append(whole)
        filled = whole.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < size).withColumn("free", size - F.col("used"))
        gaps = cut(running(filled, [], "sequence_id", "free", "g", n_whole))
    # long texts: whole sequences, then their tail joins the stream
    longer = lengths.where(F.col("n") > size)
    whole_parts = running(longer.withColumn("k", F.floor(F.col("n") / size)), [], "_key", "k", "first", longs)
    each = whole_parts.select("_key", "first", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("_", "i"))
    out.append(each.select("_key", (F.col("i") * size).alias("start"), F.lit(size).cast("long").alias("length"), (n_whole + F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    loose = lengths.where(F.col("n") > limit).select("_key", F.when(F.col("n") > size, F.col("n") - rest).otherwise(F.lit(0)).alias("start"), F.when(F.col("n") > size, rest).otherwise(F.col("n")).alias("size")).where("size > 0")
    stream = cut(running(loose, [], "_key", "size", "f", total))
    length = tail_ids + sum(n * k for n, k in short.items() if n > limit)
    taken = (size * n_whole - sum(n * k for n, k in short.items() if n <= limit)) if plan else 0
    first = n_whole + parts
    full, left = divmod(max(0, length - taken), size)
    more = spark.range(full).select((F.lit(first) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(size).cast("long").alias("free"), (F.lit(taken) + F.col("id") * size).cast("long").alias("g"))
    powers = [1 << b for b in range(size.bit_length()) if left >> b & 1][::-1]
    ends = list(itertools.accumulate(powers, initial=0))
    rows = [(first + full + i, 0, p, taken + full * size + ends[i]) for i, p in enumerate(powers)]
    more = more.unionByName(spark.createDataFrame(rows, "sequence_id long, used long, free long, g long"))
    every = more if gaps is None else gaps.select(*more.columns).unionByName(more)
    out.append(_poured(stream, every))
    return functools.reduce(DataFrame.unionByName, out)


_PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def _cut_up(with_ids: bool):
    def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        out = []
        for width, body, rows in zip(texts.field("width").to_pylist(), texts.field("ids"), pieces):
            ids, here = np.frombuffer(body.as_buffer(), dtype=f"<u{width}").astype("<u4"), []
            for r in rows.as_py():
                part = ids[r["start"] : r["start"] + r["length"]]
                here.append(r | {"ids_crc32": zlib.crc32(part), "ids": part.tolist() if with_ids else None})
            out.append(here)
        release_memory()
        return pa.array(out, _PIECES)

    kind = "array<struct<start: bigint, length: bigint, sequence_id: bigint, offset: bigint, ids_crc32: bigint, ids: array<int>>>"
    return F.arrow_udf(run, returnType=kind).asNondeterministic()


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, unit: int = UNIT, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    size: a power of two; unit divides it. Null and empty texts are their end id alone, one piece of one id. Texts of any
    length are taken whole. Each row is a document of its own, whether or not its id or text repeats; null ids stay null. Ties
    (equal lengths) go by the row's key. An empty table gives no rows; other columns are ignored.
    """
    found = tokenised(docs.select("doc_id", "text"), tokenizer)
    pieces = placed(found, size, unit)
    if pieces is None:
        pieces = docs.sparkSession.createDataFrame([], "_key long, start long, length long, sequence_id long, offset long")
    by_doc = pieces.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    whole = found.join(by_doc, "_key").select("doc_id", "n", F.explode(_cut_up(with_ids)("x", "pieces")).alias("x"))
    return whole.select("doc_id", "x.start", "x.length", "x.ids_crc32", F.col("n").alias("doc_tokens"), "x.sequence_id", "x.offset", *(["x.ids"] if with_ids else []))
