"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A document that
holds a window holds every shingle (pair of neighbouring words) of it, so one necessary shingle is
enough to find it: the rarest one by its count over all documents, at a known offset. Documents'
shingles are joined with those prefix shingles; offset and length bound the place, and the words at
that place are compared with the window's, all within the join's condition, so that the join puts out
verified occurrences only.

Benchmark tables are small next to a corpus; tables made from them are broadcast only if they have at most
BROADCAST_ROWS rows and BROADCAST_BYTES bytes. Beyond that places of shingles (no words) are shuffled to the
prefix, and the words of the documents that have a candidate come to it by a second join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, packed, unpacked

WINDOW = 13
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _places(words: str, size: int) -> Column:
    """An array with an element for each shingle of the words, in order."""
    here = F.col(words)
    if size == 1:
        return F.arrays_zip(here.alias("x"), here.alias("y"))
    after = F.slice(here, 2, F.greatest(F.size(here) - 1, F.lit(0)))
    return F.arrays_zip(F.slice(here, 1, F.greatest(F.size(here) - 1, F.lit(0))).alias("x"), after.alias("y"))


def _shingle(place: str, size: int) -> Column:
    return F.xxhash64(F.col(f"{place}.x")) if size == 1 else F.xxhash64(F.col(f"{place}.x"), F.col(f"{place}.y"))


def windows_of(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: win (its words), len, items (the sorted ids of the items that have it, as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.size("w"), F.lit(WINDOW)))
    each = sized.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    cut_out = each.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("win"))
    return cut_out.groupBy("win", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _small(df: DataFrame) -> bool:
    """Whether df may be broadcast: few rows, and few bytes as JSON (about what its arrays and strings take)."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _small(df) else df


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), start (from 0), len and items of every occurrence of a window."""
    windows = cut(windows_of(benchmark))
    base = docs.select("doc_id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("w"))
    out = None
    for size in sorted({min(2, r["len"]) for r in windows.select("len").distinct().collect()}):
        own = windows.where(F.least(F.col("len"), F.lit(2)) == size)
        parts = own.select("win", "len", "items", F.posexplode(_places("win", size)).alias("off", "p")).withColumn("s", _shingle("p", size))
        wanted = cut(parts.select(F.col("s").alias("k")).distinct())
        seen = base.select(F.explode(_places("w", size)).alias("p")).select(_shingle("p", size).alias("s"))
        counts = seen.join(_sized(wanted), F.col("s") == F.col("k")).groupBy("k").agg(F.count("*").alias("n"))
        # a window with a shingle that is in no document occurs in none
        rated = parts.join(cut(counts), F.col("s") == F.col("k"), "left")
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "s")).alias("r")
        prefix = rated.groupBy("win", "len", "items").agg(rarest).where(F.col("r.n") > 0).select("win", "len", "items", "r.off", F.col("r.s").alias("k"))
        prefix = cut(prefix)
        start = F.col("pos") - F.col("off")
        if _small(prefix):
            each = base.select("doc_id", "tag", "w", F.posexplode(_places("w", size)).alias("pos", "p")).withColumn("s", _shingle("p", size))
            fits = (start >= 0) & (start + F.col("len") <= F.size("w"))
            same = F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")
            found = each.join(F.broadcast(prefix), (F.col("s") == F.col("k")) & fits & same)
            found = found.select("doc_id", "tag", start.alias("start"), "len", "items")
        else:
            found = _far(base, prefix, size, start)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, tag long, start int, len int, items array<string>")
    return out


def _far(base: DataFrame, prefix: DataFrame, size: int, start: Column) -> DataFrame:
    """occurrences where the prefix is too large to broadcast: places go to the prefix without words, then
    candidates meet the words of their document (each id and text once)."""
    places = base.select("doc_id", "tag", F.size("w").alias("n"), F.posexplode(_places("w", size)).alias("pos", "p"))
    thin = places.select("doc_id", "tag", "n", "pos", _shingle("p", size).alias("s")).distinct()
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    near = thin.join(prefix, (F.col("s") == F.col("k")) & fits).select(F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag"), start.alias("start"), "len", "win", "items")
    texts = base.dropDuplicates(["doc_id", "tag"])
    here = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag"))
    same = F.slice(F.col("w"), F.col("start") + 1, F.col("len")) == F.col("win")
    return texts.join(near, here & same).select("doc_id", "tag", "start", "len", "items")


def _hits(found: DataFrame) -> DataFrame:
    """n_hit (words inside any occurrence) and items for each document that has one."""
    spans = F.sort_array(F.collect_set(F.struct("start", "len")))
    grouped = found.groupBy("doc_id", "tag").agg(spans.alias("spans"), F.collect_set("items").alias("sets"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def step(state: Column, x: Column) -> Column:
        end = (x["start"] + x["len"]).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(x["start"].cast("long"), state["reach"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["reach"], end).alias("reach"))

    return grouped.select(
        F.col("doc_id").alias("_id"),
        F.col("tag").alias("_tag"),
        F.aggregate("spans", zero, step, lambda s: s["n"]).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"),
    )


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated of each row of docs.

    Null texts have no words and are never contaminated; items without words have no window; null item
    ids hit words but are not listed. Rows with equal id and text get equal results, ids that repeat
    with other texts are judged apart. Empty tables give no rows or no hits; other columns are ignored.
    """
    hits = _hits(occurrences(docs, benchmark))
    base = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    none = F.array().cast("array<string>")
    out = base.join(hits, same, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all columns of docs.

    Texts are not shuffled if the contaminated documents number at most BROADCAST_ROWS.
    """
    hits = cut(_hits(occurrences(docs, benchmark)).select("_id", "_tag", F.col("n_hit").alias("_hit")))
    words = F.size(words_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag")) & (20 * F.col("_hit") >= words)
    return unpacked(packed(docs, "doc_id", "text").join(_sized(hits), same, "left_anti"))
