"""How far the word use of a language's sources lies from each other, in plain relational steps.

Terms are runs of characters outside SEPARATOR, A-Z lower-cased. A language keeps the V terms that at least LEAST_DOCS of its documents
hold. Every (language, source) group gives every kept term a smoothed share in parts of SCALE,

    p = 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V))

with N the counts of all kept terms together; the language as a whole does so too. Two groups differ by the sum of
|p - q| over the kept terms; a group's own terms are those above the language's share.

Steps: texts are exploded into terms and counted by (lang, source, term) map-side before any shuffle. A window over
(lang, term), whose groups are a language's sources, sums a term over the language, and what it keeps is written. Groups are crossed
with the kept vocabulary of their language by a join on (lang, salt), so that a language with most of the
rows is dealt out over SALTS parts; what a source lacks counts as zero. The pairs come from a self-join on (lang, term),
a row a pair of sources, once for both directions. The ranks of a group's terms are cut to TOP in each task before they meet.
Terms are what matches of the complement SEPARATOR part, which is the same and much cheaper in Spark than all matches.

Shares are exact: SCALE * (count + ALPHA) is a DECIMAL(38, 0), divided as whole numbers.

Null texts, languages and sources count as empty strings. A row is a document, so repeated rows count as often as they
stand there. A text without terms still makes its group occur. A language that keeps no term (V = 0) has pairs of value 0
and no terms. Ranks break ties by the item's bytes. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_UPPER, cut

SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SCALE = 1_000_000_000
ALPHA = 5
TOP = 50
#: Parts that the vocabulary of a language is dealt out to.
SALTS = 64


def _named(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source")], F.coalesce("text", empty).alias("text"))


def _lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` folds other scripts too, so it serves only texts without another capital; it is faster
    than a translation."""
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(others, F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lower(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that hold it)."""
    terms = _named(docs).select("lang", "source", F.split(_lower(F.col("text")), SEPARATOR, -1).alias("t"))
    # every place counts once, and every distinct term of a document once more for the documents
    twice = terms.select("lang", "source", F.posexplode(F.array("t", F.array_distinct("t"))).alias("of_docs", "t"))
    each = twice.select("lang", "source", "of_docs", F.explode("t").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("of_docs")).alias("n"), F.sum("of_docs").alias("d"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n and n_lang of the terms that a language keeps."""
    lang = Window.partitionBy("lang", "term")
    summed = counts.withColumn("n_lang", F.sum("n").over(lang)).withColumn("d_lang", F.sum("d").over(lang))
    return summed.where(F.col("d_lang") >= least).select("lang", "source", "term", "n", "n_lang")


def _share(count: str, total: str, terms: str) -> Column:
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {ALPHA} AS DECIMAL(20, 0))) div CAST({total} + {ALPHA} * {terms} AS DECIMAL(20, 0))")


def shares(own: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, term, n, p (the group's) and q (the language's) for every group and every term kept of its language."""
    kept = own.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    sized = groups.join(langs, "lang").join(sums, ["lang", "source"], "left").select("lang", "source", "terms", "total_lang", F.coalesce("total", F.lit(0)).alias("total"))
    dealt = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(dealt, ["lang", "salt"])
    full = dense.join(own.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("lang", "source", "term", "n", _share("n", "total", "terms").alias("p"), _share("n_lang", "total_lang", "terms").alias("q"))


def pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, each pair in both directions."""
    a, b = (shared.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("x", "px"), ("y", "py")))
    apart = a.join(b, ["lang", "term"]).where("x < y").groupBy("lang", "x", "y").agg(F.sum(F.abs(F.col("px") - F.col("py"))).alias("v"))
    every = groups.select("lang", F.col("source").alias("x")).join(groups.select("lang", F.col("source").alias("y")), "lang").where("x < y")
    both = every.join(apart, ["lang", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    return both.select("lang", F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("y").alias("i")), F.struct(F.col("y").alias("s"), F.col("x").alias("i")))).alias("d"), "v").select("lang", F.col("d.s").alias("source"), F.col("d.i").alias("item"), F.col("v").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: for each group all other sources of its language, the
    furthest first, and its top terms above the language's share. Odd rows: see the module's text."""
    groups = cut(_named(docs).select("lang", "source").distinct())
    shared = cut(shares(cut(kept_counts(term_counts(docs), least)), groups))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    apart = pairs(shared, groups).withColumn("rank", F.row_number().over(order))
    high = shared.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    said = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return said(apart, "pair").unionByName(said(best, "term"))
