"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs (url, label 1 = block), at most ``max_rows`` of them. Features
of a URL: lengths, depth, digit ratio, character entropy, hyphens, number of parameters, and the
smoothed share of blocked URLs among training URLs with the same host ending, host label or file
ending (suffix statistics). Trees are fitted on quantile bins with the logistic loss.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

FEATURES = ["length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "hyphens", "params", "longest_label", "suffix_rate", "label_rate", "ending_rate"]
#: Endings of hosts and files in the generated labelled set; each class draws from all of them.
HOST_ENDINGS = [".com", ".org", ".net", ".info", ".io", ".co"]
FILE_ENDINGS = ["", "", "", "/", ".html", ".php"]


# --- features


def split_url(url: str | None) -> tuple[str, str, str]:
    """host (A-Z lower-cased), path and query of a url; all empty for null or without ://"""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not found:
        return "", "", ""
    host = re.sub("[A-Z]+", lambda m: m.group().lower(), found.group(1))
    return host, found.group(2), found.group(3) or ""


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _digits(text: str) -> float:
    return sum(c.isdigit() for c in text) / len(text) if text else 0.0


def _endings(host: str, path: str) -> tuple[str, list[str], str]:
    labels = host.split(".")
    inner = [w for label in labels[:-2] for w in label.split("-")]
    last = path.rsplit("/", 1)[-1]
    return ".".join(labels[-2:]), inner, last.rsplit(".", 1)[-1] if "." in last else ""


@dataclass
class SuffixStats:
    """Smoothed share of blocked URLs for each host ending, host word and file ending."""

    prior: float = 0.5
    rates: dict = field(default_factory=dict)

    @classmethod
    def learn(cls, urls: list[str], labels: np.ndarray, weight: float = 5.0) -> SuffixStats:
        prior = float(labels.mean()) if len(labels) else 0.5
        seen: dict = defaultdict(lambda: [0.0, 0.0])
        for url, y in zip(urls, labels, strict=True):
            host, path, _ = split_url(url)
            suffix, inner, ending = _endings(host, path)
            for key in {("s", suffix), ("e", ending), *(("l", w) for w in inner)}:
                seen[key][0] += y
                seen[key][1] += 1
        return cls(prior, {k: (a + weight * prior) / (n + weight) for k, (a, n) in seen.items()})

    def of(self, host: str, path: str) -> tuple[float, float, float]:
        suffix, inner, ending = _endings(host, path)
        rate = lambda key: self.rates.get(key, self.prior)
        return rate(("s", suffix)), max((rate(("l", w)) for w in inner), default=self.prior), rate(("e", ending))


def describe(url: str | None, stats: SuffixStats) -> list[float]:
    host, path, query = split_url(url)
    labels = host.split(".")
    text = url or ""
    return [
        len(text), len(host), len(path), len(labels), path.rstrip("/").count("/"), _digits(text), _digits(host),
        _entropy(text), _entropy(host), host.count("-"), len([p for p in query.split("&") if p]),
        max(map(len, labels)), *stats.of(host, path),
    ]


# --- trees


@dataclass
class Boosted:
    """Trees as arrays: feature, threshold, value by node; node i has the children 2i+1 and 2i+2."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss on quantile bins; the first of equal splits wins."""
    share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
    base = math.log(share / (1 - share))
    nodes = 2 ** (depth + 1) - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else None
    shape = (trees if len(x) else 0, nodes)
    features, thresholds, values = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.zeros(shape)
    margin = np.full(len(x), base)
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf, 0)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e) or len(rows) < 2:
                        continue
                    left_g = np.bincount(binned[rows, f], g[rows], minlength=len(e) + 1).cumsum()[:-1]
                    left_h = np.bincount(binned[rows, f], h[rows], minlength=len(e) + 1).cumsum()[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, e[at], at)
                features[t, k], thresholds[t, k] = best[1], best[2]
                right = x[rows, best[1]] > best[2]
                node[rows] = 2 * k + 1 + right
        for k in range(2**depth - 1, nodes):
            rows = node == k
            values[t, k] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        margin += values[t, node]
    return Boosted(base, features, thresholds, values, depth)


@dataclass
class UrlModel:
    stats: SuffixStats
    trees: Boosted

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each url is to be blocked."""
        if not urls:
            return np.zeros(0)
        return self.trees.predict(np.array([describe(u, self.stats) for u in urls], dtype=np.float64))


def fit(labelled: DataFrame, max_rows: int = 20000) -> UrlModel:
    """Fit on the max_rows labelled URLs (url, label) with the smallest hash; rows with nulls are left out.
    Labels of one class only, or none, give a constant score.

    Suffix statistics for training rows come from the other half of the rows, so that a row's own
    label is never among its features.
    """
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("int").alias("label"))
    found = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).collect()
    urls, y = [r["url"] for r in found], np.array([float(r["label"] > 0) for r in found])
    half = np.arange(len(urls)) % 2 == 0
    x = np.zeros((len(urls), len(FEATURES)))
    for side in (half, ~half):
        stats = SuffixStats.learn([u for u, s in zip(urls, ~side, strict=True) if s], y[~side])
        for i in np.flatnonzero(side):
            x[i] = describe(urls[i], stats)
    return UrlModel(SuffixStats.learn(urls, y), fit_trees(x, y))


def _name(rng: random.Random, syllables: int) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(syllables))


def generated_labelled(spark: SparkSession, n: int = 6000, seed: int = 5) -> DataFrame:
    """Seeded labelled URLs for use where no labelled list is at hand. They hold no list of words or hosts: all
    names are random syllables, drawn alike for both classes, so every host is new. The classes differ in shape
    only, and overlap, as published statistics of spam hosts do (more hyphens, digits, labels, depth and
    parameters, longer names). Pass a real list (url, label) to fit() wherever there is one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        block = i % 4 == 0
        chance = lambda yes, no: rng.random() < (yes if block else no)  # noqa: E731, B023
        words = [_name(rng, rng.randint(2, 4)) for _ in range(rng.choice([2, 2, 3, 4, 5]) if chance(0.75, 0.04) else 1)]
        if chance(0.3, 0.05):
            words[-1] += str(rng.randint(1, 9999))
        if chance(0.15, 0.01):
            words.append(_name(rng, 9))
        labels = [_name(rng, rng.randint(1, 3)) for _ in range(rng.choice([1, 2, 3]) if chance(0.4, 0.1) else 0)]
        labels = labels or rng.choice([[], [], ["www"], ["m"], ["blog"]])
        host = ".".join([*labels, "-".join(words)]) + rng.choice(HOST_ENDINGS)
        steps = [str(rng.randint(0, 99999)) if rng.random() < 0.4 else _name(rng, rng.randint(1, 4)) for _ in range(rng.randint(1, 6) if chance(0.5, 0.1) else rng.randint(0, 3))]
        params = [f"{_name(rng, 1)}={rng.randint(0, 999)}" for _ in range(rng.randint(2, 7) if chance(0.4, 0.05) else rng.randint(0, 2))]
        url = f"{rng.choice(['http', 'https'])}://{host}/" + "/".join(steps) + (rng.choice(FILE_ENDINGS) if steps else "")
        rows.append((url + ("?" + "&".join(params) if params else ""), int(block)))
    return spark.createDataFrame(rows, "url string, label int")


# --- rules


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits. rules: (host/path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is the longest
        r_host, slash, r_path = text.partition("/")
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(slash + r_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """pages (page_id, url) with host, path, rule, score and verdict; no row is dropped or shuffled.

    A null url, or one without ://, has empty host and path, fits no rule, and is judged by the
    trees as an empty text. Repeated rows are judged one by one; an empty table gives no rows; columns of
    pages other than page_id and url are dropped. The list of rules is part of the plan: meant for some
    hundreds at most.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(urls: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(urls.to_pylist()), pa.float64())

    out = pages.select("page_id", "url").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    out = out.withColumn("score", F.arrow_udf(run, returnType="double").asNondeterministic()(F.col("url")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
