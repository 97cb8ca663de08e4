"""Queries of learned operators against naive versions: convolutions place by place, trees walked one node at a time, and all
segmentations of small texts."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from decidra.llm import pieces, quality_cnn, urls
from decidra.llm import queries as Q
from test_pieces import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def naive_score(model, body):
    """Every filter at every place of every chunk of the whole text, one place after the other."""
    C = quality_cnn
    blocks = max(C.CHUNK // C.BLOCK, -(-len(body) // C.BLOCK))
    size = (blocks + blocks % 2) * C.BLOCK
    text = body + bytes(size + C.TAPS - 1 - len(body))
    chunks = []
    for start in range(0, size - C.CHUNK + 1, C.STEP):
        best = np.full(C.FILTERS, -np.inf)
        for at in range(start, start + C.CHUNK):
            best = np.maximum(best, sum(model.filters[tap, text[at + tap]].astype(np.float64) for tap in range(C.TAPS)))
        chunks.append(np.maximum(best + model.bias, 0))
    x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.std(chunks, axis=0), [math.log(len(chunks))]])
    hidden = np.maximum(((x - model.mean) / model.scale) @ model.w1 + model.b1, 0)
    return 1 / (1 + math.exp(-(hidden @ model.w2 + model.b2)))


def test_op2_scores_are_the_naive_ones(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    model = quality_cnn.fit(read("documents"), read("labels"))
    scores = {r.doc_id: r.score for r in Q.op2_quality(spark, SF).collect()}
    texts = sorted(((d["text"] or "").encode(), d["doc_id"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    texts.sort(key=lambda t: len(t[0]))
    for body, i in [*texts[:25], *texts[60:90], texts[-1]]:  # short ones, some of middle length and the longest, each whole
        assert scores[i] == pytest.approx(naive_score(model, body), abs=2e-4)


def plain_features(url, stats):
    text = url or ""
    rest = text.partition("://")[2] if "://" in text else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    query = rest[len(path) + 1 :].partition("#")[0] if rest[len(path) :].startswith("?") else ""
    share = lambda s: sum(c.isdigit() for c in s) / len(s) if s else 0.0
    entropy = lambda s: -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0
    return [len(text), len(host), len(path), host.count(".") + 1, path.rstrip("/").count("/"), share(text), share(host), entropy(text), entropy(host), host.count("-"), sum(1 for p in query.split("&") if p), max(map(len, host.split("."))), *stats.of(host, path)]


def test_op4_scores_are_those_of_the_trees(spark):
    model = urls.fit(urls.generated_labelled(spark))
    t = model.trees

    def leaf(tree, x, node=0, level=0):
        if level == t.depth:
            return t.values[tree][node]
        return leaf(tree, x, 2 * node + (2 if x[t.features[tree][node]] > t.thresholds[tree][node] else 1), level + 1)

    rows = Q.op4_urls(spark, SF).collect()
    pages = {p["page_id"]: p["url"] for p in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    assert len(rows) == len(pages)
    for r in rows:
        x = plain_features(pages[r.page_id], model.stats)
        assert r.score == pytest.approx(1 / (1 + math.exp(-t.base - sum(leaf(k, x) for k in range(len(t.values))))))


def test_op10_samples_are_segmentations_with_their_probability(spark, tmp_path):
    """Through the query, over every row of a table of small texts: what is emitted is among all segmentations, has its own
    probability, comes once, and hashes to its ids; the first samples follow the distribution."""
    words = ["the", "cat", "an", "ab"]
    rows = [(i, words[i % 4], "en", "s", 3) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    truth = {w: brute("▁" + w) for w in words}
    named = {w: {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(): p for ids, p in truth[w].items()} for w in words}
    got = Q.op10_pieces(spark, str(tmp_path)).collect()
    firsts, seen = Counter(), set()
    for r in got:
        word = words[r.doc_id % 4]
        assert math.exp(r.log_prob) == pytest.approx(named[word][r.ids_sha256], rel=1e-6) and r.decoded and r.log_inclusion <= 1e-9
        assert (r.doc_id, r.ids_sha256) not in seen
        seen.add((r.doc_id, r.ids_sha256))
        firsts[word, r.ids_sha256] += r["rank"] == 0
    assert Counter(r.doc_id for r in got) == {i: min(2, len(truth[w])) for i, w, *_ in rows}
    for w in words:
        for name, p in named[w].items():
            assert abs(firsts[w, name] / 300 - p) < 4.5 * math.sqrt(p * (1 - p) / 300) + 1e-9
    assert pieces.decode(pieces.encode("the cat")) == "the cat"
