import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from decidra.llm import pieces

pytestmark = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no vocabulary file")
TEXTS = ["", " ", "a", "the cat", "  two  spaces ", "é ü\nline\ttab", "▁own mark▁ ▁▁", "\0zero\0", "日本語テキスト 🎈 x", "word " * 2000, "x" * 5000]


def brute(chunk):
    """All segmentations of a one-chunk text with their probabilities."""
    v = pieces.vocabulary(pieces.MODEL)
    names = {v.processor.id_to_piece(i): i for i in range(v.processor.get_piece_size()) if v.bytes_of[i] and not v.processor.is_byte(i)}

    def split(at):
        if at == len(chunk):
            return [((), 0.0)]
        out = []
        for to in range(at + 1, len(chunk) + 1):
            if chunk[at:to] in names:
                i = names[chunk[at:to]]
                out += [((i, *rest), v.weight[i] + w) for rest, w in split(to)]
        return out

    found = split(0)
    total = sum(math.exp(w) for _, w in found)
    return {ids: math.exp(w) / total for ids, w in found}


@pytest.mark.parametrize("text", TEXTS)
def test_every_sample_decodes_to_the_text(text):
    got = pieces.sample_rows([text], np.array([5], dtype=np.uint64), 3)[0]
    assert got and all(pieces.decode(ids) == text for ids, _, _ in got)
    assert len({tuple(ids.tolist()) for ids, _, _ in got}) == len(got)
    assert all(p <= 1e-9 and q <= 1e-9 for _, p, q in got)
    assert pieces.decode(pieces.encode("the cat")) == "the cat"


def test_probabilities_and_inclusion_match_enumeration():
    truth = brute("▁the")
    n, k = 4000, 2
    rows = pieces.sample_rows(["the"] * n, np.arange(n, dtype=np.uint64) * 7919, k)
    first = Counter(tuple(r[0][0].tolist()) for r in rows)
    for ids, p in truth.items():
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9
    for r in rows[:50]:
        for ids, logp, _ in r:
            assert math.isclose(math.exp(logp), truth[tuple(ids.tolist())], rel_tol=1e-9)
    # inclusion scores give unbiased totals: sum of p / inclusion estimates the whole mass 1
    total = [sum(math.exp(p - q) for _, p, q in r) for r in rows]
    assert abs(np.mean(total) - 1) < 5 * np.std(total) / math.sqrt(n) + 0.01


def test_joint_top_two_of_several_chunks_match_enumeration():
    """All segmentations of a text are the products of its chunks'; the second draw is without the first."""
    truth = {}
    for a, p in brute("▁to").items():
        for b, q in brute("▁he").items():
            truth[a + b] = p * q
    assert len(truth) > 3 and math.isclose(sum(truth.values()), 1)
    n = 6000
    rows = pieces.sample_rows(["to he"] * n, np.arange(n, dtype=np.uint64) * 104729 + 3, 2)
    pairs = Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in rows)
    for a, p in truth.items():
        for b, q in truth.items():
            want = 0.0 if a == b else p * q / (1 - p)
            assert abs(pairs[a, b] / n - want) < 4.5 * math.sqrt(want * (1 - want) / n) + 2 / n
    for r in rows[:50]:
        assert all(math.isclose(math.exp(logp), truth[tuple(ids.tolist())], rel_tol=1e-9) for ids, logp, _ in r)


def test_parts_of_a_long_chunk_match_the_whole(monkeypatch):
    text = "".join(random.Random(4).choice("etxqzj漢字é") for _ in range(400))
    key = np.array([11], dtype=np.uint64)
    cut = pieces.sample_rows([text], key, 3)[0]
    monkeypatch.setattr(pieces, "LONG", 10**9)
    whole = pieces.sample_rows([text], key, 3)[0]
    assert [ids.tolist() for ids, _, _ in cut] == [ids.tolist() for ids, _, _ in whole]
    assert np.allclose([x[1:] for x in cut], [x[1:] for x in whole])


def test_all_segmentations_come_out_when_k_is_large():
    truth = brute("▁cat")
    got = pieces.sample_rows(["cat"], np.array([3], dtype=np.uint64), len(truth) + 5)[0]
    assert {tuple(ids.tolist()) for ids, _, _ in got} == set(truth)
    assert all(q == 0.0 for _, _, q in got)


def test_results_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cde é") for _ in range(rng.randint(0, 80))) for _ in range(30)]
    keys = np.arange(30, dtype=np.uint64)
    whole = pieces.sample_rows(texts, keys, 3)
    for i in range(30):
        alone = pieces.sample_rows([texts[i]], keys[i : i + 1], 3)[0]
        assert [(a.tolist(), p, q) for a, p, q in alone] == [(a.tolist(), p, q) for a, p, q in whole[i]]


def test_rows(spark):
    data = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (3, TEXTS[3], 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, rank int")
    got = pieces.sampled(df, k=2).collect()
    assert all(r.decoded for r in got)
    assert [r for r in got if r.doc_id is None][0].ids == []
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 4 and len({(r["rank"], tuple(r.ids)) for r in same}) == 2
    assert pieces.sampled(df.limit(0)).collect() == []
    named = spark.createDataFrame([("x/1", "the cat"), (None, "")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in pieces.sampled(named, k=1).collect()) == ["None", "x/1"]
