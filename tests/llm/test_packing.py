"""Packing: the plan against bounds and enumeration, and all pieces against a plain tokeniser."""

import binascii
import itertools
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from decidra.llm import packing
from decidra.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [packing.END]


def check_pieces(rows, docs, size):
    """Every id in exactly one piece, offsets gapless, sizes held. Gives the ids of padding."""
    ids = {k: plain_ids(t) for k, t in docs.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[k][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == binascii.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_knapsack_finds_the_best_pattern():
    rng = np.random.default_rng(0)
    for _ in range(30):
        worth = rng.random(6) - 0.2
        value, pattern = packing.knapsack(worth, 9)
        best = max(sum(worth[u] * a[u] for u in range(6)) for a in itertools.product(range(10), repeat=6) if sum((u + 1) * a[u] for u in range(6)) <= 9) if _ < 2 else value
        assert np.isclose(value, best) and np.isclose(worth @ pattern, value) and (np.arange(1, 7) * pattern).sum() <= 9


def test_columns_reach_the_bound_of_the_program():
    """Pieces of 6, 5, 4 and 1 of 10: an optimal plan wastes nothing, the first patterns do."""
    demand = np.zeros(10, dtype=np.int64)
    demand[[5, 3]] = 700  # 6 + 4 fill a sequence
    demand[4] = 300  # 5 + 5
    patterns, x = packing.generate_columns(demand, 10)
    assert np.isclose(x.sum(), 850) and np.allclose((patterns * x[:, None]).sum(axis=0), demand)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_demand_exactly(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    demand = (rng.random(capacity) ** 4 * rng.choice([3, 50, 5000])).astype(np.int64)
    plan = packing.packed_patterns(demand, capacity)
    weight = np.arange(1, capacity + 1)
    assert all((p * weight).sum() <= capacity and k > 0 for p, k in plan)
    assert (sum((p * k for p, k in plan), np.zeros(capacity, dtype=np.int64)) == demand).all()
    patterns, x = packing.generate_columns(demand, capacity)
    assert sum(k for _, k in plan) <= x.sum() + (demand > 0).sum() + 1


SAYINGS = ["", " ", "Ein Haus\n\tam  See", "it's 'sun don't <|endoftext|>x y", "École ́a", "x" * 300 + " y", "naïve—  word", "ΑΣ ΑΣΑ", "a\x1cb\x00c", "1²³ ½x", "İstanbul ſ ß", "漢字 kana", "ﬁne ﬂow"]


@pytest.mark.parametrize("remembered", [3, 500_000])
def test_words_give_the_ids_of_the_text(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    words = packing.WordIds(packing.default_tokenizer())
    plain = [np.array(plain_ids(t)[:-1], dtype="<u2").tobytes() for t in SAYINGS]
    for _ in range(2):
        assert words.encode(SAYINGS) == plain
    assert [words.encode([t])[0] for t in SAYINGS] == plain


def test_plain_characters_are_parted_as_the_tokenizer_does():
    """Every character that PLAIN lets through, between and beside letters, digits and signs."""
    words = packing.WordIds(packing.default_tokenizer())
    shown = [chr(c) for c in range(0x2100) if packing.PLAIN.fullmatch(chr(c))]
    assert len(shown) > 370
    texts = [f"a{c}b {c}{c} 1{c}2 .{c}! {c}'s A{c.upper()}" for c in shown]
    texts = [t for t in texts if packing.PLAIN.fullmatch(t)]
    assert words.encode(texts) == [np.array(plain_ids(t)[:-1], dtype="<u2").tobytes() for t in texts]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_op12(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = Q.op12_packing(spark, SF).collect()
    assert check_pieces(rows, docs, 4096) == 0
    cut = [k for k, own in itertools.groupby(sorted(r.doc_id for r in rows)) if len(list(own)) > 1]
    assert len(cut) < len(docs) / 4  # most texts stay whole


def lengths(spark, sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "_key long, n long").repartition(3)


@pytest.mark.parametrize("sizes", [[5], [64], [65, 1], [63] * 9, [200, 7, 7, 30], [64, 64, 64], list(range(1, 140)), [1000], [33] * 50 + [20] * 10])
def test_every_shape_of_table_is_packed(spark, sizes):
    rows = packing.placed(lengths(spark, sizes), size=64, unit=4).collect()
    seen, used = defaultdict(set), defaultdict(set)
    for r in rows:
        ids, places = set(range(r.start, r.start + r.length)), set(range(r.offset, r.offset + r.length))
        assert r.length > 0 and not ids & seen[r["_key"]] and not places & used[r.sequence_id]
        seen[r["_key"]] |= ids
        used[r.sequence_id] |= places
    assert {k: len(v) for k, v in seen.items()} == dict(enumerate(sizes))
    assert all(v == set(range(len(v))) and len(v) <= 64 for v in used.values())
    if max(sizes) > 64:
        assert all(len(v) & (len(v) - 1) == 0 for v in used.values())


def test_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 5)
    monkeypatch.setattr(packing, "BLOCK", 100)
    test_every_shape_of_table_is_packed(spark, [int(x) for x in np.random.default_rng(1).integers(1, 150, 300)])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "one word " * 3000), (4, "x"), (4, "x"), (5, "é" * 2000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, n string")
    out = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0) for r in out if r.start == 0) == [0, 1, 2, 3, 4, 4, 5]
    assert [r.ids for r in out if r.doc_id in (1, 2)] == [[2], [2]]
    assert sum(r.length for r in out) == sum(len(plain_ids(t)) for _, t in rows)
    assert packing.pack(docs.limit(0)).collect() == []


def test_a_batch_looks_up_each_chunk_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    words = packing.WordIds(packing.default_tokenizer())
    words.known = Counted()
    texts = ["the same words, " * 500, "The SAME words", ""]
    found = words.encode(texts)
    assert [np.frombuffer(x, dtype=words.kind).tolist() + [packing.END] for x in found] == [plain_ids(t) for t in texts]
    assert words.known.asked <= 10


def test_odd_texts_in_a_batch_and_words_that_stay(monkeypatch):
    words = packing.WordIds(packing.default_tokenizer())
    odd = ["", " \n", "A B\x1cC d\x1f", "it's we'll 'd", "x² 3½", "İstanbul", "日本", "<|endoftext|> a", " lead  trail ", "a\x0bb\x0cc\rd\te", "\x00\x01", "’s —--", "€9"]
    for batch in (odd, odd[5:7], odd[::-1]):
        assert [np.frombuffer(x, dtype=words.kind).tolist() + [packing.END] for x in words.encode(batch)] == [plain_ids(t) for t in batch]
    monkeypatch.setattr(packing, "REMEMBERED", len(words.known) + 3)
    words.encode(["lead new1x new2y new3z new4w"])
    assert "lead" in words.known and len(words.known) <= 20
