import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from decidra.llm import simhash
from decidra.llm.components import components

SCHEMA = "doc_id long, text string, _fp string"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "one"), (905, "a b c"), (None, "one"), (906, "É a\x1cb  c d")]
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(300)]
        rows.append((i, " ".join(words)))
        for j in range(rng.randint(0, 4)):
            words[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * i + j, "\n".join(words)))
    return rows + [(3, rows[11][1]), (3, rows[11][1])]


def test_fingerprints_match_brute_force():
    for _, text in corpus():
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    other = base.copy()
    for i in range(len(base)):
        for bit in rng.choice(64, 1 + i % 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    a, ra = simhash.fingerprint_keys(base)
    b, rb = simhash.fingerprint_keys(other)
    shared = set(zip(a.tolist(), ra.tolist())) & set(zip(b.tolist(), rb.tolist()))
    assert {r for _, r in shared} == set(range(len(base)))


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in got if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.keep_first(df.limit(0)).collect() == []


def test_large_cluster_needs_no_pairs():
    rng = np.random.default_rng(4)
    centre = np.uint64(0x0123456789ABCDEF)
    values = np.unique(np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 2, replace=False).astype(np.uint64)) for _ in range(3000)]))
    assert len(simhash.forest(values)) == len(values) - 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[201] == 200


def crowded():
    """Fingerprints of which many share every key of two segments, in chains, pairs and alone."""
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 1 << 21, 500, dtype=np.uint64) << np.uint64(43)
    near = wide ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    return np.unique(np.concatenate([wide, near, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))


def least_of_links(values, pairs):
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def all_links(values):
    return [(int(x), int(y)) for i, x in enumerate(values) for y in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ x) <= 4]]


def test_long_runs_go_round_again_and_lose_no_link(spark):
    values = crowded()
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = least_of_links(values, all_links(values))
    for run in (32, 1 << 14):
        got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, run).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got)
        assert least_of_links(values, got) == want


def test_a_run_over_many_batches_is_passed_on_whole():
    values = np.sort(crowded())
    keys = np.concatenate([[-5, -5], np.full(len(values), 7), [8, 9, 9]]).astype(np.int64)
    fps = np.concatenate([[1, 3], values.view(np.int64), [1, 0, 1]])
    for step in (1, 7, 40, len(keys)):
        batches = [pa.record_batch([pa.array(keys[i : i + step]), pa.array(fps[i : i + step])], ["key", "fp"]) for i in range(0, len(keys), step)]
        rows = [r for b in simhash._link_batches(iter(batches), 40) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in rows if r["key"] is None) == [(0, 1), (1, 3)]
        again = [(r["a"], r["key"]) for r in rows if r["key"] is not None]
        assert len(again) == len(set(again)) == 5 * len(values)
        assert {a for a, _ in again} == set(values.view(np.int64).tolist())
        assert all(r["free"] != -1 for r in rows if r["key"] is not None)


@pytest.mark.parametrize("edges", [40, 1 << 18])
def test_components_over_many_tasks(spark, monkeypatch, edges):
    """A giant component with a hub, long chains that cross tasks, loops and repeats; small tasks need several rounds."""
    from decidra.llm import components as C

    monkeypatch.setattr(C, "EDGES", edges)
    rng = np.random.default_rng(edges)
    hub = [(int(x), 500) for x in rng.choice(np.arange(501, 1500), 600, replace=False)]
    chain = rng.permutation(np.arange(2000, 2400)).tolist()
    some = rng.integers(3000, 3400, (150, 2)).tolist()
    rows = hub + list(zip(chain, chain[1:])) + [tuple(x) for x in some] + [(7, 7), (8, 9), (9, 8), (8, 9), (500, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(rows, "a long, b long").repartition(6)).collect()))
    root = {x: x for r in rows for x in r}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in rows:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if x != 7}


def test_a_giant_component_of_fingerprints(spark):
    """Two thousand fingerprints chained by single bits end in one class with the smallest id."""
    rng = np.random.default_rng(2)
    fps, now = [], int(rng.integers(0, 1 << 62))
    for _ in range(2000):
        now ^= 1 << int(rng.integers(0, 63))
        fps.append(now)
    nodes = spark.createDataFrame([(f, 5 + i) for i, f in enumerate(dict.fromkeys(fps))], "_fp long, own long").repartition(5)
    named = simhash.classes(nodes, simhash._edges(nodes)).collect()
    assert len(named) == len(set(fps)) and {r["first"] for r in named} == {5}
