from collections import Counter, defaultdict

import pytest

from decidra.llm import sharding
from decidra.llm.sharding import Ring, assign

SCHEMA = "doc_id long, text string, shard int"


def rows(spark, data, ring, load="rows"):
    return assign(spark.createDataFrame(data, SCHEMA), ring, load).collect()


@pytest.mark.parametrize("load", ["rows", "bytes"])
def test_every_row_has_one_gapless_slot(spark, load):
    data = [(i % 300, None if i % 50 == 0 else "é" * (i % 37), 9) for i in range(400)] + [(None, "", 1)] * 3
    got = rows(spark, data, Ring(5, epsilon=0.02), load)
    assert len(got) == len(data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_exact_capacities_leave_counts_one_apart(spark):
    got = rows(spark, [(i, "x", 0) for i in range(1003)], Ring(8, epsilon=0))
    n = Counter(r.shard for r in got)
    assert len(n) == 8 and max(n.values()) - min(n.values()) <= 1


def test_bytes_stay_below_capacity(spark):
    got = rows(spark, [(i, "x" * (i % 200), 0) for i in range(2000)], Ring(8, epsilon=0.05), "bytes")
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8 + 201


def test_growth_moves_few_rows(spark):
    data = [(i, "x", 0) for i in range(4000)]
    a = {r.doc_id: r.shard for r in rows(spark, data, Ring(8, epsilon=0.25))}
    b = {r.doc_id: r.shard for r in rows(spark, data, Ring(9, epsilon=0.25))}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(data)


def test_empty_table(spark):
    assert rows(spark, [], Ring(3)) == []


def test_copies_of_one_row_are_dealt_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    data = [(None, "same", 0)] * 500 + [(7, None, 0)] * 60 + [(i, "x", 0) for i in range(40)]
    for load in ("rows", "bytes"):
        got = rows(spark, data, Ring(3, epsilon=0), load)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == 600 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        if load == "rows":
            assert sorted(map(len, slots.values())) == [200, 200, 200]
        assert Counter(r.doc_id for r in got)[None] == 500


def brute_pour(ring, loads):
    """Round by round, each cell offers what is left to the next distinct shard clockwise."""
    points, room, left, out = ring.points(), ring.capacities(sum(loads.values())), dict(loads), Counter()
    orders = {}
    for cell in loads:
        at = next((i for i, p in enumerate(points) if p[0] >= cell), 0)
        orders[cell] = list(dict.fromkeys(p[2] for p in points[at:] + points[:at]))
    for step in range(ring.shards):
        for cell in sorted(loads):
            shard = orders[cell][step]
            took = min(room[shard], left[cell])
            room[shard] -= took
            left[cell] -= took
            out[cell, shard] += took
    return +out


def test_overflow_goes_on_clockwise():
    for epsilon in (0, 0.1, 2.0):
        ring = Ring(6, vnodes=4, cell_bits=8, epsilon=epsilon)
        loads = {c: (c * 37 % 11) + (300 if c == 9 else 0) for c in range(256)}
        loads = {c: n for c, n in loads.items() if n}
        got = Counter()
        for cell, a, b, shard in ring.pour(loads):
            got[cell, shard] += b - a
        assert got == brute_pour(ring, loads)
        assert sum(got.values()) == sum(loads.values())


def test_many_shards_pour_quickly():
    ring = Ring(512, epsilon=0.1)
    assert sum(b - a for _, a, b, _ in ring.pour(dict.fromkeys(range(1 << 15), 3))) == 3 << 15
