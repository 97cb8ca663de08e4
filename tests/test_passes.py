"""Passes, pairs, shared encodings and attention against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import attention as T
from decidra.operators import passes as P


def plain_passes(rows, lanes, most, budget):
    """(lane, pass, width) by key; rows: (key, length)."""
    import hashlib

    lane = lambda k: int(hashlib.md5(f"lane:{k}".encode()).hexdigest()[:8], 16) % lanes
    out = {}
    for at in range(lanes):
        own = sorted([(-n, str(k), k) for k, n in rows if lane(k) == at])
        number, held, width = 0, 0, 0
        for n, _, k in own:
            if held and (held >= most or (held + 1) * width > budget):
                number, held = number + 1, 0
            width = -n if not held else width
            held += 1
            out[k] = (at, number, width)
    return out


@pytest.mark.parametrize(("most", "budget"), [(3, 10**9), (100, 60), (4, 80), (1, 1)])
def test_passes_hold_their_bounds(spark, most, budget):
    rng = random.Random(most)
    rows = [(i, rng.choice([1, 5, 5, 20, 100])) for i in range(150)]
    df = spark.createDataFrame([(i, "x" * n, "mine") for i, n in rows], "id long, text string, other string").repartition(3)
    seen = lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    out = P.run_passes(df, F.col("id"), F.length("text"), F.col("text"), seen, "array<double>", 3, most, budget)
    assert out.columns == ["lane", "id", "text", "other", "pass", "width", "result"]
    got = {r.id: r for r in out.collect()}
    want = plain_passes(rows, 3, most, budget)
    sizes = {}
    for k, (lane, number, width) in want.items():
        assert (got[k].lane, got[k]["pass"], got[k].width) == (lane, number, width) and got[k].result[0] == dict(rows)[k]
        sizes.setdefault((lane, number), []).append(k)
    for ks in sizes.values():  # a pass is one call of the model
        assert {got[k].result[1] for k in ks} == {len(ks)} and len(ks) <= most and (len(ks) == 1 or len(ks) * got[ks[0]].width <= budget)
    s = P.padding(out, F.length("text")).first()
    assert (s.passes, s.rows, s.tokens) == (len(sizes), 150, sum(n for _, n in rows)) and s.padded == sum(len(k) * want[k[0]][2] for k in sizes.values()) - s.tokens


def test_odd_rows_of_passes(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "abc")], "id long, text string")
    run = lambda d, model: P.run_passes(d, F.col("id"), F.length("text"), F.col("text"), model, "long", 2)
    assert sorted((r.id or 0, r.result) for r in run(df, lambda ts: [len(t or "") for t in ts]).collect()) == [(0, 3), (1, 0), (1, 0), (2, 0)]
    assert run(df.limit(0), lambda ts: [0 for _ in ts]).collect() == []
    with pytest.raises(Exception, match="results for"):
        run(df, lambda ts: [1]).collect()


def test_requests_and_pairs_are_put_together_in_order(spark):
    asked = [(i, f"state {i}", [f"q{j}" for j in range(n)]) for i, n in enumerate((1, 40, 3, 0))]
    model = lambda texts: [[float(t.split("q")[1]), float(t.split()[1])] for t in texts]
    got = {r.request: r for r in P.answer_requests(spark.createDataFrame(asked, "request long, state string, questions array<string>"), model, 2, rows=7).collect()}
    assert {i: r.answers for i, r in got.items()} == {i: [[float(j), float(i)] for j in range(len(q))] for i, _, q in asked if q}
    assert got[1].passes > 5 and got[0].passes == 1
    states = spark.createDataFrame([(1, "alpha"), (2, None)], "id long, state string")
    questions = spark.createDataFrame([(1, "a", ["x", "y", "z"]), (1, "b", ["w"]), (2, "a", ["v", "u"]), (2, "c", [])], "id long, name string, options array<string>")
    pair = lambda texts: [{"logit": float(ord(t[0])), "evidence": float(len(t))} for t in texts]
    out = {(r.id, r.name): r for r in P.score_pairs(states, questions, pair, 2, rows=2).collect()}
    assert {k: r.logits for k, r in out.items()} == {(1, "a"): [120.0, 121.0, 122.0], (1, "b"): [119.0], (2, "a"): [118.0, 117.0]}
    assert out[1, "a"].evidence == pytest.approx(1 / (1 + math.exp(-9))) and out[2, "a"].evidence == pytest.approx(1 / (1 + math.exp(-4)))
    assert all(r.cost <= 18 for r in out.values())


def test_fan_out_encodes_a_state_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(df):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b.assign(prefix=b["_text"].str.len().fillna(0).astype("int64"))

        return df.mapInPandas(run, "_text string, prefix long")

    rows = [(i, "same state" if i % 2 else None, ["q"] * (9 if i < 20 else 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "request long, state string, questions array<string>")
    length = lambda s: F.coalesce(F.length(s), F.lit(0)).cast("long")
    out = P.fan_out(df, encode, lambda p, q: p + F.length(q), lambda s, q: length(s) + F.length(q)).collect()
    assert {r.request: (r.way, r.answers) for r in out} == {i: ("prefix" if i < 20 else "packed", [(11 if i % 2 else 1)] * (9 if i < 20 else 2)) for i in range(30)}
    assert calls.value == 2 and tuple(P.encodings(df).first()) == (20 * 9 + 10 * 2, 10 + 2)


# --- attention


def np_decision(tokens, mask, q, o, reader, bil, bias, ev, heads, scale, otok):
    h, q, d = np.array(tokens), np.array(q), len(q[0])
    w, context = np.zeros((heads, len(q), len(h))), []
    for k in range(heads):
        s = slice(k * d // heads, (k + 1) * d // heads)
        z = q[:, s] @ h[:, s].T / math.sqrt(d // heads)
        z[:, ~np.array(mask)] = -np.inf
        e = np.exp(z - z.max(axis=1, keepdims=True))
        w[k] = e / e.sum(axis=1, keepdims=True)
        context.append(w[k] @ h[:, s])
    z = np.array(reader) @ np.concatenate(context, axis=1).ravel()
    mean = np.maximum(w.mean(axis=0), 1e-9)
    logits = np.array(o) @ (np.array(bil) @ z) / math.sqrt(d) + np.array(o) @ np.array(bias)
    if scale is not None:
        unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
        logits = logits + [scale * (unit(np.array(t)) @ unit(h[np.array(mask)]).T).max(axis=1).mean() for t in otok]
    x = np.array(ev) @ [*z, -(mean * np.log(mean)).sum(axis=1).mean(), 1.0]
    return logits, 1 / (1 + np.exp(-x))


@pytest.mark.parametrize(("heads", "scale"), [(1, None), (2, 10.0), (4, None)])
def test_compiled_decision(spark, heads, scale):
    rng = np.random.default_rng(heads)
    d, m = 8, 3
    make = lambda *n: rng.normal(size=n).tolist()
    q, o, reader, bil, bias, ev, otok = make(m, d), make(4, d), make(d, m * d), make(d, d), make(d), make(d + 2), make(4, 2, d)
    rows = [(i, make(n, d), [bool(x) for x in rng.random(n) < 0.7]) for i, n in enumerate((1, 5, 9, 4, 6))] + [(9, make(2, d), [False, False]), (10, [], []), (11, None, None)]
    df = spark.createDataFrame(rows, "id int, t array<array<double>>, m array<boolean>")
    got = {r.id: r.x for r in df.select("id", T.compiled_decision(F.col("t"), F.col("m"), q, o, reader, bil, bias, ev, heads, scale, otok).alias("x")).collect()}
    for i, t, mask in rows[:5]:
        if any(mask):
            logits, evidence = np_decision(t, mask, q, o, reader, bil, bias, ev, heads, scale, otok)
            assert np.allclose(got[i].logits, logits) and got[i].evidence == pytest.approx(evidence)
    assert got[9] is None and got[10] is None and got[11] is None


def test_content_scores(spark):
    rng = np.random.default_rng(0)
    d, w = 6, rng.normal(size=(6, 6))
    tokens, decision = rng.normal(size=(7, d)), rng.normal(size=d)
    norm = lambda v: (v - v.mean()) / np.sqrt(v.var() + 1e-5)
    spans = [(0, 3), (-1, -1), (6, 7), (2, 2)]
    df = spark.createDataFrame([(tokens.tolist(), decision.tolist(), spans)], "t array<array<double>>, d array<double>, s array<struct<first: int, end: int>>")
    got = df.select(T.content_scores(F.col("t"), F.col("d"), F.col("s"), w.tolist()).alias("x")).first().x
    want = [w @ norm(decision) @ norm(tokens[a : max(b, a + 1)].mean(axis=0)) / math.sqrt(d) if a >= 0 else 0.0 for a, b in spans]
    assert np.allclose(got, want)


def test_masks(spark):
    row = spark.createDataFrame([([True, True, False], 2)], "real array<boolean>, n int").select(T.suffix_mask(F.col("real"), F.col("n")).alias("s"), T.causal_mask(F.col("n")).alias("c"), T.causal_mask(F.lit(0)).alias("z")).first()
    assert row.s == [[True, True, True, False, False], [True, True, True, True, False], [True, True, True, True, True]]
    assert row.c == [[True, False], [True, True]] and row.z == []


@pytest.mark.parametrize(("most", "budget", "part"), [(3, 10**9, 100), (7, 60, 1), (4, 80, 300), (5, 5000, 700)])
def test_a_lane_is_cut_into_parts_that_keep_its_passes(spark, most, budget, part):
    rng = random.Random(part)
    rows = [(i, rng.choice([0, 1, 5, 5, 5, 20, 100])) for i in range(400)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in rows], "id long, text string").repartition(3)
    tasks = lambda texts: [len(texts)] * len(texts)
    out = P.run_passes(df, F.col("id"), F.length("text"), F.col("text"), tasks, "long", 2, most, budget, ["id"], part)
    found = out.withColumn("task", F.spark_partition_id()).collect()
    want = plain_passes(rows, 2, most, budget)
    assert {r.id: (r.lane, r["pass"], r.width) for r in found} == want and len(found) == 400
    held = {}
    for lane, number, _ in want.values():
        held[lane, number] = held.get((lane, number), 0) + 1
    assert all(r.result == held[r.lane, r["pass"]] for r in found)  # a pass is still one call of the model
    assert len({r.task for r in found}) > 2  # more tasks than lanes


def test_repeated_keys_stay_in_one_part(spark):
    df = spark.createDataFrame([("k", "abc")] * 50 + [(None, "de")] * 20, "id string, text string")
    out = P.run_passes(df, F.col("id"), F.length("text"), F.col("text"), lambda ts: [len(ts)] * len(ts), "long", 2, 4, 1000, part=1).collect()
    assert len(out) == 70 and sorted({(r.id or "", r["pass"]) for r in out}) == [("", i) for i in range(5)] + [("k", i) for i in range(13)]
