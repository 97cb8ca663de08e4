import math
import random

import pytest
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.operators import calibrate, conformal, metrics, scoring
from decidra.sources.records import SCORED


def scored(spark, rows):
    full = [(str(i), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCORED)


def item(probs, label, qtype="bool", source="s", answerable=True, evidence=1.0):
    target = [float(i == label) for i in range(len(probs))]
    return ([float(p) for p in probs], target, label, qtype, source, answerable, evidence)


def overall(df):
    return metrics.summary(df).where("level = 'overall'").first()


def test_hand_computed_summary(spark):
    got = overall(scored(spark, [item([0.5, 0.25, 0.25], 0, "choice"), item([0.1, 0.9], 1), item([0.4, 0.6], 0)]))
    assert got["count"] == 3 and got.accuracy == pytest.approx(2 / 3)
    assert got.brier == pytest.approx((0.375 + 0.02 + 0.72) / 3) and got.nll == pytest.approx(-math.log(0.5 * 0.9 * 0.4) / 3)
    assert got.score_mae is None and got.evidence_auc is None


def test_ece(spark):
    three_of_four = [item([0.75, 0.25], 0)] * 3 + [item([0.75, 0.25], 1)]
    assert overall(scored(spark, three_of_four)).ece == pytest.approx(0.0, abs=1e-12)
    two_bins = three_of_four + [item([0.4, 0.6], 0)] * 4  # half of the items are off by 0.6
    assert overall(scored(spark, two_bins)).ece == pytest.approx(0.3)


def test_auc_and_single_class(spark):
    rows = [item([1, 0], 0, evidence=e, answerable=a) for e, a in ((0.2, False), (0.3, True), (0.5, False), (0.6, False), (0.7, True))]
    assert overall(scored(spark, rows)).evidence_auc == pytest.approx(4 / 6)  # 1 + 3 of 6 pairs are in order
    assert math.isnan(overall(scored(spark, rows[2:4])).evidence_auc)


def test_auc_where_evidence_crowds(spark):
    """Most evidence at one value: ties go by item id, and the rank sum is that of a plain sort."""
    rng = random.Random(6)
    rows = [item([1, 0], 0, evidence=rng.choice([0.5, 0.5, 0.5, 0.999, rng.random()]), answerable=rng.random() < 0.6) for _ in range(500)]
    order = sorted(range(500), key=lambda i: (rows[i][6], str(i)))
    pos = [r for r, i in enumerate(order, 1) if rows[i][5]]
    want = (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (500 - len(pos)))
    assert overall(scored(spark, rows)).evidence_auc == pytest.approx(want)


def test_levels_and_empty(spark):
    rows = [item([0.2, 0.3, 0.5], 1, "score", "a"), item([0.6, 0.4], 0, "bool", "b")]
    got = {(r.level, r.key): r for r in metrics.summary(scored(spark, rows)).collect()}
    assert set(got) == {("overall", ""), ("type", "score"), ("type", "bool"), ("source", "a"), ("source", "b")}
    assert got["type", "score"].score_mae == pytest.approx(0.3)
    assert metrics.summary(scored(spark, [])).collect() == []
    table = metrics.reliability(scored(spark, rows)).collect()
    assert len(table) == 10 and sum(r["count"] for r in table) == 2


def test_bins_are_open_below(spark):
    edges = metrics.edges(10)
    df = spark.createDataFrame([(0.0,), (0.1,), (0.1 + 1e-12,), (1.0,)], "p double")
    assert [r[0] for r in df.select(A.bin_of(F.col("p"), edges)).collect()] == [0, 0, 1, 9]


@pytest.mark.parametrize("probs,want", [([0.0, 1.0], 1.0), ([0.2] * 5, 0.0), ([0.1, 0.7, 0.1, 0.1], 0.6), ([1.0], 1.0)])
def test_confidence(spark, probs, want):
    assert spark.createDataFrame([(probs,)], "p array<double>").select(A.confidence(F.col("p"))).first()[0] == pytest.approx(want)


def test_targets(spark):
    row = spark.range(1).select(
        A.ordinal_target(F.lit(2.5), F.lit(6), 0.7).alias("o"),
        A.training_target(F.lit("choice"), F.array(F.lit(0.0), F.lit(1.0)), F.lit(1)).alias("c"),
        A.training_target(F.lit("score"), F.array(F.lit(0.4), F.lit(0.6)), F.lit(1)).alias("soft"),
    ).first()
    assert sum(row.o) == pytest.approx(1) and all(row.o[i] == pytest.approx(row.o[5 - i]) for i in range(3)) and row.o[2] == max(row.o)
    assert row.o[2] / row.o[1] == pytest.approx(math.exp((1.5**2 - 0.5**2) / (2 * 0.49)))
    assert row.c == [0, 1] and row.soft == [0.4, 0.6]


@pytest.mark.parametrize("probs,n", [([0.5, 0.5], 3), ([0.0, 0.0], 2), ([float("nan"), 1.0], 2), ([float("inf"), 1.0], 2)])
def test_bad_probabilities_are_errors(spark, probs, n):
    df = spark.createDataFrame([(probs,)], "p array<double>").select(A.checked_probabilities(F.col("p"), F.lit(n)))
    with pytest.raises(Exception, match="probabilit"):
        df.collect()


def draws(n, k, sharpen, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        z = [rng.gauss(0, 1.5) for _ in range(k)]
        e = [math.exp(x) for x in z]
        p = [x / sum(e) for x in e]
        label = rng.choices(range(k), p)[0]
        s = [x**sharpen for x in p]
        out.append(item([x / sum(s) for x in s], label, "choice"))
    return out


def test_temperature_is_recovered(spark):
    df = scored(spark, draws(2500, 5, 1.6, 1)).persist()
    t = calibrate.fit_temperature(df)
    assert abs(t - 1.6) < 0.15
    assert overall(calibrate.rescaled(df, t)).ece < overall(df).ece
    same = calibrate.rescaled(df, 1.0).select(F.max(A.squared_distance(F.col("probs"), F.col("probs")))).first()[0]
    assert same == 0 and calibrate.fit_temperature(df.limit(0)) == 1.0


def test_binomial_cdf(spark):
    cases = [(4, 17, 0.2), (0, 5, 0.1), (30, 200, 0.1), (9, 9, 0.4), (150, 1000, 0.1), (90, 1000, 0.1), (999, 1000, 0.1), (3, 900, 0.1)]
    for k, n, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(conformal.binomial_cdf(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(min(1, want), abs=1e-11)
    # a billion items: the sum has as many terms as the spread, and agrees with the normal approximation
    for z in (-3.0, 0.0, 2.0):
        n, p = 10**9, 0.1
        got = spark.range(1).select(conformal.binomial_cdf(F.lit(int(n * p + z * math.sqrt(n * p * (1 - p)))), F.lit(n), p)).first()[0]
        assert got == pytest.approx((1 + math.erf(z / math.sqrt(2))) / 2, abs=1e-4)
    got = spark.range(1, 60).select(F.col("id"), conformal.log_gamma(F.col("id").cast("double")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.id)) < 1e-11 for r in got)


def test_coverage_and_act_error(spark):
    thresholds = conformal.fit(scored(spark, draws(3000, 3, 1.0, 2)), alpha=0.2).persist()
    got = conformal.evaluate(scored(spark, draws(3000, 3, 1.0, 3)), thresholds).first()
    assert 0.77 <= got.coverage <= 0.83 and got.act_error <= 0.2 and got.act_rate > 0.1


def test_coin_flips_never_act(spark):
    rows = [item([0.55, 0.45], i % 2) for i in range(120)]
    t = conformal.fit(scored(spark, rows))
    assert t.first().act_threshold is None
    kept = conformal.decorate(scored(spark, [*rows[:1], item([0.2, 0.3, 0.5], 0, "score")]), t).collect()
    assert [r.act for r in sorted(kept, key=lambda r: r.item_id)] == [False, None]


def test_set_threshold_is_the_sorted_rank(spark):
    """Scores that crowd near zero, with many ties, against a plain sort."""
    rng = random.Random(8)
    tops = [round(1 - rng.choice([1e-9, 1e-6, 1e-6, 0.01, rng.random() / 2]), 9) for _ in range(301)]
    rows = [item([p, 1 - p], 0) for p in tops]
    for alpha in (0.01, 0.1, 0.5):
        want = sorted(1 - p for p in tops)[min(301, math.ceil(302 * (1 - alpha))) - 1]
        assert conformal.set_thresholds(scored(spark, rows), alpha).first().set_threshold == pytest.approx(want, abs=1e-15)


def test_scorers_agree(spark):
    df = spark.createDataFrame([(1, "ab", [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]])], "id long, text string, v array<double>, o array<array<double>>")
    p = scoring.score(df, scoring.CosineScorer("v", "o")).first().probs
    assert p[0] == pytest.approx(1 / (1 + math.exp(-20)))
    f = scoring.score(df, scoring.FunctionScorer("text", lambda texts: [[20.0, 0.0] for _ in texts])).first().probs
    assert f == pytest.approx(p)
    a = df.select("id", F.array(F.lit(0.5), F.lit(0.5)).alias("probs"), F.lit(0.2).alias("evidence"))
    b = df.select("id", F.array(F.lit(0.51), F.lit(0.49)).alias("probs"), F.lit(0.2).alias("evidence"))
    r = scoring.agreement(a, b, ["id"], 0.02).first()
    assert r.ok and r.max_probability_gap == pytest.approx(0.01)
    assert not scoring.agreement(a, b.limit(0), ["id"], 0.02).first().ok
    assert scoring.load_scorer("cosine:state=v,options=o") == scoring.CosineScorer("v", "o")
    with pytest.raises(KeyError):
        scoring.load_scorer("unheard")
    with pytest.raises(ValueError):
        scoring.ask(spark.range(1), spark.range(256))
    e = spark.range(1).select(scoring.evidence_head(F.array(F.lit(1.0), F.lit(3.0)), [0.0, 0.0], 0.0)).first()[0]
    assert e == 0.5


def test_losses_of_odd_rows(spark):
    rows = [([0.2, 0.8], [0.0, 1.0]), ([0.0, 0.3, 0.7], [0.5, 0.25, 0.25]), (None, [1.0]), ([1.0], None), ([0.5, None], [1.0, 0.0]), ([0.5, 0.5], [1.0]), ([0.5], [0.5, 0.25, 0.25]), ([0.5, 0.5], [None, 1.0]), ([], []), ([1.0, 0.0], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "probs array<double>, target array<double>").repartition(3)
    temperatures = [0.25, 1.0, 5.0, 1.0]
    t = F.explode(F.array(*[F.lit(x) for x in temperatures]))
    loss = A.nll(A.rescale(F.col("probs"), F.col("t")), F.col("target"))
    want = {r.t: r.x for r in df.select("*", t.alias("t")).groupBy("t").agg(F.avg(loss).alias("x")).collect()}
    got = {r.temperature: r.nll for r in calibrate.nll_grid(df, temperatures).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = calibrate.nll_grid(df, temperatures)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # rows are not multiplied by the temperatures
    assert calibrate.nll_grid(df.limit(0), temperatures).collect() == []
