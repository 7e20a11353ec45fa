"""Quantiles from bracketed scans and running sums, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import multiple, ranks


def table(spark, seed=1, n=6000):
    rng = np.random.default_rng(seed)
    rows = [(["a", "b", None][int(rng.integers(3))], float(x)) for x in np.round(rng.normal(size=n) * 50, int(rng.integers(1, 3)))]
    rows += [("a", 0.0)] * 2500 + [("b", None)] * 9 + [("none", None)] * 3 + [("one", 4.5)] + [("two", 1.0), ("two", 2.0)] + [("inf", math.inf), ("inf", 1.0), ("inf", -math.inf)]
    return rows, spark.createDataFrame(rows, "`g.` string, `x.` double").repartition(5)


@pytest.mark.parametrize("full", [16_000, 0])
def test_quantiles_are_exact(spark, monkeypatch, full):
    """Groups with one heavy value, a null name, no value, infinities; with and without brackets."""
    monkeypatch.setattr(ranks, "FULL", full)
    monkeypatch.setattr(ranks, "SKETCH", 400)
    monkeypatch.setattr(ranks, "RANK_ERROR", 2.296 / 400**0.9021)
    rows, df = table(spark)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0) if not full else (0.25, 0.5, 0.75, 1.0)
    if not full:  # small groups are bracketed by ranks only beyond FULL; keep the large ones
        df = df.where(F.col("`g.`").isin("a", "b") | F.col("`g.`").isNull())
    got = {r[0]: r for r in ranks.quantile_table(df, ["g."], "x.", at, {"n": F.count("*"), "top": F.max("`x.`")}).collect()}
    for g in {r[0] for r in rows if full or r[0] in ("a", "b", None)}:
        values = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == sum(k == g for k, _ in rows)
        for k, q in enumerate(at):
            if not values:
                assert got[g][f"q{k}"] is None
            elif g != "inf" or (len(values) - 1) * q % 1 == 0:  # nothing lies between infinities
                want = sorted(values)[int((len(values) - 1) * q)] if g == "inf" else float(np.quantile(values, q))
                assert got[g][f"q{k}"] == pytest.approx(want, rel=1e-12)
    whole = ranks.quantile_table(df.where("abs(`x.`) < 1e300"), [], "x.", (0.5,)).first()[0]
    assert whole == pytest.approx(float(np.median([x for k, x in rows if x is not None and abs(x) < 1e300 and (full or k in ("a", "b", None))])))
    assert ranks.quantile_table(df.limit(0), ["g."], "x.", (0.5,)).count() == 0


def test_running_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 1013, i % 5) for i in range(1013)], "k long, n long").repartition(3)
    few = {r.k: r.upto for r in ranks.running(df, ["k"], {"upto": "n"}).collect()}
    monkeypatch.setattr(ranks, "FEW", 10)
    assert {r.k: r.upto for r in ranks.running(df, ["k"], {"upto": "n"}).collect()} == few


def test_adjust_by_ranges(spark, monkeypatch):
    """As many tasks as ranges, and the same answers as the plain step-up."""
    monkeypatch.setattr(ranks, "FEW", 0)
    rng = np.random.default_rng(2)
    p = [float(x) for x in np.round(rng.random(300) ** 3, 3)]
    tests = spark.createDataFrame([(i, x, i % 2 == 0) for i, x in enumerate(p)] + [(999, None, True)], "id long, p double, exploratory boolean").repartition(4)
    got = {r.id: r for r in multiple.adjust(tests).collect()}
    order = sorted(p)
    cut = max([x for k, x in enumerate(order, 1) if x <= k * 0.05 / 300], default=-1.0)
    assert all((got[i].bh, got[i].bonferroni, got[i].m) == (x <= cut, x <= 0.05 / 300, 300) for i, x in enumerate(p))
    assert got[999].bh is None and got[999].bh_rank is None and sorted(r.bh_rank for r in got.values() if r.p is not None) == [*range(1, 301)]
    families = {r.id: r.bh for r in multiple.adjust(tests, family=["exploratory"]).collect()}
    for kind in (True, False):
        own = sorted(x for i, x in enumerate(p) if (i % 2 == 0) == kind)
        cut = max([x for k, x in enumerate(own, 1) if x <= k * 0.05 / len(own)], default=-1.0)
        assert all(families[i] == (x <= cut) for i, x in enumerate(p) if (i % 2 == 0) == kind)
    assert multiple.adjust(tests.where("p is null")).first().bh is None


def test_groups_beyond_the_bound_raise(spark):
    from fieldmark.operators import compare

    df = spark.range(500).select((F.col("id") % 250).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    for f in (ranks.kruskal, compare.levene):
        with pytest.raises(ValueError, match="more than 200"):
            f(df, "g", "x")
    with pytest.raises(ValueError, match="two groups"):
        ranks.mann_whitney(df, "g", "x")


def test_grams_by_key(spark):
    """All keys in one aggregation, as one pass for each."""
    from fieldmark.operators.gram import gram, grams

    rng = np.random.default_rng(5)
    rows = [(int(k), float(1e6 + a), float(a * k + b), float(b)) for k, a, b in zip(rng.integers(0, 4, 400), rng.normal(size=400), rng.normal(size=400), strict=True)] + [(1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, a double, `b.c` double, d double").repartition(3)
    got = grams(df, "k", ["a", "b.c", "d"], {"a": 1e6, "b.c": 0.3, "d": 0.0})
    assert set(got) == {0, 1, 2, 3}
    for k, g in got.items():
        want = gram(df.where(F.col("k") == k), {c: F.col(f"`{c}`") for c in ("a", "b.c", "d")})
        assert g.n == want.n and g.mean == pytest.approx(want.mean) and g.cross == pytest.approx(want.cross, rel=1e-6, abs=1e-6)


def test_pair_ranks(spark):
    """Every pair's U and ties in one job, as each pair by itself."""
    from fieldmark.operators import compare

    rng = np.random.default_rng(8)
    rows = [(f"g{int(k)}", float(v)) for k, v in zip(rng.integers(0, 4, 300), rng.integers(0, 40, 300), strict=True)] + [("g9", 1.5), ("g9", 2.5), ("g8", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    levels = ["g0", "g1", "g2", "g3", "g9"]
    got = ranks.pair_ranks(df, "g", "x", levels)
    found = {(r.level_a, r.level_b): r for r in compare.post_hoc(df, "g", "x", False).collect()}
    for i, a in enumerate(levels):
        for j, b in enumerate(levels[i + 1 :], i + 1):
            x, y = ([v for g, v in rows if g == c and v is not None] for c in (a, b))
            u = sum((v > w) + (v == w) / 2 for v in x for w in y)
            t = [(x + y).count(v) for v in set(x + y)]
            assert got[i, j] == (u, sum(n**3 - n for n in t))
            alone = ranks.mann_whitney(df.where(F.col("g").isin(a, b)), "g", "x") if (i, j) in ((0, 1), (3, 4)) else None
            if alone:
                assert found[a, b].p == pytest.approx(min(1.0, alone["p"] * 10)) and found[a, b].rank_biserial_low == pytest.approx(alone["rank_biserial_low"])
