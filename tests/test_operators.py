import math
import timeit
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions.columns import banded_number, clean_columns, composite, encode_binary, number
from fieldmark.operators import coding, compare, deident, factor, impute, mediate, multiple, prep, profile, ranks, regress, weights
from fieldmark.plans import methods, report
from fieldmark.plans.analyze import Spec, analyze
from fieldmark.streaming import events as streams


def frame(spark, data, schema, parts=3):
    return spark.createDataFrame(data, schema).repartition(parts)


def test_banded_labels(spark):
    labels = {"0–25%": 12.5, "75–100%": 87.5, "18-24": 21.0, "30%": 30.0, "2 次及以上": 2.0, "大二": 2.0, "1~5": 3.0, "家庭给": None, "男": None, "": None, None: None}
    got = frame(spark, [(x,) for x in labels], "s string").select("s", banded_number(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == labels


def test_numbers_and_headers(spark):
    got = frame(spark, [(x,) for x in ("1", " 2.5 ", "x", "NaN", None, "1e3")], "s string").select("s", number(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == {"1": 1.0, " 2.5 ": 2.5, "x": None, "NaN": None, None: None, "1e3": 1000.0}
    df = spark.createDataFrame([(1, 2, 3)], ["a  b", "c", "d"]).toDF(" a  b", "a b", " ")
    assert clean_columns(df).columns == ["a b", "a b_2", "未命名"]


def test_kinds(spark):
    rows = [(i % 5 + 1, i * 1.5, f"g{i % 2}", f"some long free text number {i}", None) for i in range(30)]
    df = frame(spark, rows, "likert int, x double, g string, t string, e string")
    found = {k.name: (k.kind, k.ordinal) for k in profile.kinds(df)}
    assert found == {"likert": ("categorical", True), "x": ("continuous", False), "g": ("categorical", False), "t": ("text", False), "e": ("empty", False)}


def test_alpha_and_scales(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 300)
    items = np.clip(np.round(3 + base[:, None] + rng.normal(0, 0.6, (300, 3))), 1, 5)
    df = frame(spark, [tuple(map(float, r)) for r in items], "Q1 double, Q2 double, Q3 double")
    got = profile.cronbach_alpha(df, ["Q1", "Q2", "Q3"])
    c = np.cov(items.T)
    assert got["alpha"] == pytest.approx(1.5 * (1 - np.trace(c) / c.sum()))
    assert profile.scales(df) == {"Q": ["Q1", "Q2", "Q3"]}
    assert profile.cronbach_alpha(df.limit(0), ["Q1", "Q2"]) is None


def test_exact_rank_tests(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 5.0), ("b", 6.0)], "g string, x double")
    got = ranks.mann_whitney(df, "g", "x")
    assert (got["u"], got["p"]) == (1.0, pytest.approx(0.2))
    d = frame(spark, [(float(x),) for x in (1, 2, 3, 4, 5, 0)], "d double")
    w = compare.wilcoxon(d)
    assert (w["n_pair"], w["n_zero"], w["n_use"], w["p"], w["rank_biserial"]) == (6, 1, 5, pytest.approx(0.0625), 1.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_kendall_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 5, 60)
    s = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2
    tie = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    n0 = 60 * 59 / 2
    got = ranks.kendall(frame(spark, [(int(a), int(b)) for a, b in zip(x, y)], "x int, y int", parts), "x", "y")
    assert got["tau"] == pytest.approx(s / math.sqrt((n0 - tie(x)) * (n0 - tie(y))))


def test_compare_routes(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(m + rng.normal())) for g, m in (("a", 0.0), ("b", 1.0), ("c", 2.0)) for _ in range(40)]
    got = compare.compare(frame(spark, rows, "g string, x double"), "g", "x")
    assert got["method"] in ("anova", "anova_welch") and got["p"] < 0.001 and got["eta2_low"] < got["eta2"] < got["eta2_high"]
    assert got["post_hoc"].count() == 3
    two = compare.compare(frame(spark, rows[:80], "g string, x double"), "g", "x")
    assert two["method"] in ("t", "welch") and two["d"] < 0
    assert compare.compare(frame(spark, rows[:40], "g string, x double"), "g", "x")["method"] is None
    assert methods.truth_table() and methods.pick_compare(2, False, True) == "mannwhitney"


def test_within(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 60)
    rows = [(float(x), float(x + 0.5 + e)) for x, e in zip(a, rng.normal(0, 0.5, 60))]
    df = frame(spark, rows, "x double, y double")
    got, swapped = compare.within(df, "x", "y"), compare.within(df, "y", "x")
    assert got["method"] == "paired_t" and got["t"] == pytest.approx(-swapped["t"]) and got["p"] == pytest.approx(swapped["p"])
    low, high = compare.bootstrap_median(compare.differences(df, "x", "y"), replicates=200)
    assert low < 0.5 < high + 0.2


def test_ols_matches_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(0, 0.5, 200)
    df = frame(spark, [(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, y double")
    found = regress.diagnostics(df, "y", ["a", "b"], row_order="i")
    design = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    assert [r["b"] for r in found["fit"]["coefficients"]] == pytest.approx(beta.tolist())
    assert found["dw"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    h = np.einsum("ij,jk,ik->i", design, np.linalg.inv(design.T @ design), design)
    cook = e**2 / (3 * (e @ e) / 197) * h / (1 - h) ** 2
    assert found["cook_max"] == pytest.approx(cook.max())
    assert found["n_cook_flag"] == (cook > 4 / 200).sum()
    part = regress.partial(df, "a", "y", ["b"])
    assert part["df"] == 197


def test_regression_reads_numbers_as_they_are(spark):
    """Doubles and whole numbers take no way over text, and a number is the same by either way."""
    from fieldmark.functions.columns import number_of

    kinds = "a double, b long, c int, d float, e decimal(9, 2), f boolean, g string, `h.i` double"
    rows = [(1.5, 2**53 + 1, -7, 0.1, 2, True, " 3 ", math.inf), (math.nan, None, 0, math.nan, None, False, "x", -0.0), (None, 5, None, None, 1, None, "NaN", 1e-320)]
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), *r[5:]) for r in rows], kinds)
    by_text = df.select(*[number(F.col(f"`{c}`")).alias(c) for c in df.columns]).collect()
    assert df.select(*[number_of(df, c).alias(c) for c in df.columns]).collect() == by_text
    for c in ("a", "b", "c", "A"):
        plan = df.select(*regress.design(df, [c]).values())._jdf.queryExecution().analyzed().toString()
        assert "as string" not in plan


def test_durbin_watson_ties_and_batches(spark):
    rng = np.random.default_rng(8)
    o, e = rng.integers(0, 40, 500), rng.normal(size=500)
    at = np.lexsort((e, o))
    want = (np.diff(e[at]) ** 2).sum() / (e**2).sum()
    df = frame(spark, [(int(a), float(b)) for a, b in zip(o, e)], "o int, residual double", 7)
    for batch in (10_000, 9):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert regress.durbin_watson(df, "o") == pytest.approx(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert math.isnan(regress.durbin_watson(df.limit(0), "o"))


def test_sensitivity_takes_a_fit(spark):
    """The fit of ``diagnostics`` serves, and products about a number near the means are the same."""
    from fieldmark.operators.gram import gram

    rng = np.random.default_rng(12)
    x = rng.normal(1e6, 1, 300)
    rows = [(float(a), float(3 * a + b)) for a, b in zip(x, rng.standard_t(2, 300))] + [(None, 1.0), (1.0, None)]
    df = frame(spark, rows, "x double, y double")
    found = regress.diagnostics(df, "y", ["x"])
    one, two = regress.sensitivity(df, "y", ["x"]), regress.sensitivity(df, "y", ["x"], full=found["fit"])
    assert one["n_flagged"] == two["n_flagged"] == found["n_cook_flag"] > 0
    assert one["without"]["r2"] == pytest.approx(two["without"]["r2"]) and one["turned"] == two["turned"]
    cols = {"x": F.col("x"), "y": F.col("y")}
    a, b = gram(df, cols), gram(df, cols, centre={"x": 1e6, "y": 3e6})
    assert a.n == b.n == 300 and a.mean == pytest.approx(b.mean) and a.cross == pytest.approx(b.cross)
    assert gram(df.limit(0), cols, centre={"x": 0, "y": 0}).n == 0


def test_logistic_recovers(spark):
    rng = np.random.default_rng(2026)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x[:, 0] - 0.8 * x[:, 1])))
    df = frame(spark, [(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    fit = regress.logistic(df, "y", ["a", "b"])
    assert fit["converged"] and fit["coefficients"][1]["b"] == pytest.approx(1.2, abs=0.35)
    table, test = regress.hosmer_lemeshow(regress.with_probability(df, fit, "y", ["a", "b"]))
    assert table.agg(F.sum("n"), F.min("n"), F.max("n")).first() == (600, 60, 60) and test["df"] == 8


def test_mediation_moderation(spark):
    rng = np.random.default_rng(99)
    x = rng.normal(size=400)
    m = 0.6 * x + rng.normal(size=400)
    y = 0.5 * m + 0.3 * x + rng.normal(size=400)
    z = 0.5 * x + 0.2 * m + 0.4 * x * m + rng.normal(size=400)
    df = frame(spark, [tuple(map(float, r)) for r in zip(x, m, y, z)], "x double, m double, y double, z double")
    got = mediate.mediation(df, "x", "m", "y", replicates=300)
    assert got["label"] == "partial mediation" and got["ci_low"] < got["indirect"] < got["ci_high"]
    mod = mediate.moderation(df, "x", "m", "z")
    assert mod["interaction"]["b"] == pytest.approx(0.4, abs=0.15) and len(mod["slopes"]) == 3
    assert mediate.mediation(df.limit(10), "x", "m", "y")["label"] == "too few rows"


def test_factor_two(spark):
    rng = np.random.default_rng(2026)
    f = rng.multivariate_normal([0, 0], [[1, 0.3], [0.3, 1]], 600)
    items = np.hstack([0.75 * f[:, [0]] + 0.66 * rng.normal(size=(600, 4)), 0.75 * f[:, [1]] + 0.66 * rng.normal(size=(600, 4))])
    df = frame(spark, [tuple(map(float, r)) for r in items], ", ".join(f"i{k} double" for k in range(8)))
    got = factor.analyse(df, df.columns)
    assert got["factors"] == 2 and got["kmo"] > 0.7 and got["bartlett"]["p"] < 0.001
    plain = factor.analyse(df, df.columns, 2, rotate=False)
    assert (got["loadings"] ** 2).sum() == pytest.approx((plain["loadings"] ** 2).sum())
    assert set(factor.name_hints(got)[1]) in ({f"i{k}" for k in range(4)}, {f"i{k}" for k in range(4, 8)})


def test_weights(spark):
    rows = [("A", 10.0, 1.0)] * 600 + [("B", 20.0, 4.0)] * 150
    df = frame(spark, rows, "g string, x double, w double")
    assert weights.weighted_mean(df, "x", "w")["mean"] == pytest.approx(15.0)
    assert weights.check(df, "w")["deff"] == pytest.approx(1.5625)
    assert weights.weighted_diff(df, "x", "g", "w")["diff"] == pytest.approx(10)
    equal = weights.check(df.withColumn("w", F.lit(2.0)), "w")
    assert equal["deff"] == pytest.approx(1)


def test_multiple(spark):
    got = multiple.adjust(spark.createDataFrame([(x,) for x in (0.01, 0.02, 0.03, 0.04, 0.05)], "p double")).agg(F.count_if("bh"), F.count_if("bonferroni")).first()
    assert got == (5, 1)
    assert multiple.adjust(spark.createDataFrame([(None,), (0.01,)], "p double")).where("p is null").first()["bh"] is None


def test_prep_skips(spark):
    rows = [("R01", "单身", "<不适用>", 3, "true"), ("R02", "恋爱", "500", 2, "false"), ("R03", "恋爱", "300", 1, "false"), ("R04", "恋爱", None, 2, "false"), ("R05", "单身", "<不适用>", 4, "true"), ("R06", "恋爱", "100", 1, "false")]
    df = frame(spark, rows, "id string, state string, spend string, grade int, `恋爱_跳题` string")
    kept, log = prep.run(df, [prep.mark_skips, prep.delete_incomplete])
    assert kept.count() == 5 and "恋爱_跳题" not in kept.columns and len(log) == 2
    listwise, _ = prep.run(df, [prep.mark_skips, lambda d: prep.delete_incomplete(d, False)])
    assert listwise.count() == 3


def test_prep_scores(spark):
    df = frame(spark, [(1, 5.0, None), (2, None, None), (4, 3.0, 2.0)], "a int, b double, c double")
    out, _ = prep.run(df, [lambda d: prep.reverse(d, "a, 5"), lambda d: prep.composites(d, "s = b + c\nm = mean(b, c)\nz = b + nope")])
    got = {r["a_原始"]: (r["a"], r["s"], r["m"]) for r in out.collect()}
    assert got == {1: (5.0, 5.0, 5.0), 2: (4.0, 0.0, None), 4: (2.0, 5.0, 2.5)}
    assert "z" not in out.columns and composite("z = mean(a)", ["a"]) is None
    filled, _ = prep.fill(df, ["b"], "median")
    assert filled.where("b is null").count() == 0
    assert prep.drop_empty_columns(df.withColumn("n", F.lit(None).cast("int")))[0].columns == ["a", "b", "c"]


@pytest.mark.parametrize("parts", [1, 5])
def test_mice_does_not_depend_on_layout(spark, parts):
    rng = np.random.default_rng(7)
    a = rng.normal(size=120)
    b = 0.8 * a + 0.6 * rng.normal(size=120)
    rows = [(i, float(x), None if i % 4 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    got = impute.mice(frame(spark, rows, "id long, a double, b double", parts), "id", ["a", "b"], sets=2, sweeps=2)
    assert got.count() == 240 and got.where("b is null").count() == 0
    value = got.where("_set = 1 and id = 0").first()["b"]
    assert value == pytest.approx(test_mice_does_not_depend_on_layout.__dict__.setdefault("seen", value))


def test_mice_by_patterns_and_by_rows(spark, monkeypatch):
    """Cross products of each pattern of missing columns give what sweeps over the rows give, and write no table."""
    rng = np.random.default_rng(21)
    x = rng.normal(1000, 1, (240, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.4], [0, 0, 1]])
    gone = rng.random((240, 3)) < [0.3, 0.25, 0.2]
    rows = [(i, *[None if m else float(v) for v, m in zip(r, g)], float(r.sum() + rng.normal()), i % 20 == 0) for i, (r, g) in enumerate(zip(x, gone))]
    df = frame(spark, rows, "id long, a double, b double, c double, d double, out boolean")
    written, seen = [], []
    monkeypatch.setattr(impute, "written", lambda t: written.append(t) or t.localCheckpoint())
    for most in (impute.MOST, 0):
        monkeypatch.setattr(impute, "MOST", most)
        got = impute.mice(df, "id", ["a", "b", "c", "d"], sets=2, sweeps=3, skip=F.col("out"))
        seen.append(sorted(got.collect(), key=lambda r: (r["_set"], r["id"])))
        assert bool(written) == (most == 0)
    assert len(seen[0]) == 480 and gone[1:, :2].all(1).any()
    for one, two in zip(*seen, strict=True):
        assert tuple(one) == pytest.approx(tuple(two)) and one.asDict().keys() == two.asDict().keys()
        assert (one["a"] is None) == bool(gone[one["id"], 0] and one["out"])


def test_rubin():
    got = impute.rubin([1.0, 1.2, 0.8], [0.04, 0.05, 0.045])
    assert got["total"] > got["within"] and got["ci_low"] < 1 < got["ci_high"]


def test_segments(spark):
    text = "访谈时间：2024-01-02\n受访者：某某\n\n访员：你平时怎么安排时间？\n受访者1：我觉得以前很忙，现在好多了\n因为换了工作\n时长：41 分钟\n尾巴\n---\n访员：第二场开始\n[姓名2]：好的"
    docs = frame(spark, [(1, text), (2, None), (3, "")], "doc_id long, text string")
    units = coding.segments(coding.lines_of(docs)).orderBy("session", "unit").collect()
    assert [(r["speaker"], r["text"]) for r in units] == [("访员", "你平时怎么安排时间？"), ("受访者1", "我觉得以前很忙，现在好多了 因为换了工作"), ("访员", "第二场开始"), ("[姓名2]", "好的")]
    who = coding.interviewers(coding.lines_of(docs), coding.segments(coding.lines_of(docs)))
    assert [tuple(r) for r in who.collect()] == [(1, "访员")]
    assert coding.usable(coding.segments(coding.lines_of(docs)), who).count() == 1
    assert coding.quotes(coding.segments(coding.lines_of(docs))).first()["speaker"] == "受访者1"


def test_keywords(spark):
    units = frame(spark, [(1, "我在准备考研，考研压力大"), (2, "压力不小"), (3, "无关")], "no long, text string")
    words = spark.createDataFrame([("考研",), ("压力",), ("准备考研",), ("研",)], "word string")
    got = {r["word"]: (r["n_segments"], r["n"]) for r in coding.keyword_hits(units, words, ["no"]).collect()}
    assert got == {"压力": (2, 2), "准备考研": (1, 1)}


def test_codesum(spark):
    rows = [(1, "甲", "很长的一段话用来当作引语使用的内容", "加班、压力", "工作", "时间冲突", True), (2, "乙", "第二段", "压力", "工作", "时间冲突；关系", False), (3, "丙", "第三段", "加班", "", "", False), (4, "—", "元", "x", "y", "z", False)]
    sheet = frame(spark, rows, "no long, speaker string, text string, codes string, categories string, themes string, star boolean")
    c = coding.coded(sheet)
    themes = {r["label"]: (r["place"], r["n_people"], r["n_segments"]) for r in coding.label_summary(c, "themes").collect()}
    assert themes == {"时间冲突": (1, 2, 2), "关系": (2, 1, 1)}
    filled = {r["no"]: (r["categories_all"], r["is_inferred"]) for r in coding.inferred(c, "codes", "categories").collect()}
    assert filled[3] == (["工作"], True) and filled[1] == (["工作"], False)
    matrix = {r["label"]: (r["甲"], r["乙"]) for r in coding.person_matrix(c, "themes", ["甲", "乙"]).collect()}
    assert matrix == {"时间冲突": (1, 1), "关系": (0, 1)}
    assert coding.theme_quotes(c, top=1).where("theme = '时间冲突'").first()["no"] == 1
    assert {r["check"]: r["n"] for r in coding.health(c).collect()}["uncoded"] == 0


def test_deident(spark):
    text = "姓名：陈嘉怡 手机 139-0000-1111，备用１３９００００１１１１\n邮箱 a.b@x.com QQ 18900001111\n陈嘉怡老师说好。时长：41 分钟"
    docs = frame(spark, [(1, text), (2, None), (3, "没有")], "doc_id long, text string")
    out, mapping = deident.deidentify(docs)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[3] == "没有" and got[2] is None
    assert "陈嘉怡" not in got[1] and "1111" not in got[1] and "a.b@x.com" not in got[1] and "41 分钟" in got[1]
    phones = {r["placeholder"] for r in mapping.where("kind = '手机'").collect()}
    assert phones == {"[手机1]"}
    assert deident.guard(out).count() == 0 and deident.guard(docs).count() > 0
    rules = deident.parse_rules("a = b\n!不用管 X\n!这是微信 abc\n!第2段是手机\n!第3段不用管\n!什么\n")
    assert rules.pairs == [("a", "b")] and rules.named == [("abc", "微信")] and rules.ignored == ["X"] and rules.places == {1: "手机", 2: None} and rules.odd == ["!什么"]
    masked = deident.mask_columns(frame(spark, [("王一", "1"), ("王一", "2")], "`姓名` string, n string"), "k")
    assert masked.select("姓名").distinct().count() == 1


def test_layout(spark):
    found = deident.detect_layout(["陈嘉怡 13900001111 女", "王小明 13900002222 男"])
    assert found["style"] == "line" and [p["kind"] for p in found["places"]] == ["姓名", "手机", None]
    assert deident.apply_layout(frame(spark, [("陈嘉怡 13900001111 女",)], "line string"), found).first()[0] == "[姓名] [手机] 女"
    told = deident.apply_layout(frame(spark, [("陈嘉怡 13900001111 女",)], "line string"), found, confirmed={1: None, 2: "性别"})
    assert told.first()[0] == "[姓名] 13900001111 [性别]"
    with pytest.raises(ValueError, match="unknown"):
        deident.apply_layout(frame(spark, [("a b",)], "line string"), deident.detect_layout(["a b"]))


def test_acknowledged(spark, tmp_path):
    for k in range(3):
        deident.acknowledge(spark, f"file://{tmp_path}/ack", f"doc{k % 2}", "seen")
    assert {r["id"] for r in deident.acknowledged(spark, f"file://{tmp_path}/ack").collect()} == {"doc0", "doc1"}
    assert deident.acknowledged(spark, f"file://{tmp_path}/ack", 1).count() == 1


def test_quantile_table_both_ways(spark, monkeypatch):
    rows = [(g, float(v)) for g in "ab" for v in np.random.default_rng(ord(g)).integers(0, 50, 101 if g == "a" else 64)]
    df = frame(spark, rows, "g string, x double")
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = {g: [float(np.quantile([v for h, v in rows if h == g], q)) for q in at] for g in "ab"}
    for state in (10**6, 16_000):
        monkeypatch.setattr(ranks, "FULL", state)
        got = {r[0]: list(r[1:]) for r in ranks.quantile_table(df, ["g"], "x", at).collect()}
        assert got == {g: pytest.approx(v) for g, v in want.items()}
        assert ranks.quantile_table(df, [], "x", (0.5,)).first()[0] == pytest.approx(np.median([v for _, v in rows]))


def test_bootstrap_keyed_by_rows(spark):
    """Replicates do not depend on how rows lie, and equal rows do not cancel out."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 300).astype(float)
    rows = [(float(a), float(a + rng.integers(0, 3)), float(2 * a + rng.integers(0, 4))) for a in x]
    df = frame(spark, rows, "x double, m double, y double")
    one, two = (mediate.mediation(df.repartition(k), "x", "m", "y", replicates=300) for k in (1, 5))
    assert (one["ci_low"], one["ci_high"]) == pytest.approx((two["ci_low"], two["ci_high"]))
    assert one["ci_low"] < one["indirect"] < one["ci_high"]


def test_bootstrap_draws_from_tables():
    """Weights have the probabilities of a Poisson distribution, and cost less than a third of single draws."""
    rng = np.random.default_rng(11)
    for mean in (1, 3, 60, 200):
        p, size = mediate.Poisson(mean), 400_000
        got = np.bincount(p.draw(rng, size), minlength=len(p.upto))
        k = np.arange(len(got))
        want = size * np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))
        many = want > 20
        assert ((got - want)[many] ** 2 / want[many]).sum() < many.sum() + 6 * math.sqrt(2 * many.sum())
        assert abs(got[~many].sum() - want[~many].sum()) < 6 * math.sqrt(want[~many].sum()) + 1
        one, other = (min(timeit.repeat(f, number=1, repeat=3)) for f in (lambda p=p: p.draw(rng, size), lambda mean=mean: rng.poisson(mean, size)))
        assert 3 * one < other


def test_bootstrap_does_not_depend_on_batches(spark):
    """A bucket that goes on in the next batch is one bucket, and sums are those of its weights."""
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.normal(size=300), rng.integers(0, 2, 300), rng.normal(size=300)])]
    df = frame(spark, rows + rows[:50], "x double, m double, y double")
    seen = []
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        seen.append(mediate._poisson_grams(df, ["x", "m", "y"], 350, 200, 1))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(*seen)
    x = np.column_stack([np.ones(350), np.array(rows + rows[:50])])
    assert np.abs(seen[0].mean(0) - x.T @ x).max() < 6 * np.sqrt((x**4).sum(0).max() * 2 / 200)
    assert seen[0][:, 0, 0].std() == pytest.approx(math.sqrt(350), rel=0.2)


def test_bootstrap_median_interval(spark):
    values = np.random.default_rng(5).normal(3, 1, 400)
    for n in (400, 399):
        low, high = compare.bootstrap_median(frame(spark, [(float(v),) for v in values[:n]], "d double"))
        draws = np.median(np.random.default_rng(0).choice(values[:n], (4000, n)), axis=1)
        assert (low, high) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])), abs=0.04)


def test_rules(spark, tmp_path):
    from fieldmark.plans import rules

    body = '# x\n```json\n{"purpose_verbs.vague_openers": ["了解"], "purpose_verbs.finite_verbs": ["比较"]}\n```\n```json\n{"sample_size.study_types": [{"label": "访谈", "signals": ["访谈"], "min": 8, "max": 20}]}\n```\n```json\n[1]\n```\n'
    (tmp_path / "r.md").write_text(body)
    found, wrong = rules.load_rules(spark, f"file://{tmp_path}/r.md")
    assert len(found) == 3 and len(wrong) == 1
    assert rules.check_purpose("本研究希望了解用户", found)[0]["found"] == "了解" and not rules.check_purpose("比较两组", found)
    assert rules.check_sample("两类各 4 人", "深度访谈", found)[0]["found"] == "few" and not rules.check_sample("视情况", "访谈", found)
    with pytest.raises(rules.RuleError):
        rules.load_rules(spark, f"file://{tmp_path}/none.md")


def test_intent_words():
    assert methods.guess_kind("两个分类变量有关联吗") == "assoc" and methods.guess_kind("谁更高") == "compare" and methods.guess_kind("前后测有差异吗") == "within"


def test_ledger_reset(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    multiple.register(spark, path, [{"label": "a", "p": 0.01}])
    kept = multiple.reset(spark, path)
    assert spark.read.parquet(kept).count() == 1 and multiple.load(spark, path).count() == 0 and multiple.reset(spark, path) is None


def test_text_sources(spark, tmp_path):
    from fieldmark.sources import tables

    (tmp_path / "w.txt").write_text("加班 手机 # 注释\n我\n")
    assert {r[0] for r in tables.read_lexicon(spark, f"file://{tmp_path}/w.txt", ("食堂",)).collect()} == {"加班", "手机", "食堂"}
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"x,1\n" * 30_000 + "王,2\n".encode("gb18030"))
    assert tables.read_table(spark, f"file://{tmp_path}/late.csv").where("a = '王'").count() == 1
    tables.write_text(spark, "甲\n乙", f"file://{tmp_path}/out", "GBK")
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*")).decode("gbk").split() == ["甲", "乙"]
    lines = frame(spark, [("x", k, f"受访者{k}：" + "好" * 20) for k in range(9)] + [("y", 0, "正文")], "path string, line_no int, line string")
    assert tables.only_transcript(lines) == "x"


def test_report(spark):
    md = "# 1. 目的\n了解\n## 变量\n| 变量名 | 角色 | 层次 | 操作化 |\n|---|---|---|---|\n| 满意度 | 因变量 | 定序 | 李克特量表 |\n| 平台 | 自变量 | 定类 | 单选：安卓/苹果 |"
    secs = report.sections(frame(spark, [(1, md)], "doc_id long, text string"))
    assert [r["title"] for r in secs.orderBy("section").collect()] == ["目的", "变量"]
    items = report.options(report.question_kinds(report.variable_rows(secs)))
    got = {r["name"]: (r["kind"], r["options"]) for r in items.collect()}
    assert got == {"满意度": ("likert", None), "平台": ("single", ["安卓", "苹果"])}
    assert report.fill_time(items, 10).first()["over"]
    assert report.markdown(spark.range(1)).splitlines()[0] == "| id |"
    assert "T-TEST" in report.spss_syntax(spark.range(1), "x.csv", "t", "id", "g")


def test_analyze(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert analyze(orders, Spec(dv="o_totalprice", group="o_orderpriority")).question == "compare"
    assert analyze(orders, Spec(ivs=["o_orderstatus", "o_orderpriority"])).method == "chi2"
    assert analyze(orders, Spec(intent="看看现状")).question == "describe"
    with pytest.raises(ValueError, match="no such columns"):
        analyze(orders, Spec(dv="nope"))
    assert encode_binary(orders.where("o_orderstatus in ('F', 'O')"), "o_orderstatus") is not None


def test_sources(spark, tmp_path):
    from fieldmark.sources import tables

    (tmp_path / "a.csv").write_bytes("﻿姓名 ,分数,空\n王,1,\nNA,2,\n".encode())
    df = tables.read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["姓名", "分数"] and df.where("`姓名` is null").count() == 1
    (tmp_path / "b.csv").write_bytes("姓名,分数\n王,1\n".encode("gb18030"))
    assert tables.read_table(spark, f"file://{tmp_path}/b.csv").first()[0] == "王"
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_bytes("访员：好\n受访者1：在".encode("gb18030"))
    lines = tables.read_transcripts(spark, f"file://{tmp_path}/t")
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["访员：好", "受访者1：在"]
    (tmp_path / "t/y.txt").write_bytes(b"a\0b")
    with pytest.raises(Exception, match="not a text file"):
        tables.read_transcripts(spark, f"file://{tmp_path}/t").collect()
    one, two = (tables.write_table(spark.range(2), f"file://{tmp_path}/out", "r") for _ in range(2))
    assert one != two and spark.read.csv(two, header=True).count() == 2


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = streams.windowed(streams.event_stream(spark, f"file://{tmp_path}/in", 10), late="100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in streams.windowed(events).collect()}


def test_unify_and_scales(spark):
    rows = spark.createDataFrame([(1, ["压力", "加班。"]), (2, ["【压力】"]), (3, ["压力"]), (4, [])], "no long, codes array<string>")
    got = {r["no"]: r["codes"] for r in coding.unify_labels(rows, "codes").collect()}
    assert got == {1: ["压力", "加班。"], 2: ["压力"], 3: ["压力"], 4: []}
    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    items = np.clip(np.round(3 + base[:, None] + rng.normal(0, 0.7, (200, 4))), 1, 5)
    df = frame(spark, [tuple(map(float, r)) for r in items], "S_1 double, S_2 double, S_3 double, S_4 double")
    assert factor.by_scale(df, parallel=False)["S"]["factors"] == 1


def test_draw_categories_many_levels(spark):
    rows = [(i, f"v{i:05d}" if i < 3000 else None) for i in range(6000)]
    got = impute.draw_categories(spark.createDataFrame(rows, "id long, c string"), "id", "c").toPandas()
    assert len(got) == 6000 and list(got.columns) == ["id", "c"] and got["c"].notna().all()
    drawn = got[got["id"] >= 3000]["c"].str[1:].astype(int)
    assert (drawn >= 1000).mean() == pytest.approx(2 / 3, abs=0.05)


def test_person_matrix_is_checked(spark):
    rows = spark.range(1001).select(F.array(F.lit("a")).alias("codes"), F.col("id").cast("string").alias("speaker"), F.col("id").alias("no"))
    with pytest.raises(ValueError, match="speakers"):
        coding.person_matrix(rows, "codes")
    assert coding.person_labels(rows, "codes").count() == 1001
    assert len(coding.person_matrix(rows.limit(1000), "codes").columns) == 1001
