"""Screening questions and the answers of gates, against plain loops."""

import random

from pyspark.sql import functions as F

from fieldmark.plans import screening

RULES = {"screener.max_questions": 2, "screener.screenout_signals": ["同行", "竞品"], "screener.binary_signals": ["是/否"], "screener.none_answer_signals": ["以上都不是"], "strategy.goal_signals": {"feature": ["功能", "Feature"]}, "strategy.priority_frameworks": [{"framework": "KANO"}]}


def test_screeners(spark):
    forms = [
        (1, 1, "年龄", "单选：18-24 / 25-30"),
        (2, 1, "恋爱状态", "从未恋爱 / 恋爱中"),
        (3, 1, "筛选A", "最近用过哪几个"), (3, 2, "筛选B", "是否在同行工作"), (3, 3, "筛选C", "是/否"),
        (4, 1, "筛选1 竞品", "以上都不是"),
        (5, 1, "筛选1", "以上都不是 / 其他（请注明）"),
        (6, 1, None, None),
    ]
    got = screening.check_screener(spark.createDataFrame(forms, "doc_id long, place int, name string, how string").repartition(3), RULES)
    assert {(r.doc_id, r.check, r.found) for r in got.collect()} == {(1, "none", ""), (2, "gate", "恋爱状态"), (3, "many", "3"), (3, "late", "筛选B"), (3, "binary", "是/否"), (4, "no_way_out", "以上都不是"), (6, "none", "")}
    assert screening.check_priorities("想看新功能", RULES) == [{"check": "priorities", "found": "feature", "frameworks": ["KANO"]}] and not screening.check_priorities("x", RULES)


def test_intervals(spark):
    cases = {"18-24 岁": (18, 24), "24～18": (18, 24), "18岁以下": (float("-inf"), 18), "不到18": (float("-inf"), 17), "3 次": (3, 3), "5次及以上": (5, float("inf")), "超过 35": (36, float("inf")), "0–25%": (0, 25), "≥1.5": (1.5, float("inf")), "从未": None, "2年至3年": (2, 3)}
    df = spark.createDataFrame([(x,) for x in cases], "a string").select("a", screening.interval(F.col("a")).alias("i"))
    assert {r.a: tuple(r.i) if r.i else None for r in df.collect()} == cases


def test_gate_faults(spark):
    """Random answers over 0 to 30: amounts between the answers that none or several cover."""
    rng = random.Random(6)
    rows, want = [], {}
    for q in range(200):
        spans = [tuple(sorted((rng.randrange(30), rng.randrange(30)))) for _ in range(rng.randrange(6))]
        rows.append((q, "x", [f"{a}-{b}岁" for a, b in spans] + ["不清楚"]))
        cover = {n: sum(a <= n <= b for a, b in spans) for n in range(31)}
        inside = [n for n in cover if spans and min(a for a, _ in spans) <= n <= max(b for _, b in spans)]
        want[q] = ({n for n in inside if cover[n] == 0}, {n for n in inside if cover[n] > 1})
    got = screening.gate_faults(spark.createDataFrame(rows, "doc_id long, `na.me` string, options array<string>"), ["doc_id", "na.me"]).collect()
    for q, (gaps, overlaps) in want.items():
        own = [r for r in got if r.doc_id == q]
        assert {n for r in own if r.fault == "gap" for n in range(int(r.low), int(r.high) + 1)} == gaps
        assert {n for r in own if r.fault == "overlap" for n in range(int(r.low), int(r.high) + 1)} == overlaps
