"""Many words at once against plain loops, and the rules that use them."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import coding, deident, matching


def plain_spans(words, text):
    """Left to right, the longest at each place."""
    out, at = [], 0
    while at < len(text):
        fit = max((w for w in words if w and text.startswith(w, at)), key=len, default="")
        if fit:
            out.append((at, at + len(fit)))
        at += len(fit) or 1
    return out


def test_spans_and_occurrences(spark, monkeypatch):
    rng = random.Random(3)
    symbols = "ab王é😀 "
    words = list({"".join(rng.choice(symbols) for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randrange(80))) for _ in range(200)] + ["", "a" * 5000]
    found = matching.automaton([*words, ""])
    for t in texts:
        assert matching.spans(found, t) == plain_spans(words, t)
        new = {w: f"<{w}>" for w in words}
        want, at = "", 0
        for a, b in plain_spans(words, t):
            want, at = want + t[at:a] + f"<{t[a:b]}>", b
        assert matching.put_in(found, new, t) == want + t[at:]
    assert matching.spans(matching.automaton([]), "x") == [] and matching.put_in(matching.automaton([]), {}, "x") == "x"
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "`no.` long, text string").repartition(3)
    lexicon = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "word string")
    want = {(i, w): sum(t.startswith(w, k) for k in range(len(t))) for i, t in enumerate(texts) for w in words}
    want = {k: n for k, n in want.items() if n}
    for most in (matching.MOST_CHARACTERS, 50):
        monkeypatch.setattr(matching, "MOST_CHARACTERS", most)
        assert {(r[0], r[1]): r[2] for r in matching.occurrences(docs, lexicon, ["no."]).collect()} == want
    assert matching.occurrences(docs, lexicon.limit(0), ["no."]).count() == 0


def test_keywords_of_any_script(spark):
    units = spark.createDataFrame([(1, "人工智能实验室用大数据平台的API"), (2, "API和SDK，人工智能"), (3, None)], "no long, text string")
    words = spark.createDataFrame([("人工智能实验室",), ("人工智能",), ("大数据平台",), ("API",), ("SDK",), ("无",)], "word string")
    got = {r["word"]: (r["n_segments"], r["n"]) for r in coding.keyword_hits(units, words, ["no"]).collect()}
    assert got == {"人工智能实验室": (1, 1), "人工智能": (1, 1), "大数据平台": (1, 1), "API": (2, 2), "SDK": (1, 1)}


def test_replaced_places_never_overlap(spark):
    docs = spark.createDataFrame([(1, "张伟明和张伟，张伟明天"), (2, "x"), (3, None)], "doc_id long, text string")
    mapping = spark.createDataFrame([(1, "张伟", "[姓名1]"), (1, "张伟明", "[姓名2]"), (1, "姓名1", "!"), (3, "y", "z")], "doc_id long, value string, placeholder string")
    got = {r.doc_id: r.text for r in deident.replaced(docs, mapping).collect()}
    assert got == {1: "[姓名2]和[姓名1]，[姓名2]天", 2: "x", 3: None}


@pytest.mark.parametrize("text", ["我同学叫张伟", "叫李雷", "他姓欧阳", "我姓庞统", "名字：Alice", "室友名叫翟天临，很好", "司马光老师", "R01 阮小明 男 19岁", "上官婉儿：在", "诸葛亮提到：好"])
def test_names_behind_clues(spark, text):
    out, mapping = deident.deidentify(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    if text == "他姓欧阳":  # a family name alone
        return
    names = [r.value for r in mapping.where("kind = '姓名'").collect()]
    assert len(names) == 1 and names[0] not in out.first()["text"]


@pytest.mark.parametrize("text", ["时长：41 分钟", "我爸妈都是老师", "这种基本都是他", "安排：看书", "关系：朋友", "单位：学校"])
def test_no_names(spark, text):
    assert deident.deidentify(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()["text"] == text


def test_rules_act(spark):
    docs = spark.createDataFrame([(1, "晓晓 13700002222\n群 13900001111 微信群"), (2, "甲 13700002222 女 杭州\n乙 13700003333 男 苏州\n丙 13700004444 女"), (3, "晓晓晓晓")], "doc_id long, text string")

    def done(rules):
        return {r.doc_id: r.text for r in deident.deidentify(docs, rules=rules)[0].collect()}

    assert "[QQ1]" in done("!这是QQ 13700002222 = ")[1] and "[手机" in done("!这是手机 13700002222")[1]
    kept = done("!不用管 13700002222")
    assert "13700002222" in kept[1] and "13700002222" in kept[2] and "[手机1]" in kept[1] and "13700003333" not in kept[2]
    assert done("晓晓 = [受访者A]\n群 =")[1].startswith("[受访者A] [手机1]\n [手机2] 微信") and done("晓晓 = [受访者A]")[3] == "[受访者A][受访者A]"
    placed = done("!第1段是姓名\n!第2段不用管")
    assert placed[2] == "[姓名1] 13700002222 女 杭州\n[姓名2] 13700003333 男 苏州\n丙 [手机1] 女"
    for bad in ("!什么 x", "!第0段是手机", "!这是猫 x", "no rule", "= x"):
        with pytest.raises(ValueError, match="nothing can carry out"):
            deident.deidentify(docs, rules=bad)
    with pytest.raises(ValueError, match="deidentify"):
        deident.apply_rules(docs, "!第1段是姓名")
    got = {r.text: r.n for r in deident.apply_rules(docs.where("doc_id = 3"), "晓 = y\n晓晓晓 = z\n!不用管 晓晓", count="n").collect()}
    assert got == {"zy": 2}
    hits = {r.rule: (r.n_docs, r.n) for r in deident.rule_hits(docs, "晓晓 = a\n没有 = b\n!不用管 13700002222").collect()}
    assert hits == {"晓晓": (2, 4), "没有": (0, 0), "13700002222": (2, 2)}
    assert deident.apply_rules(docs, "a = b").columns == docs.columns and docs.select(F.col("text")).count() == 3
