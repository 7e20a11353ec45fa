"""Checks of questions that let people into a study: how many there are, how they are put, and
whether the answers of a gate leave gaps or overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import col
from fieldmark.plans.rules import group

# What names a screening question, what a gate asks for, and answers that keep people out.
SCREENS = "筛"
GATE_NAMES = ("状态", "经历", "经验", "身份", "是否", "有无", "使用过", "接触过")
GATE_ANSWERS = ("从未", "没有", "无", "从不", "使用过", "用过", "接触过", "不确定")
OTHER_WAYS = ("其他", "请注明")

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def _holds(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The words that a text holds."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.instr(text, w) > 0) if words else F.array().cast("array<string>")


def check_screener(items: DataFrame, rules: dict, id: str = "doc_id", place: str = "place", name: str = "name", text: str = "how") -> DataFrame:
    """``id, check, found`` of forms that are meant to screen; ``found`` says by what.

    ``none``: neither a screening question nor one that works as a gate; ``gate``: only the
    latter, which may do; ``many``: more than the rules' ``max_questions``; ``late``: a
    screening question that sends people away (``screenout_signals``) behind another one;
    ``binary``: a yes-or-no wording (``binary_signals``); ``no_way_out``: ``none_answer_signals``
    without another answer. Forms are grouped, so any number is checked at once.
    """
    own = group(rules, "screener")
    n, words = F.coalesce(col(name), F.lit("")), F.coalesce(col(text), F.lit(""))
    screens = F.instr(n, SCREENS) > 0
    gate = (F.size(_holds(n, GATE_NAMES)) > 0) & words.rlike("[/／、]") & (F.size(_holds(words, GATE_ANSWERS)) > 0)
    rows = items.select(col(id).alias("id"), col(place).alias("place"), n.alias("name"), words.alias("text"), screens.alias("screens"), gate.alias("gate"))
    nth = F.row_number().over(Window.partitionBy("id", "screens").orderBy("place", "name"))
    both = F.concat_ws(" ", "name", "text")
    rows = rows.withColumn("nth", nth).withColumn("out", F.size(_holds(both, own.get("screenout_signals", []))) > 0)
    forms = rows.groupBy("id").agg(
        F.count_if("screens").alias("n"),
        F.min_by("name", F.when(F.col("gate"), F.struct("place", "name"))).alias("gate"),
        F.min(F.when(F.col("screens") & F.col("out") & (F.col("nth") > 1), F.struct("nth", "name"))).alias("late"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("screens"), both))), "\n").alias("said"),
    )
    binary, none = _holds(F.col("said"), own.get("binary_signals", [])), _holds(F.col("said"), own.get("none_answer_signals", []))
    most = int(own.get("max_questions") or 4)
    found = {
        "none": F.when((F.col("n") == 0) & F.col("gate").isNull(), F.lit("")),
        "gate": F.when((F.col("n") == 0) & F.col("gate").isNotNull(), F.col("gate")),
        "many": F.when(F.col("n") > most, F.col("n").cast("string")),
        "late": F.when(F.col("late").isNotNull(), F.col("late.name")),
        "binary": F.when(F.size(binary) > 0, F.array_join(binary, "、")),
        "no_way_out": F.when((F.size(none) > 0) & (F.size(_holds(F.col("said"), OTHER_WAYS)) == 0), F.array_join(none, "、")),
    }
    every = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("found")) for k, c in found.items()])
    return forms.select(F.col("id").alias(id), F.explode(F.filter(every, lambda x: x["found"].isNotNull())).alias("x")).select(id, "x.check", "x.found")


def interval(answer: Column, step: float = 1.0) -> Column:
    """``low, high`` of an answer about an amount, ends included; null where it names none.

    A range, "A and less", "less than A", "A and more", "more than A" or one number; ``step`` is
    the least difference of two amounts.
    """
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s", "")
    span = rf"{NUMBER}[^0-9.]{{0,3}}[-–—~～至到]{NUMBER}"
    a, b = (F.regexp_extract(text, span, k).try_cast("double") for k in (1, 2))
    one = F.regexp_extract(text, NUMBER, 1).try_cast("double")
    inf = F.lit(float("inf"))
    low = (
        F.when(text.rlike(span), F.least(a, b)).when(text.rlike("以下|以内|不超过|至多|[≤]|不到|低于|少于|小于|未满|[<＜]"), -inf)
        .when(text.rlike("超过|大于|多于|高于|[>＞]"), one + step).otherwise(one)
    )
    high = (
        F.when(text.rlike(span), F.greatest(a, b)).when(text.rlike("以下|以内|不超过|至多|[≤]"), one).when(text.rlike("不到|低于|少于|小于|未满|[<＜]"), one - step)
        .when(text.rlike("以上|起|至少|[≥+]|超过|大于|多于|高于|[>＞]"), inf).otherwise(one)
    )
    return F.when(one.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def gate_faults(items: DataFrame, keys: list[str], answers: str = "options", step: float = 1.0) -> DataFrame:
    """``keys, fault, low, high``: amounts between two answers of a question that none covers (``gap``)
    and those that two cover (``overlap``), ends included.

    Answers are swept in the order of their lower ends, each question by itself; those
    without an amount are left out, and so is what lies outside all answers.
    """
    rows = items.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.posexplode(col(answers)).alias("n", "answer"))
    rows = rows.withColumn("i", interval(F.col("answer"), step)).where("i is not null and i.low <= i.high").select(*[f"k{i}" for i in range(len(keys))], "n", "i.low", "i.high")
    before = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("low", "high", "n").rowsBetween(Window.unboundedPreceding, -1)
    swept = rows.withColumn("reach", F.max("high").over(before)).where("reach is not null")
    gap = F.when(F.col("low") > F.col("reach") + step, F.struct(F.lit("gap").alias("fault"), (F.col("reach") + step).alias("low"), (F.col("low") - step).alias("high")))
    overlap = F.when(F.col("low") <= F.col("reach"), F.struct(F.lit("overlap").alias("fault"), F.col("low").alias("low"), F.least("reach", "high").alias("high")))
    found = swept.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.coalesce(gap, overlap).alias("f")).where("f is not null")
    return found.select(*[col(k) for k in keys], "f.fault", "f.low", "f.high").distinct()


def check_priorities(study: str, rules: dict) -> list[dict]:
    """A study whose goal the rules know (``strategy.goal_signals``), and the frameworks by which its
    conclusions could be ranked, to be chosen before the analysis."""
    own, low = group(rules, "strategy"), study.lower()
    goal = next((g for g, words in (own.get("goal_signals") or {}).items() if any(w.lower() in low for w in words)), None)
    return [{"check": "priorities", "found": goal, "frameworks": [f.get("framework") for f in own.get("priority_frameworks") or []]}] if goal else []
