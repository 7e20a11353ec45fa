"""Which procedure a question gets, as tables; and what kind of question a text asks."""

from __future__ import annotations

# Procedures by number of groups, normality and equal variances.
COMPARE = {
    (2, True, True): "t",
    (2, True, False): "welch",
    (2, False, True): "mannwhitney",
    (2, False, False): "mannwhitney",
    (3, True, True): "anova",
    (3, True, False): "anova_welch",
    (3, False, True): "kruskal",
    (3, False, False): "kruskal",
}
# Words that name a kind of question, in the order in which kinds are tried.
QUESTION_WORDS = {
    "within": ("前后测", "前测", "后测", "配对", "同一批人", "干预前", "干预后", "两个时间点", "重复测量", "before", "after"),
    "assoc": ("交叉表", "卡方", "两个分类", "分类变量", "两类", "占比", "分布"),
    "compare": ("不一样", "有差异", "更高", "更低", "多于", "少于", "差别", "比一", "相比", "哪个更", "谁更", "组间", "区分", "是不是更", "更倾向于", "更愿意", "更倾向"),
    "relate": ("相关", "有关系", "影响", "预测", "能解释", "关联", "越高", "越多", "有没有关系"),
    "describe": ("了解", "看看", "现状", "长什么样", "描述"),
}


def pick_compare(k: int, all_normal: bool = True, equal_var: bool = True) -> str:
    return COMPARE[min(k, 3), bool(all_normal), bool(equal_var)]


def override_compare(k: int, want: str | None) -> str | None:
    """The wanted procedure if it fits the number of groups."""
    return want if want in {m for (n, _, _), m in COMPARE.items() if n == min(k, 3)} else None


def truth_table() -> list[tuple[int, bool, bool, str]]:
    return [(*key, m) for key, m in COMPARE.items()]


def pick_within(two_columns: bool = True, diff_normal: bool = True, zero_share: float | None = None) -> dict:
    """Procedure for paired values, by the normality of the differences; a fifth of zeros warns."""
    method = ("paired_t" if diff_normal else "wilcoxon") if two_columns else "one_t"
    return {"method": method, "many_ties": bool(zero_share is not None and zero_share > 0.2)}


def pick_relate(n_iv: int = 1, normal_xy: bool = True, categorical_iv: bool = False, binary_dv: bool = False) -> str:
    if binary_dv:
        return "logistic"
    if n_iv > 1 or categorical_iv:
        return "ols"
    return "pearson" if normal_xy else "spearman"


def pick_partial(n_controls: int = 1, normal: bool = True) -> str:
    return "partial" if n_controls else ("pearson" if normal else "spearman")


def pick_assoc(levels_a: int, levels_b: int, small_share: float | None = None) -> dict:
    """Chi-squared; with more than a fifth of small expectations an exact test is advised."""
    small = bool(small_share is not None and small_share > 0.2)
    return {"method": "chi2", "advice": ("fisher" if levels_a == levels_b == 2 else "merge levels") if small else None}


def pick_mediated(mediator: bool = False, moderator: bool = False, n: int | None = None) -> dict:
    method = "moderated mediation" if mediator and moderator else "mediation" if mediator else "moderation" if moderator else "ols"
    least = {"mediation": 20, "moderation": 30}.get(method, 0)
    return {"method": method, "enough": n is None or n >= least}


def guess_kind(text: str) -> str | None:
    """The first kind of question one of whose words the text holds."""
    low = (text or "").lower()
    return next((kind for kind, words in QUESTION_WORDS.items() if any(w in low for w in words)), None)


def pick(kind: str, **facts) -> dict:
    """One entry for all kinds of question."""
    if kind == "compare":
        return {"method": pick_compare(facts.get("k", 2), facts.get("all_normal", True), facts.get("equal_var", True))}
    if kind == "within":
        return pick_within(facts.get("two_columns", True), facts.get("diff_normal", True), facts.get("zero_share"))
    if kind == "assoc":
        return pick_assoc(facts.get("levels_a", 0), facts.get("levels_b", 0), facts.get("small_share"))
    if kind == "causal":
        return pick_mediated(facts.get("mediator", False), facts.get("moderator", False), facts.get("n"))
    if kind == "relate":
        if facts.get("n_controls"):
            return {"method": pick_partial(facts["n_controls"], facts.get("normal_xy", True))}
        return {"method": pick_relate(facts.get("n_iv", 1), facts.get("normal_xy", True), facts.get("categorical_iv", False), facts.get("binary_dv", False))}
    return {"method": "describe"}


def route(dv: str | None, group: str | None, ivs: list[str], mediator: str | None = None, moderator: str | None = None, intent: str = "") -> str:
    """The question a filled form asks; the intent's words count only if the form is empty."""
    if group:
        return "compare"
    if mediator or moderator:
        return "causal"
    if dv and ivs:
        return "relate"
    if len(ivs) >= 2:
        return "assoc"
    return guess_kind(intent) or "describe"


def data_bounds(intent: str, entries: list[dict]) -> tuple[list[dict], list[str]]:
    """Rules whose trigger words the intent holds, and the ids of incomplete rules.

    Each rule needs ``id, triggers, needs, gives, fallback, why``.
    """
    need = ("id", "triggers", "needs", "gives", "fallback", "why")
    broken = [str(e.get("id", "?")) for e in entries if not all(e.get(k) for k in need)]
    hit = [e for e in entries if all(e.get(k) for k in need) and any(t in intent for t in e["triggers"])]
    return hit, broken
