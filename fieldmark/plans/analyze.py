"""From a question to results: profile, plan, statistics, finish."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import col, number
from fieldmark.operators import compare, mediate, profile, regress
from fieldmark.plans.methods import guess_kind, pick, pick_relate, route


@dataclass
class Spec:
    """What is asked: columns by role, an intent in words, and policies for open choices."""

    dv: str | None = None
    group: str | None = None
    ivs: list[str] = field(default_factory=list)
    controls: list[str] = field(default_factory=list)
    mediator: str | None = None
    moderator: str | None = None
    second: str | None = None
    intent: str = ""
    alpha: float = 0.05
    policy: str = "nonparam"
    method: str | None = None


@dataclass
class Result:
    question: str
    method: str | None
    values: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def analyze(df: DataFrame, spec: Spec) -> Result:
    """The procedure that the spec asks for, on only the columns that it names."""
    named = [c for c in (spec.dv, spec.group, spec.mediator, spec.moderator, spec.second, *spec.ivs, *spec.controls) if c]
    missing = [c for c in named if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    df = df.select(*[col(c) for c in dict.fromkeys(named)]) if named else df
    if not named and guess_kind(spec.intent) == "assoc":
        # no variables named: the first two categorical columns
        two = [k.name for k in profile.kinds(df) if k.kind == "categorical"][:2]
        if len(two) < 2:
            raise ValueError("fewer than two categorical columns")
        spec = replace(spec, ivs=two)
        df = df.select(*map(col, two))
    question = "within" if spec.second else route(spec.dv, spec.group, spec.ivs, spec.mediator, spec.moderator, spec.intent)
    if question == "within":
        out = compare.within(df, spec.dv, spec.second, spec.alpha)
        return Result(question, out["method"], out)
    if question == "compare":
        out = compare.compare(df, spec.group, spec.dv, spec.alpha, spec.policy, spec.method)
        return Result(question, out["method"], out, {"groups": compare.group_table(df, spec.group, spec.dv, spec.alpha), "box": compare.box_stats(df, spec.group, spec.dv)})
    if question == "causal":
        if spec.mediator:
            out = mediate.mediation(df, spec.ivs[0], spec.mediator, spec.dv, tuple(spec.controls), spec.alpha)
            return Result(question, "mediation", out)
        return Result(question, "moderation", mediate.moderation(df, spec.ivs[0], spec.moderator, spec.dv, tuple(spec.controls), spec.alpha))
    if question == "assoc":
        out = profile.chi_square(df, *spec.ivs[:2])
        advice = pick("assoc", small_share=out["share_expected_lt5"])["advice"]
        return Result(question, "chi2", out, {"cells": profile.cross_table(df, *spec.ivs[:2])}, [f"small expected counts: {advice}"] if advice else [])
    if question == "relate":
        return _relate(df, spec)
    return Result("describe", "describe", {}, {"profile": profile.profile(df)})


def _relate(df: DataFrame, spec: Spec) -> Result:
    kinds = {k.name: k for k in profile.kinds(df)}
    words = tuple(c for c in spec.ivs if kinds[c].kind in ("categorical", "text") and not kinds[c].ordinal and df.schema[c].dataType.simpleString() == "string")
    dv = kinds[spec.dv]
    binary = dv.distinct == 2 and dv.kind == "categorical"
    if spec.controls:
        return Result("relate", "partial", regress.partial(df, spec.ivs[0], spec.dv, spec.controls, spec.alpha))
    method = spec.method or pick_relate(len(spec.ivs), True, bool(words), binary)
    if method in ("pearson", "spearman"):
        pair = df.select(number(col(spec.ivs[0])).alias("x"), number(col(spec.dv)).alias("y")).dropna()
        fine = compare.normal(pair.select("x"), spec.alpha) is not False and compare.normal(pair.select("y"), spec.alpha) is not False
        method = spec.method or ("pearson" if fine else "spearman")
        table = regress.correlations(df, spec.ivs[0], spec.dv, method, spec.alpha)
        return Result("relate", method, {r["coefficient"]: r["value"] for r in table.collect()}, {"coefficients": table})
    if method == "logistic":
        from fieldmark.functions.columns import encode_binary

        coded = df.withColumn("_y", encode_binary(df, spec.dv))
        fit = regress.logistic(coded, "_y", spec.ivs, words, spec.alpha)
        seen = regress.with_probability(coded, fit, "_y", spec.ivs, words)
        bins, test = regress.hosmer_lemeshow(seen)
        return Result("relate", method, fit | {"classification": regress.classification(seen), "hosmer_lemeshow": test}, {"bins": bins})
    found = regress.diagnostics(df, spec.dv, spec.ivs, words, None, spec.alpha)
    turned = regress.sensitivity(df, spec.dv, spec.ivs, words, spec.alpha)
    notes = ["the conclusion turns without influential rows"] if turned["turned"] else []
    return Result("relate", "ols", found | {"sensitivity": turned}, {}, notes)


def introspect(df: DataFrame) -> DataFrame:
    """``name, kind, n_unique`` of every column."""
    return profile.profile(df).select("name", "kind", F.col("n_unique"))
