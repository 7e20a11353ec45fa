"""Correlation and regression from shared cross products.

A design is a mapping of names to numeric columns. Linear algebra on the driver sees
only matrices of the size of the design; everything over rows stays in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import dist
from fieldmark.functions.columns import col, dummies, number, number_of
from fieldmark.operators.gram import Gram, gram
from fieldmark.operators.ranks import kendall, with_ranks

# Conventional limits of the diagnostics.
VIF_WATCH, VIF_SERIOUS, DW_LOW, DW_HIGH, COOK_STRONG = 5.0, 10.0, 1.5, 2.5, 1.0
IRLS_ITERATIONS, IRLS_TOLERANCE = 100, 1e-10


def design(df: DataFrame, columns: list[str], categorical: tuple[str, ...] = ()) -> dict[str, Column]:
    """Numeric columns as scores (ordinal ones too), categorical ones as indicators."""
    out: dict[str, Column] = {}
    for c in columns:
        out |= dummies(df, c) if c in categorical else {c: number_of(df, c)}
    return out


def fisher_interval(r: float, n: float, alpha: float = 0.05) -> tuple[float | None, float | None]:
    if n < 4 or abs(r) >= 1:
        return None, None
    z, half = math.atanh(r), dist.norm_ppf(1 - alpha / 2) / math.sqrt(n - 3)
    return math.tanh(z - half), math.tanh(z + half)


def r_test(r: float, df: float) -> float:
    return 0.0 if abs(r) >= 1 else dist.t_sf2(r * math.sqrt(df / (1 - r * r)), df)


def correlations(df: DataFrame, x: str, y: str, primary: str = "pearson", alpha: float = 0.05) -> DataFrame:
    """Pearson, Spearman and Kendall side by side, one of them marked as primary."""
    pair = df.select(number(col(x)).alias("x"), number(col(y)).alias("y")).dropna()
    ranked = with_ranks(pair, ["x", "y"])
    n, rp, rs = ranked.agg(F.count("*"), F.corr("x", "y"), F.corr("rank_x", "rank_y")).first()
    tau = kendall(pair, "x", "y")
    rows = []
    for name, r in (("pearson", rp), ("spearman", rs)):
        low, high = fisher_interval(r, n, alpha) if r is not None else (None, None)
        rows.append((name, n, r, r_test(r, n - 2) if r is not None and n > 2 else None, low, high, name == primary))
    rows.append(("kendall", n, tau["tau"], tau["p"], None, None, primary == "kendall"))
    return df.sparkSession.createDataFrame(rows, "coefficient string, n long, value double, p double, ci_low double, ci_high double, is_primary boolean")


def bends(pearson: float, spearman: float, gap: float = 0.15) -> bool:
    """Whether ranks agree so much better than values that the relation looks curved."""
    return pearson * spearman < 0 or abs(spearman) - abs(pearson) >= gap


def partial(df: DataFrame, x: str, y: str, controls: list[str], alpha: float = 0.05) -> dict:
    """Partial correlation from the inverse correlation matrix; n - 2 - k degrees of freedom."""
    names = [x, y, *controls]
    g = gram(df, {c: number(col(c)) for c in names})
    p = np.linalg.pinv(g.corr())
    r = float(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))
    dof = g.n - 2 - len(controls)
    low, high = fisher_interval(r, dof + 2, alpha)
    return {"n": int(g.n), "r": r, "df": int(dof), "p": r_test(r, dof), "ci_low": low, "ci_high": high}


def solve(g: Gram, y: str, xs: list[str], alpha: float = 0.05) -> dict:
    """Least squares with an intercept, from cross products alone."""
    s = g.sub([*xs, y])
    raw = s.raw()
    xx, xy = raw[:-1, :-1], raw[:-1, -1]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    b = beta[1:]
    cross, total = s.cross[:-1, -1], s.cross[-1, -1]
    rss = max(0.0, float(total - 2 * b @ cross + b @ s.cross[:-1, :-1] @ b))
    k = len(beta)
    dof = s.n - k
    mse = rss / dof if dof > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse) * mse, 0))
    sd = np.sqrt(np.diag(s.cross) / (s.n - 1))
    t_crit = dist.t_ppf(1 - alpha / 2, dof) if dof > 0 else math.nan
    r2 = 1 - rss / total if total > 0 else math.nan
    f = (r2 / (k - 1)) / ((1 - r2) / dof) if k > 1 and r2 < 1 and dof > 0 else math.nan
    rows = []
    for j, name in enumerate(["(intercept)", *xs]):
        t = beta[j] / se[j] if se[j] > 0 else math.nan
        rows.append({"name": name, "b": float(beta[j]), "se": float(se[j]), "t": float(t), "p": dist.t_sf2(t, dof) if t == t else None, "ci_low": float(beta[j] - t_crit * se[j]), "ci_high": float(beta[j] + t_crit * se[j]), "beta": float(beta[j] * sd[j - 1] / sd[-1]) if j and sd[-1] > 0 else None})
    return {"n": int(s.n), "k": k, "df": int(dof), "coefficients": rows, "r2": r2, "adj_r2": 1 - (1 - r2) * (s.n - 1) / dof if dof > 0 else None, "f": f, "f_p": dist.f_sf(f, k - 1, dof) if f == f else None, "mse": mse, "rss": rss, "inverse": inverse, "mean": dict(zip(s.names, s.mean.tolist(), strict=True))}


def ols(df: DataFrame, y: str, xs: list[str], categorical: tuple[str, ...] = (), alpha: float = 0.05) -> dict:
    cols = design(df, xs, categorical)
    return solve(gram(df, cols | {y: number_of(df, y)}), y, list(cols), alpha)


def vif(g: Gram, xs: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    if len(xs) < 2:
        return dict.fromkeys(xs, 1.0)
    return dict(zip(xs, np.diag(np.linalg.pinv(g.sub(xs).corr())).tolist(), strict=True))


def with_influence(df: DataFrame, fit: dict, cols: dict[str, Column], y: Column, keep: list[str]) -> DataFrame:
    """Complete rows with ``fitted, residual, leverage, cook``: expressions of the small inverse."""
    at = {f"x{k}": c for k, c in enumerate(cols.values())}
    rows = df.select(*[col(c) for c in keep], y.alias("y_"), *[c.alias(a) for a, c in at.items()]).dropna(subset=["y_", *at])
    x = [F.lit(1.0), *[F.col(a) for a in at]]
    beta = [r["b"] for r in fit["coefficients"]]
    inverse, k = fit["inverse"], len(x)
    fitted = sum((F.lit(b) * v for b, v in zip(beta[1:], x[1:], strict=True)), F.lit(beta[0]))
    lever = sum((F.lit(float(inverse[i, j]) * (1 if i == j else 2)) * x[i] * x[j] for i in range(k) for j in range(i, k)), F.lit(0.0))
    rows = rows.withColumn("fitted", fitted).withColumn("leverage", lever).withColumn("residual", F.col("y_") - F.col("fitted"))
    h = F.col("leverage")
    cook = F.col("residual") ** 2 / F.lit(k * fit["mse"]) * h / F.when(h < 1, (1 - h) ** 2)
    return rows.withColumn("cook", cook)


def diagnostics(df: DataFrame, y: str, xs: list[str], categorical: tuple[str, ...] = (), row_order: str | None = None, alpha: float = 0.05) -> dict:
    """VIF, influence counts, Breusch-Pagan, Durbin-Watson and residual normality.

    Durbin-Watson needs the order of rows, so it is given only with ``row_order``.
    """
    cols, target = design(df, xs, categorical), number_of(df, y)
    g = gram(df, cols | {y: target})
    fit = solve(g, y, list(cols), alpha)
    rows = with_influence(df, fit, cols, target, [row_order] if row_order else [])
    flag = 4 / fit["n"]
    n_flag, n_strong, top = rows.agg(F.count_if(F.col("cook") > flag), F.count_if(F.col("cook") > COOK_STRONG), F.max("cook")).first()
    squared = {c: F.col(f"x{k}") for k, c in enumerate(cols)} | {"e2": F.col("residual") ** 2}
    near = dict(zip(cols, g.mean, strict=False)) | {"e2": fit["rss"] / fit["n"]}
    lm = fit["n"] * solve(gram(rows, squared, centre=near), "e2", list(cols))["r2"]
    out = {"fit": fit, "vif": vif(g, list(cols)), "cook_flag": flag, "n_cook_flag": n_flag, "n_cook_strong": n_strong, "cook_max": top, "bp": lm, "bp_p": dist.chi2_sf(lm, len(cols)) if lm == lm else None}
    if row_order:
        out["dw"] = durbin_watson(rows, row_order)
    if 4 <= fit["n"] <= 5000:
        out["shapiro_w"], out["shapiro_p"] = dist.shapiro(np.array([r[0] for r in rows.select("residual").collect()]))
    return out


def durbin_watson(rows: DataFrame, order: str) -> float:
    """Sum of squared steps over sum of squares of ``residual`` in row order; rows of equal
    order stand by their residuals.

    The order is cut into ranges; each range is sorted once and steps alone, and the steps
    between ranges come from their first and last rows.
    """
    dealt = rows.select(col(order).alias("o"), "residual").repartitionByRange("o", "residual").sortWithinPartitions("o", "residual")

    def run(batches):
        part = first = last = None
        s = q = 0.0
        for pdf in batches:
            e = pdf["residual"].to_numpy()
            if not len(e):
                continue
            if part is None:
                part, first, last = int(pdf["part"].iloc[0]), e[0], e[0]
            s, q, last = s + float(np.sum(np.diff(e, prepend=last) ** 2)), q + float(np.sum(e**2)), e[-1]
        if part is not None:
            yield pd.DataFrame({"part": [part], "s": [s], "q": [q], "first": [first], "last": [last]})

    ends = dealt.select(F.spark_partition_id().alias("part"), "residual").mapInPandas(run, "part int, s double, q double, first double, last double")
    over = Window.orderBy("part")  # one row per range
    s, q, between = ends.withColumn("gap", F.col("first") - F.lag("last").over(over)).agg(F.sum("s"), F.sum("q"), F.sum(F.col("gap") ** 2)).first()
    return ((s or 0.0) + (between or 0.0)) / q if q else math.nan


def sensitivity(df: DataFrame, y: str, xs: list[str], categorical: tuple[str, ...] = (), alpha: float = 0.05, full: dict | None = None) -> dict:
    """The fit with and without rows of a Cook's distance over 4/n, and whether the
    conclusion turns: significance flips, R2 moves by 0.10, or (one predictor) r by 0.15.

    ``full``: the fit with all rows, where ``ols`` or ``diagnostics`` has given it already.
    """
    cols, target = design(df, xs, categorical), number_of(df, y)
    full = full or solve(gram(df, cols | {y: target}), y, list(cols), alpha)
    rows = with_influence(df, full, cols, target, [])
    flagged = F.col("cook") > 4 / full["n"]
    names = {c: F.col(f"x{k}") for k, c in enumerate(cols)} | {y: F.col("y_")}
    less = solve(gram(rows.where(~F.coalesce(flagged, F.lit(False))), names, centre=full["mean"]), y, list(cols), alpha)
    n_flag = full["n"] - less["n"]
    a, b = full["coefficients"][1], less["coefficients"][1]
    turned = (a["p"] < alpha) != (b["p"] < alpha) or abs(full["r2"] - less["r2"]) >= 0.10
    if len(cols) == 1:
        ra, rb = (math.copysign(math.sqrt(max(0.0, f["r2"])), f["coefficients"][1]["b"]) for f in (full, less))
        turned = turned or abs(ra - rb) >= 0.15
    return {"n_flagged": n_flag, "full": full, "without": less, "turned": turned}


def logistic(df: DataFrame, y: str, xs: list[str], categorical: tuple[str, ...] = (), alpha: float = 0.05) -> dict:
    """Binary logistic regression by reweighted least squares; ``y`` holds 0 and 1.

    Each iteration is one aggregation of the weighted cross products.
    """
    cols = design(df, xs, categorical)
    at = [f"x{k}" for k in range(len(cols))]
    rows = df.select(number(col(y)).alias("y"), *[c.alias(a) for a, c in zip(at, cols.values(), strict=True)]).dropna().persist()
    x = [F.lit(1.0), *map(F.col, at)]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, last, done = np.zeros(k), -math.inf, False
    for _ in range(IRLS_ITERATIONS):
        eta = sum((F.lit(float(b)) * v for b, v in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-eta))
        w = F.greatest(p * (1 - p), F.lit(1e-10))
        # log(1 + e^|eta|) keeps large values finite
        ll = F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
        got = rows.agg(F.count("*"), F.sum("y"), F.sum(ll), *[F.sum((F.col("y") - p) * v) for v in x], *[F.sum(w * x[i] * x[j]) for i, j in pairs]).first()
        n, ones, ll_now = got[0], got[1], got[2]
        score = np.array(got[3 : 3 + k], float)
        info = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[3 + k :], strict=True):
            info[i, j] = info[j, i] = v
        inverse = np.linalg.pinv(info)
        if done or abs(ll_now - last) < IRLS_TOLERANCE * (abs(ll_now) + 1e-10):
            done = True
            break
        last, beta = ll_now, beta + inverse @ score
    rows.unpersist()
    se, z_crit = np.sqrt(np.diag(inverse)), dist.norm_ppf(1 - alpha / 2)
    share = ones / n
    ll0 = n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else 0.0
    table = []
    for j, name in enumerate(["(intercept)", *cols]):
        z = beta[j] / se[j]
        table.append({"name": name, "b": float(beta[j]), "se": float(se[j]), "z": float(z), "p": 2 * dist.norm_cdf(-abs(z)), "or": math.exp(beta[j]), "or_low": math.exp(beta[j] - z_crit * se[j]), "or_high": math.exp(min(700.0, beta[j] + z_crit * se[j]))})
    lr = 2 * (ll_now - ll0)
    return {"n": n, "converged": done, "coefficients": table, "ll": ll_now, "ll0": ll0, "mcfadden": 1 - ll_now / ll0 if ll0 else None, "aic": 2 * k - 2 * ll_now, "bic": k * math.log(n) - 2 * ll_now, "lr": lr, "lr_df": k - 1, "lr_p": dist.chi2_sf(lr, k - 1)}


def with_probability(df: DataFrame, fit: dict, y: str, xs: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    """``y, p`` of complete rows under a logistic fit."""
    cols = design(df, xs, categorical)
    beta = [r["b"] for r in fit["coefficients"]]
    eta = sum((F.lit(b) * c for b, c in zip(beta[1:], cols.values(), strict=True)), F.lit(beta[0]))
    return df.select(number(col(y)).alias("y"), (1 / (1 + F.exp(-eta))).alias("p")).dropna()


def classification(predicted: DataFrame, cut: float = 0.5) -> dict:
    """Counts and rates of ``y, p`` at a cut, against always naming the larger class."""
    hit, one = F.col("p") >= cut, F.col("y") == 1
    tp, fp, fn, tn = predicted.agg(F.count_if(hit & one), F.count_if(hit & ~one), F.count_if(~hit & one), F.count_if(~hit & ~one)).first()
    n = tp + fp + fn + tn
    accuracy, baseline = (tp + tn) / n, max(tp + fn, fp + tn) / n
    return {"n": n, "tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": accuracy, "baseline": baseline, "lift": accuracy - baseline, "sensitivity": tp / (tp + fn) if tp + fn else None, "specificity": tn / (tn + fp) if tn + fp else None}


def hosmer_lemeshow(predicted: DataFrame, groups: int = 10) -> tuple[DataFrame, dict]:
    """Observed and expected counts by groups of predicted probability, and the test.

    Groups are equal in number of rows, the first ones one larger where rows don't divide;
    places come from running counts over distinct probabilities, not from one sorted task.
    """
    from fieldmark.operators.ranks import running

    n = predicted.count()
    g = min(groups, max(2, n // 5))
    cells = predicted.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    placed = running(cells, ["p"], {"upto": "n"})
    size, extra = divmod(n, g)
    edge = extra * (size + 1)

    def group_of(place: Column) -> Column:
        return F.when(place < edge, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - edge) / max(size, 1)))

    # a tied probability may span several groups: its rows are shared out in proportion
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    spread = placed.withColumn("g", F.explode(F.sequence(group_of(first).cast("int"), group_of(last).cast("int"))))
    start = F.when(F.col("g") < extra, F.col("g") * (size + 1)).otherwise(edge + (F.col("g") - extra) * size)
    stop = start + F.when(F.col("g") < extra, size + 1).otherwise(size)
    part = F.least(stop, F.col("upto")) - F.greatest(start, first)
    table = spread.groupBy((F.col("g") + 1).alias("bin")).agg(F.sum(part).cast("long").alias("n"), F.sum(F.col("ones") * part / F.col("n")).alias("observed"), F.sum(F.col("p") * part).alias("expected"))
    rows = table.collect()  # at most ``groups`` rows
    stat = sum((r["observed"] - r["expected"]) ** 2 / (r["expected"] * (1 - r["expected"] / r["n"])) for r in rows if 0 < r["expected"] < r["n"])
    return table, {"groups": len(rows), "chi2": stat, "df": len(rows) - 2, "p": dist.chi2_sf(stat, len(rows) - 2) if len(rows) > 2 else None}


def fit_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``n, slope, intercept, r2`` of the least-squares line, in each group if asked."""
    a, b = number(col(y)), number(col(x))
    keys = [col(k).alias(k) for k in by or []]
    return df.groupBy(*keys).agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))
