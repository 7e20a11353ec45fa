"""Registered queries of the statistics and text operators, with their SQL.

Each query runs an operator over whole tables; the SQL computes the same rows in
DuckDB where SQL can. Doubles are rounded on both sides, since sums differ in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.columns import composite, p_band, reverse_score
from fieldmark.operators import coding, compare, deident, factor, impute, mediate, multiple, prep, profile, ranks, regress, weights
from fieldmark.operators.gram import gram
from fieldmark.plans import report
from fieldmark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, found: dict, names: list[str], digits: int = 6) -> DataFrame:
    """One row of a result's numbers, rounded."""
    row = [found[n] if found[n] is None else round(float(found[n]), digits) for n in names]
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))


@query("""
WITH g AS (SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g),
s AS (SELECT sum(g.n * (g.m - t.m) ** 2) AS b, sum((g.n - 1) * g.v) AS w, any_value(t.n) AS n, any_value(t.k) AS k FROM g, t)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, (k - 1)::DOUBLE AS df1, (n - k)::DOUBLE AS df2, round(b / (b + w), 6) AS eta2 FROM s
""")
def anova_price_by_priority(spark, sf_dir):
    gs = compare.groups(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return numbers(spark, compare.one_way([g.n for g in gs], [g.mean for g in gs], [g.sd**2 for g in gs]), ["f", "df1", "df2", "eta2"])


@query("SELECT o_orderpriority AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def group_descriptives(spark, sf_dir):
    got = compare.group_table(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return got.select("level", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "median")])


@query("""
SELECT c.name, CASE WHEN d <= 12 AND whole THEN 'categorical' ELSE 'continuous' END AS kind, n AS n_valid, d AS n_unique FROM (
SELECT 'l_linenumber' AS name, count(l_linenumber) AS n, count(DISTINCT l_linenumber) AS d, true AS whole FROM lineitem UNION ALL
SELECT 'l_quantity', count(l_quantity), count(DISTINCT l_quantity), bool_and(l_quantity = floor(l_quantity)) FROM lineitem UNION ALL
SELECT 'l_discount', count(l_discount), count(DISTINCT l_discount), bool_and(l_discount = floor(l_discount)) FROM lineitem UNION ALL
SELECT 'l_returnflag', count(l_returnflag), count(DISTINCT l_returnflag), true FROM lineitem) c
""")
def variable_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return profile.profile(lines).select("name", "kind", "n_valid", "n_unique")


@query("""
SELECT name, round(100 * missing / n, 1) AS missing_pct FROM (
SELECT 'x' AS name, count(*)::DOUBLE AS n, count(*) FILTER (l_orderkey % 7 = 0)::DOUBLE AS missing FROM lineitem UNION ALL
SELECT 'y', count(*)::DOUBLE, count(*) FILTER (l_partkey % 11 = 0)::DOUBLE FROM lineitem)
""")
def missing_share(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    df = lines.select(F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("x"), F.expr("if(l_partkey % 11 = 0, null, l_tax)").alias("y"))
    return profile.profile(df).select("name", "missing_pct")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey % 7 <> 0 AND l_partkey % 11 <> 0) AS n_complete,
       (count(*) FILTER (l_orderkey % 7 = 0) + count(*) FILTER (l_partkey % 11 = 0)) AS n_missing_cells FROM lineitem
""")
def completeness(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("x"), F.expr("if(l_partkey % 11 = 0, null, l_tax)").alias("y"))
    return profile.completeness(df)


@query("""
WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place, (SELECT sum(n) FROM c)::DOUBLE AS t FROM c),
x AS (SELECT place::INT AS place, value, n, t FROM r WHERE place <= 3 UNION ALL
      SELECT 4, '（其余 ' || (count(*))::VARCHAR || ' 类）', sum(n)::BIGINT, any_value(t) FROM r WHERE place > 3)
SELECT place, value, n, round(n * 100 / t, 6) AS pct, round(sum(n) OVER (ORDER BY place) * 100 / t, 6) AS cum_pct FROM x
""")
def freq_priority(spark, sf_dir):
    got = profile.freq_table(table(spark, sf_dir, "orders"), "o_orderpriority", 3)
    return got.select("place", "value", "n", F.round("pct", 6).alias("pct"), F.round("cum_pct", 6).alias("cum_pct"))


@query("""
SELECT l_returnflag, variable, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(median(x), 6) AS median, min(x) AS min, max(x) AS max,
       round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurt
FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME variable VALUE x) GROUP BY 1, 2
""")
def describe_lineitem(spark, sf_dir):
    got = profile.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return got.select("l_returnflag", "variable", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "skew", "kurt")])


@query("""
SELECT o_orderstatus AS "row", o_orderpriority AS "column", count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) FILTER (grouping(o_orderpriority) = 0) OVER (PARTITION BY o_orderstatus), 6) AS row_pct
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def crosstab_status_priority(spark, sf_dir):
    got = profile.cross_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return got.select("row", "column", "n", F.round("row_pct", 6).alias("row_pct"))


@query("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT x.a, y.b, x.n * y.n / t.n AS e FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1) x, (SELECT b, sum(n) AS n FROM c GROUP BY 1) y, (SELECT sum(n) AS n FROM c) t),
s AS (SELECT sum((coalesce(n, 0) - e) ** 2 / e) AS chi2, count(*) FILTER (e < 5)::DOUBLE AS small FROM g LEFT JOIN c USING (a, b))
SELECT round(chi2, 4) AS chi2, round(sqrt(chi2 / ((SELECT sum(n) FROM c) * (least((SELECT count(DISTINCT a) FROM c), (SELECT count(DISTINCT b) FROM c)) - 1))), 4) AS v,
       (((SELECT count(DISTINCT a) FROM c) - 1) * ((SELECT count(DISTINCT b) FROM c) - 1))::DOUBLE AS df, small AS n_expected_lt5 FROM s
""")
def chi2_cramers_v(spark, sf_dir):
    return numbers(spark, profile.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), ["chi2", "v", "df", "n_expected_lt5"], 4)


@query("""
WITH x AS (SELECT l_quantity AS a, l_linenumber::DOUBLE AS b, l_discount * 100 AS c FROM lineitem)
SELECT round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha, count(*)::DOUBLE AS n FROM x
""")
def alpha_lineitem_scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_discount") * 100).alias("c"))
    return numbers(spark, profile.cronbach_alpha(items, ["a", "b", "c"]), ["alpha", "n"])


@query("""
WITH m AS (SELECT o_orderpriority AS g, median(o_totalprice) AS m FROM orders GROUP BY 1),
d AS (SELECT o_orderpriority AS g, abs(o_totalprice - m) AS x FROM orders JOIN m ON o_orderpriority = g),
g AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g)
SELECT round((sum(g.n * (g.m - t.m) ** 2) / (any_value(k) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - any_value(k))), 6) AS f, (any_value(k) - 1)::DOUBLE AS df1, (any_value(t.n) - any_value(k))::DOUBLE AS df2 FROM g, t
""")
def levene_brown_forsythe(spark, sf_dir):
    return numbers(spark, compare.levene(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), ["f", "df1", "df2"])


@query("""
WITH g AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1),
x AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS d, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.g = 'A' AND b.g = 'N')
SELECT round(d / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df,
       round(d, 6) AS diff, round(d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM x
""")
def welch_t_returnflag(spark, sf_dir):
    a, b = compare.groups(table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')"), "l_returnflag", "l_quantity")
    found = compare.t_test(a, b, False)
    return numbers(spark, found | {"df": round(found["df"], 4)}, ["t", "df", "diff", "d"])


@query("""
WITH x AS (SELECT l_returnflag AS g, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'N')),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM x),
s AS (SELECT count(*) FILTER (g = 'A')::DOUBLE AS n1, count(*) FILTER (g = 'N')::DOUBLE AS n2, sum(r) FILTER (g = 'A') AS r1 FROM r)
SELECT round(r1 - n1 * (n1 + 1) / 2, 4) AS u, n1, n2, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS rank_biserial FROM s
""")
def mann_whitney_u(spark, sf_dir):
    found = ranks.mann_whitney(table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')"), "l_returnflag", "l_quantity")
    return numbers(spark, found, ["u", "n1", "n2", "rank_biserial"])


@query("""
WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders),
t AS (SELECT count(*)::DOUBLE AS n, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice)),
t2 AS (SELECT (SELECT count(*)::DOUBLE FROM orders) AS n, ties FROM t),
s AS (SELECT sum(q) AS q, count(*) AS k FROM (SELECT sum(r) ** 2 / count(*) AS q FROM r GROUP BY g))
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS h, (k - 1)::DOUBLE AS df,
       round(((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) - k + 1) / (n - k), 6) AS epsilon2 FROM s, t2
""")
def kruskal_h(spark, sf_dir):
    found = ranks.kruskal(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return numbers(spark, found | {"h": round(found["h"], 4)}, ["h", "df", "epsilon2"])


@query("""
WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)
SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r
""")
def pearson_spearman(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return ranks.with_ranks(pair, ["a", "b"]).agg(F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.corr("rank_a", "rank_b"), 6).alias("spearman"))


@query("""
WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x),
t AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(s / sqrt((t.n * (t.n - 1) / 2 - tx.v) * (t.n * (t.n - 1) / 2 - ty.v)), 8) AS tau, t.n AS n FROM s, t, tx, ty
""")
def kendall_tau(spark, sf_dir):
    return numbers(spark, ranks.kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"), ["tau", "n"], 8)


@query("""
WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS xy, corr(l_extendedprice, l_linenumber) AS xz, corr(l_quantity, l_linenumber) AS yz, count(*)::DOUBLE AS n FROM lineitem)
SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r, n - 3 AS df FROM c
""")
def partial_corr(spark, sf_dir):
    return numbers(spark, regress.partial(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_linenumber"]), ["r", "df"])


@query("""
SELECT 'intercept' AS name, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL
SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem
""")
def ols_gram(spark, sf_dir):
    fit = regress.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    rows = [(n, round(r["b"], 2), round(float(fit["r2"]), 6)) for n, r in zip(("intercept", "l_quantity"), fit["coefficients"], strict=True)]
    return spark.createDataFrame(rows, "name string, b double, r2 double")


@query("SELECT 'l_quantity' AS name, round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) FROM lineitem")
def vif(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice"]
    got = regress.vif(gram(table(spark, sf_dir, "lineitem"), {n: F.col(n) for n in names}), names)
    return spark.createDataFrame([(n, round(v, 6)) for n, v in got.items()], "name string, vif double")


@query("""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS m, count(*)::DOUBLE AS n FROM lineitem),
e AS (SELECT l_extendedprice - a - b * l_quantity AS e, 1 / n + (l_quantity - m) ** 2 / sxx AS h, n FROM lineitem, f),
s AS (SELECT sum(e * e) / (any_value(n) - 2) AS mse FROM e)
SELECT count(*) FILTER (e * e / (2 * mse) * h / (1 - h) ** 2 > 4 / n) AS n_flagged, count(*) AS n FROM e, s
""")
def cooks_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cols, y = {"x": F.col("l_quantity")}, F.col("l_extendedprice")
    fit = regress.solve(gram(lines, cols | {"y": y}), "y", ["x"])
    return regress.with_influence(lines, fit, cols, y, []).agg(F.count_if(F.col("cook") > 4 / fit["n"]).alias("n_flagged"), F.count("*").alias("n"))


@query()
def breusch_pagan_sensitivity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = regress.diagnostics(lines, "l_extendedprice", ["l_quantity", "l_discount"], row_order="l_orderkey")
    turned = regress.sensitivity(lines, "l_extendedprice", ["l_quantity", "l_discount"], full=found["fit"])
    return numbers(spark, found | {"n_flagged": turned["n_flagged"], "r2_without": turned["without"]["r2"]}, ["bp", "bp_p", "dw", "cook_max", "n_flagged", "r2_without"])


@query("""
WITH d AS (SELECT p_size - l_quantity AS d FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT count(*)::DOUBLE AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, round(avg(d) / stddev_samp(d), 6) AS dz FROM d
""")
def paired_t(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = compare.one_sample_t(compare.differences(pair, "l_quantity", "p_size"), "d")
    return numbers(spark, found | {"t": round(found["t"], 4)}, ["n", "mean", "sd", "t", "dz"])


@query("""
WITH d AS (SELECT p_size - l_quantity AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
SELECT (SELECT count(*) FROM d)::DOUBLE AS n_pair, (SELECT count(*) FROM d WHERE d = 0)::DOUBLE AS n_zero, count(*)::DOUBLE AS n_use,
       sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, round((sum(r) FILTER (d > 0) - sum(r) FILTER (d < 0)) / sum(r), 6) AS rank_biserial FROM r
""")
def wilcoxon_signed_rank(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return numbers(spark, compare.wilcoxon(compare.differences(pair, "l_quantity", "p_size")), ["n_pair", "n_zero", "n_use", "w_plus", "w_minus", "rank_biserial"])


@query()
def post_hoc_pairs(spark, sf_dir):
    return compare.post_hoc(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", True)


@query("""
WITH q AS (SELECT o_orderstatus AS level, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT level, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
       count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_outside FROM orders JOIN q ON o_orderstatus = level GROUP BY level
""")
def box_stats(spark, sf_dir):
    got = compare.box_stats(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return got.select("level", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "n_outside")


#: Newton's steps for one intercept and two slopes, each over all rows; the last state's information gives the errors.
LOGISTIC = """
WITH RECURSIVE d AS (SELECT (l_returnflag = 'N')::DOUBLE AS y, l_quantity AS u, l_discount AS v FROM lineitem),
steps AS (
  SELECT 0 AS i, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2
  UNION ALL
  SELECT i + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det
  FROM (
    SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22,
           h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11) AS det
    FROM (
      SELECT i, b0, b1, b2, sum(w) AS h00, sum(w * u) AS h01, sum(w * v) AS h02, sum(w * u * u) AS h11, sum(w * u * v) AS h12, sum(w * v * v) AS h22, sum(y - p) AS g0, sum((y - p) * u) AS g1, sum((y - p) * v) AS g2
      FROM (SELECT *, p * (1 - p) AS w FROM (SELECT s.i, s.b0, s.b1, s.b2, d.*, 1 / (1 + exp(-(s.b0 + s.b1 * u + s.b2 * v))) AS p FROM steps s, d WHERE s.i < 12))
      GROUP BY ALL))),
last AS (SELECT * FROM steps WHERE i = 12),
h AS (
  SELECT sum(w) AS h00, sum(w * u) AS h01, sum(w * v) AS h02, sum(w * u * u) AS h11, sum(w * u * v) AS h12, sum(w * v * v) AS h22
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT d.*, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM d, last))),
e AS (SELECT *, h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11) AS det FROM h),
found AS (
  SELECT unnest(['(intercept)', 'l_quantity', 'l_discount']) AS name, unnest([b0, b1, b2]) AS b,
         unnest([sqrt((h11 * h22 - h12 * h12) / det), sqrt((h00 * h22 - h02 * h02) / det), sqrt((h00 * h11 - h01 * h01) / det)]) AS se
  FROM last, e)
SELECT name, round(b, 6) AS b, round(se, 6) AS se, round(exp(b), 6) AS odds_ratio, true AS converged FROM found
"""


@query(LOGISTIC)
def logistic_flag(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "N").cast("double"))
    fit = regress.logistic(lines, "y", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(r["name"], round(r["b"], 6), round(r["se"], 6), round(r["or"], 6), fit["converged"]) for r in fit["coefficients"]], "name string, b double, se double, odds_ratio double, converged boolean")


@query("""
WITH p AS (SELECT l_quantity / 100 AS p, (l_returnflag = 'N')::DOUBLE AS y FROM lineitem)
SELECT count(*)::DOUBLE AS n, count(*) FILTER (p >= 0.3 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.3 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.3 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.3 AND y = 0)::DOUBLE AS tn FROM p
""")
def classification_table(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 100).alias("p"), (F.col("l_returnflag") == "N").cast("double").alias("y"))
    return numbers(spark, regress.classification(seen, 0.3), ["n", "tp", "fp", "fn", "tn"])


@query("""
WITH p AS (SELECT o_totalprice / 1000000 AS p, (o_orderstatus = 'F')::DOUBLE AS y FROM orders),
g AS (SELECT p, y, ntile(10) OVER (ORDER BY p) AS bin FROM p)
SELECT bin::INT AS bin, count(*) AS n, round(sum(p), 4) AS expected FROM g GROUP BY 1
""")
def hosmer_lemeshow_bins(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000000).alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return regress.hosmer_lemeshow(seen)[0].select("bin", "n", F.round("expected", 4).alias("expected"))


@query("""
WITH w AS (SELECT l_extendedprice AS x, l_quantity AS w FROM lineitem)
SELECT round(sum(w * x) / sum(w), 4) AS mean, round(sum(w) ** 2 / sum(w * w), 4) AS n_eff, count(*)::DOUBLE AS n FROM w
""")
def weighted_mean_neff(spark, sf_dir):
    return numbers(spark, weights.weighted_mean(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), ["mean", "n_eff", "n"], 4)


@query("""
SELECT count(*)::DOUBLE AS positive, min(l_quantity) AS min, max(l_quantity) AS max, round(count(*) / (sum(l_quantity) ** 2 / sum(l_quantity ** 2)), 6) AS deff, round(max(l_quantity) / sum(l_quantity), 10) AS max_share FROM lineitem
""")
def weight_checks(spark, sf_dir):
    found = weights.check(table(spark, sf_dir, "lineitem"), "l_quantity")
    return numbers(spark, found | {"deff": round(found["deff"], 6)}, ["positive", "min", "max", "deff", "max_share"], 10)


@query("""
WITH g AS (SELECT l_linestatus AS g, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT round((SELECT m FROM g WHERE g = 'O') - (SELECT m FROM g WHERE g = 'F'), 4) AS diff
""")
def weighted_diff(spark, sf_dir):
    return numbers(spark, weights.weighted_diff(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "l_quantity"), ["diff"], 4)


@query("""
WITH s AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_tax) / sum(l_quantity) AS my FROM lineitem)
SELECT round(sum(l_quantity * (l_discount - mx) * (l_tax - my)) / sqrt(sum(l_quantity * (l_discount - mx) ** 2) * sum(l_quantity * (l_tax - my) ** 2)), 6) AS r FROM lineitem, s
""")
def weighted_corr(spark, sf_dir):
    return numbers(spark, weights.weighted_corr(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_quantity"), ["r"])


#: One test for each customer: a p-value by rule, small for some.
P_RULE = "pow((c_custkey * 7919 % 10007 + 1) / 10008{double}, 3)"
TESTS_SQL = f"SELECT c_custkey AS id, {P_RULE.format(double='::DOUBLE')} AS p, c_custkey % 2 = 0 AS exploratory FROM customer"


def tests_of_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(P_RULE.format(double="D")).alias("p"), (F.col("c_custkey") % 2 == 0).alias("exploratory"))


@query(f"""
WITH r AS (SELECT id, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM ({TESTS_SQL}))
SELECT id, round(p, 12) AS p, p <= 0.05::DOUBLE / m AS bonferroni, k <= coalesce((SELECT max(k) FROM r WHERE p <= k * 0.05::DOUBLE / m), 0) AS bh FROM r
""")
def bh_fdr(spark, sf_dir):
    return multiple.adjust(tests_of_customers(spark, sf_dir)).select("id", F.round("p", 12).alias("p"), "bonferroni", "bh")


@query("""
WITH x AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem)
SELECT round(stddev_samp(x), 6) AS sd, round(stddev_samp(coalesce(x, (SELECT avg(x) FROM x))), 6) AS sd_filled, round(avg(coalesce(x, (SELECT avg(x) FROM x))), 6) AS mean_filled FROM x
""")
def mean_fill_sd_shrink(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("x"))
    filled, _ = prep.fill(df, ["x"], "mean")
    before = df.agg(F.round(F.stddev_samp("x"), 6)).first()[0]
    return filled.agg(F.lit(before).alias("sd"), F.round(F.stddev_samp("x"), 6).alias("sd_filled"), F.round(F.avg("x"), 6).alias("mean_filled"))


@query()
def mice_comparison(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("q"), F.expr("if(l_partkey % 5 = 0, null, l_extendedprice)").alias("e"), "l_discount")
    done = impute.mice(lines, "id", ["q", "e", "l_discount"])
    return impute.compare_missing(lines, done, ["q", "e"])


@query("""
SELECT l_orderkey, l_linenumber, 8 - l_linenumber::DOUBLE AS reversed, (l_quantity + coalesce(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax END, 0)) / (CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 2 END) AS score FROM lineitem
""")
def reverse_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("t", F.expr("if(l_partkey % 11 = 0, null, l_tax)"))
    name, score = composite("score = mean(l_quantity, t)", lines.columns)
    return lines.select("l_orderkey", "l_linenumber", reverse_score(F.col("l_linenumber"), 7).alias("reversed"), score.alias(name))


@query("""
WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem)
SELECT 'l_extendedprice' AS variable, round(any_value(m - 3 * sd), 2) AS low, round(any_value(m + 3 * sd), 2) AS high, count(*) FILTER (l_extendedprice < m - 3 * sd OR l_extendedprice > m + 3 * sd) AS n_outliers FROM lineitem, s
""")
def zscore_marks(spark, sf_dir):
    got = prep.outlier_counts(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])
    return got.select("variable", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n_outliers")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT 'o_totalprice' AS variable, round(any_value(a - 1.5 * (b - a)), 2) AS low, round(any_value(b + 1.5 * (b - a)), 2) AS high, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n_outliers FROM orders, q
""")
def iqr_marks(spark, sf_dir):
    got = prep.outlier_counts(table(spark, sf_dir, "orders"), ["o_totalprice"], "iqr")
    return got.select("variable", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n_outliers")


@query("SELECT 'o_orderpriority=' || o_orderpriority AS level, count(*) AS n FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def dummy_levels(spark, sf_dir):
    from fieldmark.functions.columns import dummies

    orders = table(spark, sf_dir, "orders")
    cols = dummies(orders, "o_orderpriority")
    return orders.agg(*[F.sum(c).cast("long").alias(n) for n, c in cols.items()]).unpivot([], [f"`{n}`" for n in cols], "level", "n")


@query("""
SELECT count(*) AS n FROM lineitem WHERE (l_orderkey % 7 <> 0) OR (l_orderkey % 3 = 0)
""")
def skip_aware_deletion(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("x"), F.expr("if(l_orderkey % 3 = 0, 'yes', 'no')").alias("q_skip"))
    done, _ = prep.run(df, [prep.mark_skips, prep.delete_incomplete])
    return done.agg(F.count("*").alias("n"))


@query()
def mediation_price(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("m"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    found = mediate.mediation(orders, "x", "m", "y")
    return spark.createDataFrame([(found["n"], found["label"], found["indirect"], found["ci_low"], found["ci_high"])], "n long, label string, indirect double, ci_low double, ci_high double")


@query()
def moderation_price(spark, sf_dir):
    found = mediate.moderation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice")
    return spark.createDataFrame([(s["sd"], s["w"], s["slope"], s["se"], s["p"]) for s in found["slopes"]], "sd long, w double, slope double, se double, p double")


@query()
def factor_loadings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"))
    return factor.loading_table(spark, factor.analyse(lines, lines.columns))


@query("""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) <> '') AS n_filled FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents) GROUP BY 1
""")
def document_lines(spark, sf_dir):
    return coding.lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_filled"))


@query("""
WITH s AS (SELECT role AS speaker, count(*) AS n_units, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1)
SELECT *, round(n_chars * 100 / (SELECT sum(n_chars) FROM s)::DOUBLE, 6) AS pct FROM s
""")
def speaker_share(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker")
    return coding.speaker_share(units).withColumn("pct", F.round("pct", 6))


@query(f"""
SELECT * FROM (PIVOT (SELECT DISTINCT lang AS label, source FROM documents) ON source IN ({", ".join(f"'src{k}'" for k in range(20))}) USING count(*) GROUP BY label)
""")
def role_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.array("lang").alias("label"), F.col("source").alias("speaker"), F.col("doc_id").alias("no"))
    return coding.person_matrix(docs, "label")


@query("""
WITH x AS (SELECT unnest(string_split(lang || '、' || source, '、')) AS label, source AS speaker, doc_id AS no FROM documents),
s AS (SELECT label, count(DISTINCT speaker) AS n_people, count(DISTINCT no) AS n_segments FROM x GROUP BY 1)
SELECT row_number() OVER (ORDER BY n_people DESC, n_segments DESC, label)::INT AS place, label, n_people, n_segments FROM s
""")
def theme_coverage(spark, sf_dir):
    sheet = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("no"), F.col("source").alias("speaker"), "text", F.col("lang").alias("codes"), F.lit("").alias("categories"), F.concat_ws("、", "lang", "source").alias("themes"))
    return coding.label_summary(coding.coded(sheet), "themes").select("place", "label", "n_people", "n_segments")


@query(r"""
SELECT DISTINCT doc_id, m AS value, ((length(text) - length(replace(text, m, ''))) / length(m))::BIGINT AS n
FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1)) AS m FROM documents)
""")
def email_entities(spark, sf_dir):
    got = deident.entities(table(spark, sf_dir, "documents"), names=False, kinds={"邮箱": deident.DIRECT["邮箱"]})
    return got.select("doc_id", "value", "n")


@query(r"""
WITH e AS (SELECT doc_id, m AS value, min(instr(text, m)) AS first FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1)) AS m FROM documents) GROUP BY 1, 2)
SELECT doc_id, value, '[邮箱' || row_number() OVER (PARTITION BY doc_id ORDER BY first, value)::VARCHAR || ']' AS placeholder FROM e
""")
def email_pseudonyms(spark, sf_dir):
    found = deident.entities(table(spark, sf_dir, "documents"), names=False, kinds={"邮箱": deident.DIRECT["邮箱"]})
    return deident.numbered(found, ["doc_id"], ["first"]).select("doc_id", "value", "placeholder")


@query(r"""
WITH e AS (SELECT doc_id, m AS value, min(instr(text, m)) AS first FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1)) AS m FROM documents) GROUP BY 1, 2),
n AS (SELECT doc_id, value, '[邮箱' || row_number() OVER (PARTITION BY doc_id ORDER BY first, value)::VARCHAR || ']' AS placeholder FROM e),
l AS (SELECT doc_id, list(value || chr(1) || placeholder ORDER BY length(value) DESC, value DESC) AS parts FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN parts IS NULL THEN text ELSE list_reduce(list_prepend(text, parts), lambda a, b: replace(a, split_part(b, chr(1), 1), split_part(b, chr(1), 2))) END AS text FROM documents LEFT JOIN l USING (doc_id)
""")
def email_replaced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deident.entities(docs, names=False, kinds={"邮箱": deident.DIRECT["邮箱"]})
    return deident.replaced(docs, deident.numbered(found, ["doc_id"], ["first"]), "doc_id")


@query()
def deidentified(spark, sf_dir):
    texts, _ = deident.deidentify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return texts


@query()
def quasi_report(spark, sf_dir):
    return deident.quasi_report(table(spark, sf_dir, "documents"))


@query(r"""SELECT event_id, regexp_replace(props, '("k"\s*:\s*)("[^"]*"|-?[0-9][0-9.eE+\-]*)', '\1"***"', 'g') AS props FROM events""")
def json_key_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", deident.mask_json(F.col("props"), ("k",)).alias("props"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 1000000 < 0.05 THEN 'significant' WHEN o_totalprice / 1000000 < 0.1 THEN 'near' ELSE 'not significant' END AS band FROM orders")
def p_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", p_band(F.col("o_totalprice") / 1000000).alias("band"))


@query("""
SELECT 'changed' AS change, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 9 <> 0 UNION ALL SELECT 'removed', o_orderkey FROM orders WHERE o_orderkey % 9 = 0
""")
def table_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = old.where("o_orderkey % 9 <> 0").withColumn("o_custkey", F.expr("if(o_orderkey % 5 = 0, o_custkey + 1, o_custkey)"))
    return report.diff(old, new, ["o_orderkey"]).select("change", "o_orderkey")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def event_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events")).select("user_id", "start", "n")


@query("""
SELECT conv_id, turn, text, CASE WHEN c IS NULL THEN '' ELSE c END AS code FROM conversations LEFT JOIN
  (SELECT trim(text) AS t, max_by('c' || (conv_id % 10)::VARCHAR, conv_id * 1000 + turn) AS c FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1) ON trim(text) = t
""")
def carry_over_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    old = rows.where("conv_id % 3 = 0").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("no"), F.concat(F.lit("c"), (F.col("conv_id") % 10).cast("string")).alias("code"))
    done = coding.carry_over(rows.withColumn("code", F.lit(None).cast("string")), old, ["code"])
    return done.select("conv_id", "turn", "text", F.coalesce("code", F.lit("")).alias("code"))


@query("""
WITH x AS (SELECT doc_id AS no, lang AS code, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'k_' || lang END AS cat FROM documents),
r AS (SELECT code, min(cat) AS t FROM x WHERE cat IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cat) = 1)
SELECT no, coalesce(cat, t, '') AS category, cat IS NULL AND t IS NOT NULL AS is_inferred FROM x LEFT JOIN r USING (code)
""")
def code_inference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("no"), F.array("lang").alias("codes"), F.expr("if(doc_id % 3 = 0, cast(array() as array<string>), array(concat('k_', lang)))").alias("categories"))
    got = coding.inferred(rows, "codes", "categories")
    return got.select("no", F.array_join("categories_all", "、").alias("category"), "is_inferred")


@query("""
WITH b AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)
SELECT least(floor((o_totalprice - low) / ((high - low) / 20)), 19)::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1
""")
def price_histogram(spark, sf_dir):
    return compare.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20).select("bin", "n")


@query("""
SELECT round(avg(l_extendedprice), 4) AS mean, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted_mean,
       round(sum(l_quantity * l_extendedprice) / sum(l_quantity) - avg(l_extendedprice), 4) AS shift FROM lineitem
""")
def unweighted_vs_weighted(spark, sf_dir):
    return numbers(spark, weights.compare_weighted(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), ["mean", "weighted_mean", "shift"], 4)


@query("""
WITH g AS (SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
w AS (SELECT *, n / v AS w, sum(n / v) OVER () AS sw, sum(n / v * m) OVER () / sum(n / v) OVER () AS mm, count(*) OVER ()::DOUBLE AS k FROM g),
s AS (SELECT sum(w * (m - mm) ** 2) / (any_value(k) - 1) AS a, sum((1 - w / sw) ** 2 / (n - 1)) AS lam, any_value(k) AS k FROM w)
SELECT round(a / (1 + 2 * (k - 2) / (k * k - 1) * lam), 6) AS f, k - 1 AS df1, round((k * k - 1) / (3 * lam), 4) AS df2 FROM s
""")
def welch_anova(spark, sf_dir):
    found = compare.welch_anova(compare.groups(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))
    return numbers(spark, found | {"df2": round(found["df2"], 4)}, ["f", "df1", "df2"])


@query("SELECT c_custkey, CASE WHEN trim(c_name) <> '' THEN '[姓名' || substr(sha256('salt' || trim(c_name)), 1, 10) || ']' ELSE c_name END AS name FROM customer")
def masked_columns(spark, sf_dir):
    return deident.mask_columns(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), "salt")


@query("SELECT o_orderkey, (o_orderstatus = 'O')::DOUBLE AS y FROM orders WHERE o_orderstatus IN ('F', 'O')")
def binary_encoding(spark, sf_dir):
    from fieldmark.functions.columns import encode_binary

    two = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    return two.select("o_orderkey", encode_binary(two, "o_orderstatus").alias("y"))


@query("""
WITH q AS (SELECT count(*) AS n, count(*) FILTER (l_orderkey % 7 = 0) AS m FROM lineitem)
SELECT (m * 100.0 / n) > 10 AS dropped FROM q
""")
def sparse_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_tax", F.expr("if(l_orderkey % 7 = 0, null, l_quantity)").alias("x"))
    kept, _ = prep.drop_sparse(df, 10.0)
    return spark.createDataFrame([("x" not in kept.columns,)], "dropped boolean")


@query("SELECT l_returnflag AS mode FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_returnflag LIMIT 1)")
def mode_fill_value(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag").unionByName(spark.createDataFrame([(None,)], "l_returnflag string"))
    filled, _ = prep.fill(df, ["l_returnflag"], "mode")
    return filled.groupBy("l_returnflag").count().orderBy(F.desc("count"), "l_returnflag").limit(1).select(F.col("l_returnflag").alias("mode"))


@query(f"""
WITH t AS ({TESTS_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t),
a AS (SELECT exploratory, p < 0.05 AS raw, p <= 0.05::DOUBLE / m AS bon, k <= coalesce((SELECT max(k) FROM r WHERE p <= k * 0.05::DOUBLE / m), 0) AS bh FROM r)
SELECT coalesce(exploratory::VARCHAR, 'all') AS exploratory, count(*) AS n_tests, count(*) FILTER (raw) AS n_raw, count(*) FILTER (bon) AS n_bonferroni, count(*) FILTER (bh) AS n_bh, count(*) FILTER (raw AND NOT bh) AS n_dropped, round(1 - 0.95::DOUBLE ** count(*), 6) AS familywise FROM a GROUP BY CUBE (exploratory)
""")
def ledger_summary(spark, sf_dir):
    got = multiple.summary(tests_of_customers(spark, sf_dir)).withColumn("familywise", F.round("familywise", 6))
    return got.withColumn("exploratory", F.coalesce(F.col("exploratory").cast("string"), F.lit("all")))


@query("""
WITH x AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem), n AS (SELECT count(*) AS n, count(*)::DOUBLE AS m FROM x),
r AS (SELECT corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM x)),
t AS (SELECT x, y, count(*)::DOUBLE AS k FROM x GROUP BY 1, 2), s AS (SELECT sum(a.k * b.k * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM t a JOIN t b ON a.x <> b.x AND a.y <> b.y),
tx AS (SELECT sum(k * (k - 1)) / 2 AS t FROM (SELECT sum(k) AS k FROM t GROUP BY x)), ty AS (SELECT sum(k * (k - 1)) / 2 AS t FROM (SELECT sum(k) AS k FROM t GROUP BY y))
SELECT 'pearson' AS coefficient, n, round(pearson, 8) AS value, true AS is_primary FROM n, r UNION ALL SELECT 'spearman', n, round(spearman, 8), false FROM n, r
UNION ALL SELECT 'kendall', n, round(s / sqrt((m * (m - 1) / 2 - tx.t) * (m * (m - 1) / 2 - ty.t)), 8), false FROM n, s, tx, ty
""")
def correlation_report(spark, sf_dir):
    got = regress.correlations(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return got.select("coefficient", "n", F.round("value", 8).alias("value"), "is_primary")


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def fit_lines(spark, sf_dir):
    got = regress.fit_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return got.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("""
SELECT variable, q::DOUBLE AS q, round(value, 4) AS value FROM (
  SELECT 'o_totalprice' AS variable, unnest([0.25, 0.5, 0.75]) AS q, unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) AS value FROM orders)
""")
def quantiles(spark, sf_dir):
    return profile.quantiles(table(spark, sf_dir, "orders"), ["o_totalprice"]).withColumn("value", F.round("value", 4))


@query(r"""
WITH e AS (SELECT doc_id, m AS value, min(instr(text, m)) AS first, any_value(text) AS text FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1)) AS m FROM documents) GROUP BY 1, 2),
l AS (SELECT doc_id, value, first, '#' || (length(substr(text, 1, first)) - length(replace(substr(text, 1, first), chr(10), '')) + 1)::VARCHAR AS line FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS several, row_number() OVER (PARTITION BY doc_id, line ORDER BY first, value) AS k FROM l)
SELECT doc_id, value, '[邮箱' || line || CASE WHEN several > 1 THEN chr((96 + k)::INT) ELSE '' END || ']' AS placeholder FROM n
""")
def email_by_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deident.entities(docs, names=False, kinds={"邮箱": deident.DIRECT["邮箱"]})
    return deident.numbered_by_sequence(found, docs).select("doc_id", "value", "placeholder")
