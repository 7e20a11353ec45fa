"""Scalar column functions of survey tables: coercion, labels, scores, codes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
# Sentinels of questions that did not apply, and markers of skipped respondents.
SENTINELS = ("<不适用>", "不适用", "N/A", "NA", "无此题", "跳过")
SKIP_SUFFIXES = ("_跳题", "_skip", "_不适用")
SKIP_TRUE = ("true", "1", "是", "y", "yes")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def number(c: Column) -> Column:
    """As a double; null where it is no number, NaN included."""
    v = F.trim(c.cast("string")).try_cast("double")
    v = F.when(c.cast("string").isin("true", "false"), c.cast("string").isin("true").cast("double")).otherwise(v)
    return F.when(~F.isnan(v), v)


def number_of(df: DataFrame, name: str) -> Column:
    """``number`` of a column; doubles and whole numbers are taken as they are, not by their text."""
    c, kind = col(name), df.select(col(name)).schema[0].dataType
    if isinstance(kind, T.DoubleType):
        return F.when(~F.isnan(c), c)
    return c.cast("double") if isinstance(kind, T.IntegralType) else number(c)


def numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, as doubles."""
    return df.select(*[number(col(n)).alias(n) if not isinstance(df.schema[n].dataType, T.DoubleType) else F.when(~F.isnan(col(n)), col(n)).alias(n) for n in names])


def clean_columns(df: DataFrame, blank: str = "未命名") -> DataFrame:
    """Headers trimmed, white space collapsed, blanks named, repeats numbered from 2."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"\s+", " ", c).strip() or blank
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        names.append(name if n == 1 else f"{name}_{n}")
    return df.toDF(*names)


def sentinel_to_null(c: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    return F.when(~F.coalesce(F.trim(c).isin(*sentinels), F.lit(False)), c)


def is_skip_marker(name: str) -> bool:
    return name.endswith(SKIP_SUFFIXES)


def skipped(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*SKIP_TRUE), F.lit(False))


def banded_number(c: Column) -> Column:
    """A label that stands for a number: middle of ``a-b``, ``a and more``, a number with a
    unit, or a school year; null for any other."""
    s = F.regexp_replace(F.translate(F.trim(c.cast("string")), "–—－~～至", "------"), r"(?U)\s+", "")
    num = r"(-?[0-9]+(?:\.[0-9]+)?)"

    def part(pattern: str, group: int) -> Column:
        return F.when(F.regexp_extract(s, pattern, group) != "", F.regexp_extract(s, pattern, group).cast("double"))

    band = rf"^{num}[^0-9\-]*-{num}[^0-9]*$"
    middle = (part(band, 1) + part(band, 2)) / 2
    open_end = part(rf"^{num}[^0-9]*(?:及以上|以上|以下|以内|起|多|余)$", 1)
    unit = part(rf"^{num}[^0-9]*$", 1)
    years = "一二三四五六七八九十"
    year = F.when(s.rlike(f"^大[{years}]$"), F.instr(F.lit(years), F.substring(s, 2, 1)))
    return F.coalesce(middle, open_end, unit, year.cast("double"))


def reverse_score(c: Column, maximum: float) -> Column:
    return F.lit(maximum) + 1 - number(c)


def mean_of(cs: list[Column]) -> Column:
    """Mean of what is there; null if nothing is."""
    n = reduce(lambda a, b: a + b, [number(c).isNotNull().cast("int") for c in cs])
    return sum_of(cs) / F.when(n > 0, n)


def sum_of(cs: list[Column]) -> Column:
    """Sum of what is there; 0 if nothing is."""
    return reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in cs])


def composite(rule: str, known: list[str]) -> tuple[str, Column] | None:
    """``name = mean(a, b)``, ``sum(a, b)`` or ``a + b`` as a named column; None for a rule
    with fewer than two known items."""
    m = re.fullmatch(r"\s*(.+?)\s*[=＝]\s*(?:(mean|avg|average|平均|sum|total|求和|总分)\s*[(（](.+)[)）]|(.+))\s*", rule, re.IGNORECASE)
    if not m:
        return None
    name, kind, inside, plain = m.groups()
    items = [x.strip() for x in re.split(r"[,，、+＋]", inside or plain)]
    items = [x for x in dict.fromkeys(items) if x in known]
    if len(items) < 2:
        return None
    mean = kind and kind.lower() in ("mean", "avg", "average", "平均")
    return name, (mean_of if mean else sum_of)([col(x) for x in items])


def encode_binary(df: DataFrame, name: str) -> Column:
    """1 for the last of exactly two levels in string order, 0 for the first."""
    low, high, n = df.select(F.min(col(name).cast("string")), F.max(col(name).cast("string")), F.count_distinct(col(name).cast("string"))).first()
    if n != 2:
        raise ValueError(f"{name} has {n} levels, not two")
    return F.when(col(name).isNotNull(), (col(name).cast("string") == high).cast("double"))


def levels(df: DataFrame, name: str, most: int = 200) -> list[str]:
    """Distinct values in string order; a bounded list."""
    got = [r[0] for r in df.select(col(name).cast("string")).where(col(name).isNotNull()).distinct().sort(col(name).cast("string")).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{name} has more than {most} levels")
    return got


def dummies(df: DataFrame, name: str) -> dict[str, Column]:
    """An indicator for each level but the first, in string order; null stays null."""
    return {f"{name}={v}": F.when(col(name).isNotNull(), (col(name).cast("string") == v).cast("double")) for v in levels(df, name)[1:]}


def format_p(p: Column) -> Column:
    """A dash for null, two significant digits below 0.0001, else four decimals."""
    small = F.regexp_replace(F.format_string("%.1e", p), r"\.0e", "e")
    return F.when(p.isNull(), "—").when(p < 1e-4, small).otherwise(F.format_string("%.4f", p))


def p_band(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), "none").when(p < alpha, "significant").when(p < 0.1, "near").otherwise("not significant")


def label_order(c: Column, locale: str = "zh") -> list[Column]:
    """Sort keys of labels: numbers first and by value, then words as the locale's dictionary has
    them (for ``zh`` by their reading), nulls last."""
    n = number(c)
    return [c.isNull(), n.asc_nulls_last(), F.collate(c.cast("string"), locale), c.cast("string")]
