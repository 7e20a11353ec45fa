"""Results as rows of text: Markdown tables, SPSS syntax, and differences of two results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import col, is_numeric
from fieldmark.plans.staleness import times


def markdown(df: DataFrame, most: int = 40, digits: int = 3) -> str:
    """The first rows of a result as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def spss_syntax(df: DataFrame, path: str, procedure: str, dv: str | None = None, group: str | None = None, ivs: tuple[str, ...] = ()) -> str:
    """Syntax that reads the exported table and repeats a procedure in SPSS."""
    kinds = [f"  {c} {'F12.4' if is_numeric(df, c) else 'A255'}" for c in df.columns]
    read = [f"GET DATA /TYPE=TXT /FILE='{path}' /ENCODING='UTF8'", " /DELIMITERS=',' /QUALIFIER='\"' /FIRSTCASE=2 /VARIABLES=", *kinds, "."]
    xs = " ".join(ivs)
    commands = {
        "t": f"T-TEST GROUPS={group} /VARIABLES={dv}.",
        "welch": f"T-TEST GROUPS={group} /VARIABLES={dv}.",
        "anova": f"ONEWAY {dv} BY {group} /STATISTICS DESCRIPTIVES HOMOGENEITY WELCH /POSTHOC=TUKEY.",
        "anova_welch": f"ONEWAY {dv} BY {group} /STATISTICS DESCRIPTIVES HOMOGENEITY WELCH /POSTHOC=GH.",
        "mannwhitney": f"NPAR TESTS /M-W={dv} BY {group}.",
        "kruskal": f"NPAR TESTS /K-W={dv} BY {group}.",
        "pearson": f"CORRELATIONS /VARIABLES={dv} {xs}.",
        "spearman": f"NONPAR CORR /VARIABLES={dv} {xs} /PRINT=BOTH.",
        "ols": f"REGRESSION /STATISTICS COEFF CI(95) R ANOVA COLLIN TOL /DEPENDENT {dv} /METHOD=ENTER {xs}.",
        "logistic": f"LOGISTIC REGRESSION VARIABLES {dv} /METHOD=ENTER {xs} /PRINT=GOODFIT CI(95).",
        "chi2": f"CROSSTABS /TABLES={dv} BY {xs} /STATISTICS=CHISQ PHI /CELLS=COUNT ROW EXPECTED.",
    }
    return "\n".join([*read, commands.get(procedure, f"DESCRIPTIVES VARIABLES={dv or xs}.")])


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``change, <keys>, old, new``: rows added, removed or with any changed cell, by key."""
    a = old.select(*[col(k).alias(k) for k in keys], F.to_json(F.struct(*[col(c) for c in old.columns])).alias("old"))
    b = new.select(*[col(k).alias(k) for k in keys], F.to_json(F.struct(*[col(c) for c in new.columns])).alias("new"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(change.alias("change"), *keys, "old", "new").where("change is not null")


def sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, section, title, body``: Markdown texts cut at their ``#`` headings."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,6} )", -1)
    rows = docs.select(id, F.posexplode(parts).alias("section", "part"))
    title = F.trim(F.regexp_replace(F.regexp_extract("part", r"^\n?#{1,6} ([^\n]*)", 1), r"^[0-9]+[.、．]\s*", ""))
    return rows.select(id, "section", title.alias("title"), F.trim(F.regexp_replace("part", r"^\n?(#{1,6} [^\n]*)?", "")).alias("body")).where("section > 0 or trim(body) <> ''")


def variable_rows(sections_: DataFrame, id: str = "doc_id") -> DataFrame:
    """``id, name, role, level, how``: four-column Markdown tables of variables, headers and
    placeholders left out."""
    lines = sections_.select(id, "section", F.posexplode(F.split("body", r"\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select(id, "section", "line_no", cells.alias("c")).where(F.size("c") >= 4)
    real = ~F.element_at("c", 1).rlike(r"^(变量名?|name|variable|[:\-\s]*|（.*）|<.*>|…|\.\.\.)$")
    return rows.where(real).select(id, F.element_at("c", 1).alias("name"), F.element_at("c", 2).alias("role"), F.element_at("c", 3).alias("level"), F.element_at("c", 4).alias("how"))


# Seconds that an item of each kind takes to fill in.
ITEM_SECONDS = {"single": 8, "multiple": 12, "likert": 10, "rank": 11, "number": 10, "short": 12, "matrix": 15, "open": 45}


def question_kinds(variables: DataFrame) -> DataFrame:
    """``variables`` plus the kind of item that would ask for each, by level and wording; null:
    take it from logs instead of asking."""
    how, level = F.lower("how"), F.col("level")
    kind = (
        F.when(how.rlike("日志|埋点|后台|log"), None)
        .when(how.rlike("开放|描述|为什么|open"), "open")
        .when(how.rlike("多选|multiple"), "multiple")
        .when(how.rlike("排序|rank"), "rank")
        .when(how.rlike("量表|李克特|同意|满意|likert"), "likert")
        .when(level.rlike("定序|ordinal"), "likert")
        .when(level.rlike("定距|定比|interval|ratio"), "number")
        .otherwise("single")
    )
    return variables.withColumn("kind", kind)


def fill_time(items: DataFrame, target_seconds: float, by: str = "doc_id") -> DataFrame:
    """``n_items, seconds, over``: time to fill in, over where 15 % beyond the target."""
    price = F.coalesce(*[F.when(F.col("kind") == k, s) for k, s in ITEM_SECONDS.items()], F.lit(0))
    got = items.groupBy(by).agg(F.count("kind").alias("n_items"), F.sum(price).alias("seconds"))
    return got.withColumn("over", F.col("seconds") > 1.15 * target_seconds)


# Where a wording lists its choices, in the order in which places are tried, and
# words of instructions, which are no choices.
CHOICES = (
    r"[（(]([^（）()]{2,80})[）)]",
    r"(?:单选|多选|排序)[：:]\s*([^（(]+)",
    r"(?:编码为|归为|归入|分为|类别为|取值)\s*([^。；;]{2,80})",
    r"如\s*([^。；;]{2,80}?)\s*(?:等|等等)",
    r"[：:]\s*([^（(。；;]*[/／|、][^（(。；;]*)",
    r"按\s*([^。；;]{2,80}?)\s*(?:区间|分组|档位|归组|分档)",
)
INSTRUCTIONS = "按 |分组|选择后|归组|计算|得出|注明|填写|允许|大概|自报|由前|区间归"
LONGEST_CHOICE, MOST_CHOICES = 14, 8


def _is_choice(word: Column) -> Column:
    """A choice is a short word without marks of a sentence."""
    return (F.length(word) <= LONGEST_CHOICE) & ~word.rlike("[。；;（）():：]")


def _choices(listed: Column) -> Column:
    """The choices of a listing: its words up to the last short one, instructions left out. Null where
    a word is no choice, where the first is an instruction, or where they are too few or too many."""
    bare = F.transform(F.split(listed, r"[/／|、,，]"), lambda x: F.regexp_replace(x, r"^[\s\u3000]+|(?:[（(][^（）()]*[）)])?[\s\u3000。；;]*$", ""))
    words = F.filter(bare, lambda x: ~x.isin("", "等", "等等", "其他等"))
    last = F.array_max(F.transform(words, lambda x, i: F.when(F.length(x) <= LONGEST_CHOICE, i + 1)))
    choices = F.filter(F.slice(words, 1, F.coalesce(last, F.lit(0))), lambda x: ~x.rlike(INSTRUCTIONS))
    told = F.coalesce(F.get(words, F.lit(0)).rlike(INSTRUCTIONS), F.lit(False))
    return F.when(F.size(choices).between(2, MOST_CHOICES) & ~told & F.forall(choices, _is_choice), choices)


def options(items: DataFrame, text: str = "how") -> DataFrame:
    """``items`` plus ``options``: the choices that a wording lists, from the first place that has some."""
    found = [_choices(F.regexp_extract(F.col(text), p, 1)) for p in CHOICES]
    return items.withColumn("options", F.coalesce(*found))


def section_diff(old: DataFrame, new: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``change, id, title, old, new`` of Markdown texts by their sections; titles that repeat are told apart by their place among themselves."""
    sides = []
    for docs in (old, new):
        nth = F.row_number().over(Window.partitionBy(id, "title").orderBy("section"))
        sides.append(sections(docs, id, text).withColumn("nth", nth).select(id, "title", "nth", "body"))
    return diff(*sides, [id, "title", "nth"]).drop("nth")


def line_diff(old: DataFrame, new: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``change, id, line, n``: lines of texts that one side has more often than the other."""
    counted = [docs.select(id, F.explode(F.split(F.col(text), r"\r\n|\r|\n", -1)).alias("line"), F.lit(sign).alias("n")) for docs, sign in ((old, -1), (new, 1))]
    got = counted[0].unionByName(counted[1]).groupBy(id, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return got.select(F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), id, "line", F.abs("n").alias("n"))


LABELS = "version string, label string, note string, at timestamp"


def label_version(spark: SparkSession, folder: str, name: str, version: str, label: str = "", note: str = "") -> None:
    """Name a version of a result, or say something about it; the version itself is never touched."""
    if version not in {r["version"] for r in versions(spark, folder, name).select("version").collect()}:
        raise ValueError(f"{name} has no version {version}")
    spark.createDataFrame([(version, label.strip()[:60], note.strip()[:400])], "version string, label string, note string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/{name}_labels")


def versions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``version, at, n_bytes, label, note`` of a result that ``sources.write_table`` wrote, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
    version = F.regexp_extract("path", r"/(v[0-9]{17}-[0-9a-f]{6})/[^/]+$", 1)
    found = files.groupBy(version.alias("version")).agg(F.max("modificationTime").alias("at"), F.sum("length").alias("n_bytes")).where("version <> ''")
    if times(spark, f"{folder}/{name}_labels") is None:
        told = spark.createDataFrame([], LABELS)
    else:
        told = spark.read.schema(LABELS).parquet(f"{folder}/{name}_labels")
    # of several the newest that says something
    last = told.groupBy("version").agg(*[F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("at"))).alias(c) for c in ("label", "note")])
    return found.join(last, "version", "left").select("version", "at", "n_bytes", "label", "note").orderBy(F.desc("version"))


def stale(spark: SparkSession, inputs: list[str], output: str) -> bool:
    """Whether an input was written after the output's oldest file, or the output is missing."""
    made = times(spark, output)
    return made is None or any(found and found[1] > made[0] for found in (times(spark, p) for p in inputs))


def assemble(title: str, parts: list[tuple[str, DataFrame | str]], sources: list[str] = ()) -> str:
    """A Markdown report: a heading, each part as text or table, and where the figures are from."""
    body = [f"# {title}"]
    for head, part in parts:
        body += [f"## {head}", part if isinstance(part, str) else markdown(part)]
    if sources:
        body += ["## Sources", "\n".join(f"- {x}" for x in sources)]
    return "\n\n".join(body) + "\n"


def frame(spark: SparkSession, result: dict) -> DataFrame:
    """The numbers of a result as ``name, value`` rows."""
    rows = [(k, float(v)) for k, v in result.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "name string, value double")
