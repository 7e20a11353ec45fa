"""De-identification with numbered placeholders, consistent within a scope.

Entities are found by ordered patterns on Spark columns, numbered by first appearance,
and put in by one pass over each text, so a placeholder is never searched again and a
value inside a longer one is never touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.operators.matching import occurrences, replaced_each, replaced_in

# Kinds of direct identifiers with pattern (its group is what is replaced) and
# confidence, in the order in which they claim text. Labelled numbers come before bare ones.
DIRECT = {
    "身份证": (r"(?<!\d)(\d{17}[\dXx])(?!\d)", "high"),
    "邮箱": (r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "high"),
    "QQ": (r"(?i:QQ|扣扣)\s*(?:群|号)?\s*(?:是|为|[:：])?\s*(\d{5,12})", "high"),
    "微信": (r"(?i:微信|wechat|vx)\s*(?:号|ID)?\s*(?:是|为|[:：])?\s*([A-Za-z][\w\-]{5,19})", "high"),
    "编号": (r"(?:学号|工号|员工号|工牌)\s*[:：]?\s*([A-Za-z0-9\-]{4,20})", "high"),
    "手机": (r"(?<![\d０-９])([1１][3-9３-９][\d０-９][\s\-\u3000\uff0d\u2010-\u2015\u2212\uff0e\u3002]?[\d０-９]{4}[\s\-\u3000\uff0d\u2010-\u2015\u2212\uff0e\u3002]?[\d０-９]{4})(?![\d０-９])", "high"),
    "卡号": (r"(?<!\d)(\d{16,19})(?!\d)", "mid"),
    "座机": (r"(?<!\d)(0\d{2,3}[- ]?\d{7,8})(?!\d)", "mid"),
    "车牌": (r"([京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-Z0-9]{5})", "mid"),
    "昵称": (r"(?:昵称|网名)\s*[:：]\s*([\w\u4e00-\u9fa5\-]{2,20})", "mid"),
}
# Cities and quasi-identifiers, which are reported and never replaced.
CITIES = (
    "北京", "上海", "广州", "深圳", "杭州", "南京", "成都", "重庆", "武汉", "西安",
    "苏州", "天津", "长沙", "郑州", "青岛", "宁波", "东莞", "沈阳", "合肥", "佛山",
    "无锡", "济南", "大连", "福州", "厦门", "哈尔滨", "昆明", "南昌", "贵阳", "石家庄",
    "太原", "南宁", "兰州", "长春", "常州", "泉州", "温州", "徐州", "烟台",
)
QUASI = {
    "年龄": r"(?<!\d)(\d{1,2}\s*(?:岁|周岁))",
    "具体单位": r"([\u4e00-\u9fa5]{2,12}(?:大学|学院|学校|公司|集团|医院|银行|研究所|研究院|工作室|事业部))",
    "精确收入": r"((?<![\d.])\d{1,3}(?:\.\d)?\s*[kK千]\b|(?<![\d.])\d{4,7}\s*(?:元|块|万))",
    "具体日期": r"(\d{4}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?)",
    "门牌地址": r"([\u4e00-\u9fa5]{2,10}(?:路|街|巷|小区|大厦|公寓|号楼|单元)\s*[\dA-Za-z\-]*号?)",
    "行政区": r"([\u4e00-\u9fa5]{2,4}(?:区|县|镇|街道)(?!别|域|分|间|块))",
    "可识别特征": r"((?:我们(?:部门|组|团队|班)就(?:我)?一(?:个|名)|全公司只有我|我们那届只有))",
    "城市": f"({'|'.join(CITIES)})",
}
#: The most common family names, in order of their frequency in the survey that the
#: Chinese Academy of Sciences published in 2006; a hundred a line. A parameter wherever it is used.
SURNAMES = (
    "李王张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐沿梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强柴华车冉房边"
)
#: Family names of two characters.
LONG_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "司徒", "令狐", "夏侯", "宇文", "长孙", "端木", "轩辕", "南宫", "独孤", "闻人", "申屠", "呼延", "澹台")
#: Words that begin like a name and are none.
NOT_NAMES = (
    "时候", "时间", "时长", "时段", "时代", "方法", "方式", "方便", "方面", "高兴", "江湖", "金额", "白天", "常常", "万一", "于是", "任何", "任务", "何时", "马上", "黄色", "石头", "文件", "文化",
    "康复", "安排", "安全", "安装", "安静", "管理", "关系", "关于", "关注", "单位", "单身", "成绩", "成功", "成本", "成员", "解释", "解决", "向上", "华为", "强调", "强烈", "强度", "路上", "路线", "位置",
    "阳光", "包括", "包含", "车辆", "边缘", "查看", "查询", "司机", "曲线", "游戏", "左右", "齐全", "牛奶", "温度", "季度", "景点", "薄弱", "卫生", "莫名", "申请", "房间", "费用", "席位", "项目", "章节", "施工", "尤其", "盛行",
)
HAN = "\\u4e00-\\u9fa5"

# Patterns whose group is a name that its context gives away. %s is a known family
# name. Own: the fifth ends where the Han characters end, so that no sentence is cut for a name.
NAME_PATTERNS = (
    r"(?m)^(%s[\u4e00-\u9fa5]{1,2})\s*[:：]",
    r"(?:我叫|我是|我姓|姓|名叫|叫)\s*(%s[\u4e00-\u9fa5]{1,2})",
    r"(?:记录人?|访谈者|访谈对象|受访者|被访者|主持人|记录)\s*[:：]\s*(%s[\u4e00-\u9fa5]{1,2})",
    r"(%s[\u4e00-\u9fa5]{1,2})\s*(?:老师|同学|先生|女士|小姐|经理|主任|医生|教授|店长|主管|队长)",
    r"(?:受访者|被访者|被试|访谈对象)\s*[:：]\s*([\u4e00-\u9fa5]{2,4})(?![\u4e00-\u9fa5])",
    r"(%s[\u4e00-\u9fa5]{1,2})\s*(?:说|提到|表示|认为)\s*[:：]",
    r"(?:姓名|名字|全名)\s*[:：]\s*([^\s:：,，;；|]{2,5})",
    r"(?m)^(?:[A-Za-z]{0,3}\d{1,4}[\s、.,，-]+)?(%s[\u4e00-\u9fa5]{1,2})\s+(?:男|女|\d{1,2}\s*岁)",
)


def name_patterns(surnames: str = SURNAMES) -> list[str]:
    """The patterns with ``surnames`` (one character each) and the family names of two put in."""
    known = f"(?:{'|'.join(LONG_SURNAMES)}|[{surnames}])"
    return [p.replace("%s", known) for p in NAME_PATTERNS]


def contact_names(text: Column, surnames: str = SURNAMES) -> Column:
    """Of each line with a direct identifier its name, if just one word on it can be one."""
    contact = "|".join(f"(?:{p})" for p, _ in DIRECT.values())
    word = F.lit(rf"(?<![{HAN}])((?:{'|'.join(LONG_SURNAMES)}|[{surnames}])[{HAN}]{{1,2}})(?![{HAN}])")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(contact))
    names = F.transform(lines, lambda x: F.filter(F.array_distinct(F.regexp_extract_all(x, word, F.lit(1))), lambda w: ~w.isin(*NOT_NAMES, *CITIES)))
    return F.flatten(F.filter(names, lambda x: F.size(x) == 1))


def _cells(line: Column) -> Column:
    """Cells of a line of a table inside a text: between bars, tabs or commas."""
    bars = F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")
    cells = F.when(F.trim(line).startswith("|"), bars).when(line.contains("\t"), F.split(line, "\t")).when(line.contains(","), F.split(line, ",")).otherwise(F.array().cast("array<string>"))
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


#: What a cell under a header must look like to be replaced.
CELL_VALUES = {"姓名": None, "编号": r"\d{6,20}", "手机": r"1[3-9]\d{9}", "邮箱": r"[\w.+-]+@[\w.-]+\.\w+", "QQ": r"\d{5,12}", "微信": r"[A-Za-z][\w-]{4,19}", "身份证": r"\d{17}[\dXx]"}


def table_entities(docs: DataFrame, id: str = "doc_id", text: str = "text", surnames: str = SURNAMES, header_lines: int = 20) -> DataFrame:
    """``id, kind, value``: cells of tables inside texts, by the header above them.

    A header is the first of a text's first lines with two identifying columns or more. A
    cell counts if it looks like its column's kind, so that data columns stay.
    """
    kinds = F.transform(F.col("cells"), lambda c: header_kind(c))
    lines = docs.select(F.col(id), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^\s*\||\t|,"))
    lines = lines.select(id, "line_no", _cells(F.col("line")).alias("cells"))
    heads = lines.where(F.col("line_no") < header_lines).withColumn("kinds", kinds).where(F.size(F.filter("kinds", lambda k: k.isNotNull())) >= 2)
    heads = heads.groupBy(id).agg(F.min(F.struct("line_no", "kinds")).alias("head"))
    cells = lines.join(heads, id).where(F.col("line_no") > F.col("head.line_no")).select(id, "head.kinds", F.posexplode("cells").alias("k", "value"))
    cells = cells.withColumn("kind", F.try_element_at("kinds", F.col("k") + 1)).where("kind is not null")
    looks = F.coalesce(*[F.when(F.col("kind") == kind, F.col("value").rlike(f"^(?:{p or f'[{surnames}][{HAN}]{{1,3}}'})$")) for kind, p in CELL_VALUES.items()], F.lit(False))
    return cells.where(looks).select(id, "kind", "value")


def entity_key(kind: Column, value: Column) -> Column:
    """One key for the spellings of a number: half width, without separators."""
    half = F.translate(value, "０１２３４５６７８９", "0123456789")
    return F.when(kind.isin("手机", "座机"), F.regexp_replace(half, r"[^0-9]", "")).otherwise(value)


def _found(text: Column, kind: str, pattern: str, confidence: str) -> Column:
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(confidence).alias("confidence")))


def entities(docs: DataFrame, id: str = "doc_id", text: str = "text", names: bool = True, kinds: dict = DIRECT, surnames: str = SURNAMES, tables: bool = False) -> DataFrame:
    """``id, kind, value, key, confidence, n, first``: each value found, once per document.

    Kinds claim text in their order; what one has claimed is not looked at by the next.
    ``n`` counts all its places in the text and ``first`` is the first: what a clue gives
    away once is known in the whole text. ``tables`` also looks into tables inside texts.
    """
    body = F.col(text)
    none = F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit("").alias("confidence"))), lambda s: F.lit(False))
    parts, rest = [], body
    for kind, (pattern, confidence) in kinds.items():  # what one kind has claimed, the next ones don't see
        parts.append(_found(rest, kind, pattern, confidence))
        rest = F.regexp_replace(rest, pattern, "\u0001")
    parts = [F.when(body.rlike(rf"[0-9@０-９{HAN}]|(?i:wechat|vx)"), F.concat(*parts)).otherwise(none)]
    if names:
        values = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in name_patterns(surnames)], contact_names(body, surnames))
        values = F.filter(values, lambda v: ~v.isin(*NOT_NAMES, *CITIES))
        parts.append(F.when(body.rlike(f"[{HAN}]"), F.transform(values, lambda v: F.struct(F.lit("姓名").alias("kind"), v.alias("value"), F.lit("mid").alias("confidence")))).otherwise(none))
    rank = {k: i for i, k in enumerate([*kinds, "姓名"])}
    rows = docs.select(F.col(id), F.explode(F.array_distinct(F.concat(*parts))).alias("e")).select(id, "e.*")
    if tables:
        rows = rows.unionByName(table_entities(docs, id, text, surnames).withColumn("confidence", F.lit("mid")))
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for k, i in rank.items()], F.lit(len(rank)))
    got = rows.where(F.length("value") > 1).groupBy(id, "value").agg(F.min(F.struct(order.alias("o"), "kind", "confidence")).alias("b"))
    places = docs.select(F.col(id).alias("_id"), body.alias("_t"))
    got = got.join(places, F.col(id) == F.col("_id")).withColumn("first", F.expr("instr(_t, value)"))
    n = ((F.length("_t") - F.length(F.replace(F.col("_t"), F.col("value"), F.lit("")))) / F.length("value")).cast("long")
    return got.select(id, F.col("b.kind").alias("kind"), "value", entity_key(F.col("b.kind"), F.col("value")).alias("key"), F.col("b.confidence").alias("confidence"), n.alias("n"), "first")


def numbered(found: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``found`` plus ``placeholder``: ``[kind N]`` by first appearance within the scope."""
    firsts = found.groupBy(*scope, "kind", "key").agg(F.min(F.struct(*order)).alias("_f"))
    place = F.row_number().over(Window.partitionBy(*scope, "kind").orderBy("_f", "key"))
    named = firsts.select(*scope, "kind", "key", F.format_string("[%s%d]", "kind", place).alias("placeholder"))
    return found.join(named, [*scope, "kind", "key"])


def replaced(docs: DataFrame, mapping: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each document's values replaced in one pass: from left to right, the longest of
    those that begin at one place, so that no two replaced places overlap.

    ``mapping``: ``id, value, placeholder``. What was put in is not looked at again.
    """
    per_doc = mapping.groupBy(id).agg(F.array_distinct(F.collect_list(F.struct("value", "placeholder"))).alias("_map"))
    joined = docs.join(per_doc, id, "left")
    new = F.when(F.col("_map").isNotNull(), replaced_each(F.col(f"`{text}`"), F.col("_map.value"), F.col("_map.placeholder"))).otherwise(F.col(f"`{text}`"))
    return joined.withColumn(text, new).select(*docs.columns)


def deidentify(docs: DataFrame, id: str = "doc_id", text: str = "text", names: bool = True, tables: bool = True, rules: str = "") -> tuple[DataFrame, DataFrame]:
    """Texts with placeholders numbered within each document, and the mapping with counts.

    ``rules`` (``parse_rules``) come before all patterns: their replacements are made first, values
    they name the kind of are numbered with that kind, places of records are taken as they
    say, and what they leave alone stays in the text and is no entity. A rule that can't be
    read raises, since a rule that does nothing looks like one that did.
    """
    told = understood(rules)
    texts = apply_rules(docs, "\n".join(f"{a} = {b}" for a, b in told.pairs), text, told.ignored) if told.pairs else docs
    found = entities(texts, id, text, names, tables=tables)
    columns = found.columns
    named = [*told.named, *[(v, None) for v in told.ignored]]
    if named:
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(v,) for v, _ in named], "value string")), "value", "left_anti")
        found = found.unionByName(_told_entities(texts, [(v, k) for v, k in named if k], id, text).select(*columns))
    if told.places:
        at = place_entities(texts, told.places, id, text)
        found = found.join(at.where("kind is null").select(id, "value"), [id, "value"], "left_anti")
        placed = at.where("kind is not null")
        found = found.join(placed.select(id, "value"), [id, "value"], "left_anti").unionByName(placed.select(*columns))
    mapping = numbered(found.select(*columns), [id], ["first"])
    kept = mapping.select(id, "value", "placeholder")
    if told.ignored:  # what is left alone is matched and put back, so that nothing inside it is replaced
        alone = docs.sparkSession.createDataFrame([(v,) for v in told.ignored], "word string")
        kept = kept.unionByName(occurrences(texts, alone, [id], text).select(id, F.col("word").alias("value"), F.col("word").alias("placeholder")))
    return replaced(texts, kept, id, text), mapping.select(id, "kind", "value", "placeholder", "n", "confidence")


def _told_entities(docs: DataFrame, told: list[tuple[str, str]], id: str, text: str) -> DataFrame:
    kinds = docs.sparkSession.createDataFrame(told, "value string, kind string")
    hits = occurrences(docs, kinds.withColumnRenamed("value", "word"), [id], text).withColumnRenamed("word", "value").join(F.broadcast(kinds), "value")
    where = hits.join(docs.select(id, F.col(text).alias("_t")), id)
    return where.select(id, "kind", "value", entity_key(F.col("kind"), F.col("value")).alias("key"), F.lit("high").alias("confidence"), "n", F.expr("instr(_t, value)").alias("first"))


def place_entities(docs: DataFrame, places: dict[int, str | None], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, kind, value, key, confidence, n, first`` of what stands at the named places of records.

    Records are the lines of a text with as many words as most of its lines with two words or
    more have; a place without kind is one to leave alone, and its kind is null.
    """
    lines = docs.select(id, F.col(text).alias("_t"), F.explode(F.split(F.col(text), r"\r?\n")).alias("line"))
    lines = lines.withColumn("words", F.split(F.trim("line"), r"[\s,，;；|\t]+")).withColumn("size", F.size("words")).where("size > 1")
    usual = lines.groupBy(id, "size").agg(F.count("*").alias("c")).groupBy(id).agg(F.max(F.struct("c", "size")).alias("m")).select(id, F.col("m.size").alias("size"))
    which = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(kind).cast("string").alias("kind")) for k, kind in places.items()])
    at = lines.join(usual, [id, "size"]).select(id, "_t", "words", F.explode(which).alias("p"))
    at = at.select(id, "_t", "p.kind", F.try_element_at("words", F.col("p.place") + 1).alias("value")).where("value <> ''")
    n = ((F.length("_t") - F.length(F.replace(F.col("_t"), F.col("value"), F.lit("")))) / F.length("value")).cast("long")
    at = at.groupBy(id, "value").agg(F.max("kind").alias("kind"), F.first("_t").alias("_t"))
    return at.select(id, "kind", "value", entity_key(F.col("kind"), F.col("value")).alias("key"), F.lit("high").alias("confidence"), n.alias("n"), F.expr("instr(_t, value)").alias("first"))


def report(mapping: DataFrame) -> DataFrame:
    """``kind, confidence, n_values, n_hits`` over all documents."""
    return mapping.groupBy("kind", "confidence").agg(F.count_distinct("value").alias("n_values"), F.sum("n").alias("n_hits"))


def quasi_report(docs: DataFrame, text: str = "text", patterns: dict = QUASI) -> DataFrame:
    """``kind, value, n, n_docs`` of quasi-identifiers; nothing is replaced."""
    found = F.concat(*[_found(F.col(text), k, p, "low") for k, p in patterns.items()])
    rows = docs.select(F.monotonically_increasing_id().alias("_r"), F.explode(found).alias("e"))
    return rows.groupBy("e.kind", "e.value").agg(F.count("*").alias("n"), F.count_distinct("_r").alias("n_docs"))


@dataclass
class Rules:
    """Custom rules, understood: what to replace, values of a known kind, what to leave alone, and
    what is at a place of a record."""

    pairs: list[tuple[str, str]] = field(default_factory=list)
    named: list[tuple[str, str]] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    places: dict[int, str | None] = field(default_factory=dict)
    odd: list[str] = field(default_factory=list)


#: Kinds that a directive may name, and the one each stands for.
TOLD_KINDS = {"手机": "手机", "手机号": "手机", "QQ": "QQ", "qq": "QQ", "微信": "微信", "微信号": "微信", "邮箱": "邮箱", "姓名": "姓名", "编号": "编号", "学号": "编号", "工号": "编号", "身份证": "身份证"}


def parse_rules(text: str) -> Rules:
    """Rules as lines ``src = dst`` (an empty dst deletes) and directives behind ``!``:
    ``不用管 X`` leaves X alone, ``这是K X`` says that X is of kind K, ``第N段是K`` and
    ``第N段不用管`` say what the N-th place of a record is. Other lines are odd."""
    out = Rules()
    for line in filter(None, map(str.strip, text.splitlines())):
        told = re.sub(r"\s+", " ", line[1:]).strip().removesuffix("=").strip() if line[0] in "!！" else None
        if told is None:
            src, equals, dst = (x.strip() for x in line.partition("="))
            (out.pairs.append((src, dst)) if src and equals else out.odd.append(line))
        elif m := re.fullmatch(r"(?:不用管|不管|保留) ?(?P<value>.+)", told):
            out.ignored.append(m["value"])
        elif (m := re.fullmatch(r"这是(?P<kind>[^ ]+) (?P<value>.+)", told)) and m["kind"] in TOLD_KINDS:
            out.named.append((m["value"], TOLD_KINDS[m["kind"]]))
        elif (m := re.fullmatch(r"第 ?(?P<n>\d+) ?段 ?(?:[是为] ?(?P<kind>[^ ]+)|不用管|别管|不是标识符)", told)) and m["n"] != "0" and (m["kind"] is None or m["kind"] in TOLD_KINDS):
            out.places[int(m["n"]) - 1] = TOLD_KINDS.get(m["kind"])
        else:
            out.odd.append(line)
    return out


def understood(rules: str) -> Rules:
    """Rules of which every line can be carried out."""
    told = parse_rules(rules)
    if told.odd:
        raise ValueError("rules that nothing can carry out: " + "; ".join(told.odd))
    return told


def apply_rules(docs: DataFrame, rules: str, text: str = "text", ignored: tuple[str, ...] | list[str] = (), count: str | None = None) -> DataFrame:
    """The replacements of the rules, all in one pass over each text: from left to right, the longest
    of those that begin at one place. What is to be left alone stays, with all inside it.
    Values of a told kind and places need ``deidentify``, which numbers them, and raise here."""
    told = understood(rules)
    if told.named or told.places:
        raise ValueError("kinds of values and places need deidentify")
    new = {}
    for src, dst in told.pairs:
        new.setdefault(src, dst)  # of two rules for one text the first counts
    return replaced_in(docs, new | {v: v for v in [*told.ignored, *ignored]}, text, count)


def rule_hits(docs: DataFrame, rules: str, text: str = "text") -> DataFrame:
    """``rule, n_docs, n``: every replacement, named value and value left alone with the number of its
    places in the texts; those without one are 0, so that a rule in vain is seen."""
    told = understood(rules)
    words = [*dict.fromkeys([*(a for a, _ in told.pairs), *(a for a, _ in told.named), *told.ignored])]
    every = docs.sparkSession.createDataFrame([(w,) for w in words], "rule string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    hits = occurrences(rows, every, ["row"], "text", "rule").groupBy(F.col("word").alias("rule")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    return every.join(hits, "rule", "left").select("rule", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n", F.lit(0)).alias("n"))


def ambiguous_numbers(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mobile-like numbers on lines that speak of QQ or WeChat: ``id, line_no, value``."""
    lines = docs.select(id, F.posexplode(F.split(F.col(text), r"\n", -1)).alias("line_no", "line")).where(F.col("line").rlike("(?i)QQ|扣扣|微信|wechat|vx"))
    return lines.select(id, "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![0-9])(1[3-9][0-9]{9})(?![0-9])"), F.lit(1))).alias("value")).distinct()


def missed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digit runs of identifier length that no rule claimed: ``id, value``."""
    pattern = r"(?<![0-9０-９])([0-9０-９][0-9０-９\s\-－．.]{6,20}[0-9０-９])(?![0-9０-９])"
    seen = docs.select(id, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("value")).distinct()
    known = entities(docs, id, text, names=False).select(id, "value")
    return seen.join(known, [id, "value"], "left_anti")


# Words in headers and keys that name an identifier, first match first.
HEADER_WORDS = {
    "姓名": ("姓名", "名字", "受访者", "被访者", "联系人", "称呼", "name"),
    "编号": ("学号", "学籍号", "工号"),
    "手机": ("手机", "电话", "联系方式", "联系电话", "phone", "mobile"),
    "邮箱": ("邮箱", "email", "e-mail", "邮件", "mail"),
    "QQ": ("qq",),
    "微信": ("微信", "wechat"),
    "身份证": ("身份证", "idcard"),
}


def header_kind(name: Column) -> Column:
    """The kind of identifier that a header names, or null."""
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), kind) for kind, words in HEADER_WORDS.items()])


def kind_of_header(name: str) -> str | None:
    low = name.strip().lower()
    return next((k for k, words in HEADER_WORDS.items() if any(w in low for w in words)), None)


def mask_columns(df: DataFrame, salt: str) -> DataFrame:
    """Columns whose header names an identifier, as keyed placeholders that keep equality."""
    out = {}
    for c in df.columns:
        kind = kind_of_header(c)
        if kind:
            v = F.col(f"`{c}`").cast("string")
            out[c] = F.when(F.trim(v) != "", F.concat(F.lit(f"[{kind}"), F.substring(F.sha2(F.concat(F.lit(salt), F.trim(v)), 256), 1, 10), F.lit("]"))).otherwise(v)
    return df.withColumns(out) if out else df


def mask_json(c: Column, keys: tuple[str, ...], mask: str = "***") -> Column:
    """JSON text with the values of the named keys masked, strings and numbers alike."""
    out = c
    for k in keys:
        out = F.regexp_replace(out, rf'("{re.escape(k)}"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*)', f'$1"{mask}"')
    return out


def guard(docs: DataFrame, id: str = "doc_id", text: str = "text", acknowledged: DataFrame | None = None) -> DataFrame:
    """Documents that still hold precise identifiers, ``id, kind, n``, without those that were
    acknowledged or whose id says that they are de-identified."""
    kinds = {k: DIRECT[k] for k in ("身份证", "邮箱", "QQ", "微信", "编号", "手机")}
    rows = docs.where(~F.col(id).cast("string").rlike("脱敏|deident|anonym"))
    if acknowledged is not None:
        rows = rows.join(acknowledged.select(id), id, "left_anti")
    return entities(rows, id, text, names=False, kinds=kinds).groupBy(id, "kind").agg(F.sum("n").alias("n"))


def detect_layout(lines: list[str], sample: int = 3) -> dict:
    """How a sheet of contacts is laid out, from its first records: ``block`` (blank lines
    between records), ``line`` (one record a line) or ``unknown``, with the kind at each place."""
    checks = {"手机": r"1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}", "邮箱": r"[\w.+-]+@[\w.-]+\.\w+", "身份证": r"\d{17}[\dXx]", "姓名": rf"[{SURNAMES}][一-龥]{{1,2}}"}
    blocks = [b.split("\n") for b in re.split(r"\n\s*\n", "\n".join(lines).strip()) if b.strip()]
    style = "block" if len(blocks) > 1 and all(len(b) > 1 for b in blocks[:sample]) else "line"
    records = blocks if style == "block" else [re.split(r"[\s,，;；|\t]+", x.strip()) for x in lines if x.strip()]
    places = []
    for k in range(max(map(len, records[:sample]), default=0)):
        values = [re.sub(r"^[^:：]{1,8}[:：]\s*", "", r[k]).strip() for r in records[:sample] if k < len(r)]
        votes = {kind: sum(bool(re.fullmatch(p, v)) for v in values) for kind, p in checks.items()}
        best = max(votes, key=votes.get)
        places.append({"place": k, "kind": best if votes[best] else None, "agree": votes[best], "seen": len(values)})
    known = any(p["kind"] for p in places)
    return {"style": style if known else "unknown", "records": len(records), "places": places, "uncertain": [p["place"] for p in places if p["kind"] and p["agree"] < p["seen"]]}


def apply_layout(lines: DataFrame, layout: dict, line: str = "line", order: str = "line_no", confirmed: dict[int, str | None] | None = None) -> DataFrame:
    """Lines of a sheet with the identifying places of each record replaced by their kind.

    One record a line: places are words of the line. Blocks between blank lines: places are
    lines of the block, a label before a colon stays; ``order`` numbers the lines of one
    sheet. ``confirmed`` (place: kind, or None to leave it) overrides what was detected.
    A sheet of unknown layout raises, since passing it on would pass on what it holds.
    """
    kinds = {p["place"]: p["kind"] for p in layout["places"]} | (confirmed or {})
    kinds = {k: v for k, v in kinds.items() if v}
    if layout["style"] == "unknown" and not kinds:
        raise ValueError("the layout is unknown: name the places to replace")

    def mask(value: Column, place: Column) -> Column:
        return F.coalesce(*[F.when(place == k, F.lit(f"[{kind}]")) for k, kind in kinds.items()], value) if kinds else value

    if layout["style"] != "block":
        parts = F.split(F.trim(F.col(line)), r"[\s,，;；|\t]+")
        return lines.withColumn(line, F.array_join(F.transform(parts, mask), " "))
    sheet = [c for c in lines.columns if c not in (line, order)]
    blank = F.trim(F.col(line)) == ""
    block = F.count_if(blank).over(Window.partitionBy(*sheet).orderBy(order))
    place = F.row_number().over(Window.partitionBy(*sheet, "_block", blank).orderBy(order)) - 1
    label = F.regexp_extract(F.col(line), r"^([^:：]{1,8}[:：]\s*)", 1)
    new = F.when(blank, F.col(line)).otherwise(mask(F.col(line), F.col("_place")))
    new = F.when(new.startswith("[") & (new != F.col(line)), F.concat(label, new)).otherwise(new)
    return lines.withColumn("_block", block).withColumn("_place", place).withColumn(line, new).select(*lines.columns)


ACKNOWLEDGED = "id string, note string, at timestamp"


def acknowledge(spark: SparkSession, path: str, id: str, note: str = "") -> None:
    """Add a document to the table of those whose identifiers were seen and accepted."""
    now = spark.range(1).select(F.lit(id).alias("id"), F.lit(note).alias("note"), F.current_timestamp().alias("at"))
    now.write.mode("append").parquet(path)


def acknowledged(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """The newest ``most`` acknowledgements, one for each document."""
    rows = spark.read.schema(ACKNOWLEDGED).parquet(path)
    return rows.groupBy("id").agg(F.max_by("note", "at").alias("note"), F.max("at").alias("at")).orderBy(F.desc("at"), "id").limit(most)


def numbered_by_sequence(found: DataFrame, docs: DataFrame, sequence: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` plus ``placeholder`` named by where an entity first stands: its document's
    ``sequence`` value, or ``#`` and the line; several of a kind there get a, b, ..."""
    where = docs.select(id, F.col(text).alias("_t"), *([F.col(sequence).cast("string").alias("_s")] if sequence else []))
    line = F.concat(F.lit("#"), (F.length(F.substring(F.col("_t"), F.lit(1), F.col("first"))) - F.length(F.replace(F.substring(F.col("_t"), F.lit(1), F.col("first")), F.lit("\n"), F.lit(""))) + 1).cast("string"))
    at = found.join(where, id).withColumn("_at", F.col("_s") if sequence else line)
    firsts = at.groupBy(id, "kind", "key").agg(F.min(F.struct("first", "_at")).alias("_f"))
    firsts = firsts.withColumn("_at", F.col("_f._at"))
    order = Window.partitionBy(id, "kind", "_at").orderBy("_f", "key")
    several = F.count("*").over(Window.partitionBy(id, "kind", "_at")) > 1
    n = F.row_number().over(order)
    suffix = F.when(several, F.when(n <= 26, F.char(n + 96)).otherwise(n.cast("string"))).otherwise("")
    named = firsts.select(id, "kind", "key", F.format_string("[%s%s%s]", "kind", "_at", suffix).alias("placeholder"))
    return found.join(named, [id, "kind", "key"])
