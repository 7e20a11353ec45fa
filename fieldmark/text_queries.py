"""Registered queries of the text, coding and form operators, with their SQL.

The tables hold no Han text, so each row of a whole table is put into a Han sentence,
transcript, sheet or form; the SQL says what the operator must find in it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import banded_number, clean_columns, format_p, label_order, number
from fieldmark.operators import coding, compare, deident, factor, impute, mediate, prep, regress
from fieldmark.operators.gram import gram
from fieldmark.operators.ranks import kendall
from fieldmark.plans import ordered, report, screening
from fieldmark.plans.analyze import introspect
from fieldmark.queries import numbers, query, table
from fieldmark.sources import tables

# transcripts: each conversation is one interview, its turns lines of speakers

LINES = r"""
WITH l AS (SELECT conv_id, turn, 'P' || role AS label, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)
"""


def transcripts(spark, sf_dir):
    body = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.concat(F.lit("P"), "role", F.lit("："), body).alias("line"))


@query(LINES + "SELECT conv_id, 0::BIGINT AS session, label AS speaker, body AS text FROM l WHERE body <> ''")
def transcript_segments(spark, sf_dir):
    return coding.segments(transcripts(spark, sf_dir), "conv_id").select("conv_id", "session", "speaker", "text")


@query(LINES + "SELECT conv_id, min_by(label, turn) AS speaker FROM l WHERE body <> '' GROUP BY 1")
def interviewer_by_first(spark, sf_dir):
    lines = transcripts(spark, sf_dir)
    return coding.interviewers(lines, coding.segments(lines, "conv_id"), id="conv_id")


@query(LINES + ", f AS (SELECT conv_id, min_by(label, turn) AS label FROM l WHERE body <> '' GROUP BY 1) SELECT l.conv_id, l.label AS speaker, body AS text FROM l ANTI JOIN f ON l.conv_id = f.conv_id AND l.label = f.label WHERE length(body) >= 60")
def usable_segments(spark, sf_dir):
    lines = transcripts(spark, sf_dir)
    units = coding.segments(lines, "conv_id")
    return coding.usable(units, coding.interviewers(lines, units, id="conv_id"), 60, id="conv_id").select("conv_id", "speaker", "text")


@query("SELECT conv_id, count(*) AS n_separators, 0::BIGINT AS n_labels FROM conversations WHERE turn % 3 = 2 GROUP BY 1")
def merged_transcripts(spark, sf_dir):
    lines = transcripts(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 3 == 2, "-----").otherwise(F.col("line")))
    return coding.merged(lines, "conv_id")


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS part FROM documents)
SELECT doc_id, count(*) AS n, sum(length(trim(part, ' ')))::BIGINT AS n_chars FROM p WHERE trim(part, ' ') <> '' GROUP BY 1
""")
def document_paragraphs(spark, sf_dir):
    got = coding.paragraphs(table(spark, sf_dir, "documents"))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


#: What a turn says, by number: signals, commonplaces, fillers and something identifying.
SAID = ("我觉得后来大家都变了，因为当时没有别的办法", "一般都是这样，反正是差不多都那么过来的吧", "嗯", "我发现其实以前和现在完全不是一回事，所以才会这样想", "好的", "我当时的电话是13900001111，后来换了", "他说有一次加班到很晚，结果第二天还是照常上班", "平时就看看手机")
SCORES = (2, -3, 0, 6, 0, 0, 3, 0)


def said(spark, sf_dir):
    which = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", which.alias("text"))


@query(f"SELECT conv_id, turn, ([{', '.join(map(str, SCORES))}])[((conv_id + turn) % {len(SAID)} + 1)::INT] AS score FROM conversations")
def quote_scores(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", coding.quote_score(F.col("text")).alias("score"))


WORDS = ("加班", "上班", "手机", "电话", "办法", "大家", "第二天", "没说过")


@query(f"""
WITH s AS (SELECT ([{", ".join(f"'{x}'" for x in SAID)}])[((conv_id + turn) % {len(SAID)} + 1)::INT] AS text FROM conversations)
SELECT word, count(*) AS n_segments, count(*)::BIGINT AS n FROM s JOIN (SELECT unnest([{", ".join(f"'{w}'" for w in WORDS)}]) AS word) w ON contains(s.text, w.word) GROUP BY 1
""")
def keyword_segments(spark, sf_dir):
    lexicon = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return coding.keyword_hits(said(spark, sf_dir), lexicon, ["conv_id", "turn"])


# coded sheets: each document is a row, its source the speaker

SHEET = """
WITH s AS (SELECT doc_id AS no, CASE WHEN doc_id % 11 = 0 THEN '—' ELSE source END AS speaker, text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS code,
                  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'c' || (length(lang || source) + ascii(lang)) % 4 END AS category, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 't9' ELSE 't' || (length(lang || source) + ascii(lang)) % 4 % 2 END AS theme FROM documents),
r AS (SELECT * FROM s WHERE speaker <> '—')
"""


def sheet(spark, sf_dir):
    category = F.concat(F.lit("c"), ((F.length(F.concat("lang", "source")) + F.ascii("lang")) % 4).cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("no"), F.when(F.col("doc_id") % 11 == 0, "—").otherwise(F.col("source")).alias("speaker"), "text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("codes"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(category).alias("categories"), F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 3 == 0, "t9").otherwise(F.concat(F.lit("t"), (F.substring(category, 2, 1).cast("int") % 2).cast("string"))).alias("themes"),
    )
    return coding.coded(rows)


@query(SHEET + "SELECT count(*) AS n, count(*) FILTER (code <> '') AS n_codes, count(*) FILTER (category <> '') AS n_categories, count(*) FILTER (theme <> '') AS n_themes FROM r")
def coding_progress(spark, sf_dir):
    return coding.progress(sheet(spark, sf_dir))


@query(SHEET + "SELECT no, speaker FROM r WHERE code = ''")
def uncoded_rows(spark, sf_dir):
    return coding.uncoded(sheet(spark, sf_dir)).select("no", "speaker")


@query(SHEET + ", m AS (SELECT code AS label, list_sort(list(DISTINCT category)) AS t FROM r WHERE code <> '' AND category <> '' GROUP BY 1) SELECT label, array_to_string(t, '|') AS targets FROM m WHERE len(t) > 1")
def code_conflicts(spark, sf_dir):
    return coding.learned(sheet(spark, sf_dir), "codes", "categories")[1].select("label", F.array_join("targets", "|").alias("targets"))


@query(SHEET + """, m AS (SELECT category AS label, list_sort(list(DISTINCT theme)) AS t FROM r WHERE category <> '' AND theme <> '' GROUP BY 1), f AS (SELECT label, t[1] AS target FROM m WHERE len(t) = 1)
SELECT no, CASE WHEN theme <> '' THEN theme ELSE coalesce(target, '') END AS themes, theme = '' AND target IS NOT NULL AS inferred FROM r LEFT JOIN f ON category = label""")
def theme_inference(spark, sf_dir):
    got = coding.inferred(sheet(spark, sf_dir), "categories", "themes")
    return got.select("no", F.array_join("themes_all", "|").alias("themes"), F.col("is_inferred").alias("inferred"))


@query(SHEET + "SELECT theme, category, count(DISTINCT no) AS n FROM r WHERE category <> '' AND theme <> '' GROUP BY 1, 2")
def theme_categories(spark, sf_dir):
    return coding.theme_by_category(sheet(spark, sf_dir))


@query(SHEET + """, q AS (SELECT theme, no, speaker, text, 1 + CASE WHEN length(text) BETWEEN 16 AND 90 THEN 2 WHEN length(text) < 14 THEN -2 ELSE 0 END - 1 AS score FROM r WHERE theme <> '')
SELECT theme, no, speaker, place FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, length(text) DESC, no)::INT AS place FROM q) WHERE place <= 3""")
def quotes_of_themes(spark, sf_dir):
    return coding.theme_quotes(sheet(spark, sf_dir).withColumn("star", F.lit(False))).select("theme", "no", "speaker", "place")


@query(SHEET + """, t AS (SELECT theme, count(DISTINCT speaker) AS p, count(DISTINCT no) AS s FROM r WHERE theme <> '' GROUP BY 1), v AS (SELECT theme, max(k) / sum(k) AS top FROM (SELECT theme, speaker, count(*) AS k FROM r WHERE theme <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT 'people' AS "check", count(DISTINCT speaker) AS n FROM r UNION ALL SELECT 'low_coverage', count(*) FROM t WHERE p < 2 UNION ALL SELECT 'single_evidence', count(*) FROM t WHERE s = 1
UNION ALL SELECT 'themes_over', greatest(count(*) - 8, 0) FROM t UNION ALL SELECT 'one_voice', count(*) FROM v WHERE top >= 0.8 UNION ALL SELECT 'uncoded', count(*) FROM r WHERE code = ''""")
def coding_health(spark, sf_dir):
    return coding.health(sheet(spark, sf_dir))


@query("SELECT DISTINCT source AS speaker, lang AS label FROM documents")
def speaker_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.array("lang").alias("label"), F.col("source").alias("speaker"), F.col("doc_id").alias("no"))
    return coding.person_labels(rows, "label")


@query("""
WITH v AS (SELECT doc_id AS no, lang AS base, CASE WHEN doc_id % 3 = 0 THEN '【' || lang || '】' WHEN doc_id % 3 = 1 THEN lang || '。' ELSE lang END AS label FROM documents),
n AS (SELECT base, label, count(*) AS k FROM v GROUP BY 1, 2), b AS (SELECT base, label AS best FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k DESC, label) AS p FROM n) WHERE p = 1)
SELECT no, best AS codes FROM v JOIN b USING (base)
""")
def unified_labels(spark, sf_dir):
    d = F.col("doc_id") % 3
    label = F.when(d == 0, F.concat(F.lit("【"), "lang", F.lit("】"))).when(d == 1, F.concat("lang", F.lit("。"))).otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("no"), F.array(label).alias("codes"))
    return coding.unify_labels(rows, "codes").select("no", F.array_join("codes", "|").alias("codes"))


# de-identification: each customer is one record

N8 = "lpad((c_custkey % 100000000)::VARCHAR, 8, '0')"


def eight(c: str = "c_custkey"):
    return F.lpad((F.col(c) % 100000000).cast("string"), 8, "0")


def contacts(spark, sf_dir):
    k = eight()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(
        F.lit("身份证 110101199"), k, F.lit("X，QQ：1"), k, F.lit("，微信号 wx_"), k, F.lit("，工号 E-"), k, F.lit("\n手机 139-"), F.substring(k, 1, 4), F.lit("-"), F.substring(k, 5, 4),
        F.lit("，卡 62220212"), k, F.lit("，座机 010-"), k, F.lit("，车牌 京A"), F.substring(k, 4, 5), F.lit("，网名：n"), k, F.lit("，邮箱 u"), k, F.lit("@x.com")).alias("text"))


@query(f"""
WITH k AS (SELECT c_custkey AS doc_id, {N8} AS k FROM customer)
SELECT doc_id, '身份证' AS kind, '110101199' || k || 'X' AS value, '110101199' || k || 'X' AS key FROM k
UNION ALL SELECT doc_id, 'QQ', '1' || k, '1' || k FROM k
UNION ALL SELECT doc_id, '微信', 'wx_' || k, 'wx_' || k FROM k
UNION ALL SELECT doc_id, '编号', 'E-' || k, 'E-' || k FROM k
UNION ALL SELECT doc_id, '手机', '139-' || k[1:4] || '-' || k[5:8], '139' || k FROM k
UNION ALL SELECT doc_id, '卡号', '62220212' || k, '62220212' || k FROM k
UNION ALL SELECT doc_id, '座机', '010-' || k, '010' || k FROM k
UNION ALL SELECT doc_id, '车牌', '京A' || k[4:8], '京A' || k[4:8] FROM k
UNION ALL SELECT doc_id, '昵称', 'n' || k, 'n' || k FROM k
UNION ALL SELECT doc_id, '邮箱', 'u' || k || '@x.com', 'u' || k || '@x.com' FROM k
""")
def direct_identifiers(spark, sf_dir):
    return deident.entities(contacts(spark, sf_dir), names=False).select("doc_id", "kind", "value", "key")


def named_records(spark, sf_dir):
    """A name that a clue gives away once and that stands elsewhere without one."""
    name = F.concat(F.element_at(F.array(*map(F.lit, "王李张刘陈")), (F.col("c_custkey") % 5 + 1).cast("int")), F.element_at(F.array(F.lit("小明"), F.lit("嘉怡"), F.lit("伟")), (F.col("c_custkey") % 3 + 1).cast("int")))
    number = F.concat(F.lit("139"), eight())
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("姓名："), name, F.lit("\n时长：41 分钟\n周涛 "), number, F.lit("\n我和"), name, F.lit("一起")).alias("text"))


NAME = "(['王', '李', '张', '刘', '陈'])[(c_custkey % 5 + 1)::INT] || (['小明', '嘉怡', '伟'])[(c_custkey % 3 + 1)::INT]"


@query(f"SELECT c_custkey AS doc_id, '[姓名1]' AS placeholder, {NAME} AS value, 2::BIGINT AS n FROM customer UNION ALL SELECT c_custkey, '[姓名2]', '周涛', 1 FROM customer")
def names_in_context(spark, sf_dir):
    found = deident.entities(named_records(spark, sf_dir)).where("kind = '姓名'")
    return deident.numbered(found, ["doc_id"], ["first"]).select("doc_id", "placeholder", "value", "n")


@query("SELECT c_custkey AS doc_id, '姓名：[姓名1]' || chr(10) || '时长：41 分钟' || chr(10) || '[姓名2] [手机1]' || chr(10) || '我和[姓名1]一起' AS text FROM customer")
def names_replaced(spark, sf_dir):
    return deident.deidentify(named_records(spark, sf_dir))[0]


@query(f"SELECT c_custkey AS doc_id, '姓名' AS kind, {NAME} AS value FROM customer UNION ALL SELECT c_custkey, '手机', '139' || {N8} FROM customer")
def table_cells(spark, sf_dir):
    name = F.regexp_extract("text", "姓名：(.*)\n", 1)
    docs = named_records(spark, sf_dir).select("doc_id", F.concat(F.lit("名单\n| 姓名 | 电话 | 分数 |\n|---|---|---|\n| "), name, F.lit(" | 139"), eight("doc_id"), F.lit(" | 20000001 |\n| 合计 | - | 7 |")).alias("text"))
    return deident.table_entities(docs)


@query(f"SELECT c_custkey AS doc_id, '[姓名] [手机] ' || {N8} AS line FROM customer")
def layout_lines(spark, sf_dir):
    name = F.regexp_extract("text", "姓名：(.*)\n", 1)
    lines = named_records(spark, sf_dir).select("doc_id", F.concat(name, F.lit("，139"), eight("doc_id"), F.lit("，"), eight("doc_id")).alias("line"))
    return deident.apply_layout(lines, deident.detect_layout(["王小明，13900000001，00000001", "李嘉怡，13900000002，00000002"]))


@query(f"SELECT c_custkey AS doc_id, l.line_no, CASE l.line_no WHEN 0 THEN '姓名：[姓名]' WHEN 1 THEN '手机：[手机]' WHEN 2 THEN '备注：' || {N8} ELSE '' END AS line FROM customer, (SELECT unnest([0, 1, 2, 3]) AS line_no) l")
def layout_blocks(spark, sf_dir):
    name = F.regexp_extract("text", "姓名：(.*)\n", 1)
    lines = F.array(F.concat(F.lit("姓名："), name), F.concat(F.lit("手机：139"), eight("doc_id")), F.concat(F.lit("备注："), eight("doc_id")), F.lit(""))
    rows = named_records(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    found = deident.detect_layout(["姓名：王小明", "手机：13900000001", "备注：无", "", "姓名：李嘉怡", "手机：13900000002", "备注：无"])
    return deident.apply_layout(rows, found)


@query("SELECT kind, value, count(*) AS n, count(*) AS n_docs FROM (SELECT unnest(['年龄', '具体单位', '具体日期', '城市', '可识别特征']) AS kind, unnest([(18 + c_custkey % 60)::VARCHAR || '岁', '某某大学', '2024年' || (c_custkey % 12 + 1)::VARCHAR || '月', '杭州', '全公司只有我']) AS value FROM customer) GROUP BY 1, 2")
def quasi_identifiers(spark, sf_dir):
    age, month = (18 + F.col("c_custkey") % 60).cast("string"), (F.col("c_custkey") % 12 + 1).cast("string")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("今年"), age, F.lit("岁，某某大学，2024年"), month, F.lit("月到杭州；全公司只有我")).alias("text"))
    return deident.quasi_report(docs)


@query(f"SELECT c_custkey AS doc_id, 0 AS line_no, '139' || {N8} AS value FROM customer")
def ambiguous_mobiles(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("微信或手机 139"), eight(), F.lit("\n手机 138"), eight()).alias("text"))
    return deident.ambiguous_numbers(docs)


@query(f"SELECT c_custkey AS doc_id, '9' || {N8} || '77' AS value FROM customer")
def missed_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("代码 9"), eight(), F.lit("77，手机 139"), eight()).alias("text"))
    return deident.missed(docs)


@query("SELECT c_custkey::VARCHAR AS doc_id, '手机' AS kind, 1::BIGINT AS n FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 <> 0")
def guarded_documents(spark, sf_dir):
    k = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(F.concat(k.cast("string"), F.when(k % 2 == 0, "_脱敏").otherwise("")).alias("doc_id"), F.concat(F.lit("手机 139"), eight()).alias("text"), (k % 3 == 0).alias("seen"))
    return deident.guard(docs, acknowledged=docs.where("seen"))


@query("SELECT c_custkey AS doc_id, replace(replace(c_name, 'Customer', '客户'), '#', '') AS text FROM customer")
def custom_rules(spark, sf_dir):
    return deident.apply_rules(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text")), "Customer = 客户\n# =\n!不用管 0")


# forms: each part is a brief with a table of variables

FORM = "# 目的\n了解\n## 变量\n| 变量名 | 角色 | 层次 | 操作化 |\n|---|---|---|---|\n| "


def forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(FORM), "p_type", F.lit(" | 自变量 | 定类 | 单选：甲/乙/"), "p_brand", F.lit(" |\n| 满意 | 因变量 | 定序 | 李克特量表 |\n| 价格 | 控制 | 定比 | 数字 |\n| 原因 | 探索 | 定类 | 开放题 |")).alias("text"))


@query("SELECT p_partkey AS doc_id, unnest([p_type, '满意', '价格', '原因']) AS name, unnest(['自变量', '因变量', '控制', '探索']) AS role, unnest(['single', 'likert', 'number', 'open']) AS kind, unnest(['甲|乙|' || p_brand, NULL, NULL, NULL]) AS options FROM part")
def form_questions(spark, sf_dir):
    items = report.options(report.question_kinds(report.variable_rows(report.sections(forms(spark, sf_dir)))))
    return items.select("doc_id", "name", "role", "kind", F.array_join("options", "|").alias("options"))


@query("SELECT p_partkey AS doc_id, 4::BIGINT AS n_items, 73::BIGINT AS seconds, true AS over FROM part")
def form_time(spark, sf_dir):
    return report.fill_time(report.question_kinds(report.variable_rows(report.sections(forms(spark, sf_dir)))), 60)


WORDINGS = ("是否来过（来过/没来过/记不清）", "多选：跑步 / 游泳 / 打球", "编码为 只看不买 / 偶尔购买 / 经常购买", "如价格、味道、排队时间等", "自报居住方式：独居 / 合租 / 与家人同住", "按 0–20%、20–40%、40–60% 区间归组", "按 3 天、4 天分组后由系统算出来的一段很长很长的说明", "李克特量表")
LISTED = ("来过|没来过|记不清", "跑步|游泳|打球", "只看不买|偶尔购买|经常购买", "价格|味道|排队时间", "独居|合租|与家人同住", "0–20%|20–40%|40–60%", "3 天|4 天", None)


@query(f"SELECT p_partkey, ([{', '.join('NULL' if x is None else repr(x) for x in LISTED)}])[(p_partkey % {len(WORDINGS)} + 1)::INT] AS options FROM part")
def option_patterns(spark, sf_dir):
    how = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.col("p_partkey") % len(WORDINGS) + 1).cast("int"))
    return report.options(table(spark, sf_dir, "part").select("p_partkey", how.alias("how"))).select("p_partkey", F.array_join("options", "|").alias("options"))


@query("SELECT 'changed' AS change, p_partkey AS doc_id, '变量' AS title FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'added', p_partkey, '附' FROM part WHERE p_partkey % 3 = 1")
def form_changes(spark, sf_dir):
    old, k = forms(spark, sf_dir), F.col("doc_id") % 3
    new = old.withColumn("text", F.when(k == 0, F.replace("text", F.lit("数字"), F.lit("整数"))).when(k == 1, F.concat("text", F.lit("\n# 附\n表"))).otherwise(F.col("text")))
    return report.section_diff(old, new).select("change", "doc_id", "title")


@query("SELECT 'removed' AS change, p_partkey AS doc_id, '了解' AS line, 1::BIGINT AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'added', p_partkey, '比较', 1 FROM part WHERE p_partkey % 2 = 0")
def form_line_changes(spark, sf_dir):
    old = forms(spark, sf_dir)
    new = old.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("了解"), F.lit("比较"))).otherwise(F.col("text")))
    return report.line_diff(old, new)


# cleaning and coercion

SKIPPING = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderkey % 3 = 0 AS skipped FROM orders"


def skipping(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 4 == 0, "<不适用>").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 3 == 0, "是").otherwise("否").alias("x_跳题"))


@query(f"SELECT o_orderkey, price, status FROM ({SKIPPING}) WHERE price IS NOT NULL AND status IS NOT NULL")
def listwise_deletion(spark, sf_dir):
    marked, _ = prep.mark_skips(skipping(spark, sf_dir))
    return prep.delete_incomplete(marked, skip_aware=False)[0].select("o_orderkey", "price", "status")


@query(f"SELECT o_orderkey, price, status, skipped FROM ({SKIPPING})")
def sentinels_and_skips(spark, sf_dir):
    return prep.mark_skips(skipping(spark, sf_dir))[0].withColumnRenamed(prep.SKIPPED, "skipped")


@query(f"SELECT o_orderkey, price FROM ({SKIPPING}) WHERE price IS NOT NULL")
def pairwise_rows(spark, sf_dir):
    return prep.pairwise(skipping(spark, sf_dir), ["price"]).select("o_orderkey", "price")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 5.0 WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN 3.0 ELSE NULL END AS value FROM part")
def banded_labels(spark, sf_dir):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    label = F.when(k == 0, F.concat(size, F.lit("–"), (F.col("p_size") + 10).cast("string"), F.lit("%"))).when(k == 1, F.concat(size, F.lit(" 次及以上"))).when(k == 2, F.concat(size, F.lit("%"))).when(k == 3, "大三").otherwise("异地")
    return table(spark, sf_dir, "part").select("p_partkey", banded_number(label).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN p_retailprice END AS value FROM part")
def coerced_numbers(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(k == 1, F.col("p_retailprice").cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "part").select("p_partkey", number(text).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '—' ELSE '0.' || lpad((p_size * 100)::VARCHAR, 4, '0') END AS p FROM part")
def formatted_p(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", format_p(F.when(F.col("p_partkey") % 2 == 1, F.col("p_size") / 100.0)).alias("p"))


# statistics whose figures SQL can state

@query("""
WITH g AS (SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
SELECT a.g AS level_a, b.g AS level_b, round(a.m - b.m, 4) AS effect, round(abs(a.m - b.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS statistic FROM g a JOIN g b ON a.g < b.g, e
""")
def tukey_statistics(spark, sf_dir):
    got = compare.post_hoc(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", True)
    return got.select("level_a", "level_b", F.round("effect", 4).alias("effect"), F.round("statistic", 6).alias("statistic"))


@query("""
SELECT 'l_quantity' AS name, round(regr_slope(y, x), 4) AS b, round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)), 4) AS se, round(corr(y, x), 8) AS beta
FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)
""")
def regression_coefficient(spark, sf_dir):
    got = regress.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])["coefficients"][1]
    return spark.createDataFrame([(got["name"], round(got["b"], 4), round(got["se"], 4), round(got["beta"], 8))], "name string, b double, se double, beta double")


RESIDUALS = """
WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i, avg(o_custkey) AS m, regr_sxx(o_totalprice, o_custkey) AS sxx, count(*)::DOUBLE AS n FROM orders),
e AS (SELECT o_orderkey AS o, o_custkey AS x, o_totalprice - i - s * o_custkey AS e, 1 / n + (o_custkey - m) ** 2 / sxx AS h, n FROM orders, f)
"""


@query(RESIDUALS + ", v AS (SELECT sum(e * e) / (any_value(n) - 2) AS mse FROM e) SELECT round(any_value(n) * regr_r2(e * e, x), 6) AS bp, (SELECT count(*) FROM e, v WHERE e * e / (2 * mse) * h / (1 - h) ** 2 > 4 / n) AS n_cook FROM e")
def breusch_pagan(spark, sf_dir):
    got = regress.diagnostics(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"])
    return spark.createDataFrame([(round(float(got["bp"]), 6), got["n_cook_flag"])], "bp double, n_cook long")


@query(RESIDUALS + "SELECT round(sum((e - p) ** 2) / sum(e * e), 8) AS dw FROM (SELECT e, lag(e) OVER (ORDER BY o) AS p FROM e)")
def durbin_watson(spark, sf_dir):
    got = regress.diagnostics(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], row_order="o_orderkey")
    return numbers(spark, got, ["dw"], 8)


@query(RESIDUALS + """, v AS (SELECT sum(e * e) / (any_value(n) - 2) AS mse FROM e), k AS (SELECT o FROM e, v WHERE e * e / (2 * mse) * h / (1 - h) ** 2 > 4 / n)
SELECT (SELECT count(*) FROM k) AS n_flagged, round(regr_slope(o_totalprice, o_custkey), 6) AS b, round(regr_r2(o_totalprice, o_custkey), 8) AS r2 FROM orders ANTI JOIN k ON o_orderkey = k.o""")
def fit_without_influential(spark, sf_dir):
    got = regress.sensitivity(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"])
    return spark.createDataFrame([(got["n_flagged"], round(got["without"]["coefficients"][1]["b"], 6), round(float(got["without"]["r2"]), 8))], "n_flagged long, b double, r2 double")


@query("""
WITH c AS (SELECT (l_returnflag = 'R')::INT AS y, (l_linestatus = 'O')::INT AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT sum(n) FILTER (y = 1 AND x = 0) AS a, sum(n) FILTER (y = 0 AND x = 0) AS b, sum(n) FILTER (y = 1 AND x = 1) AS c, sum(n) FILTER (y = 0 AND x = 1) AS d FROM c)
SELECT round(ln(a / b), 6) AS b0, round(ln(c / d) - ln(a / b), 6) AS b1, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se1,
       round(2 * (a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) - (a + c) * ln((a + c) / (a + b + c + d)) - (b + d) * ln((b + d) / (a + b + c + d))), 4) AS lr FROM t
""")
def logistic_two_by_two(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linestatus") == "O").cast("double").alias("x"))
    got = regress.logistic(rows, "y", ["x"])
    a, b = got["coefficients"]
    return spark.createDataFrame([(round(a["b"], 6), round(b["b"], 6), round(b["se"], 6), round(got["lr"], 4))], "b0 double, b1 double, se1 double, lr double")


@query("""
WITH g AS (SELECT (l_linestatus = 'O') AS w, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1), v AS (SELECT avg((l_linestatus = 'O')::DOUBLE) AS m, stddev_samp((l_linestatus = 'O')::DOUBLE) AS sd FROM lineitem),
b AS (SELECT max(s) FILTER (NOT w) AS s0, max(s) FILTER (w) - max(s) FILTER (NOT w) AS d FROM g)
SELECT k AS sd, round(s0 + d * (m + k * v.sd), 6) AS slope, round(d, 6) AS interaction FROM b, v, (SELECT unnest([-1, 0, 1]) AS k)
""")
def simple_slopes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_linestatus") == "O").cast("double").alias("w"))
    got = mediate.moderation(rows, "l_quantity", "w", "l_extendedprice")
    return spark.createDataFrame([(s["sd"], round(s["slope"], 6), round(got["interaction"]["b"], 6)) for s in got["slopes"]], "sd int, slope double, interaction double")


@query("""
WITH a AS (SELECT regr_slope(l_discount, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS c, covar_samp(l_quantity, l_discount) AS xm, var_samp(l_quantity) AS xx, var_samp(l_discount) AS mm, covar_samp(l_discount, l_extendedprice) AS my, covar_samp(l_quantity, l_extendedprice) AS xy FROM lineitem)
SELECT round(a, 8) AS a, round((xx * my - xm * xy) / (xx * mm - xm * xm), 4) AS b, round(c, 4) AS c, round((mm * xy - xm * my) / (xx * mm - xm * xm), 4) AS direct FROM a
""")
def mediation_paths(spark, sf_dir):
    got = mediate.paths(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice")
    return spark.createDataFrame([(round(got["a"]["b"], 8), round(got["b"]["b"], 4), round(got["c"]["b"], 4), round(got["direct"]["b"], 4))], "a double, b double, c double, direct double")


@query("""
WITH t AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM t a, t b),
m AS (SELECT sum(n) AS n FROM t), tx AS (SELECT sum(k * (k - 1)) / 2 AS t FROM (SELECT sum(n) AS k FROM t GROUP BY x)), ty AS (SELECT sum(k * (k - 1)) / 2 AS t FROM (SELECT sum(n) AS k FROM t GROUP BY y))
SELECT round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 8) AS tau FROM p, m, tx, ty
""")
def kendall_with_ties(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return numbers(spark, kendall(pair, "x", "y"), ["tau"], 8)


CORRELATED = """
WITH c AS (SELECT count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
p AS (SELECT *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS pb, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS pc FROM c)
"""


@query(CORRELATED + """
SELECT round((a * a + b * b + c * c) / (a * a + b * b + c * c + pa * pa + pb * pb + pc * pc), 6) AS kmo, round(-(n - 1 - 11.0::DOUBLE / 6) * ln(1 + 2 * a * b * c - a * a - b * b - c * c), 3) AS bartlett, 3::DOUBLE AS df FROM p
""")
def factor_suitability(spark, sf_dir):
    g = gram(table(spark, sf_dir, "lineitem"), {c: F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount")})
    got = factor.bartlett(g.corr(), g.n)
    return numbers(spark, {"kmo": factor.kmo(g.corr())[0], "bartlett": round(got["chi2"], 3), "df": got["df"]}, ["kmo", "bartlett", "df"])


@query("""
WITH g AS (SELECT l_linenumber, avg(l_extendedprice) AS q, var_samp(l_extendedprice) / count(*) AS u FROM lineitem GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS m, avg(q) AS estimate, avg(u) AS w, var_samp(q) AS b FROM g)
SELECT round(estimate, 4) AS estimate, round(w, 4) AS within, round(b, 4) AS between, round(w + (1 + 1 / m) * b, 4) AS total, round((1 + 1 / m) * b / (w + (1 + 1 / m) * b), 6) AS lambda, round((m - 1) / ((1 + 1 / m) * b / (w + (1 + 1 / m) * b)) ** 2, 4) AS df FROM t
""")
def pooled_estimates(spark, sf_dir):
    """Each line number's mean stands for the estimate of one completed set."""
    x = F.col("l_extendedprice")
    sets = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg(x).alias("q"), (F.var_samp(x) / F.count("*")).alias("u")).collect()
    got = impute.rubin([r["q"] for r in sets], [r["u"] for r in sets])
    return numbers(spark, {k: round(float(v), 6 if k == "lambda" else 4) for k, v in got.items()}, ["estimate", "within", "between", "total", "lambda", "df"])


# tables in and out

@query("SELECT p_partkey AS id, p_name AS \"part name\", p_brand AS \"未命名\", p_type AS \"part name_2\" FROM part")
def cleaned_table(spark, sf_dir):
    raw = tables.read_table(spark, f"{sf_dir}/part.parquet", clean=False).select("p_partkey", "p_name", "p_brand", "p_type", F.lit(None).cast("string")).toDF("id", " part   name ", "  ", "part name", "empty")
    from fieldmark.operators.prep_columns import drop_all_null

    return drop_all_null(clean_columns(raw))


@query("SELECT p_partkey, p_name, p_size FROM part")
def written_table(spark, sf_dir):
    """Written twice, read back as CSV: an earlier version stays and the newest is read."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    folder = tables.shared_dir(spark)
    tables.write_table(rows.limit(0), folder, "parts")
    path = tables.write_table(rows, folder, "parts")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT 'n_orders' AS name, count(*) AS n_unique FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders")
def introspected(spark, sf_dir):
    return introspect(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n_orders"), "o_orderstatus", "o_orderpriority")).select("name", "n_unique")


@query("SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS found FROM customer")
def identifying_lines(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("电话 139"), eight())).otherwise(F.concat(F.lit("第 "), F.col("c_custkey").cast("string"), F.lit(" 位")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), coding.identifying(text).alias("found"))


@query("SELECT c_custkey AS doc_id, (c_custkey % 6) IN (0, 1, 4, 5) AS meta FROM customer")
def metadata_lines(spark, sf_dir):
    k = (F.col("c_custkey") % 6 + 1).cast("int")
    label = F.element_at(F.array(*map(F.lit, ("访谈时间", "会议地点", "受访者1", "王小明", "受访者", "张伟"))), k)
    body = F.element_at(F.array(*map(F.lit, ("下午", "食堂", "我觉得", "好的", "李雷", "41 分钟"))), k)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), coding.is_metadata(label, body).alias("meta"))


@query("SELECT conv_id, turn, unnest(CASE (conv_id + turn) % 3 WHEN 0 THEN ['我觉得好。', '后来变了！'] WHEN 1 THEN ['为什么？', '因为忙；', '没时间'] ELSE ['就这样'] END) AS text FROM conversations")
def han_sentences(spark, sf_dir):
    said_ = F.element_at(F.array(F.lit("我觉得好。后来变了！"), F.lit("为什么？因为忙；没时间"), F.lit("就这样。。")), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.regexp_replace(said_, "。。$", "").alias("text"))
    return coding.sentences(rows).select("doc_id.conv_id", "doc_id.turn", "text")


@query("SELECT doc_id, lang, source, md5(text) AS digest, length(text)::BIGINT AS n FROM documents WHERE text <> ''")
def csv_round_trip(spark, sf_dir):
    """Whole texts, line breaks and quotes in them, written as quoted CSV and read in parallel by ranges."""
    path = f"{tables.shared_dir(spark)}/documents.csv"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").where("text <> ''")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    read = tables.read_table(spark, path)
    return read.select("doc_id", "lang", "source", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query("SELECT speaker, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT role AS speaker, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM conversations) GROUP BY speaker")
def transcript_files(spark, sf_dir):
    """Turns written as text files, one folder a speaker, and read as numbered lines: no number is left out."""
    path = f"{tables.shared_dir(spark)}/turns"
    table(spark, sf_dir, "conversations").select("role", "text").write.partitionBy("role").text(path)
    lines = tables.read_transcripts(spark, path).withColumn("speaker", F.regexp_extract("path", "role=([^/]*)", 1))
    files = lines.groupBy("speaker", "path").agg(F.count("*").alias("n"), (F.max("line_no") + 1).alias("top"), F.countDistinct("line_no").alias("distinct"), F.sum(F.length("line")).alias("chars"))
    whole = files.where("n = top and n = distinct")
    return whole.groupBy("speaker").agg(F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"))


# many words at once

HELD = "SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word FROM benchmark) WHERE length(word) >= 8"


@query(f"""
WITH hits AS (SELECT word, doc_id FROM ({HELD}) w JOIN documents d ON contains(d.text, w.word)),
alone AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND length(o.word) > length(h.word) AND contains(o.word, h.word)))
SELECT word, count(*) AS n_segments FROM alone GROUP BY word
""")
def lexicon_segments(spark, sf_dir):
    """Documents by the words of the benchmark that they hold, outside longer ones."""
    lexicon = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where("length(word) >= 8")
    return coding.keyword_hits(table(spark, sf_dir, "documents"), lexicon, ["doc_id"], top=2**31 - 1).select("word", "n_segments")


#: Family names of two characters, rare ones and common ones, and what is said before each.
TOLD_NAMES = ("欧阳娜娜", "庞统", "翟天临", "张伟", "诸葛亮", "李雷")
TOLD_BY = ("我同学叫", "他姓", "我叫", "室友名叫", "我是", "大家都叫")


@query(f"SELECT c_custkey AS doc_id, ([{', '.join(repr(x) for x in TOLD_BY)}])[(c_custkey % 6 + 1)::INT] || '[姓名1]，联系[手机1]，总机13900001111。后来[姓名1]去了[QQ1]' AS text FROM customer")
def names_and_rules(spark, sf_dir):
    """Rare and long family names behind clues, beside rules: a replacement, a value of a told kind
    and one left alone."""
    k = F.col("c_custkey")
    name, clue = (F.element_at(F.array(*map(F.lit, x)), (k % 6 + 1).cast("int")) for x in (TOLD_NAMES, TOLD_BY))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(clue, name, F.lit("，电话138"), eight(), F.lit("，总机13900001111。后来"), name, F.lit("去了老地方")).alias("text"))
    return deident.deidentify(docs, rules="电话 = 联系\n!这是QQ 老地方\n!不用管 13900001111")[0]


# differences in order

NUMBERED = "SELECT doc_id, list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x, i: i::VARCHAR || ' ' || x) AS l FROM documents WHERE text IS NOT NULL"


@query(f"""
WITH t AS (SELECT doc_id, l, len(l) AS n FROM ({NUMBERED}) WHERE len(l) > 3)
SELECT 'moved' AS change, doc_id, l[1] AS line, 0 AS old_no, (n - 1)::INTEGER AS new_no FROM t
UNION ALL SELECT 'removed', doc_id, l[2], 1, -1 FROM t
UNION ALL SELECT 'added', doc_id, '+ ' || doc_id::VARCHAR, -1, 0 FROM t
""")
def text_changes(spark, sf_dir):
    """Whole texts whose lines are numbered, against themselves with one line put in front, the second
    taken out and the first moved to the end; texts of up to three lines don't change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", ordered.LINE_BREAK, -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x)).alias("l"))
    old = docs.select("doc_id", F.array_join("l", "\n").alias("text"))
    moved = F.concat(F.array(F.concat(F.lit("+ "), F.col("doc_id").cast("string"))), F.slice("l", F.lit(3), F.size("l")), F.slice("l", 1, 1))
    new = docs.select("doc_id", F.array_join(F.when(F.size("l") > 3, moved).otherwise(F.col("l")), "\n").alias("text"))
    got = ordered.ordered_diff(old, new)
    return got.select("change", "doc_id", "line", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("old_no", "new_no")])


#: Labels in the order of their places: numbers, then words by their reading.
LABELS = ("-3", "2", "10", "阿里", "北京", "广州", "上海", "张伟", "重要")


@query(f"SELECT label, (list_position([{', '.join(repr(x) for x in LABELS)}], label))::INT AS place, n FROM (SELECT ([{', '.join(repr(x) for x in LABELS)}])[(c_custkey % {len(LABELS)} + 1)::INT] AS label, count(*) AS n FROM customer GROUP BY 1)")
def label_places(spark, sf_dir):
    k = (F.col("c_custkey") % len(LABELS) + 1).cast("int")
    counts = table(spark, sf_dir, "customer").groupBy(F.element_at(F.array(*map(F.lit, LABELS)), k).alias("label")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(*label_order(F.col("label"))))  # a row for each label
    return counts.select("label", place.alias("place"), "n")


@query("""
WITH g AS (SELECT p_partkey, p_size AS s FROM part)
SELECT p_partkey, 'gap' AS fault, (s + 1)::DOUBLE AS low, (s + 2)::DOUBLE AS high FROM g
UNION ALL SELECT p_partkey, 'overlap', s + 10, s + 10 FROM g
UNION ALL SELECT p_partkey, 'gap', s + 21, s + 24 FROM g
""")
def gate_answers(spark, sf_dir):
    """Answers about an amount whose ends depend on the row: two gaps and a shared end each."""
    s = F.col("p_size")
    answers = F.array(F.format_string("%d以下", s), F.format_string("%d-%d", s + 3, s + 10), F.format_string("%d～%d", s + 10, s + 20), F.format_string("%d 及以上", s + 25), F.lit("不确定"))
    return screening.gate_faults(table(spark, sf_dir, "part").select("p_partkey", answers.alias("options")), ["p_partkey"])


@query("""
WITH r AS (
  SELECT p.a, p.b, o_orderpriority = p.a AS first, rank() OVER (PARTITION BY p.a, p.b ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY p.a, p.b, o_totalprice) - 1) / 2.0::DOUBLE AS rank
  FROM orders JOIN (SELECT x.o_orderpriority AS a, y.o_orderpriority AS b FROM (SELECT DISTINCT o_orderpriority FROM orders) x JOIN (SELECT DISTINCT o_orderpriority FROM orders) y ON x.o_orderpriority < y.o_orderpriority) p
    ON o_orderpriority IN (p.a, p.b)),
u AS (SELECT a, b, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(rank) FILTER (first) AS r1 FROM r GROUP BY 1, 2)
SELECT a AS level_a, b AS level_b, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n2), 9) AS rank_biserial FROM u
""")
def post_hoc_ranks(spark, sf_dir):
    got = compare.post_hoc(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", False)
    return got.select("level_a", "level_b", F.col("statistic").alias("u"), F.round("rank_biserial", 9).alias("rank_biserial"))
