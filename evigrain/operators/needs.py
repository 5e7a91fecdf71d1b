"""Structured needs from request texts, all by Column expressions; every value keeps the phrases it came from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules, names and comparison words.
UNKNOWN = "未明确"
INDUSTRIES = {
    "先进装备制造": ("先进装备制造", "线缆制造", "电缆生产", "线缆在线测控", "超高压线缆"),
    "工业检测": ("工业", "探伤", "无损检测", "缺陷检测"),
    "医疗影像": ("医学成像", "医疗影像", "医疗设备", "放射诊断"),
    "公共安全": ("安检", "安全检查", "公共安全"),
    "科研仪器": ("科学仪器", "实验仪器", "科研设备"),
}
PRODUCTS = (
    "超高压线缆在线测控系统",
    "超高压电缆在线测控系统",
    "X射线探伤设备",
    "X 射线探伤设备",
    "X射线成像设备",
    "X 射线成像设备",
    "X射线探测器",
    "X 射线探测器",
    "平板探测器",
    "成像系统",
    "探测材料",
)
PRODUCT_CLAUSE = r"(?:开发|研制|生产|制造|提供)([^，。；\n]{2,40}?(?:设备|系统|装置|产品|材料|器件))"
PROBLEMS = {
    "现有探测灵敏度不足": ("灵敏度不足", "灵敏度低", "探测能力不足"),
    "材料或制备成本偏高": ("成本过高", "成本高", "降低成本"),
    "大面积制备能力不足": ("难以大面积", "无法大面积", "面积受限"),
    "器件稳定性不足": ("稳定性不足", "容易衰减", "基线漂移", "寿命短"),
    "成像分辨率不足": ("分辨率不足", "分辨率低", "图像模糊"),
    "线缆同心度在线测量能力不足": ("同心度测量能力不足", "缺少同心度在线测量"),
    "表面缺陷在线识别能力不足": ("表面缺陷识别能力不足", "缺少表面缺陷在线检测"),
}
CAPABILITIES = {
    "高灵敏度X射线探测": ("高灵敏度", "提升灵敏度", "灵敏探测"),
    "低成本材料": ("低成本", "成本可控", "降低材料成本"),
    "大面积制备": ("大面积制备", "大尺寸制备", "规模化制备"),
    "高分辨率X射线成像": ("高分辨率", "提高分辨率", "精细成像"),
    "低电压或自驱动探测": ("低电压", "低偏压", "自驱动", "无外加偏压"),
    "高稳定性探测器": ("高稳定性", "长期稳定", "降低基线漂移"),
    "柔性或曲面成像": ("柔性", "曲面成像", "可穿戴"),
    "快速响应探测": ("快速响应", "实时成像", "高速探测"),
    "超高压线缆在线同心度测量": ("同心度测量", "在线同心度控制"),
    "线缆表面缺陷智能检测": ("表面缺陷智能检测", "表面瑕疵检测", "缺陷识别"),
    "多传感器冗余监测与误差校正": ("冗余监测", "误差校正", "多电极阵列"),
}
PREFERENCES = {
    "优先支持大面积制备": ("最好可以进行大面积制备", "最好能够大面积制备", "优先大面积制备"),
    "优先采用低成本方案": ("最好低成本", "优先低成本", "成本优先"),
    "优先具备柔性适配能力": ("最好具有柔性", "优先柔性", "最好适配曲面"),
}
KEYWORDS = {
    "X射线": ("x射线", "x 射线", "x-ray"),
    "工业探伤": ("工业探伤", "工业 x 射线探伤", "探伤"),
    "探测材料": ("探测材料", "探测器材料"),
    "低成本": ("低成本", "降低成本"),
    "高灵敏度": ("高灵敏度", "提升灵敏度"),
    "大面积制备": ("大面积制备", "大尺寸制备", "规模化制备"),
    "高分辨率": ("高分辨率", "提高分辨率"),
    "低电压": ("低电压", "低偏压"),
    "自驱动": ("自驱动", "无外加偏压"),
    "柔性成像": ("柔性", "曲面成像", "可穿戴"),
}
TARGETS = (
    "最小可检测缺陷尺寸",
    "缺陷识别精度",
    "检测可靠性",
    "检测频率",
    "检测精度",
    "检测速度",
    "X射线能量",
    "灵敏度",
    "检测限",
    "分辨率",
    "成本",
    "面积",
    "尺寸",
    "厚度",
    "电压",
    "功耗",
    "响应时间",
    "温度",
    "良率",
    "寿命",
    "稳定性",
)
COMPARISONS = {
    "不超过": "<=",
    "低于": "<",
    "小于": "<",
    "以内": "<=",
    "以下": "<=",
    "至多": "<=",
    "不低于": ">=",
    "高于": ">",
    "大于": ">",
    "至少": ">=",
    "以上": ">=",
    "达到": ">=",
    "≤": "<=",
    "<": "<",
    "≥": ">=",
    ">": ">",
}
FOUNDATIONS = ("已有", "已经具备", "现有", "目前具备", "现有设备", "已有样机")
EXCLUSIONS = ("不采用", "不能使用", "不得使用", "排除", "避免使用", "禁止使用")
NUMERIC_LIMIT = r"(?:成本|温度|尺寸|厚度|电压|功耗|检测限|灵敏度)[^，。；\n]{0,20}?(?:不超过|低于|高于|至少|以内|以下|以上)[^，。；\n]{1,20}"
TEST_CONDITION = r"在[^，。；;\n]{1,40}(?:下|条件下)(?:测试|测量)?"
NOT_A_UNIT = r"(?:测试|测量|验证|实现|制备)$"
CLAUSE_ENDS = r"[，。；;\n]+"


def normalize(text: Column) -> Column:
    """Spacing only: wording and punctuation stay; null is empty."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[ \t　]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"^\s+|\s+$", "")


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, CLAUSE_ENDS), lambda c: F.trim(c)), lambda c: c != "")


def phrases(text: Column, words) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]))


def rule_hits(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """array<struct(value, phrases)> of the rules that a text meets, in their order."""
    each = [F.struct(F.lit(v).alias("value"), phrases(text, ws).alias("phrases")) for v, ws in rules.items()]
    return F.filter(F.array(*each), lambda h: F.size(h["phrases"]) > 0)


def plain_hits(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.array(v).alias("phrases")))


def industry(text: Column) -> Column:
    """struct(value, phrases): the industry with most phrases, by name where equal."""
    ranked = F.array_sort(F.transform(rule_hits(text, INDUSTRIES), lambda h: F.struct((-F.size(h["phrases"])).alias("n"), h["value"].alias("value"), h["phrases"].alias("phrases"))))
    return F.when(F.size(ranked) > 0, F.struct(ranked[0]["value"].alias("value"), ranked[0]["phrases"].alias("phrases")))


def product(text: Column) -> Column:
    low = F.lower(text)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), F.substring(text, F.locate(p.lower(), low), F.lit(len(p)))) for p in PRODUCTS])
    clause = F.nullif(F.regexp_extract(text, PRODUCT_CLAUSE, 0), F.lit(""))
    noun = F.trim(F.regexp_extract(text, PRODUCT_CLAUSE, 1))
    return F.when(named.isNotNull(), F.struct(F.regexp_replace(named, r"\s+", "").alias("value"), F.array(named).alias("phrases"))).when(
        clause.isNotNull(), F.struct(noun.alias("value"), F.array(clause).alias("phrases"))
    )


def target_metrics(text: Column) -> Column:
    """array<struct(metric_id, name, operator, value_text, unit, test_condition, raw_text)>, one a raw text."""
    words = "|".join(re.escape(w) for w in sorted(COMPARISONS, key=lambda w: (-len(w), w)))
    number = r"[±+-]?\s*\d+(?:\.\d+)?(?:\s*[×xX]\s*10\s*(?:\^\s*)?[-−]?\d+)?"
    rule = rf"({'|'.join(TARGETS)})[^，。；;\n]{{0,16}}?({words})\s*({number})\s*([^，。；;\n]{{0,24}})"
    conditions = F.transform(F.regexp_extract_all(text, F.lit(TEST_CONDITION), F.lit(0)), lambda c: F.trim(c))
    symbol = F.create_map(*[F.lit(x) for pair in COMPARISONS.items() for x in pair])
    raw = F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), lambda m: F.trim(m))
    # of equal raw texts, whatever their case and spacing, the first counts
    same = lambda m: F.regexp_replace(F.lower(m), r"\s+", "")
    folded = F.transform(raw, same)

    def one(m: Column, i: Column) -> Column:
        unit = F.trim(F.regexp_extract(m, rule, 4))
        return F.struct(
            F.format_string("TM%02d", i + 1).alias("metric_id"),
            F.regexp_extract(m, rule, 1).alias("name"),
            F.element_at(symbol, F.regexp_extract(m, rule, 2)).alias("operator"),
            F.replace(F.regexp_extract(m, rule, 3), F.lit("−"), F.lit("-")).alias("value_text"),
            F.when(unit.rlike(NOT_A_UNIT), "").otherwise(unit).alias("unit"),
            F.array_join(conditions, "；").alias("test_condition"),
            m.alias("raw_text"),
            (F.array_position(folded, same(m)) == i + 1).alias("first"),
        )

    return F.filter(F.transform(raw, one), lambda m: m["first"])


def parse(requests: DataFrame, text: str = "request_text") -> DataFrame:
    """requests with industry, product, lists of values, target_metrics, evidence, unparsed_fragments and error.

    An empty request has an error and no values; it doesn't hinder the others.
    """
    t = F.col("original_request")
    rows = requests.withColumn("original_request", normalize(F.col(text))).withColumn("error", F.when(t == "", "an empty request"))
    marked = lambda words: F.array_distinct(F.filter(clauses(t), lambda c: F.size(phrases(c, words)) > 0))
    limits = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(NUMERIC_LIMIT), F.lit(0)), lambda x: F.trim(x)))
    rows = rows.withColumns(
        {
            "_industry": industry(t),
            "_product": product(t),
            "_technical_problems": rule_hits(t, PROBLEMS),
            "_required_capabilities": rule_hits(t, CAPABILITIES),
            "_constraints": F.concat(rule_hits(t, PREFERENCES), plain_hits(limits)),
            "_keywords": rule_hits(t, KEYWORDS),
            "_existing_foundations": plain_hits(marked(FOUNDATIONS)),
            "_excluded_approaches": plain_hits(marked(EXCLUSIONS)),
            "target_metrics": target_metrics(t),
        }
    )
    fields = ("technical_problems", "required_capabilities", "constraints", "keywords", "existing_foundations", "excluded_approaches")
    tag = lambda name, hits: F.transform(hits, lambda h: F.struct(F.lit(name).alias("field"), h["value"].alias("value"), h["phrases"].alias("phrases")))
    single = lambda name: F.when(F.col(f"_{name}").isNotNull(), tag(name, F.array(f"_{name}"))).otherwise(F.array())
    targets = F.transform("target_metrics", lambda m: F.struct(F.lit("target_metrics").alias("field"), m["raw_text"].alias("value"), F.array_compact(F.array(m["raw_text"], F.nullif(m["test_condition"], F.lit("")))).alias("phrases")))
    rows = rows.withColumn("evidence_map", F.concat(targets, single("industry"), single("product"), *[tag(f, F.col(f"_{f}")) for f in fields]))
    known = F.flatten(F.transform("evidence_map", lambda e: e["phrases"]))
    unparsed = F.filter(clauses(t), lambda c: ~F.exists(known, lambda p: F.contains(F.lower(c), F.lower(p))))
    rows = rows.withColumns(
        {"industry": F.coalesce("_industry.value", F.lit(UNKNOWN)), "product": F.coalesce("_product.value", F.lit(UNKNOWN)), "unparsed_fragments": unparsed}
        | {f: F.transform(f"_{f}", lambda h: h["value"]) for f in fields}
    )
    return rows.drop("_industry", "_product", *[f"_{f}" for f in fields])


def invalid(profiles: DataFrame, key: str = "need_id") -> DataFrame:
    """(key, field, value): values without evidence, and evidence without a value. Empty for valid profiles."""
    fields = ("technical_problems", "required_capabilities", "constraints", "keywords", "existing_foundations", "excluded_approaches")
    named = lambda f: F.transform(f, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    pairs = F.concat(*[named(f) for f in fields])
    said = profiles.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    proof = profiles.select(key, F.explode("evidence_map").alias("e")).select(key, "e.field", "e.value").where(F.col("field").isin(*fields))
    return said.exceptAll(proof).union(proof.exceptAll(said))
