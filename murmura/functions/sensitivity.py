"""Rule-based sensitivity of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, patterns and word lists that results depend on.
IDENTIFIER_WEIGHTS = {"ID": 0.82, "Phone": 0.68, "Bank": 0.78, "Money": 0.18, "Email": 0.35}
IDENTIFIERS = {
    "ID": r"(?<!\d)(?:\d{17}[\dXx]|\d{15})(?!\d)",
    "Phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "Bank": r"(?<!\d)(?:4\d{15}|5[1-5]\d{14}|62\d{14,17})(?!\d)",
    "Money": r"(?i)(\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?\s?(?:元|万元|亿元|USD|CNY|RMB|dollars)",
    "Email": r"(?U)\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
}
KEYWORD_WEIGHTS = {"PersonalStrong": 0.22, "PersonalWeak": 0.34, "CorporateStrong": 0.45, "CorporateWeak": 0.28}
KEYWORDS = {
    "PersonalStrong": "身份证号?|手机号|电话号码|银行卡号?|住址|家庭住址|病历|诊断记录",
    "PersonalWeak": "参会人员|人员名单|联系人|客户|员工|姓名|包括[一-鿿]{2,4}",
    "CorporateStrong": "内部资料|请勿外传|商业秘密|机密|保密|未公开|客户名单|源代码|研发计划|投标文件",
    "CorporateWeak": "营收目标|战略规划|成本明细|利润率|报价|预算|合同|供应商",
    "Public": "首都|人口|面积|地理|历史|百科|公开|新闻|常识|天气|城市|国家|省会",
}
HEURISTICS = {"Name": "[一-鿿]{2,3}", "Private": "会议|参会|名单|联系人|客户|员工|候选人", "Finance": "余额|收入|薪资|工资|借款|贷款|资产", "Internal": "内部|外传|保密|目标|规划|未公开"}
ENTITIES = {
    "email": r"(?U)\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "url": r"(?iU)\b(?:https?://|www\.)[^\s<>()\[\]{}\"']+",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]\d{4}(?!\d)",
}


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ideographs(text: Column) -> Column:
    """Whether any keyword or heuristic rule can match: all of them hold such a character."""
    return text.rlike("[一-鿿]")


def shows(text: Column, name: str) -> Column:
    """Whether a text holds an identifier, keyword or heuristic mark; a pattern is tried only on texts that hold what all its matches hold."""
    if name in IDENTIFIERS:
        needs = {"Email": F.contains(text, F.lit("@")), "Money": text.rlike("[0-9]")}
        return needs.get(name, text.rlike("[0-9]{11}")) & text.rlike(IDENTIFIERS[name])
    return _ideographs(text) & text.rlike(KEYWORDS.get(name, HEURISTICS.get(name)))


def identifier_score(text: Column) -> Column:
    """Each pattern is tried only on texts that hold what all its matches hold."""
    needs = {"Email": F.contains(text, F.lit("@")), "Money": text.rlike("[0-9]")}
    long_number = text.rlike("[0-9]{11}")
    found = (F.when(needs.get(k, long_number), F.lit(w) * F.regexp_count(text, F.lit(IDENTIFIERS[k]))).otherwise(F.lit(0.0)) for k, w in IDENTIFIER_WEIGHTS.items())
    return clip(sum(found, F.lit(0.0)), 0.0, 1.0)


def _present(text: Column, pattern: str, weight: float) -> Column:
    return F.when(text.rlike(pattern), F.lit(weight)).otherwise(F.lit(0.0))


def is_public(text: Column) -> Column:
    return text.rlike(KEYWORDS["Public"])


def keyword_score(text: Column) -> Column:
    return clip(sum((_present(text, KEYWORDS[k], w) for k, w in KEYWORD_WEIGHTS.items()), F.lit(0.0)), 0.0, 1.0)


def heuristic_score(text: Column) -> Column:
    meeting = text.rlike(HEURISTICS["Name"]) & text.rlike(HEURISTICS["Private"]) & ~is_public(text)
    return clip(F.when(meeting, F.lit(0.12)).otherwise(F.lit(0.0)) + _present(text, HEURISTICS["Finance"], 0.18) + _present(text, HEURISTICS["Internal"], 0.12), 0.0, 1.0)


def fused_score(text: Column, nlp: Column | None = None) -> Column:
    """Rules and a classifier's score (0 without one), in [0, 1]."""
    nlp = F.lit(0.0) if nlp is None else nlp

    def whole(identifiers: Column, words: Column) -> Column:
        rule = clip(identifiers + words.score, 0.0, 1.0)
        capped = F.when(words.public & (rule < 0.2), F.least(nlp, F.lit(0.12))).otherwise(nlp)
        return F.when(identifiers > 0.8, rule).otherwise(clip(F.lit(0.65) * rule + F.lit(0.35) * capped, 0.0, 1.0))

    known = F.struct((keyword_score(text) + heuristic_score(text)).alias("score"), is_public(text).alias("public"))
    words = F.when(_ideographs(text), known).otherwise(F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("public")))
    return _let(F.struct(identifier_score(text).alias("i"), words.alias("w")), lambda x: whole(x.i, x.w))


def raw_score(score: Column) -> Column:
    return clip(F.lit(0.1) + F.lit(9.9) * score, 0.1, 10.0)


def legacy_epsilon(score: Column) -> Column:
    return clip(F.lit(0.1) + F.lit(9.9) * F.pow(F.lit(1.0) - score, F.lit(2.2)), 0.1, 10.0)


def legacy_delta(score: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) + F.lit(0.5) * score)


def profile(text: Column, nlp: Column | None = None) -> Column:
    """Struct of score, raw_score, epsilon and delta; nlp: a classifier's score, if there is one."""
    return _let(fused_score(text, nlp), lambda s: F.struct(s.alias("score"), raw_score(s).alias("raw_score"), legacy_epsilon(s).alias("epsilon"), legacy_delta(s).alias("delta")))


def entity_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(ENTITIES[kind]))


def entity_types(text: Column, kinds: tuple[str, ...] = tuple(ENTITIES)) -> Column:
    """The kinds that a text holds; a pattern is tried only on texts that hold what all its matches hold."""
    needs = {"email": F.contains(text, F.lit("@")), "url": F.contains(text, F.lit("://")) | text.rlike(r"[wW]{3}\."), "phone": text.rlike(r"[0-9]{3}[\s.-][0-9]{4}")}
    return F.array_compact(F.array(*[F.when(needs[k] & text.rlike(ENTITIES[k]), F.lit(k)) for k in kinds]))


def redact(text: Column, kinds: tuple[str, ...] = tuple(ENTITIES)) -> Column:
    for k in kinds:
        text = F.regexp_replace(text, ENTITIES[k], " ")
    return text


def sensitive_kinds(listed: str) -> tuple[str, ...]:
    """The kinds named in a comma-separated list, in order and once each."""
    found = tuple(dict.fromkeys(x.strip().lower() for x in listed.split(",") if x.strip()))
    if not found or any(x not in ENTITIES for x in found):
        raise ValueError(f"sensitive types must be among {', '.join(ENTITIES)}")
    return found
