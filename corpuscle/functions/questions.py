"""Column functions that find pages, paragraphs, years and quoted names in questions, and clean model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of references and years, in English and Chinese.
NUMERALS = "一二三四五六七八九"
NUMBER = "[0-9一二三四五六七八九十百]+"
PAGE = rf"(?i)第\s*{NUMBER}\s*页|\bpages?\s*[0-9]+\b|\bp\.?\s*[0-9]+\b"
PARAGRAPH = rf"(?i)第\s*{NUMBER}\s*(?:自然)?段|\bparagraphs?\s*[0-9]+\b|\bpara\.?\s*[0-9]+\b"
QUOTED_NAME = r"[\"'“‘]([^\"'”’\n]{2,40})[\"'”’]"
YEAR_RANGE = r"([0-9]{4})\s*[-~到至]\s*([0-9]{4})"
SINCE_YEAR = r"(?i)(?:since|after|自|从)\s*([0-9]{4})"
BEFORE_YEAR = r"(?i)(?:before|prior to|之前)\s*([0-9]{4})"
RECENT_YEARS = r"(?i)(?:最近|近)\s*[一二三四五六七八九十百千0-9]+\s*年|(?:past|recent)\s+[0-9]+\s*years?"
ONE_YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
SENTENCE_END = r"[。！？!?；;\n]+"
GRADE = r"(?i)(?:Q[0-9]{3}[A-Za-z0-9]*|[0-9]{2}Cu[A-Za-z0-9]*|[0-9]{2}Mn[A-Za-z0-9]*|SPA[-\s]?H)"
ORDINAL = rf"第\s*{NUMBER}\s*篇"
BATCH_SCOPE = r"上面(?:的|那|这)?(?:几篇|那些|这些|文献|论文|资料|结果|列表)|上述|刚才|之前|这些(?:文献|论文|资料|篇|研究)|这几篇|那些(?:文献|论文|资料|篇)|它们|各篇|分别(?:讲|说|用|采用|使用)|上面(?:列|检索|找)(?:出|到)?的"
EXPLICIT_SCOPE = rf"{BATCH_SCOPE}|上面(?:的|那|这)?内容|前面|上一轮"
INTENTS = (r"(?i)(?:图|figure|fig\.?)\s*([0-9]+|[A-Za-z])", r"(?i)(?:表|table|tab\.?)\s*([0-9]+|[A-Za-z])", r"(?i)(?:第\s*)?[0-9]+\s*(?:页|page|p\.?)", r"(?i)参考文献|引用文献|references|bibliography|引文|\brefs\b", r"(?i)总结|汇总|概述|综述|对比|主要内容|主要贡献|summarize|overview|main")
CLAUSE = r"(?:以及|还有|并且|同时|分别|另外|再者|再讲讲|再查|再帮我|与|和|、|；|;)+\s*"
FRAMING = (
    "文献", "论文", "研究", "资料", "期刊", "文章", "学术", "报道", "著作", "有没有", "哪些", "是否存在", "是否", "请问", "查询", "检索", "查找", "寻找", "关于", "相关", "方面", "领域", "方向", "工作", "内容", "情况",
    "总结", "汇总", "对比", "概述", "盘点", "发现", "是什么", "为什么", "如何", "怎么", "多少", "怎样", "请告诉", "介绍", "说明", "讲述", "描述",
)
REFERENCES_HINT = r"(?i)参\s*考\s*文\s*献|引\s*用\s*文\s*献|引\s*用\s*的?\s*文\s*献|\bbibliograph(?:y|ies)\b|\breferences?\b|\brefs?\b|\bcited\s+(?:works?|literature)\b|引\s*文"
DOCUMENT_REF = r"(?i)(?:那篇|这篇|该|此|上面|之前)(?:的|那|这)?(?:文献|论文|文章|paper|article|document)"
LOOSE_DOCUMENT_REF = "那篇|这篇|该|此|它|这个|那个|上面|之前|上一|刚才|前面|前一"
SUMMARY_HINT = INTENTS[4]
INSTRUCTIONS = {
    "summary": "Given a research topic query, retrieve relevant paper summaries and titles that discuss this topic",
    "passage": "Given a scientific question, retrieve relevant passages from research papers that answer the question",
    "entity": "Given an entity or technical term, retrieve passages that mention this entity",
}
THINKING = r"(?is)<(?:redacted_thinking|think)\b[^>]*>.*?</think\s*>"


def number(token: Column) -> Column:
    """A number in digits or in Chinese numerals up to 99; other tokens give 0."""
    digit = lambda part, empty: F.when(part == "", empty).otherwise(F.when(F.length(part) == 1, F.instr(F.lit(NUMERALS), part)).otherwise(0))
    tens, ones = F.regexp_extract(token, "^([^十]*)十(.*)$", 1), F.regexp_extract(token, "^([^十]*)十(.*)$", 2)
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("long")).when(F.contains(token, F.lit("十")), digit(tens, 1) * 10 + digit(ones, 0)).otherwise(digit(token, 0)).cast("long")


def references(question: Column, pattern: str) -> Column:
    """Numbers of the pages or paragraphs that a question names, each once, in order."""
    found = F.regexp_extract_all(question, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda m: number(F.regexp_extract(m, NUMBER, 0))), lambda n: n >= 1))


def quoted_names(question: Column) -> Column:
    """What stands in quotation marks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(question, F.lit(QUOTED_NAME), F.lit(1)), F.trim), lambda x: x != ""))


def years(question: Column, this_year: int) -> Column:
    """The years that a question asks for, as ``from-to`` or one year: a range, since, before, the last n, a single one."""
    part = lambda pattern, group: F.nullif(F.regexp_extract(question, pattern, group), F.lit(""))
    recent = number(F.regexp_extract(F.regexp_extract(question, RECENT_YEARS, 0), NUMBER, 0))
    return F.coalesce(
        F.concat(part(YEAR_RANGE, 1), F.lit("-"), part(YEAR_RANGE, 2)), F.concat(part(SINCE_YEAR, 1), F.lit(f"-{this_year}")), F.concat(F.lit("1900-"), part(BEFORE_YEAR, 1)),
        F.when(recent > 0, F.concat((F.lit(this_year) - recent).cast("string"), F.lit(f"-{this_year}"))), part(ONE_YEAR, 1), F.lit(""),
    )


def sentence_count(value: Column) -> Column:
    """Number of sentences that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(value, F.lit("")), SENTENCE_END), lambda s: F.trim(s) != "")).cast("long")


def grades(question: Column) -> Column:
    """Steel grades that a question names, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(question, F.lit(GRADE), F.lit(0))))


def intents(question: Column) -> Column:
    """How many searches a question is, as far as its words tell; 0 if no more than one shows."""
    kinds = sum((question.rlike(p).cast("int") for p in INTENTS), F.lit(0))
    clauses = F.greatest(F.size(F.filter(F.split(question, CLAUSE), lambda p: F.trim(p) != "")) - 1, F.lit(0))
    value = F.when(kinds >= 2, kinds).when((kinds >= 1) & (clauses >= 1), kinds + clauses).when(clauses >= 2, clauses).otherwise(0)
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", 0).otherwise(value)


def content_keywords(words: Column) -> Column:
    """Keywords without those that only frame a question, each once whatever its case, in order."""
    own = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (w != "") & ~w.isin(*FRAMING))
    low = F.transform(own, lambda w: F.lower(w))
    return F.filter(own, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def instructed(question: Column, stage: Column) -> Column:
    """The question as the vector model wants it: with the task of its stage, where one is given."""
    task = F.element_at(F.create_map(*(F.lit(x) for pair in INSTRUCTIONS.items() for x in pair)), F.when(stage.isin(*INSTRUCTIONS), stage).otherwise("passage"))
    own = F.trim(F.coalesce(question, F.lit("")))
    return F.when((own == "") | F.coalesce(stage == "", F.lit(True)), own).otherwise(F.concat(F.lit("Instruct: "), task, F.lit("\nQuery:"), own))


def without_thinking(value: Column, depth: int = 8) -> Column:
    """A model's answer without its thinking blocks, nested up to ``depth``; of cut-off blocks the rest beyond the tag goes."""
    for _ in range(depth):
        value = F.regexp_replace(value, THINKING, "")
    value = F.regexp_replace(value, r"(?is)^.*?</think\s*>", "")
    return F.trim(F.regexp_replace(value, r"(?is)<(?:redacted_thinking|think)\b[^>]*>.*$", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def windows(value: Column, target: int, most: int, overlap: int) -> Column:
    """Pieces of ``most`` characters, one every ``target - overlap``."""
    step = max(1, target - overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)), F.lit(step))
    return F.filter(F.transform(starts, lambda i: F.substring(value, i, F.lit(most))), lambda x: x != "")
