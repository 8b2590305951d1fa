"""Fixed words, patterns and weights of the question analysis; they decide results and so are kept together."""

#: Words that are no keywords.
STOP_WORDS = (
    "the", "and", "for", "are", "you", "what", "how", "this", "that", "was", "were", "with", "from", "into", "have", "has", "can", "will", "would", "should", "could",
    "where", "which", "when", "why", "all", "any", "some", "tell", "give", "show", "about", "describe", "explain",
    "什么", "怎么", "如何", "为什么", "哪个", "哪些", "请问", "告诉", "说说", "介绍", "可以", "需要", "数据", "结果",
)
FIGURE_LABEL = r"(?i)(?:fig(?:ure|\.)?|图)[ \t]*([0-9ivx]+)"
TABLE_LABEL = r"(?i)(?:table|表)[ \t]*([0-9ivx]+)"

#: Patterns that decide which kind of search a question leans to, in the order in which they are tried.
QUOTED = r"[\"'「」『』][^\"'「」『』]{2,}[\"'「」『』]"
CHEMICAL = r"(?:^|[^A-Za-z0-9_])[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*){2,}(?:[^A-Za-z0-9_]|$)"
DOI = r"(?i)(?:^|[^a-z0-9_])10\.[0-9]{4,}/[^ ]+"
LOCATED = r"(?i)(图[ ]*[0-9]|表[ ]*[0-9]|fig\.?[ ]*[0-9]|figure[ ]*[0-9]|table[ ]*[0-9]|第[ ]*[0-9]+[ ]*[页段节])"
VALUE = r"(含量|质量分数|占比|百分比|配比|成分|规格|尺寸|速率|强度|硬度|上限|下限|最大值|最小值|阈值|是多少|多少|数值|取值|参数)"
MEANING = r"(?i)(机理|机制|影响|对比|比较|差异|原理|趋势|关系|如何|为什么|mechanism|impact|effect|compare|comparison|difference|principle|trend|relationship|how|why)"

#: Dense weight by bias and stage; the lexical weight is the rest to 1.
DENSE_WEIGHT = {
    ("balanced", "progressive_l1"): 0.65, ("balanced", "progressive_l1_global"): 0.50, ("balanced", "progressive_l2"): 0.55, ("balanced", "local_l2"): 0.45, ("balanced", "simple"): 0.60,
    ("semantic", "progressive_l1"): 0.75, ("semantic", "progressive_l1_global"): 0.60, ("semantic", "progressive_l2"): 0.65, ("semantic", "local_l2"): 0.55, ("semantic", "simple"): 0.70,
    ("entity_heavy", "progressive_l1"): 0.50, ("entity_heavy", "progressive_l1_global"): 0.35, ("entity_heavy", "progressive_l2"): 0.40, ("entity_heavy", "local_l2"): 0.30, ("entity_heavy", "simple"): 0.45,
    ("keyword", "progressive_l1"): 0.55, ("keyword", "progressive_l1_global"): 0.40, ("keyword", "progressive_l2"): 0.45, ("keyword", "local_l2"): 0.35, ("keyword", "simple"): 0.50,
}
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 0.85
