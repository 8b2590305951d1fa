"""Column functions over texts that come from page layout: spacing, numbers, tables, captions, sections, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide results, in English and Chinese.
BLANKS = " \t\r\n\f"
CJK = "[一-鿿㐀-䶿、。《》「」『』！（），：；？]"
LABEL_GAP = r"[\s\u200b\u200c\u200d\ufeff\u00a0\u3000\u2060]*"
LABELS = ("摘要", "概要", "提要", "梗概", "关键词")
LATEX = ((r"\leqslant", "≤"), (r"\leq", "≤"), (r"\geqslant", "≥"), (r"\geq", "≥"), (r"\approx", "≈"), (r"\times", "×"), (r"\pm", "±"), (r"\%", "%"), (r"\small", ""))
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
ELEMENTS = {
    "C": "碳", "Si": "硅", "Mn": "锰", "P": "磷", "S": "硫", "Cu": "铜", "Ni": "镍", "Cr": "铬", "Mo": "钼", "Nb": "铌", "Ti": "钛", "V": "钒", "Al": "铝", "Als": "酸溶铝", "N": "氮", "O": "氧", "H": "氢", "B": "硼",
    "Zr": "锆", "Zn": "锌", "Mg": "镁", "Ca": "钙", "Sn": "锡", "Sb": "锑", "As": "砷", "W": "钨", "Co": "钴", "Pb": "铅", "Bi": "铋", "Fe": "铁", "Ce": "铈", "La": "镧", "Nd": "钕", "Y": "钇", "Ta": "钽", "RE": "稀土",
}
COMPOSITION = "化学成分 含量 (质量分数%) 表; 元素: "
FIGURE_REF = r"(?i)\b(?:Fig(?:ure|\.)?|图)\s*([0-9IVXivx]+)"
TABLE_REF = r"(?i)\b(?:Table|表)\s*([0-9IVXivx]+)"
CAPTION = r"(?m)^\[Caption\][ \t]*(.*)$"
SUMMARY_HEADS = (r"(?i)\babstract\b\s*[:：\-]?", r"(?i)\bsummary\b\s*[:：\-]?", r"(?i)\bexecutive\s+summary\b\s*[:：\-]?", r"摘\s*要\s*[:：\-]?", r"概\s*要\s*[:：\-]?")
SUMMARY_STOPS = (r"(?i)\bkeywords?\b\s*[:：]", r"关\s*键\s*词\s*[:：]", r"(?i)\b[0-9]+(?:\.[0-9]+)*\s+(?:introduction|background)\b", r"^\s*(?:引言|前言)\s*$")
TERMINATORS = "。！？!?…．."
TRAILING_NOISE = r"[\s\]\)\}”’」』〕\"']+$"
TRAILING_CITATION = r"\[[0-9,\s\-–—a-zA-Z]+\]\s*$"
LEADING_WORD = r"(?i)^(?:and|or|but|nor|yet|so|that|which|while|where|when|because|though|although|however|therefore|thus|then|moreover|furthermore|whereas)\b|^(?:且|并|而|但|而且|因此|因而|所以|于是|然而|然后|此外|其中|与)(?![一-鿿A-Za-z0-9_])"
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*\s+\S"
NEW_BLOCK = r"(?i)^(?:关键词|Key\s*words|收稿日期|参考文献|Abstract|摘\s*要|(?:[\(（]\s*)?(?:上接|下转)|[0-9]+[\.\)、]\s+\S)"
KEYWORD_LINE = r"(?i)^(?:关键词|Key\s*words?|关键字)\s*[:：]?"
REFERENCES_TITLE = r"(?i)^\s*(?:[0-9]+[\.、]?\s*)?(?:参\s*考\s*文\s*献|参\s*考\s*资\s*料|引用\s*文献|references?|bibliograph(?:y|ies)|literature\s+cited|cited\s+references?|works?\s+cited)(?:\s*[:：])?\s*(?:[（(]\s*略\s*[）)])?\s*$"
REFERENCES_TITLE_START = r"^\s*(?:[0-9]+[\.、]?\s*)?参\s*考\s*文\s*献"
ENTRY_START = r"^[\[［]|^[0-9]+[\.\)、]\s"
AUTHOR_START = r"^[A-Z][A-Za-z\-\s]*[A-Za-z\-],\s+[A-Z][A-Za-z\-]"  # no loop over a group: Java's would go as deep as the text is long
LIST_NUMBER = r"^[\[［]\s*[0-9]+\s*[\]］]|^[\[［]\s*[\]］]|^[0-9]+[\.\)、]\s"
CONCLUSION_START = r"^[0-9]+[）\)]\s*"
JOURNAL = r"(?i)\[J\]|\[M\]|\[D\]|\[C\]|\[EB/OL\]|Journal|Proceedings|et al\.|等\."
REFERENCE_NOISE = r"(?i)^(?:[\(（].*(?:上接|下转).*(?:页)?[\)）]|(?:上接|下转).*?(?:页)?[\)）]?|收稿日期|作者简介|参加试验|(?:编辑|编)\s|[\(（]?(?:作者单位|许编)[\)）]?)\s*$"
REFERENCE_BODY = r"(?i)^(?:Application of|Summary of|Key words|Abstract[:\s]|摘\s*要[：:\s])"
#: Paragraphs shorter than this go with their neighbour.
SHORT_CHARS = 40


def stripped(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(BLANKS))


def despaced(value: Column) -> Column:
    """Text whose letters stand apart put together: three single letters or Chinese characters and more in a row, and labels."""
    value = F.regexp_replace(value, rf"(?<={CJK}[ \t]{CJK})[ \t](?={CJK})|(?<={CJK})[ \t](?={CJK}[ \t]{CJK})", "")
    value = F.regexp_replace(value, r"(?<=\b[A-Za-z]\s{1,9}[A-Za-z])\s+(?=[A-Za-z]\b)|(?<=\b[A-Za-z])\s+(?=[A-Za-z]\s+[A-Za-z]\b)", "")
    for label in LABELS:
        value = F.regexp_replace(value, LABEL_GAP.join(label), label)
    return stripped(value)


def plain_numbers(value: Column) -> Column:
    """Text without LaTeX around numbers, and without blanks inside them."""
    value = F.regexp_replace(value, r"\\mathrm\{([^}]*)\}", "$1")
    for old, new in LATEX:
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.regexp_replace(F.replace(value, F.lit("$"), F.lit("")), r"(?<=[0-9.])[ \t]+(?=[0-9.])", "")


def table_lines(html: Column) -> Column:
    """The rows of an HTML table as lines, cells set off by bars; the basic entities are decoded."""

    def cell(inner: Column) -> Column:
        inner = F.regexp_replace(inner, "<[^>]+>", "")
        for old, new in ENTITIES:
            inner = F.replace(inner, F.lit(old), F.lit(new))
        return stripped(F.regexp_replace(inner, r"[ \t\r\n\f]+", " "))

    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), cell))
    return F.array_join(F.transform(F.filter(cells, lambda c: F.size(c) > 0), lambda c: F.array_join(c, " | ")), "\n")


def caption(content: Column) -> Column:
    """The text of the caption line; none where it stands in brackets."""
    found = stripped(F.regexp_extract(F.coalesce(content, F.lit("")), CAPTION, 1))
    return F.when(found.startswith("[") & found.endswith("]"), "").otherwise(found)


def table_html(content: Column) -> Column:
    """What follows the table's heading, up to the next heading in brackets."""
    return stripped(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)\[Table HTML\][ \t]*\n(.*?)(?:\n\[[A-Z][^\]]*\]|$)", 1))


def cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: stripped(c))


def _element(cell: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ELEMENTS.items() for x in pair)), cell)


def is_composition(line: Column, least: int = 3) -> Column:
    """Whether so many cells of a line are symbols of elements."""
    return F.size(F.filter(cells(line), lambda c: c.isin(*ELEMENTS))) >= least


def glossed(line: Column) -> Column:
    """The line with the Chinese name beside each symbol."""
    return F.array_join(F.transform(cells(line), lambda c: F.when(c.isin(*ELEMENTS), F.concat_ws(" ", c, _element(c))).otherwise(c)), " | ")


def composition_line(line: Column) -> Column:
    """What a line of symbols is about, in the words that questions have."""
    named = F.transform(F.filter(cells(line), lambda c: c.isin(*ELEMENTS)), lambda c: F.concat_ws(" ", c, _element(c)))
    return F.concat(F.lit(COMPOSITION), F.array_join(named, "、"))


def joined(parts: list[Column], most: int, between: str = "\n\n") -> Column:
    """The parts that aren't empty, set off and cut to ``most`` characters."""
    return F.substring(stripped(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), between)), 1, most)


def embedding_text(section: Column, kind: Column, content: Column, context: Column, most: int = 8000) -> Column:
    """What of a chunk its vector is made from, by type."""
    section, context, body = stripped(section), stripped(context), stripped(content)
    head, label = F.when(section != "", F.concat(F.lit("[Section] "), section)).otherwise(""), caption(content)
    named = F.when(label != "", F.concat(F.lit("[Caption] "), label)).otherwise("")
    lines = plain_numbers(table_lines(table_html(content)))
    first, rest = F.split(lines, "\n", 2)[0], F.coalesce(F.get(F.split(lines, "\n", 2), F.lit(1)), F.lit(""))
    composed = is_composition(first)
    shown = F.when(composed, F.array_join(F.filter(F.array(glossed(first), rest), lambda x: x != ""), "\n")).otherwise(lines)
    kind = F.coalesce(F.when(stripped(kind) == "", "text").otherwise(stripped(kind)), F.lit("text"))
    return (
        F.when(kind == "table", joined([head, named, F.when(composed, composition_line(first)).otherwise(""), shown, context], most))
        .when(kind == "image", joined([head, named, context], most)).when(kind == "equation", joined([head, body, context], most))
        .when(kind == "references", F.substring(body, 1, most)).otherwise(joined([head, plain_numbers(body)], most))
    )


def rerank_text(section: Column, kind: Column, content: Column, context: Column, most: int = 8000) -> Column:
    """What of a chunk a reranker reads: section, content, and the context of figures, tables and equations."""
    section, context, body, kind = stripped(section), stripped(context), stripped(content), F.lower(stripped(kind))
    head = F.when((section != "") & (kind != "references"), F.concat(F.lit("[Section] "), section)).otherwise("")
    return joined([head, body, F.when(kind.isin("table", "image", "equation"), context).otherwise("")], most)


def caption_label(text: Column, kind: Column) -> Column:
    """The label of the first figure (of images) or table that a caption names."""
    found = F.when(kind == "image", F.regexp_extract(text, FIGURE_REF, 1)).otherwise(F.regexp_extract(text, TABLE_REF, 1))
    return F.nullif(F.upper(found), F.lit(""))


def cross_references(text: Column, pattern: str) -> Column:
    """Labels that a text names, upper case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)))


def summary_body(value: Column) -> Column:
    """A summary without its heading, up to the first keywords or introduction."""
    value = stripped(value)
    for head in SUMMARY_HEADS:  # the first place alone
        value = stripped(F.regexp_replace(value, rf"(?s)\A(.*?)(?-s:{head})", "$1"))

    def clipped(text: Column) -> Column:
        cut = F.least(*(F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in SUMMARY_STOPS))
        return stripped(F.when(cut.isNotNull(), F.substring(text, F.lit(1), cut - 1)).otherwise(text))

    return F.get(F.transform(F.array(value), clipped), F.lit(0))


def is_summary_head(value: Column, chars: int = 30) -> Column:
    """Whether a text starts with a summary's heading."""
    head = despaced(F.substring(F.ltrim(value), 1, chars))
    found = F.lit(False)
    for p in SUMMARY_HEADS:
        found = found | head.rlike(("(?i)^" + p.removeprefix("(?i)")) if p.startswith("(?i)") else "^" + p)
    return found


def without_tail(value: Column) -> Column:
    """Text without the citations, brackets and quotation marks at its end."""
    value = F.rtrim(value)
    for _ in range(3):
        value = F.regexp_replace(F.regexp_replace(value, TRAILING_CITATION, ""), TRAILING_NOISE, "")
    return value


def ends_sentence(value: Column) -> Column:
    """Whether a text ends as a sentence does."""
    last = F.right(without_tail(value), F.lit(1))
    return (last != "") & F.contains(F.lit(TERMINATORS), last)


def continues(value: Column) -> Column:
    """Whether a text starts as the rest of a sentence does."""
    return F.when(value == "", True).when(value.rlike(NUMBERED), False).otherwise(value.rlike("^[a-z]") | value.rlike(LEADING_WORD))


def belong_together(before: Column, after: Column) -> Column:
    """Whether two paragraphs in a row are one that the layout has cut."""
    was, now = stripped(before), stripped(after)
    ended, numbered = ends_sentence(before), now.rlike(NUMBERED)
    value = (
        F.when((was == "") | (now == ""), False).when(was.rlike(KEYWORD_LINE), False).when(now.rlike(NEW_BLOCK), False)
        .when(was.endswith("：") | was.endswith(":"), True).when((F.length(now) < SHORT_CHARS) & ~ended & ~numbered, True)
        .when(ended | numbered, False).otherwise(continues(now) | ~now.rlike(r"^\p{Lu}"))
    )
    return F.coalesce(value, F.lit(False))


def fused(before: Column, after: Column) -> Column:
    """Two pieces of one paragraph: no blank where either side of the seam is Chinese."""
    left, right = F.rtrim(before), F.ltrim(after)
    seam = F.right(left, F.lit(1)).rlike("[一-鿿]") | F.left(right, F.lit(1)).rlike("[一-鿿]")
    return F.when(right == "", left).when(left == "", right).when(seam, F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))


def is_references_title(section: Column) -> Column:
    title = stripped(F.regexp_replace(F.coalesce(section, F.lit("")), r"\s+", " "))
    return (title != "") & (title.rlike(REFERENCES_TITLE) | title.rlike(REFERENCES_TITLE_START))


def is_entry_start(value: Column) -> Column:
    """Whether a text starts a new reference."""
    return stripped(value).rlike(f"{ENTRY_START}|{AUTHOR_START}")


def is_reference_noise(value: Column) -> Column:
    """Whether a text among references is a header, a footer or an abstract."""
    t = stripped(value)
    return (F.length(t) <= 3) | t.rlike(REFERENCE_NOISE) | t.rlike(REFERENCE_BODY) | ((F.length(t) > 350) & t.rlike(r"(?i)\bAbstract\b|摘\s*要"))


def inline_entries(value: Column) -> Column:
    """References of one paragraph apart, at each number in brackets."""
    parts = F.split(stripped(value), r"(?=[\[［]\s*[0-9]+\s*[\]］])")
    return F.filter(F.transform(parts, lambda p: stripped(p)), lambda p: p != "")


def heading_level(title: Column) -> Column:
    """How many numbers the title's number has; 1 without."""
    found = F.regexp_extract(F.coalesce(title, F.lit("")), r"^([0-9]+(?:\.[0-9]+)*)[\s.]", 1)
    return F.when(found == "", 1).otherwise(F.size(F.split(found, r"\.")))


def collection_slug(name: Column, prefix: str = "kb_") -> Column:
    """A collection's name in ASCII: with a digest of the whole name where that has other characters."""
    name = stripped(name)
    base = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), "_+", "_"), F.lit("_"))
    plain = F.when(base.startswith(prefix), base).otherwise(F.concat(F.lit(prefix), base))
    rest, digest = F.regexp_replace(base, f"^{prefix}", ""), F.left(F.sha1(name), F.lit(8))
    hashed = F.when(rest == "", F.concat(F.lit(prefix), digest)).otherwise(F.concat(F.lit(prefix), rest, F.lit("_"), digest))
    return F.left(F.when(~name.rlike(r"[^\x00-\x7F]") & (base != ""), plain).otherwise(hashed), F.lit(64))


def block_id(value: Column) -> Column:
    """The block id that an answer names, lower case; the answer itself if it names none."""
    value = F.btrim(stripped(value), F.lit("`\"'"))
    found = F.regexp_extract(value, r"(?i)\b((?:title|text|table|image|summary)_[a-z0-9]+(?:_p[0-9]+)?)\b", 1)
    return F.when(found != "", F.lower(found)).otherwise(value)


def document_title(stem: Column) -> Column:
    """A file's stem without the number that journals add at its end."""
    cleaned = stripped(F.rtrim(F.regexp_replace(stem, r"_[A-Z]{2,8}[0-9.]+$", ""), F.lit("_")))
    return F.when(cleaned == "", stem).otherwise(cleaned)


def document_stem(name: Column, most: int = 100) -> Column:
    """The document id that a file's name stands for: no folders, no suffix, no characters that file systems reserve."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.left(F.btrim(stripped(F.regexp_replace(stem, r"[\\/:*?\"<>|\x00-\x1f]", "_")), F.lit(".")), F.lit(most))


def sentences(value: Column) -> Column:
    """Sentences with their ends, at full stops of Chinese and at ! and ? alone."""
    parts = F.split(stripped(value), r"(?<=[。！？!?])\s*")
    return F.filter(F.transform(parts, lambda p: stripped(p)), lambda p: p != "")


def first_sentences(value: Column, n: int = 1) -> Column:
    return F.array_join(F.slice(sentences(value), 1, n), " ")


def last_sentences(value: Column, n: int = 1) -> Column:
    own = sentences(value)
    return F.array_join(F.slice(own, F.greatest(F.size(own) - n + 1, F.lit(1)), F.lit(n)), " ")
