"""Chunks from layout and cuts of texts, against plain Python that goes from text to text."""

from __future__ import annotations

import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.functions import layout as y, paragraphs, questions
from corpuscle.operators import segment
from corpuscle.plans import q_segment
from corpuscle.plans.queries import QUERIES


def one(spark, rows, column):
    """The column's value for each text."""
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


def test_letters_that_stand_apart_come_together(spark):
    given = ["A B S T R A C T", "Section 1. Introduction", "3.2 Phase transformation", "I am a b", "可 以 看 到 ， 耐 候 钢 和 碳 钢", "图 1 所示", "摘 ​ 要：本文", " x ", "a b c and d e f", None]
    assert one(spark, given, y.despaced(F.col("t"))) == ["ABSTRACT", "Section 1. Introduction", "3.2 Phase transformation", "I am a b", "可以看到，耐候钢和碳钢", "图 1 所示", "摘要：本文", "x", "abc and def", ""]


def test_nested_thinking_goes(spark):
    given = ["<think>a<think>b</think>c</think>answer", "x<think>open", "<think>a</think>" * 3 + "end"]
    assert one(spark, given, questions.without_thinking(F.col("t"))) == ["answer", "x", "end"]


def tail(text):
    text = text.rstrip()
    for _ in range(3):
        text = re.sub(y.TRAILING_NOISE, "", re.sub(y.TRAILING_CITATION, "", text))
    return text


def ended(text):
    return bool(tail(text)) and tail(text)[-1] in y.TERMINATORS


def together(was, now):
    now, kept = now.strip(), was.strip()
    if not now or not kept or re.search(y.KEYWORD_LINE, kept) or re.search(y.NEW_BLOCK, now):
        return False
    if kept.endswith((":", "：")):
        return True
    numbered = bool(re.search(y.NUMBERED, now))
    if len(now) < y.SHORT_CHARS and not ended(was) and not numbered:
        return True
    if ended(was) or numbered:
        return False
    return bool(re.search("^[a-z]", now) or re.search(y.LEADING_WORD, now)) or not now[0].isupper()


def joined(a, b):
    a, b = a.rstrip(), b.lstrip()
    if not a or not b:
        return a or b
    return a + b if re.search("[一-鿿]$", a) or re.search("^[一-鿿]", b) else f"{a} {b}"


def grouped(texts):
    groups: list[str] = []
    for t in texts:
        if groups and together(groups[-1], t):
            groups[-1] = joined(groups[-1], t)
        else:
            groups.append(t)
    out: list[str] = []
    for g in groups:
        if out and len(g) < y.SHORT_CHARS and not re.search(y.NEW_BLOCK, g.strip()) and (not ended(out[-1]) or len(out[-1]) < y.SHORT_CHARS):
            out[-1] = joined(out[-1], g)
        else:
            out.append(g)
    return out


def test_paragraphs_of_whole_documents_one_by_one(spark, tiny):
    metadata = re.compile(__import__("corpuscle.operators.filters", fromlist=["x"]).METADATA_LINE)
    expected = {}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        lines = [t for t in (r["text"] or "").split("\n") if t != ""] if (r["text"] or "").split("\n")[0] else (r["text"] or "").split("\n")
        first = (r["text"] or "").split("\n")[0] != ""
        body = [t for t in (lines[1:] if first else lines) if t.strip() and not (len(t) <= 120 and metadata.search(t.strip()))]
        if groups := grouped(body):
            expected[str(r["doc_id"])] = groups
    got: dict[str, list] = {}
    for r in QUERIES["paragraph_groups"](spark, tiny).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == expected


def test_short_paragraphs_join_as_they_add_up(spark):
    texts = ["Aa bb.", "Cc dd.", "Ee ff gg hh ii jj kk ll mm nn oo pp qq rr.", "Ss.", "Tt uu vv ww xx yy zz aa bb cc dd ee ff gg.", "hh ii", "Jj", "关键词: a", "and more", "1. Next", "耐候", "钢是。"]
    blank = F.lit("")
    items = spark.createDataFrame([("d", 0, i, "paragraph", t) for i, t in enumerate(texts)], "doc_id string, page int, pos int, type string, text string").withColumns({"caption": blank, "section": blank, "section_pos": F.lit(-1)})
    assert [r["text"] for r in segment.paragraphs(items).orderBy("pos").collect()] == grouped(texts)


def together_text(texts):
    return [t for _, _, _, t in paragraphs.joined((((), i, 0, t, i == 0) for i, t in enumerate(texts)))]


def test_paragraphs_are_joined_by_all_that_was_joined_before():
    long = "and so on, for as long as a line of this kind goes"
    assert together_text(["Key", "words: a; b", long]) == grouped(["Key", "words: a; b", long]) == ["Key words: a; b", long]
    assert together_text(["it ends.", ")", "[1]", '"', "The next one, long enough to stand on its own."]) == grouped(["it ends.", ")", "[1]", '"', "The next one, long enough to stand on its own."])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Aa", "bb", "the rest of a sentence that is long enough", ".", ":", "[1]", "[2, 3]", "]", "[", ")", " ", "\n", "Key", "words", "1. X", "2.1 Y", "and", "耐候", "。", "关键词", "Ends here."]), min_size=1, max_size=6).map("".join).filter(str.strip), max_size=14), st.sampled_from([4, 4096]))
def test_joining_is_as_going_text_by_text(texts, window):
    was, paragraphs.TAIL_CHARS = paragraphs.TAIL_CHARS, window
    try:
        assert together_text(texts) == grouped(texts)
    finally:
        paragraphs.TAIL_CHARS = was


def test_joining_is_linear():
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        assert len(together_text(["goes on and on [1])"] * n)) == 1
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_chunks_of_layout_files(spark):
    rows = {(r["doc_id"], r["type"], r["paragraph_index"], r["content"]): r for r in segment.chunks(segment.items(q_segment.LAYOUTS.df(spark))).collect()}
    assert len(rows) == 14 and len({r["pk"] for r in rows.values()}) == 14
    assert ("p1", "summary", 1, "we look at rust.") in rows
    assert ("p1", "text", 2, "The layer grows with time and with rain, as Fig. 1 shows.") in rows
    assert rows["p1", "equation", -1, "m = k t^n"]["context"] == "It is thin.\nwhere k is a rate!"
    assert rows["p1", "image", -1, "[Caption] Fig. 1 The $x$ layer\n[Image Path] images/a.jpg"]["label"] == "1"
    assert ("p1", "references", -1, "[6] Six of them") in rows
    assert ("p2", "summary", 1, "All is said here. Nothing more") in rows
    assert {r["section"] for r in rows.values() if r["doc_id"] == "p2"} == {"Summary", ""}


def test_empty_layouts(spark):
    files = spark.createDataFrame([("a", "[]"), ("b", None), ("c", "[[]]"), ("d", "not json")], "doc_id string, layout string")
    assert segment.chunks(segment.items(files)).count() == 0


@pytest.mark.parametrize("name,most", [("recursive_pieces", 300), ("merged_sentences", 10**9)])
def test_cuts_lose_no_character(spark, tiny, name, most):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got: dict[int, list] = {}
    for r in QUERIES[name](spark, tiny).orderBy("doc_id", "at").collect():
        assert 0 < len(r["piece"]) <= most
        got.setdefault(r["doc_id"], []).append(r["piece"])
    for i, t in texts.items():
        assert re.sub(r"\s+", "", "".join(got.get(i, []))) == re.sub(r"\s+", "", t)


def test_table_rows_and_composition(spark, tiny):
    rows = {r["id"]: r for r in QUERIES["table_lines"](spark, tiny).collect()}
    assert rows[1]["lines"] == "Steel | C | Si | Mn\nA & B | 0 . 1 | 0.2 | 1" and rows[1]["caption"] == "Table 1 Composition"
    assert rows[2]["lines"] == "P < 1 | x y" and rows[2]["caption"] == ""
    texts = {r["id"]: r["embedding_text"] for r in QUERIES["table_embedding_text"](spark, tiny).collect()}
    assert "元素: C 碳、Si 硅、Mn 锰" in texts[1] and "A & B | 0.1 | 0.2 | 1" in texts[1]
    assert texts[5].endswith("C | Si\n\ntwo only")


def test_vectors_must_fit_chunks(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "pk string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("b", [2.0])], "pk string, embedding array<double>")
    assert segment.with_vectors(chunks.where("pk = 'a'"), vectors).count() == 1
    with pytest.raises(Exception, match="vectors of b: 2"):
        segment.with_vectors(chunks, vectors).collect()
    assert q_segment.PAPERS


def test_groups_end_where_the_subject_changes(spark):
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0], [1.0, 1.0]]
    texts = ["aaaa", "bbbb", "cccc", "dddd", "e"]
    rows = spark.createDataFrame([("d", i, t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))], "doc_id string, pos int, text string, embedding array<double>")
    of = lambda **k: [r["piece"] for r in segment.semantic_pieces(rows, 6, 40, 0, **k).orderBy("at").collect()]
    assert of(share=0.99) == ["aaaa bbbb", "cccc dddd e"]
    assert of(share=0.99, overlap=4) == ["aaaa bbbb", "bbbb cccc dddd e"]
    assert of(share=0.5) == ["aaaa bbbb", "cccc dddd", "e"]


def test_short_groups_join_their_neighbours():
    every = [True] * 4
    assert segment._grouped(["aaaa", "bb", "cccc", "d"], every, 4, 8, 3) == ["aaaa", "bb cccc d"]
    assert segment._grouped(["aaaa", "bb", "cccc", "d"], every, 1, 8, 3) == ["aaaa", "bb cccc d"]
    assert segment._grouped(["aaaa", "d"], [True] * 2, 1, 8, 3) == ["aaaa d"]
    assert segment._grouped([], [], 1, 8, 3) == []


def test_vectors_are_loaded_with_their_files_and_checked(spark, tmp_path):
    from corpuscle.sources import chunks as store

    row = {"pk": "a::1", "doc_id": "a", "doc_name": "A", "chunk_id": "1", "type": "text", "section": "s", "page_start": 0, "paragraph_index": 1, "publication_year": 2000, "content": "c", "embedding": [1.0, 2.0]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a_vec.json").write_text(json.dumps([row, {**row, "pk": "a::2", "embedding": [1.0]}]))
    (tmp_path / "a_meta.json").write_text("{}")
    rows = store.load_vectors(spark, str(tmp_path))
    assert sorted(r["pk"] for r in rows.collect()) == ["a::1", "a::2"] and rows.first()["file"].endswith("deep/a_vec.json")
    assert store.checked(rows.where("pk = 'a::1'"), 2).count() == 1
    with pytest.raises(Exception, match="vector size is not 2"):
        store.checked(rows, 2).collect()
    with pytest.raises(ValueError, match="rebuild needed"):
        store.checked(rows.drop("section"))


def test_summaries_by_vectors(spark):
    nan = float("nan")
    rows = [
        ("a", 1, "s", "Abstract", [0.0, 1.0], "en"), ("a", 2, "t", "Body", [1.0, 0.0], "en"),  # the title settles it
        ("b", 1, "s", "Body", [1.0, 0.1], "en"), ("b", 2, "t", "Body", [1.0, 0.0], "en"), ("b", 3, "u", "Body", [1.0, 0.0], "en"), ("b", 4, "v", "Body", [0.0, 1.0], "en"),
        ("c", 1, "s", "Body", None, "en"), ("d", 1, "s", "Body", [1.0, 0.0], "zh"), ("e", 1, "s", None, [0.0, 0.0], "en"), ("f", 1, "s", "Body", [2.0, 0.0], None),
    ]
    sections = spark.createDataFrame(rows, "doc_id string, pos int, section string, title string, embedding array<double>, lang string")
    prototypes = spark.createDataFrame([("en", [2.0, 0.0]), (None, [1.0, 0.0]), ("zh", None)], "lang string, embedding array<double>")
    got = sorted((r["doc_id"], r["section"], r["tier"], r["score"]) for r in segment.summary_sections_by_vectors(sections, prototypes, "lang").collect())
    assert got == [("a", "s", 1, None), ("b", "t", 3, 1.0), ("b", "u", 3, 1.0), ("f", "s", 3, 1.0)]
    assert segment.summary_sections_by_vectors(sections.where("false"), prototypes, "lang").count() == 0

    vectors = spark.createDataFrame([("x", [1.0, 2.0]), ("x", [3.0, 6.0]), ("x", None), ("x", [1.0]), ("x", [nan, 1.0]), ("y", None)], "k string, embedding array<double>")
    assert {r["k"]: r["embedding"] for r in segment.mean_vectors(vectors, ["k"], 2).collect()} == {"x": [2.0, 4.0], "y": None}


def test_documents_as_layout_give_the_chunks_of_documents(spark, tiny):
    of = lambda name: sorted((r["doc_id"], r["type"], " ".join(r["content"].split())) for r in QUERIES[name](spark, tiny).collect())
    assert of("layout_chunks") == of("document_chunks")


def test_leaves_of_nested_blocks(spark):
    got = sorted((r["doc_id"], r["page"], r["block"], r["ord"], r["type"], r["text"], r["group"]) for r in segment.leaves(q_segment.TREES.df(spark), 0.5).collect())
    assert got == [("t1", 0, 2, 2, "text", "b", None), ("t1", 0, 6, 4, "figure", "f", 5), ("t1", 0, 8, 5, "imagecaption", "Fig. 1", 7), ("t1", 0, 9, 6, "image", "in", 5), ("t2", 0, 1, 1, "text", "a", None)]
