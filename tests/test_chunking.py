"""Chunking on exact cases and by property."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunking as K

DDL = "document_id string, version int, content string"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(texts)], DDL)


def contents(df):
    return [r["content"] for r in df.orderBy("document_id", "chunk_index").collect()]


def test_fixed_windows(spark):
    assert contents(K.chunk_fixed(docs(spark, "abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij"]
    assert contents(K.chunk_fixed(docs(spark, "   ", None), 4, 1)) == []
    for size, overlap in ((0, 0), (4, -1), (4, 4)):
        with pytest.raises(ValueError):
            K.chunk_fixed(docs(spark, "x"), size, overlap)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abc 中\n", max_size=60), st.integers(2, 9), st.integers(0, 1))
def test_fixed_windows_rebuild_the_text(spark, text, size, overlap):
    parts = contents(K.chunk_fixed(docs(spark, text), size, overlap))
    rebuilt = parts[0] + "".join(p[overlap:] for p in parts[1:]) if parts else ""
    assert rebuilt == text.strip(" \n")


MARKDOWN = """intro
# 安装
## 环境要求
需要 JDK 17。
## 步骤
first
### deep
inner
# 使用
#no heading
last"""


def test_markdown_sections(spark):
    rows = K.with_parent_id(K.markdown_sections(docs(spark, MARKDOWN, "plain text"))).orderBy(
        "document_id", "section_index").collect()
    assert [(list(r["headings"]), r["body"]) for r in rows] == [
        ([], "intro"), (["安装", "环境要求"], "需要 JDK 17。"), (["安装", "步骤"], "first"),
        (["安装", "步骤", "deep"], "inner"), (["使用"], "#no heading\nlast"), ([], "plain text")]
    assert rows[1]["parent_id"] == "d0-v1-p1"


def sections_by_stack(text):
    """Plain Python: open headings as a stack."""
    path, start, found, lines = [], 0, [], text.split("\n")
    marks = [(i, re.match(r"^(#{1,6})\s+(.*)\Z", line)) for i, line in enumerate(lines)]
    for i, mark in [m for m in marks if m[1]] + [(len(lines), None)]:
        body = "\n".join(lines[start:i]).strip()
        if body:
            found.append(([title for _, title in path], body))
        if mark:
            level = len(mark.group(1))
            path = [p for p in path if p[0] < level] + [(level, mark.group(2).strip())]
            start = i + 1
    return found


def test_markdown_sections_match_a_stack(spark):
    rng = random.Random(3)
    parts = ["", "body 1", "body 2", "#no", "## ", "####### seven"]
    parts += ["#" * n + f" t{n}" for n in range(1, 7)]
    texts = ["\n".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(50)]
    texts.append("\n".join("#" * rng.randrange(1, 7) + f" t{i}\nbody {i}" for i in range(30_000)))
    found = {}
    rows = K.markdown_sections(docs(spark, *texts)).orderBy("document_id", "section_index").collect()
    for r in rows:
        found.setdefault(r["document_id"], []).append((list(r["headings"]), r["body"]))
    ids = [r["document_id"] for r in docs(spark, *texts).collect()]
    assert [found.get(i, []) for i in ids] == [sections_by_stack(t) for t in texts]


def test_sections_are_made_once(spark, capsys):
    K.markdown_sections(docs(spark, MARKDOWN)).explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_markdown_children(spark):
    children = K.chunk_markdown(docs(spark, MARKDOWN), 600, 100)
    assert "标题：安装 > 环境要求\n需要 JDK 17。" in contents(children)
    long = K.chunk_markdown(docs(spark, "# a\n一二三四五六七八九十"), 6, 1).collect()
    assert [r["content"] for r in long] == ["标题：a\n一二三四五六", "标题：a\n六七八九十"]
    assert {r["section_index"] for r in long} == {0}
    assert [r["chunk_index"] for r in long] == [0, 1]


def test_semantic_break(spark):
    rows = [("d", i, s, v) for i, (s, v) in enumerate(zip(
        ["a。", "b。", "c。", "d。"], [[1.0, 0.0], [1.0, 0.05], [0.0, 1.0], [0.0, 1.0]]))]
    sents = spark.createDataFrame(
        rows, "document_id string, sentence_index int, sentence string, embedding array<double>")
    cut = K.chunk_semantic(sents, 0.6).orderBy("chunk_index").collect()
    assert [r["content"] for r in cut] == ["a。b。", "c。d。"]


def test_identity_is_stable(spark):
    rows = K.with_chunk_identity(K.chunk_fixed(docs(spark, "same"), 10, 0))
    assert rows.first()["chunk_id"] == "d0-v1-c0-0967115f2813a354"
    assert rows.first()["chunk_id"] == rows.first()["chunk_id"]


def test_strategies_share_one_output(spark):
    rows = docs(spark, "# h\nbody", "one two", "x! y!").withColumn(
        "strategy", F.element_at(F.array(F.lit("MARKDOWN"), F.lit("?"), F.lit("SEMANTIC")),
                                 F.substring("document_id", 2, 1).cast("int") + 1))
    embed = lambda s: s.withColumn("embedding", F.array(F.lit(1.0), F.lit(random.Random(1).random())))
    children, parents = K.chunk_documents(rows, embed=embed)
    assert sorted(contents(children)) == sorted(["标题：h\nbody", "one two", "x!y!"])
    assert [r["content"] for r in parents.collect()] == ["body"]


def test_embedding_text_falls_back(spark):
    pages = docs(spark, "# h\nbody one", "# h\nfail").withColumn("strategy", F.lit("MARKDOWN"))
    children, parents = K.chunk_documents(pages)

    def prefix(prompt):
        if "fail" in prompt:
            raise ValueError("down")
        return " ctx "

    made = K.embedding_text(children, parents, pages.select("document_id", "version", "content"), prefix)
    assert sorted(r["embedding_text"] for r in made.collect()) == [
        "ctx\n标题：h\nbody one", "标题：h\nfail"]


def test_versions_stay_apart(spark):
    rows = spark.createDataFrame(
        [("d", 1, "one?red?", "SEMANTIC"), ("d", 2, "blue!two!", "SEMANTIC"), ("e", 1, "plain", "FIXED")],
        "document_id string, version int, content string, strategy string")
    embed = lambda s: s.withColumn("embedding", F.array(F.lit(1.0)))
    children, _ = K.chunk_documents(rows, embed=embed)
    got = {(r["document_id"], r["version"], r["content"]) for r in children.collect()}
    assert got == {("d", 1, "one?red?"), ("d", 2, "blue!two!"), ("e", 1, "plain")}
    pages = children.withColumn("parent_id", F.lit(None).cast("string"))
    made = K.embedding_text(pages, rows.limit(0).select(F.lit("p").alias("parent_id"), "content"),
                            rows.select("document_id", "version", "content"), lambda p: "ctx")
    assert made.count() == 3


def test_semantic_documents_need_an_embedder(spark):
    rows = spark.createDataFrame([("d", 1, "a b", "SEMANTIC")],
                                 "document_id string, version int, content string, strategy string")
    with pytest.raises(Exception, match="embedder"):
        K.chunk_documents(rows)[0].collect()


def test_rows_of_one_key_stay_apart(spark):
    rows = spark.createDataFrame(
        [("d", 1, "one?two?", "SEMANTIC"), ("d", 1, "first!second!", "SEMANTIC"), ("d", 1, "one?two?", "SEMANTIC")],
        "document_id string, version int, content string, strategy string")
    children, _ = K.chunk_documents(rows, embed=lambda s: s.withColumn("embedding", F.array(F.lit(1.0))))
    assert sorted(r["content"] for r in children.collect()) == ["first!second!", "one?two?", "one?two?"]


@pytest.mark.parametrize("size,overlap", [(600, 100), (600, 590), (7, 3), (5, 4), (3, 0)])
def test_windows_are_slices(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab\n中😀 ") for _ in range(n)) for n in (1, 2, 5, 6, 7, 8, 599, 600, 601, 1900)]
    texts = [f"x{t}x" for t in texts]
    got = {}
    for r in K.chunk_fixed(docs(spark, *texts), size, overlap).collect():
        got.setdefault(r["document_id"], {})[r["chunk_index"]] = r["content"]
    for i, t in enumerate(texts):
        step = size - overlap
        last = max(0, -(-(len(t) - size) // step))
        assert [got[f"d{i}"][j] for j in range(len(got[f"d{i}"]))] == [t[j * step:j * step + size] for j in range(last + 1)]


def test_long_documents_take_linear_time(spark):
    import time

    long = docs(spark, "0123456789 abcdé 中文 xyz\n" * 400_000)
    start = time.monotonic()
    assert K.chunk_fixed(long).agg(F.count("*"), F.max("chunk_index")).first()[0] > 15_000
    assert time.monotonic() - start < 100


def test_rows_of_a_repeated_key_are_split_without_a_pattern(spark, capsys):
    """The pattern of sentences took most of the time; the array of sentences was made thrice a row."""
    docs = spark.createDataFrame([("a", 1, "One. Two! Three", "SEMANTIC"), ("a", 1, "Other! Text", "SEMANTIC")],
                                 "document_id string, version int, content string, strategy string")
    children, _ = K.chunk_documents(docs, embed=lambda s: s.withColumn("embedding", F.array(F.lit(1.0))))
    children.filter("chunk_index >= 0").explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert "[^。" not in plan and plan.count("split(replace(") == 1
    assert sorted(r.content for r in children.collect()) == ["One. Two!Three", "Other!Text"]
